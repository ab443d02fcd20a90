from pyspark.sql import functions as F

from quern.operators.choosing import last_wins
from quern.streaming.streams import drain, event_stream, file_stream, job_states, sessions, upsert_each_batch
from tests.conftest import rows


def test_upsert_over_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    a = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "k string, t int, v string")
    b = spark.createDataFrame([("a", 3, "z"), ("b", 4, "old")], "k string, t int, v string")
    a.coalesce(1).write.mode("append").parquet(src)
    b.coalesce(1).write.mode("append").parquet(src)
    q = upsert_each_batch(file_stream(spark, src, a.schema, 1), str(tmp_path / "out"), ["k"], "t", str(tmp_path / "cp"))
    q.awaitTermination()
    last = spark.read.parquet(str(tmp_path / "out" / f"v{q.lastProgress['batchId']}"))
    assert rows(last) == rows(last_wins(a.union(b), ["k"], [F.col("t")])) == [("a", 3, "z"), ("b", 5, "y")]
    q = upsert_each_batch(file_stream(spark, src, a.schema, 1), str(tmp_path / "out"), ["k"], "t", str(tmp_path / "cp"))
    q.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out" / "v1"))) == rows(last)


def test_job_states_as_a_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    d = spark.createDataFrame([("a", "2024-01-01 00:00:00", "running"), ("a", "2024-01-01 00:01:00", "done")], "k string, ts string, s string").withColumn("ts", F.col("ts").cast("timestamp"))
    d.write.parquet(src)
    q = job_states(file_stream(spark, src, d.schema), "k", "s", "running").writeStream.format("memory").queryName("states").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("states")) == [("a", "done", 1)]


def _events(spark, rows):
    return spark.createDataFrame(rows, "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1)


def test_complete_result_is_whole_and_never_meets_in_the_driver(spark, tmp_path):
    src = str(tmp_path / "in")
    a = _events(spark, [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 05:00:00"), (2, "2024-01-01 01:00:00")])
    b = _events(spark, [(1, "2024-01-01 10:00:00"), (3, "2024-01-01 02:00:00")])
    a.write.mode("append").parquet(src)
    b.write.mode("append").parquet(src)
    d = drain(sessions(file_stream(spark, src, a.schema, 1).withWatermark("ts", "10 minutes"), "6 hours", ["user_id"]), str(tmp_path / "work-all"), "complete")
    assert rows(d) == rows(sessions(a.union(b), "6 hours", ["user_id"])) and sorted(d.select("user_id", "events").collect()) == [(1, 3), (2, 1), (3, 1)]
    # its rows are files, not a table in the driver's memory
    assert d.inputFiles() and all(str(tmp_path / "work-all") in f for f in d.inputFiles())


def test_complete_result_of_no_files_is_empty(spark, tmp_path):
    (tmp_path / "in").mkdir()
    e = file_stream(spark, str(tmp_path / "in"), "user_id long, ts timestamp").withWatermark("ts", "10 minutes")
    assert rows(drain(sessions(e, "6 hours", ["user_id"]), str(tmp_path / "work-none"), "complete")) == []


def test_a_table_of_several_files_or_one_is_streamed_whole(spark, tmp_path):
    e = _events(spark, [(k % 3, f"2024-01-01 0{k}:00:00") for k in range(9)])
    e.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    (tmp_path / "single").mkdir()
    e.toPandas().to_parquet(tmp_path / "single" / "events.parquet", index=False, coerce_timestamps="us", allow_truncated_timestamps=True)
    for n, folder in enumerate((tmp_path, tmp_path / "single")):
        stream = event_stream(spark, str(folder)).select("user_id", "ts")
        assert drain(stream, str(tmp_path / f"work{n}")).count() == 9
