"""Structured Streaming forms of the stateful and windowed computations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.sinks import _exists
from quern.sources.tables import table


def file_stream(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(per_trigger)).parquet(path)


def event_stream(spark: SparkSession, folder: str, name: str = "events", watermark: str = "10 minutes") -> DataFrame:
    """A table, one file or a folder of them, as a stream, its `ts` as a UTC timestamp with a watermark."""
    schema = table(spark, folder, name).schema
    raw = spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")  # a pattern, as a stream's plain path must be a folder
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def drain(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there into parquet under folder; gives the result.

    In complete mode every batch writes the whole result over the one before, so that no result meets in the driver.
    """
    spark, out = df.sparkSession, f"{folder}/out"
    w = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True)
    if mode == "append":
        w = w.format("parquet").option("path", out)
    else:
        w = w.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
    w.start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out) if _exists(spark, out) else spark.createDataFrame([], df.schema)


def tumbling(e: DataFrame, width: str, keys: list[str], value: str, slide: str | None = None) -> DataFrame:
    g = e.groupBy(F.window("ts", width, slide or width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(e: DataFrame, gap: str, keys: list[str]) -> DataFrame:
    """Sessions that end `gap` after their last event, as session windows have them."""
    g = e.groupBy(F.session_window("ts", gap), *keys).agg(F.count("*").alias("events"))
    return g.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def distinct_events(e: DataFrame, keys: list[str]) -> DataFrame:
    return e.dropDuplicatesWithinWatermark(keys)


def with_dimension(e: DataFrame, dim: DataFrame, left: str, right: str) -> DataFrame:
    return e.join(dim, e[left] == dim[right], "left")


def job_states(e: DataFrame, key: str, status: str, running: str) -> DataFrame:
    """Latest status and attempts of each key, updated with every trigger (complete or update mode)."""
    return e.groupBy(key).agg(F.max_by(status, "ts").alias("status"), F.count_if(F.col(status) == running).alias("attempts"))


def upsert_each_batch(df: DataFrame, path: str, keys: list[str], order: str, checkpoint: str):
    """Started query that keeps the last row of each key in versions of a table at path: `path/v<batch>`.

    A batch that runs again after a failure writes the same version again, so every row counts exactly once.
    """
    from quern.operators.choosing import last_wins

    spark = df.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        old = spark.read.parquet(f"{path}/v{number - 1}") if number else None
        every = batch if old is None else old.unionByName(batch)
        last_wins(every, keys, [F.col(order)]).write.mode("overwrite").parquet(f"{path}/v{number}")

    return df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
