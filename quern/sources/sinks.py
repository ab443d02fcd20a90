"""Sinks: tables, exports, shards, resumable stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.audit import assert_unique


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def create_table(df: DataFrame, path: str, unique: list[str] | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """df written over path; a repeated key of `unique` raises before anything is written."""
    if unique:
        assert_unique(df, unique)
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Only the partitions that occur in df are written anew."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def shard_status(expected: DataFrame, built: DataFrame, shard: str) -> DataFrame:
    """shard, expected, built, complete: row counts by shard."""
    e = expected.groupBy(shard).agg(F.count("*").alias("expected"))
    b = built.groupBy(shard).agg(F.count("*").alias("built"))
    j = e.join(b, shard, "full").select(shard, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("built", F.lit(0)).alias("built"))
    return j.withColumn("complete", F.col("expected") == F.col("built"))


def stage(spark: SparkSession, root: str, name: str, signature: str, build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """(table, reused): a stage's table, built unless one of the same signature was finished before."""
    path = f"{root}/{name}-{signature[:16]}"
    done = _exists(spark, f"{path}/_SUCCESS")
    if not done:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), done


def reusable(spark: SparkSession, path: str) -> bool:
    """Whether a finished, non-empty table stands at path."""
    return _exists(spark, f"{path}/_SUCCESS") and not spark.read.parquet(path).isEmpty()


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; columns in name order, as reports of varying columns have them."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("header", "true").csv(path)


def export_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def markdown_lines(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """line_no, value: a pipe table as text lines, for small reports."""
    from pyspark.sql import Window

    spark = df.sparkSession
    head = spark.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))], "line_no int, value string")
    text = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    body = df.select((F.row_number().over(Window.orderBy(*order)) + 1).alias("line_no"), text.alias("value"))
    return head.unionByName(body)


def manifest(files: DataFrame) -> DataFrame:
    """path, bytes, sha256 of binary files (columns path, length, content)."""
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def action_plan(losers: DataFrame, mode: str, key: list[str]) -> DataFrame:
    """What to do with superseded rows: key and action ('move', 'delete' or 'none'); nothing is touched here."""
    if mode not in ("move", "delete", "none"):
        raise ValueError(f"unknown mode {mode}")
    return losers.select(*key, F.lit(mode).alias("action"))
