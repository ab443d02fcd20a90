"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quern", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC time, AQE and skew handling; on a cluster the submitter's settings win."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master).config("spark.driver.memory", os.environ.get("QUERN_DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_folder(spark: SparkSession, local_default: str = "/tmp/quern-shared") -> str:
    """The folder all executors share: spark.checkpoint.dir, or a default where it is unset (local mode)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = local_default
    return folder.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it has fewer partitions, for steps in Python; large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Workspace:
    """Tables written to the shared folder to cut lineage; they outlive any executor."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/quern/{purpose}-{uuid.uuid4().hex}"
        #: Tables that were saved and not dropped.
        self.names: list[str] = []

    def save(self, df: DataFrame, name: str) -> DataFrame:
        if name not in self.names:
            self.names.append(name)
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if name in self.names:
            self.names.remove(name)

    def clear(self) -> None:
        """Drops all that is left; for callers whose results no longer read it."""
        for name in list(self.names):
            self.drop(name)
