"""One-row results as columns of another frame, without a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """df with the columns of a frame of at most one row (null if it has none), read as a scalar subquery."""
    row = df.withColumn("_row", one.select(F.struct(*one.columns).alias("_row")).scalar())
    return row.select(*df.columns, *[F.col("_row")[c].alias(c) for c in one.columns])
