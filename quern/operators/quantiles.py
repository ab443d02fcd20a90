"""Exact quantiles without a task that holds all values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.subquery import with_row
from quern.operators.relations import ranged, with_running_total


def quantiles(df: DataFrame, keys: list[str], value: str, points: list[float], out: str = "quantiles") -> DataFrame:
    """keys and an array of the exact quantiles of a column, with linear interpolation; without keys one row.

    Nulls do not count; a group without values has no row (without keys: null). Equal values are counted before the
    shuffle, the distinct ones numbered within range partitions with their counts as weights, so that a hot group or
    a value that a third of all rows share is spread; of each group only the values at the wanted places are kept.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    own = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(value).cast("double").alias("_v"))
    counts = own.where(F.col("_v").isNotNull()).groupBy(*names, "_v").agg(F.count("*").alias("_c"))
    order = [*[F.asc(n) for n in names], F.asc("_v")]
    placed = with_running_total(ranged(counts, order), order, F.col("_c"), "_at")
    groups = placed.groupBy(*[F.col(n).alias(f"_g{n}") for n in names]).agg(F.min("_at").alias("_first"), F.sum("_c").alias("_n"))
    if keys:
        j = placed.join(groups, reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_g{n}")) for n in names]))
    else:
        j = with_row(placed, groups)
    j = j.withColumn("_at", F.col("_at") - F.col("_first"))

    def value_at(place):
        return F.max(F.when((F.col("_at") <= place) & (place < F.col("_at") + F.col("_c")), F.col("_v")))

    h = [F.lit(float(p)) * (F.col("_n") - 1) for p in points]
    ends = [e.alias(f"_{side}{i}") for i, x in enumerate(h) for side, e in (("l", value_at(F.floor(x))), ("h", value_at(F.ceil(x))))]
    found = j.groupBy(*names).agg(F.max("_n").alias("_n"), *ends)

    def between(i: int):
        low, high = F.col(f"_l{i}"), F.col(f"_h{i}")
        return F.when(low == high, low).otherwise((F.ceil(h[i]) - h[i]) * low + (h[i] - F.floor(h[i])) * high)

    none = F.col("_n").isNull()
    return found.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], F.when(~none, F.array(*[between(i) for i in range(len(points))])).alias(out))
