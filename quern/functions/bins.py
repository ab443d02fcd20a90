"""Binning and encoding. Left- and right-closed bins differ at the edges and have functions of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.subquery import with_row


def quantile_edges(df: DataFrame, column: str, n: int) -> DataFrame:
    """One row, `edges`: the n - 1 inner quantiles (exact, linear interpolation)."""
    from quern.operators.quantiles import quantiles

    return quantiles(df, [], column, [i / n for i in range(1, n)], "edges")


def left_closed_bin(v: Column, edges: Column) -> Column:
    """Count of edges <= v: a value on an edge belongs to the bin above."""
    return F.size(F.filter(edges, lambda e: e <= v))


def right_closed_bin(v: Column, edges: Column) -> Column:
    """1 + count of edges < v: a value on an edge belongs to the bin below."""
    return F.size(F.filter(edges, lambda e: e < v)) + 1


def bin_before(v: Column, edges: Column, bins: int) -> Column:
    """Count of edges < v, at most bins - 1."""
    return F.least(F.size(F.filter(edges, lambda e: e < v)), F.lit(bins - 1))


def with_bins(df: DataFrame, column: str, n: int, out: str = "bin", edges_from: DataFrame | None = None, closed: str = "left") -> DataFrame:
    """df with the quantile bin of a column; edges come from edges_from where given and are a scalar subquery."""
    edges = quantile_edges(edges_from if edges_from is not None else df, column, n)
    rule = left_closed_bin if closed == "left" else right_closed_bin
    return with_row(df, edges).withColumn(out, rule(F.col(column), F.col("edges"))).drop("edges")


def mixed_radix(codes: list[tuple[Column, int]]) -> Column:
    """One code of several: each (code, how many values it has); the first varies slowest."""
    out = F.lit(0).cast("bigint")
    for c, n in codes:
        out = out * n + c
    return out


def dense_codes(df: DataFrame, column: str, out: str) -> DataFrame:
    """(value, code): distinct values numbered from 0 in sorted order; for columns of few values."""
    from pyspark.sql import Window

    return df.select(column).where(F.col(column).isNotNull()).distinct().withColumn(out, F.row_number().over(Window.orderBy(column)) - 1)


def one_hot(column: str, values: list) -> list[Column]:
    """A 0/1 column for each known value; unknown ones have zeros throughout."""
    return [F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)).alias(f"{column}_{v}") for v in values]


def standardised(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Columns as (x - mean) / population deviation of fit_on; a constant column becomes 0."""
    stats = (fit_on if fit_on is not None else df).agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    wide = with_row(df, stats)
    for c in columns:
        wide = wide.withColumn(c, F.when(F.col(f"s_{c}") > 0, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0))
    return wide.select(*df.columns)
