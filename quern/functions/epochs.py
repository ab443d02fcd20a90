"""Epoch numbers: unit detection and calendar parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST_MS_2010 = 1_262_304_000_000


def epoch_to_ms(c: Column) -> Column:
    """Milliseconds of an epoch number recorded in s, ms, µs or ns, told apart by size; fractions are cut."""
    v = c.cast("bigint")
    return (
        F.when(v < 100_000_000_000, v * 1000)
        .when(v < 100_000_000_000_000, v)
        .when(v < 100_000_000_000_000_000, F.call_function("div", v, F.lit(1000)))
        .otherwise(F.call_function("div", v, F.lit(1_000_000)))
    )


def month_of_seconds(c: Column) -> Column:
    """'YYYY-MM' in UTC of epoch seconds."""
    return F.date_format(F.timestamp_seconds(c), "yyyy-MM")
