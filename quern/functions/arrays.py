"""Array, map and JSON scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distinct_in_order(c: Column) -> Column:
    """Distinct non-empty elements in order of first appearance."""
    return F.array_distinct(F.filter(c, lambda x: x.isNotNull() & (x.cast("string") != "")))


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def exactly(c: Column, n: int) -> Column:
    return F.coalesce(F.size(c) == n, F.lit(False))


def one_each(c: Column, values: list[str]) -> Column:
    """Whether the elements are exactly the given values, each once."""
    return F.coalesce(F.array_sort(c) == F.array(*[F.lit(v) for v in sorted(values)]), F.lit(False))


def first_where(c: Column, test) -> Column:
    """First element for which test holds; null if none."""
    return F.get(F.filter(c, test), F.lit(0))


def positive_min(c: Column) -> Column:
    """Aggregate: smallest positive value, 0 if there is none."""
    return F.coalesce(F.min(F.when(c > 0, c)), F.lit(0.0))


def json_list(c: Column) -> Column:
    """array<string> of a JSON text; empty for null and malformed text."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def json_number(c: Column, path: str, default: float = 0.0) -> Column:
    return F.coalesce(F.get_json_object(c, path).try_cast("double"), F.lit(default))


def chunk_number(row: Column, size: int) -> Column:
    """Number of the chunk of a one-based row number, from 0."""
    return F.floor((row - 1) / size).cast("int")
