"""Deterministic hashes for ordering, choosing and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def u64(c: Column) -> Column:
    """First eight bytes of SHA-256, big-endian, as decimal(20,0)."""
    return F.conv(F.substring(F.sha2(c.cast("string"), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def u64_order(c: Column) -> Column:
    """Text that sorts as `u64` does."""
    return F.substring(F.sha2(c.cast("string"), 256), 1, 16)


def u64_mod(c: Column, n: int | Column) -> Column:
    return F.pmod(u64(c), n if isinstance(n, Column) else F.lit(n)).cast("bigint")


def seeded_order(c: Column, seed: int | str) -> Column:
    """SHA-1 of 'seed::value': a shuffle that comes out the same everywhere."""
    return F.sha1(F.concat(F.lit(f"{seed}::"), c.cast("string")))


def fingerprint(c: Column, length: int = 12) -> Column:
    return F.substring(F.sha2(c.cast("string"), 256), 1, length)
