"""Validation: ordered reasons, completeness, null audits, alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_reason(rules: list[tuple[str, Column]], ok: str = "ok") -> Column:
    """Name of the first rule that holds, in order; ok if none does. A null condition does not hold."""
    return F.coalesce(*[F.when(c, name) for name, c in rules], F.lit(ok))


def reason_counts(df: DataFrame, reason: str = "reason") -> DataFrame:
    return df.groupBy(reason).agg(F.count("*").alias("n"))


def reason_examples(df: DataFrame, reason: str, key: str, n: int = 5) -> DataFrame:
    """The n smallest keys of each reason with their place: a report."""
    return df.select(reason, key, F.row_number().over(Window.partitionBy(reason).orderBy(key)).alias("place")).where(F.col("place") <= n)


def null_audit(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, nulls, rows: one scan, one aggregate for each column."""
    cols = columns or df.columns
    one = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(cols)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("nulls")) for i, c in enumerate(cols)])
    return one.select(F.explode(pairs).alias("p"), "_rows").select("p.column", "p.nulls", F.col("_rows").alias("rows"))


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df itself; raises if a key is repeated."""
    bad = duplicate_groups(df, keys).limit(5).collect()
    if bad:
        raise ValueError(f"repeated keys: {[tuple(r) for r in bad]}")
    return df


def group_flags(df: DataFrame, keys: list[str], member: str, valid: Column, unique: int, least_valid: int) -> DataFrame:
    """keys, unique_members, valid_members, has_unique, has_valid, exclude_reason of each group."""
    g = df.groupBy(*keys).agg(F.count_distinct(member).alias("unique_members"), F.count_if(valid).alias("valid_members"))
    g = g.withColumn("has_unique", F.col("unique_members") >= unique).withColumn("has_valid", F.col("valid_members") >= least_valid)
    return g.withColumn("exclude_reason", first_reason([("too_few_unique", ~F.col("has_unique")), ("too_few_valid", ~F.col("has_valid"))]))


def one_per_position(df: DataFrame, keys: list[str], side: str, position: str, sides: list, positions: list) -> DataFrame:
    """keys, complete: whether each side has each position exactly once and nothing else."""
    known = F.col(position).isin(*positions) & F.col(side).isin(*sides)
    want = len(sides) * len(positions)
    return df.groupBy(*keys).agg(
        ((F.count("*") == want) & (F.count_if(~known | F.col(side).isNull() | F.col(position).isNull()) == 0) & (F.count_distinct(side, position) == want)).alias("complete")
    )


def consistent_winner(df: DataFrame, keys: list[str], side: str, win: str) -> DataFrame:
    """keys, consistent: two sides, each with one value of win, and different ones."""
    s = df.groupBy(*keys, side).agg(F.min(F.col(win).cast("int")).alias("lo"), F.max(F.col(win).cast("int")).alias("hi"))
    return s.groupBy(*keys).agg(((F.count("*") == 2) & (F.sum(F.col("hi") - F.col("lo")) == 0) & (F.min("lo") != F.max("lo"))).alias("consistent"))


def alerts(rules: list[tuple[str, Column]]) -> Column:
    """array of the names of all rules that hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))


def numeric_rows(df: DataFrame, casts: dict[str, Column], required: list[str]) -> DataFrame:
    """df with columns cast to double (null where that fails), rows with a null in `required` left out."""
    return df.select(*df.columns, *[c.try_cast("double").alias(n) for n, c in casts.items()]).dropna(subset=required)


def within_space(df: DataFrame, bounds: dict[str, tuple[float, float]], choices: dict[str, list] | None = None) -> DataFrame:
    tests = [F.col(c).between(lo, hi) for c, (lo, hi) in bounds.items()] + [F.col(c).isin(*v) for c, v in (choices or {}).items()]
    return df.where(reduce(Column.__and__, tests))


def eligible(candidates: DataFrame, key: str, taken: list[DataFrame], owners: DataFrame, impacted: DataFrame, most: Column) -> DataFrame:
    """Candidates that are in none of `taken`, have owners, impact something, and impact nothing that fails `most`."""
    d = candidates
    for t in taken:
        d = d.join(t.select(key).distinct(), key, "left_anti")
    d = d.join(owners.select(key).distinct(), key, "left_semi").join(impacted.select(key).distinct(), key, "left_semi")
    return d.join(impacted.where(~most).select(key).distinct(), key, "left_anti")


def document_health(records: DataFrame, documents: DataFrame, key: str, members: str, least_members: int = 10) -> DataFrame:
    """key and one truth value for each check of a record against its document, and `complete` if all hold.

    records: key, members (array), created; documents: key, doc_key, members, created, load_error. Checks: the file is
    there, it loads, its id agrees, it has enough members, the member sets agree, the creation time is positive.
    """
    d = documents.select(F.col(key).alias("_k"), "doc_key", F.col(members).alias("_members"), F.col("created").alias("_created"), "load_error")
    j = records.join(d, records[key] == F.col("_k"), "left")
    own, theirs = (F.array_sort(F.array_distinct(F.col(c))) for c in (members, "_members"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    checks = {
        "file_present": F.col("_k").isNotNull(), "loaded": yes(~F.col("load_error")), "id_agrees": yes(F.col("doc_key") == F.col("_k")),
        "enough_members": yes(F.size(theirs) >= least_members), "members_agree": yes(own == theirs), "has_creation": yes(F.col("_created") > 0),
    }
    return j.select(key, *[c.alias(n) for n, c in checks.items()], reduce(Column.__and__, checks.values()).alias("complete"))
