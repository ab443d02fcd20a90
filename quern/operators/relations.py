"""Joins, set operations and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.subquery import with_row
from quern.session import Workspace


def inner_on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys)


def without_match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left_anti")


def with_match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left_semi")


def mismatches(left: DataFrame, right: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Pairs of rows with equal keys whose column differs: keys, left_value, right_value."""
    a = left.select(*keys, F.col(column).alias("left_value"))
    b = right.select(*keys, F.col(column).alias("right_value"))
    return a.join(b, keys).where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys of the left, of the right, and of both."""
    a = left.select(key).distinct().withColumn("_l", F.lit(1))
    b = right.select(key).distinct().withColumn("_r", F.lit(1))
    j = a.join(b, key, "full")
    return j.agg(F.count("_l").alias("left_keys"), F.count("_r").alias("right_keys"), F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("both"))


def examples(df: DataFrame, key: str, n: int = 20) -> DataFrame:
    """The n smallest keys: a report."""
    return df.select(key).distinct().orderBy(key).limit(n)


def compare_sets(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """key, status: 'missing' from actual, 'extra' in it, or 'shared'; one row for each distinct key."""
    a = expected.select(key).distinct().withColumn("_e", F.lit(1))
    b = actual.select(key).distinct().withColumn("_a", F.lit(1))
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra").otherwise("shared")
    return a.join(b, key, "full").select(key, status.alias("status"))


def lookup(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, value: str, default, out: str, small: bool = False) -> DataFrame:
    """fact with a value of a dimension, default where the key is unknown. small: the dimension's size is known to be bounded."""
    d = dim.select(F.col(dim_key).alias("_k"), F.col(value).alias("_v"))
    j = fact.join(F.broadcast(d) if small else d, fact[fact_key] == F.col("_k"), "left")
    return j.select(*fact.columns, F.coalesce("_v", F.lit(default)).alias(out))


def longest_prefix(df: DataFrame, column: str, prefixes: DataFrame, prefix: str, value: str, keys: list[str]) -> DataFrame:
    """keys, value of the longest prefix that the column starts with; null where none does.

    Prefixes are cut to their lengths: one equi-join for each length that occurs, so nothing is compared pairwise.
    """
    lengths = [r[0] for r in prefixes.select(F.length(prefix)).distinct().orderBy(F.desc(F.length(prefix))).collect()]
    out = df
    for n in lengths:
        part = prefixes.where(F.length(prefix) == n).select(F.col(prefix).alias(f"_p{n}"), F.col(value).alias(f"_v{n}"))
        out = out.join(part, F.substring(F.col(column), 1, n) == F.col(f"_p{n}"), "left")
    return out.select(*keys, F.coalesce(*[F.col(f"_v{n}") for n in lengths]).alias(value))


def ranged(df: DataFrame, order: list) -> DataFrame:
    """df in range partitions of an order, numbered by `_part`, written to the shared folder.

    Range bounds come from samples, so that computing them twice could part the rows differently. Equal rows, however
    many, are spread as well: what tells them apart is their place in the input.
    """
    placed = df.withColumn("_tie", F.monotonically_increasing_id())
    parts = placed.repartitionByRange(*order, F.col("_tie")).withColumn("_part", F.spark_partition_id())
    return Workspace(df.sparkSession, "ranges").save(parts, "rows")


def with_running_total(kept: DataFrame, order: list, amount: Column, out: str) -> DataFrame:
    """`ranged` rows with the sum of an amount over all rows before them; totals of the partitions shift each one's own."""
    sizes = kept.groupBy("_part").agg(F.sum(amount).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    own = F.sum(amount).over(Window.partitionBy("_part").orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, 0)) - amount
    return kept.withColumn("_own", own).join(F.broadcast(offsets), "_part").withColumn(out, F.col("_own") + F.col("_before")).drop("_own", "_before")


def with_row_id(df: DataFrame, order: list, out: str = "row_id", start: int = 0) -> DataFrame:
    """df with numbers start.. in an order: numbered within range partitions, shifted by the sizes of those before.

    No task sees all rows, also where many rows are equal in the order. Rows that tie are numbered in any order.
    """
    numbered = with_running_total(ranged(df, order), order, F.lit(1).cast("bigint"), "_before_row")
    return numbered.select(*df.columns, (F.col("_before_row") + start).alias(out))


def shifted_pairs(df: DataFrame, row_id: str, columns: list[str], shifts: list[int]) -> DataFrame:
    """Each row beside the row k further on (around the end), for each k: columns a_*, b_*, shift."""
    n = df.agg(F.count("*").alias("_n"))
    a = with_row(df.select(F.col(row_id).alias("_i"), *[F.col(c).alias(f"a_{c}") for c in columns]), n)
    a = a.withColumn("shift", F.explode(F.array(*[F.lit(k) for k in shifts]))).withColumn("_j", F.pmod(F.col("_i") + F.col("shift"), F.col("_n")))
    b = df.select(F.col(row_id).alias("_j"), *[F.col(c).alias(f"b_{c}") for c in columns])
    return a.join(b, "_j").where(F.col("_i") != F.col("_j")).drop("_i", "_j", "_n")


def ordering_agreement(pairs: DataFrame, truth: str, predicted: str, thresholds: list[float]) -> DataFrame:
    """min_gap, pairs, accuracy of pairs whose true values differ by at least min_gap; equal predictions count half."""
    gap = F.col(f"a_{truth}") - F.col(f"b_{truth}")
    guess = F.col(f"a_{predicted}") - F.col(f"b_{predicted}")
    score = F.when(guess == 0, 0.5).when(F.signum(guess) == F.signum(gap), 1.0).otherwise(0.0)
    d = pairs.where(gap != 0).select(F.abs(gap).alias("gap"), score.alias("score"))
    d = d.withColumn("min_gap", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).where(F.col("gap") >= F.col("min_gap"))
    return d.groupBy("min_gap").agg(F.count("*").alias("pairs"), F.avg("score").alias("accuracy"))


def children_of(parents: DataFrame, children: DataFrame, key: str, child: str) -> DataFrame:
    """parents with distinct_children, children counts and the sorted child set; 0 and empty where there are none."""
    kids = children.groupBy(key).agg(F.count("*").alias("children"), F.array_sort(F.collect_set(child)).alias("child_set"))
    j = parents.join(kids, key, "left")
    empty = F.array().cast(kids.schema["child_set"].dataType)
    return j.select(*parents.columns, F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("child_set", empty).alias("child_set")).withColumn("distinct_children", F.size("child_set"))


def delete_cascade(parent: DataFrame, child: DataFrame, key: str, doomed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parent left, child left, one row with parent_deleted and child_deleted) after removing doomed keys from both."""
    gone = doomed.select(key).distinct()
    pc = parent.join(gone, key, "left_semi").agg(F.count("*").alias("parent_deleted"))
    cc = child.join(gone, key, "left_semi").agg(F.count("*").alias("child_deleted"))
    return parent.join(gone, key, "left_anti"), child.join(gone, key, "left_anti"), with_row(pc, cc)


def edges_of(sources: list[DataFrame]) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out.distinct()


def equal_sets(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def correlated_count(outer: DataFrame, inner: DataFrame, key: str, counted: Column, out: str) -> DataFrame:
    """outer with the number of distinct values in inner for its key, 0 if none."""
    n = inner.groupBy(key).agg(F.count_distinct(counted).alias(out))
    return outer.join(n, key, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def replace_children(children: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """children with the whole set of a parent's children replaced for every parent that occurs in updates."""
    return children.join(updates.select(key).distinct(), key, "left_anti").unionByName(updates)


def alignment(left: DataFrame, right: DataFrame, key: str, column: str, tolerance: float = 1e-9) -> DataFrame:
    """One row: rows on either side without a partner, and partners whose column differs by more than tolerance."""
    a, b = left.select(key, F.col(column).alias("_a")), right.select(key, F.col(column).alias("_b"))
    j = a.withColumn("_l", F.lit(1)).join(b.withColumn("_r", F.lit(1)), key, "full")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return j.agg(
        F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"),
        F.count_if(both & ~(F.coalesce(F.abs(F.col("_a") - F.col("_b")) <= tolerance, F.lit(False)) | (F.col("_a").isNull() & F.col("_b").isNull()))).alias("differing"),
    )


def candidate_scores(owners: DataFrame, impact: DataFrame, candidate: str, owner: str, score: str, place: str, recency: str) -> DataFrame:
    """candidate, score, first_seen, rank: impact summed over a candidate's owners.

    Ties go by where a walk over the owners in order of `place`, each with its candidates most recent first, sees the
    candidate first. impact has owner, score and place; owners has candidate, owner and recency.
    """
    own = owners.select(candidate, owner, recency).distinct()
    j = own.join(impact.select(owner, score, place), owner)
    seen = F.min(F.struct(F.col(place), (-F.col(recency)).alias("r"), F.col(candidate).alias("c")))
    g = j.groupBy(candidate).agg(F.sum(score).alias("score"), seen.alias("first_seen"))
    ranked = with_row_id(g, [F.desc("score"), F.asc("first_seen")], "rank", 1)
    return ranked.select(candidate, "score", F.col(f"first_seen.{place}").alias("first_seen"), F.col("rank").cast("int").alias("rank"))


def less_group_mean(df: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """df with value less its group's mean, for groups as few as can be sent to every task: aggregated, then joined.

    Rows of a null group have their own mean.
    """
    means = df.groupBy(F.col(group).alias("_g")).agg(F.avg(value).alias("_m"))
    return df.join(means, F.col(group).eqNullSafe(F.col("_g"))).withColumn(out, F.col(value) - F.col("_m")).drop("_g", "_m")
