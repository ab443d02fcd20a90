"""Choosing rows: best of group, first and last wins, weighted picks, quotas, splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.hashing import seeded_order, u64_mod
from quern.functions.subquery import with_row


def numbered(df: DataFrame, keys: list[str], order: list, out: str = "rn") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def best_of_group(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group in the given order."""
    return numbered(df, keys, order, "_rn").where("_rn = 1").drop("_rn")


def best_struct(df: DataFrame, keys: list[str], score: list[Column], largest: bool = True) -> DataFrame:
    """The row of each group with the largest (smallest) score, by one aggregation that combines before the shuffle.

    Scores are compared from left to right, then the row's columns, so ties have one result. For order terms of one
    direction only; `best_of_group` takes any order, and costs a sort of whole groups.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*[s.alias(f"_s{i}") for i, s in enumerate(score)], *rest)
    pick = (F.max if largest else F.min)(packed).alias("_b")
    return df.groupBy(*keys).agg(pick).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def winners_and_losers(df: DataFrame, keys: list[str], order: list, tie_on: list) -> DataFrame:
    """df with rank (1 = winner) and tied (equal to the winner in the terms of tie_on)."""
    w = Window.partitionBy(*keys)
    return df.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("tied", F.dense_rank().over(w.orderBy(*tie_on)) == 1)


def first_wins(df: DataFrame, keys: list[str], order: list) -> tuple[DataFrame, DataFrame]:
    """(first row of each key, one row with `kept` and `ignored`): insert or ignore."""
    n = numbered(df, keys, order, "_rn")
    counts = n.agg(F.count_if(F.col("_rn") == 1).alias("kept"), F.count_if(F.col("_rn") > 1).alias("ignored"))
    return n.where("_rn = 1").drop("_rn"), counts


def last_wins(df: DataFrame, keys: list[str], at: list[Column]) -> DataFrame:
    """Upsert: the row of each key that is last by `at`."""
    return best_struct(df, keys, at)


def coalesce_sources(sources: list[tuple[str, DataFrame]], keys: list[str]) -> DataFrame:
    """Rows of the first source that has the key, with `source`; sources have equal columns, a source may repeat keys.

    Of repeated keys within a source the smallest row is kept.
    """
    tagged = [df.select(F.lit(i).alias("_rank"), F.lit(name).alias("source"), *sources[0][1].columns) for i, (name, df) in enumerate(sources)]
    return best_struct(reduce(DataFrame.unionByName, tagged), keys, [F.col("_rank")], largest=False).drop("_rank")


def first_filled_source(sources: list[DataFrame]) -> DataFrame:
    """The first source that has any row at all."""
    for s in sources[:-1]:
        if not s.isEmpty():
            return s
    return sources[-1]


def weighted_pick(df: DataFrame, keys: list[str], weight: str, order: list, group_key: Column) -> DataFrame:
    """One row for each group: the first whose running weight exceeds u64(group key) mod the total weight.

    Groups in which some weight is null or the total is not positive give no row.
    """
    own = Window.partitionBy(*keys)
    run = own.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    w = df.withColumn("_run", F.sum(weight).over(run)).withColumn("_total", F.sum(weight).over(own)).withColumn("_known", F.min(F.col(weight).isNotNull()).over(own))
    w = w.where(F.col("_known") & (F.col("_total") > 0)).withColumn("_pick", u64_mod(group_key, F.col("_total").cast("decimal(20,0)")))
    return w.where((F.col("_run") > F.col("_pick")) & (F.col("_run") - F.col(weight) <= F.col("_pick"))).drop("_run", "_total", "_known", "_pick")


def hash_top_k(df: DataFrame, strata: list[str], k: int | str, key: Column, ties: list) -> DataFrame:
    """The k rows of each stratum with the smallest hash; k is a number or a column."""
    n = numbered(df.withColumn("_h", key), strata, ["_h", *ties], "_rn")
    return n.where(F.col("_rn") <= (F.lit(k) if isinstance(k, int) else F.col(k))).drop("_h", "_rn")


def apportion(counts: DataFrame, n: str, target: int, order: list, out: str = "quota") -> DataFrame:
    """counts with the largest-remainder share of target, in proportion to n.

    Never more than n; equal remainders go by `order`; a target <= 0 gives 0 to all, one beyond the sum gives n.
    counts has one row for each stratum, so the single window over it stays small.
    """
    every = Window.partitionBy()
    total = F.sum(n).over(every)
    raw = F.lit(float(max(target, 0))) * F.col(n) / F.greatest(total, F.lit(1))
    d = counts.withColumn("_t", total).withColumn("_raw", raw).withColumn("_floor", F.floor("_raw")).withColumn("_frac", F.col("_raw") - F.col("_floor"))
    d = d.withColumn("_left", F.lit(max(target, 0)) - F.sum("_floor").over(every))
    d = d.withColumn("_place", F.row_number().over(Window.orderBy(F.desc("_frac"), *order)))
    q = F.col("_floor") + F.when(F.col("_place") <= F.col("_left"), 1).otherwise(0)
    q = F.when(F.col("_t") <= target, F.col(n)).otherwise(F.least(q, F.col(n)))
    return d.withColumn(out, q.cast("bigint")).drop("_t", "_raw", "_floor", "_frac", "_left", "_place")


def stratified_slice(df: DataFrame, strata: list[str], key: Column, target: int, ties: list) -> DataFrame:
    """A deterministic sample of about target rows, apportioned over the strata, smallest hashes first."""
    quota = apportion(df.groupBy(*strata).agg(F.count("*").alias("_n")), "_n", target, [F.col(s) for s in strata], "_quota")
    return hash_top_k(df.join(F.broadcast(quota.drop("_n")), strata), strata, "_quota", key, ties).drop("_quota")


def quota_with_spill(df: DataFrame, tier: str, quotas: dict[str, int], need: int, order: list) -> DataFrame:
    """The first rows of each tier up to its quota, then the best left over up to `need` rows; column `picked_as`."""
    q = F.coalesce(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])[F.col(tier)], F.lit(0))
    n = numbered(df, [tier], order, "_rn").withColumn("_in", F.col("_rn") <= q)
    inside, rest = n.where("_in"), n.where("not _in")
    have = inside.agg(F.count("*").alias("_have"))
    best = rest.orderBy(*order).limit(need)
    spill = with_row(best.withColumn("_place", F.row_number().over(Window.orderBy(*order))), have).where(F.col("_place") <= need - F.col("_have"))
    cols = df.columns
    return inside.select(*cols, F.lit("quota").alias("picked_as")).unionByName(spill.select(*cols, F.lit("spill").alias("picked_as")))


def band_fallthrough(df: DataFrame, keys: list[str], band: Column) -> DataFrame:
    """Rows of the first non-empty band of each group; rows with a null band are in none."""
    d = df.withColumn("band", band).where(F.col("band").isNotNull())
    first = d.groupBy(*keys).agg(F.min("band").alias("band"))
    return d.join(first, [*keys, "band"])


def stratified_folds(df: DataFrame, strata: list[str], key: Column, folds: int, test_share: float = 0.0) -> DataFrame:
    """df with `fold` (0.. in hash order within the stratum) and `is_test` for round(n * test_share) rows of each stratum."""
    own = Window.partitionBy(*strata)
    d = df.withColumn("_rn", F.row_number().over(own.orderBy(key))).withColumn("_n", F.count("*").over(own))
    test = F.col("_rn") <= F.bround(F.col("_n") * test_share)
    return d.withColumn("is_test", test).withColumn("fold", ((F.col("_rn") - 1) % folds).cast("int")).drop("_rn", "_n")


def sequential_split(df: DataFrame, order: str, share: float = 0.75) -> DataFrame:
    """df with is_train for the first floor(share * n) rows in order of a unique column."""
    from quern.operators.relations import with_row_id

    d = with_row(with_row_id(df, [F.col(order)], "_id"), df.agg(F.count("*").alias("_all")))
    return d.select(*df.columns, (F.col("_id") < F.floor(F.col("_all") * share)).alias("is_train"))


def seeded_sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows in seeded hash order: a sampling operator, the limit is its feature."""
    return df.orderBy(seeded_order(F.col(key), seed), key).limit(n)


def capped_by_order(df: DataFrame, order: list, caps: list[tuple[str, int]], rest: str, out: str = "label") -> DataFrame:
    """Label by place in a global order: the first cap rows, the next cap rows, ..., the rest.

    Every row, a repeated one as well, has one place and one label; which of two rows that tie comes first is not
    defined. Rows are numbered within range partitions, so that no task sorts them all.
    """
    from quern.operators.relations import with_row_id

    bound, chain = 0, F.lit(rest)
    bounds = []
    for name, n in caps:
        bound += n
        bounds.append((name, bound))
    for name, bound in reversed(bounds):
        chain = F.when(F.col("_place") < bound, name).otherwise(chain)
    return with_row_id(df, order, "_place").withColumn(out, chain).drop("_place")


def first_per_signature(df: DataFrame, sig: str, id_column: str) -> DataFrame:
    """df with duplicate_of: the smallest id with the same signature, null for that one itself."""
    first = df.groupBy(sig).agg(F.min(id_column).alias("_first"))
    d = df.join(first, sig)
    return d.withColumn("duplicate_of", F.when(F.col(id_column) != F.col("_first"), F.col("_first"))).drop("_first")


def streaks(df: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """Runs of equal values of each key in order: keys, value, length, run (number from 1).

    A null value is a value like any other; rows that tie in the order may come in any order. Runs are found within
    range partitions of (keys, order), whatever the number of rows of a key; those at a partition's borders are then
    merged with their neighbours. What meets in one task for that is at most two partial runs of each partition.
    """
    from quern.operators.relations import ranged

    by = [*[F.asc(k) for k in keys], *order]
    kept = ranged(df, by)
    w = Window.partitionBy("_part").orderBy(*by, "_tie")
    same = F.lit(True)
    for c in (*keys, value):
        same = same & F.lag(c).over(w).eqNullSafe(F.col(c))
    fresh = F.when(same & (F.row_number().over(w) > 1), 0).otherwise(1)
    local = kept.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(w))
    local = local.groupBy("_part", "_run", *keys, value).agg(F.count("*").alias("length"))
    last = local.groupBy("_part").agg(F.max("_run").alias("_last"))
    local = local.join(F.broadcast(last), "_part")
    at_border = (F.col("_run") == 1) | (F.col("_run") == F.col("_last"))
    edge = Window.orderBy("_part", "_run")
    joined = F.lit(True)
    for c in (*keys, value):
        joined = joined & F.lag(c).over(edge).eqNullSafe(F.col(c))
    # A partition's first run goes on the last one of the partition before where keys and value are the same.
    goes_on = joined & (F.col("_run") == 1) & (F.row_number().over(edge) > 1)
    border = local.where(at_border).withColumn("_group", F.sum(F.when(goes_on, 0).otherwise(1)).over(edge))
    merged = border.groupBy("_group", *keys, value).agg(F.min(F.struct("_part", "_run")).alias("_at"), F.sum("length").alias("length"))
    inner = local.where(~at_border).select(*keys, value, F.struct("_part", "_run").alias("_at"), "length")
    runs = inner.unionByName(merged.select(*keys, value, "_at", "length"))
    numbered = numbered_within(runs, keys, [F.col("_at._part"), F.col("_at._run")], "run")
    return numbered.select(*keys, value, "length", F.col("run").cast("bigint").alias("run"))


def numbered_within(df: DataFrame, keys: list[str], order: list, out: str) -> DataFrame:
    """df with numbers from 1 within each key in an order, also of keys that hold a large part of all rows."""
    from quern.operators.relations import with_row_id

    by = with_row_id(df, [*[F.asc(k) for k in keys], *order], "_id")
    first = by.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.min("_id").alias("_first"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return by.join(first, same).select(*df.columns, (F.col("_id") - F.col("_first") + 1).alias(out))
