"""Best representative of each duplicate group, field by field or as a whole record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.ids import clean_bundle, clean_match_id


def survive_fields(rows: DataFrame, keys: list[str], fields: list[str], priority: list[Column], at: Column, smallest: bool = False, also: tuple[Column, ...] = ()) -> DataFrame:
    """One record for each group of keys; each field comes from the best row that has it.

    One aggregation: for each field the maximum of the struct (non-null, *priority, at, value). priority columns
    count high before low, a null as lowest; at last the larger value wins (the smaller one with `smallest`, which
    takes numeric priorities), so ties and repeated rows have one result. A field that is null in the whole group is
    null; a field may be a struct, whose parts then stay together. Rows with a null key are a group of their own, as
    in any grouping. The maximum is combined before the shuffle: a hot group costs one row for each task. An empty
    input gives an empty result; columns not named are not read. `also`: further aggregates, under their own names.
    """
    names = [f"_p{i}" for i in range(len(priority))]
    high = [*[p.alias(n) for p, n in zip(priority, names)], at.alias("_at")]
    if smallest:
        # The order of the maximum with all terms turned, so that the value itself can count low before high.
        turned = [F.struct(p.isNull().alias("none"), F.negate(p).alias("v")).alias(n) for p, n in zip([*priority, at], [*names, "_at"])]
        ranked = rows.select(*keys, *fields, *turned)
        best = [F.min(F.struct(F.col(f).isNull().alias("has"), *names, "_at", F.col(f).alias("value"))).alias(f"_b_{f}") for f in fields]
    else:
        ranked = rows.select(*keys, *fields, *high)
        best = [F.max(F.struct(F.col(f).isNotNull().alias("has"), *names, "_at", F.col(f).alias("value"))).alias(f"_b_{f}") for f in fields]
    grouped = ranked.groupBy(*keys).agg(*best, *also)
    more = [c for c in grouped.columns if c not in keys and not c.startswith("_b_")]
    return grouped.select(*keys, *[F.col(f"_b_{f}.value").alias(f) for f in fields], *more)


def surviving_bundle(occurrences: DataFrame, headers: DataFrame, least_bundles: int = 2, most_participants: int = 10) -> DataFrame:
    """match_id, bundle, bundles: of each match listed under at least least_bundles bundles the surviving header's.

    Order of preference: has a header; valid_for_pipeline 1; participant_count (null 0, capped at
    most_participants); later fetched_at_utc (null earliest); the bundle name that sorts first. Ids are compared in
    clean form; rows of either table with a null or blank id or bundle are left out; repeated rows change nothing;
    a bundle that no occurrence lists cannot survive. No headers: the name alone decides. No occurrences: no rows.

    Occurrences and headers go into one long form. Both steps are field-by-field survivorship: by (match, bundle) the
    header's attributes survive as one composite struct, beside whether the bundle is listed; by match the bundle
    survives, its attributes being the priorities. Each is one aggregation, combined before the shuffle.
    """
    worth = F.struct(
        F.coalesce((F.col("valid_for_pipeline") == 1).cast("int"), F.lit(0)).alias("v"),
        F.least(F.coalesce(F.col("participant_count"), F.lit(0)), F.lit(most_participants)).alias("c"),
        F.col("fetched_at_utc").cast("bigint").alias("t"),
    )
    kind = "struct<v:int,c:int,t:bigint>"
    ids = [clean_match_id(F.col("match_id")).alias("match_id"), clean_bundle(F.col("bundle")).alias("bundle")]
    listed = occurrences.select(*ids, F.lit(1).alias("listed"), F.lit(None).cast(kind).alias("worth"))
    held = headers.select(*ids, F.lit(None).cast("int").alias("listed"), worth.cast(kind).alias("worth"))
    long = listed.unionByName(held).where(F.col("match_id").isNotNull() & F.col("bundle").isNotNull())
    by_bundle = survive_fields(long, ["match_id", "bundle"], ["listed", "worth"], [], F.lit(0)).where("listed = 1")
    priority = [F.col("worth").isNotNull().cast("int"), F.col("worth.v"), F.col("worth.c")]
    best = survive_fields(by_bundle, ["match_id"], ["bundle"], priority, F.col("worth.t"), smallest=True, also=(F.count("*").alias("bundles"),))
    return best.where(F.col("bundles") >= least_bundles).select("match_id", "bundle", "bundles")
