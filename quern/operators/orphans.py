"""References to records that do not exist: tagged parent and child keys in long form, one grouping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.epochs import month_of_seconds
from quern.functions.ids import clean_match_id, clean_player, key128

WEEK_S = 604_800
UNKNOWN = "unknown"


def tagged_keys(parts: list[tuple[DataFrame, str, str, bool, dict[str, str]]], extra: dict[str, str]) -> DataFrame:
    """Long form of (table, parent name, key column, is parent, {extra column: expression}).

    Rows: parent, key, child_of (null for a parent row), is_parent and the extra columns (null where not given).
    Rows with a null key are left out.
    """
    out = []
    for df, parent, key, is_parent, given in parts:
        cols = [F.expr(given[c]).cast(kind).alias(c) if c in given else F.lit(None).cast(kind).alias(c) for c, kind in extra.items()]
        out.append(df.where(F.col(key).isNotNull()).select(F.lit(parent).alias("parent"), F.col(key).alias("key"), F.lit(is_parent).alias("is_parent"), *cols))
    return reduce(DataFrame.unionByName, out)


def orphan_counts(children: list[tuple[str, DataFrame, Column, Column]], parents: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """General report: children is (parent table, child rows, key, period), parents is (parent table, rows, key).

    Columns parent_table, period, orphan_rows, orphan_keys: child rows, and distinct keys, by period whose key the
    parent table lacks. Null keys refer to nothing and are no orphans; a null period is 'unknown'; repeated rows each
    count as rows. One shuffle by (parent table, key, period): counts are combined before it, so a hot key is one row
    for each task and period.
    """
    kids = [df.select(F.lit(t).alias("parent_table"), key.cast("string").alias("key"), F.coalesce(period.cast("string"), F.lit(UNKNOWN)).alias("period"), F.lit(1).alias("n"), F.lit(0).alias("p")) for t, df, key, period in children]
    olds = [df.select(F.lit(t).alias("parent_table"), key.cast("string").alias("key"), F.lit(None).cast("string").alias("period"), F.lit(0).alias("n"), F.lit(1).alias("p")) for t, df, key in parents]
    long = reduce(DataFrame.unionByName, [*kids, *olds]).where(F.col("key").isNotNull())
    by_period = long.groupBy("parent_table", "key", "period").agg(F.sum("n").alias("n"), F.max("p").alias("p"))
    periods = F.collect_list(F.when(F.col("n") > 0, F.struct("period", "n")))
    keys = by_period.groupBy("parent_table", "key").agg(F.max("p").alias("p"), periods.alias("periods")).where("p = 0")
    return (
        keys.select("parent_table", F.explode("periods").alias("x"))
        .groupBy("parent_table", F.col("x.period").alias("period"))
        .agg(F.sum("x.n").alias("orphan_rows"), F.count("*").alias("orphan_keys"))
    )


def _reads(*names: str) -> Column:
    """True for every row, but reads the columns: two uses of a grouping then need the same aggregates, and Spark
    runs its shuffle once for both."""
    return F.size(F.array(*[F.col(n).isNull() for n in names])) == len(names)


def match_reference_orphans(participants: DataFrame, ranks: DataFrame, matches: DataFrame, targets: DataFrame, late_after_s: int = WEEK_S) -> DataFrame:
    """ref_field, match_id, puuid, orphan_state, orphan_month: one row per reference that lacks its record.

    States: 'missing' (no such record), 'late' (the player's first rank row came more than late_after_s after the
    match's first fetch), 'overcount' (more mapped players claimed than can be found). Null and blank ids and values
    that stand for no player refer to nothing; ids are compared in clean form; repeated rows give one row. Empty
    tables are tables without records. Other columns are not read.

    Keys of players travel as 16 bytes until the reference is known to be an orphan. Parent and child keys are
    grouped once for each kind of parent; references then meet those groups, first by match and then by player. A
    hot player is split by adaptive skew joins, since the rows there are joined, not grouped.
    """
    pair = participants.select(clean_match_id(F.col("match_id")).alias("match_id"), clean_player(F.col("puuid")).alias("puuid")).where(F.col("match_id").isNotNull())
    rank = ranks.select(clean_player(F.col("puuid")).alias("puuid"), F.col("fetched_at_utc").cast("bigint").alias("fetched")).where(F.col("puuid").isNotNull())
    head = matches.select(clean_match_id(F.col("match_id")).alias("match_id"), F.col("fetched_at_utc").cast("bigint").alias("fetched"), F.col("game_creation_utc_ms").cast("bigint").alias("created"))
    label = targets.select(clean_match_id(F.col("match_id")).alias("match_id"), F.col("mapped_participants").cast("bigint").alias("mapped"))

    match_keys = tagged_keys(
        [
            (head, "matches", "match_id", True, {"fetched": "fetched", "created": "if(created > 0, created, null)"}),
            (pair, "matches", "match_id", False, {"in_pairs": "1"}),
            (label, "matches", "match_id", False, {"in_labels": "1", "mapped": "mapped"}),
        ],
        {"fetched": "bigint", "created": "bigint", "mapped": "bigint", "in_pairs": "int", "in_labels": "int"},
    )
    match = match_keys.groupBy(F.col("key").alias("match_id")).agg(
        F.max("is_parent").alias("known"),
        F.min("fetched").alias("m_fetched"),
        F.max("mapped").alias("mapped"),
        F.max("in_pairs").alias("in_pairs"),
        F.max("in_labels").alias("in_labels"),
        F.min("created").alias("created"),
    )
    month = F.coalesce(F.date_format(F.timestamp_millis("created"), "yyyy-MM"), F.lit(UNKNOWN))
    match = match.withColumn("month", month).drop("created")

    valid = pair.where(F.col("puuid").isNotNull())
    player_keys = tagged_keys(
        [
            (rank.select(*key128(F.col("puuid")), "puuid", "fetched"), "player_ranks", "puuid", True, {"fetched": "fetched", "untimed": "fetched is null", "h1": "h1", "h2": "h2"}),
            (valid.select(*key128(F.col("puuid")), "puuid"), "player_ranks", "puuid", False, {"h1": "h1", "h2": "h2"}),
        ],
        {"fetched": "bigint", "untimed": "boolean", "h1": "bigint", "h2": "bigint"},
    )
    player = player_keys.groupBy("h1", "h2").agg(
        F.max("key").alias("puuid"),
        F.max("is_parent").alias("ranked"),
        F.min("is_parent").alias("only_ranked"),
        F.min("fetched").alias("p_fetched"),
        F.max("untimed").alias("untimed"),
    )

    pairs = valid.select("match_id", *key128(F.col("puuid"))).distinct()
    match = match.where(_reads("known", "m_fetched", "month", "mapped", "in_pairs", "in_labels"))
    player = player.where(_reads("h1", "h2", "puuid", "ranked", "only_ranked", "p_fetched", "untimed"))
    placed = pairs.join(match.where("in_pairs = 1").select("match_id", "m_fetched", "month", "mapped"), "match_id")
    joined = placed.join(player.select("h1", "h2", "puuid", "ranked", "p_fetched", "untimed"), ["h1", "h2"])
    late = F.col("ranked") & ~F.coalesce("untimed", F.lit(False)) & (F.col("p_fetched") - F.col("m_fetched") > late_after_s)
    state = F.when(~F.col("ranked"), "missing").when(late, "late")

    none, zero = F.lit(None).cast("bigint"), F.lit(0)

    def row(field: str, match_id: Column, puuid: Column, what: Column, when: Column, claimed: Column, found: Column) -> Column:
        return F.struct(
            F.lit(field).alias("ref_field"), match_id.alias("match_id"), puuid.alias("puuid"), what.alias("orphan_state"), when.alias("orphan_month"), claimed.alias("claimed"), found.cast("int").alias("found")
        )

    m, blank = F.col("match_id"), F.lit("")
    overcount = "skill_targets.mapped_participants"
    from_pairs = F.array(
        F.when(state.isNotNull(), row("match_participants.puuid", m, F.col("puuid"), state, F.col("month"), none, zero)),
        F.when(F.col("mapped").isNotNull() & F.col("ranked"), row(overcount, m, blank, F.lit("overcount"), F.col("month"), F.col("mapped"), F.lit(1))),
    )
    from_matches = F.array(
        F.when(~F.col("known") & (F.col("in_pairs") == 1), row("match_participants.match_id", m, blank, F.lit("missing"), F.col("month"), none, zero)),
        F.when(~F.col("known") & (F.col("in_labels") == 1), row("skill_targets.match_id", m, blank, F.lit("missing"), F.col("month"), none, zero)),
        F.when(F.col("mapped").isNotNull(), row(overcount, m, blank, F.lit("overcount"), F.col("month"), F.col("mapped"), zero)),
    )
    fetched_month = F.coalesce(month_of_seconds(F.col("p_fetched")), F.lit(UNKNOWN))
    from_players = F.array(F.when(F.col("only_ranked"), row("player_ranks.puuid", blank, F.col("puuid"), F.lit("missing"), fetched_month, none, zero)))

    long = reduce(DataFrame.unionByName, [df.select(F.explode(F.array_compact(rows)).alias("r")).select("r.*") for df, rows in ((joined, from_pairs), (match, from_matches), (player, from_players))])
    keys = ["ref_field", "match_id", "puuid", "orphan_state", "orphan_month"]
    found = long.groupBy(*keys).agg(F.max("claimed").alias("claimed"), F.sum("found").alias("found"))
    return found.where(F.col("claimed").isNull() | (F.col("claimed") > F.col("found"))).select(*keys)


def orphans_by_period(orphans: DataFrame) -> DataFrame:
    """ref_field, orphan_state, orphan_month, orphans: the report by table and period."""
    return orphans.groupBy("ref_field", "orphan_state", "orphan_month").agg(F.count("*").alias("orphans"))
