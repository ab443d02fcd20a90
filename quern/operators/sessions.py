"""Activity grouped into sessions: local sessions per time chunk, then a merge across chunk borders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.epochs import FIRST_MS_2010, epoch_to_ms
from quern.functions.ids import clean_match_id, clean_player, key128

DAY_MS = 86_400_000


def _runs(df: DataFrame, keys: list[str], start: str, end: str, gap: int) -> DataFrame:
    """Numbers runs of rows, in order of start, whose distance from the row before is at most gap."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.lag(end).over(w)
    first = F.when(before.isNull() | (F.col(start) - before > gap), 1).otherwise(0)
    return df.withColumn("_new", first).withColumn("_run", F.sum("_new").over(w)).drop("_new")


def chunked_sessions(events: DataFrame, keys: list[str], at: str, gap: int, chunk: int = DAY_MS, unique: str | None = None) -> DataFrame:
    """Sessions of each key: keys, session_start, session_end, session_duration, events.

    One input row is one event at the bigint `at`; rows at most `gap` apart belong together. Rows with a null
    time count nowhere; a null key is a key like any other. Rows at the same time are all counted, but where `unique`
    names a column, rows of a key with the same time and value of it are one event. An empty input gives no sessions.
    Other columns are not read, so extra ones cannot clash.

    A key's rows are spread over (key, time chunk), so that no task holds all rows of a hot key. Of a chunk only
    its first and last session can go on in a neighbour; only those, at most two for each chunk of the calendar,
    meet again by key. Their number is bounded by the time span, not by the number of rows. The other sessions take
    the same second step under their own chunk, where nothing is near enough to merge: one pass serves both.
    """
    t = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    k = [f"_k{i}" for i in range(len(keys))]
    own = [F.col(unique).alias("_once")] if unique else []
    rows = events.where(F.col(at).isNotNull()).select(*t, F.col(at).cast("bigint").alias("_at"), *own)
    rows = rows.withColumn("_chunk", F.call_function("div", F.col("_at") - F.pmod(F.col("_at"), F.lit(chunk)), F.lit(chunk)))
    if unique:
        # Parted as the window below needs it, so that the repeats cost no shuffle of their own.
        rows = rows.repartition(*k, "_chunk").distinct()
    local = (
        _runs(rows, [*k, "_chunk"], "_at", "_at", gap)
        .groupBy(*k, "_chunk", "_run")
        .agg(F.min("_at").alias("_s"), F.max("_at").alias("_e"), F.count("*").alias("_n"))
    )
    at_border = (F.col("_s") - F.col("_chunk") * chunk < gap) | ((F.col("_chunk") + 1) * chunk - F.col("_e") <= gap)
    placed = local.select(*k, F.when(~at_border, F.col("_chunk")).alias("_inside"), "_s", "_e", "_n")
    merged = _runs(placed, [*k, "_inside"], "_s", "_e", gap).groupBy(*k, "_inside", "_run").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.sum("_n").alias("_n"))
    return merged.select(
        *[F.col(f"_k{i}").alias(name) for i, name in enumerate(keys)],
        F.col("_s").alias("session_start"),
        F.col("_e").alias("session_end"),
        (F.col("_e") - F.col("_s")).alias("session_duration"),
        F.col("_n").alias("events"),
    )


def usable_match_times(times: DataFrame, first_ms: int = FIRST_MS_2010) -> DataFrame:
    """match_id, at_ms: of a match's usable rows the one updated last holds (the later time at a tie).

    A row is usable if its time, whatever its unit, lies from first_ms up to the row's updated_at_utc; a null in
    match_id, time or updated_at_utc makes it unusable.
    """
    ms = epoch_to_ms(F.col("game_creation_utc_ms"))
    rows = times.select(clean_match_id(F.col("match_id")).alias("match_id"), ms.alias("_ms"), F.col("updated_at_utc").cast("bigint").alias("_u"))
    usable = rows.where(F.col("match_id").isNotNull() & (F.col("_ms") >= first_ms) & (F.col("_ms") <= F.col("_u") * 1000))
    return usable.groupBy("match_id").agg(F.max(F.struct("_u", "_ms")).alias("_best")).select("match_id", F.col("_best._ms").alias("at_ms"))


def play_sessions(history: DataFrame, times: DataFrame, gap_ms: int = 7_200_000, chunk_ms: int = DAY_MS) -> DataFrame:
    """Sessions of distinct games by player: puuid, session_start_ms, session_end_ms, duration_ms, games.

    history has puuid and match_id, times has match_id, game_creation_utc_ms and updated_at_utc; ids are brought to
    their clean form first. Null or blank ids and values that stand for no player give no row, nor do games without
    a usable time; repeated rows count once. Players travel as 16-byte keys; the ids come back at the end.
    """
    plays = history.select(clean_player(F.col("puuid")).alias("puuid"), clean_match_id(F.col("match_id")).alias("match_id"))
    plays = plays.where(F.col("puuid").isNotNull() & F.col("match_id").isNotNull())
    keyed = plays.select(*key128(F.col("puuid")), "match_id", "puuid")
    names = keyed.groupBy("h1", "h2").agg(F.max("puuid").alias("puuid"))
    placed = keyed.select("h1", "h2", "match_id").join(usable_match_times(times), "match_id")
    out = chunked_sessions(placed, ["h1", "h2"], "at_ms", gap_ms, chunk_ms, unique="match_id").join(names, ["h1", "h2"])
    return out.select(
        "puuid",
        F.col("session_start").alias("session_start_ms"),
        F.col("session_end").alias("session_end_ms"),
        F.col("session_duration").alias("duration_ms"),
        F.col("events").alias("games"),
    )

