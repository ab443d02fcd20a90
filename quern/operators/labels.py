"""Skill labels and player history: ladder joins, coverage, priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import ranks as R
from quern.functions.clock import clock_hour, in_clock_window
from quern.operators.relations import with_row_id


def probits(rows: DataFrame, rank: str, lp: str, server: Column, bins: DataFrame, cutoffs: DataFrame | None = None) -> DataFrame:
    """rows with percentile and probit of rank and points on the server's ladder (the default one if it has none).

    bins: server, ord, rank, lower_pct, upper_pct (`ranks.ladder`, 31 rows a server: broadcast). cutoffs: server, gm,
    chall, first (`ranks.cutoffs`); a server has its own cut-offs also where its ladder is the default one, and the
    default ones if it is not listed. Null for unknown ranks; negative points count as 0.
    """
    known = bins.select(F.col("server").alias("_known")).distinct()
    d = rows.withColumn("_own", F.upper(server)).join(F.broadcast(known), F.col("_own") == F.upper("_known"), "left").withColumn("_s", F.coalesce("_known", F.lit("default"))).drop("_known")
    points = F.greatest(F.coalesce(F.col(lp).cast("double"), F.lit(0.0)), F.lit(0.0))
    if cutoffs is None:
        d = d.withColumns({"_gm": F.lit(R.GRANDMASTER_LP), "_ch": F.lit(R.CHALLENGER_LP), "_first": F.lit(R.FIRST_LP)})
    else:
        c = cutoffs.select(F.col("server").alias("_cs"), F.col("gm").alias("_gm0"), F.col("chall").alias("_ch0"), F.col("first").alias("_f0"))
        d = d.join(F.broadcast(c), F.col("_own") == F.col("_cs"), "left")
        d = d.withColumns({"_gm": F.coalesce("_gm0", F.lit(R.GRANDMASTER_LP)), "_ch": F.coalesce("_ch0", F.lit(R.CHALLENGER_LP)), "_first": F.coalesce("_f0", F.lit(R.FIRST_LP))})
    d = d.withColumn("_lp", points).withColumn("_rank", R.effective_rank(F.col(rank), F.col("_lp"), F.col("_gm"), F.col("_ch")))
    d = d.withColumn("_frac", R.lp_fraction(F.col("_rank"), F.col("_lp"), F.col("_gm"), F.col("_ch"), F.col("_first")))
    b = bins.select(F.col("server").alias("_bs"), F.col("rank").alias("_br"), "lower_pct", "upper_pct")
    d = d.join(F.broadcast(b), (F.col("_s") == F.col("_bs")) & (F.col("_rank") == F.col("_br")), "left")
    pct = R.percentile_of(F.col("lower_pct"), F.col("upper_pct"), F.col("_frac"))
    return d.withColumn("percentile", pct).withColumn("probit", R.normal_quantile(F.col("percentile") / 100)).select(*rows.columns, "percentile", "probit")


def server_labels(participants: DataFrame, ranked: DataFrame, bins: DataFrame, cutoffs: DataFrame | None = None, least_mapped: int = 9, want_unique: int = 10) -> DataFrame:
    """match_id, average_skill_level, mapped_participants, unique_participants, skill_server of matches with enough players.

    participants: match_id, puuid; ranked: puuid, rank, lp, one row for each player. A player's rank is placed on the
    ladder and cut-offs of each match's own server, the part of the id before its underscore, so one player may have
    several values. Null ids count nowhere, repeated rows once.
    """
    own = participants.where(F.col("match_id").isNotNull() & F.col("puuid").isNotNull()).select("match_id", "puuid").distinct()
    j = own.join(ranked.select("puuid", "rank", "lp"), "puuid", "left").withColumn("skill_server", F.upper(F.substring_index("match_id", "_", 1)))
    p = probits(j, "rank", "lp", F.col("skill_server"), bins, cutoffs)
    g = p.groupBy("match_id", "skill_server").agg(F.avg("probit").alias("average_skill_level"), F.count("probit").alias("mapped_participants"), F.count("*").alias("unique_participants"))
    g = g.where((F.col("unique_participants") >= want_unique) & (F.col("mapped_participants") >= least_mapped))
    return g.select("match_id", "average_skill_level", "mapped_participants", "unique_participants", "skill_server")


def player_counters(edges: DataFrame, keys: list[str], local: Column, windows: dict[str, tuple[float, float]]) -> DataFrame:
    """keys, games, timed and one count for each clock window, over a player's history without a cut-off."""
    hour = clock_hour(local)
    return edges.groupBy(*keys).agg(F.count("*").alias("games"), F.count(local).alias("timed"), *[F.count_if(in_clock_window(hour, a, b)).alias(n) for n, (a, b) in windows.items()])


def coverage(edges: DataFrame, player: str, match: str, known: Column, target: int, bands: tuple[int, int] = (8, 10)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(player, covered), (match, covered members), one row of totals: covered players, matches with at least each band.

    A player is covered with at least `target` known items, a match counts its covered players.
    """
    players = edges.groupBy(player).agg(F.count_if(known).alias("covered")).withColumn("is_covered", F.col("covered") >= target)
    per = edges.select(match, player).distinct().join(players, player).groupBy(match).agg(F.count_if("is_covered").alias("covered_members"), F.count("*").alias("members"))
    low, high = bands
    totals = per.agg(F.count("*").alias("matches"), F.count_if(F.col("covered_members") >= low).alias("at_least_low"), F.count_if(F.col("covered_members") >= high).alias("at_least_high"))
    return players, per, totals


def priorities(edges: DataFrame, player: str, match: str, players: DataFrame, per_match: DataFrame, target: int, full: int = 10, near: int = 8) -> DataFrame:
    """player, best_partial, near, incomplete, deficit, place: unresolved players, most useful first."""
    j = edges.select(player, match).distinct().join(per_match.where(F.col("covered_members") < full), match).join(players.where("not is_covered"), player)
    g = j.groupBy(player).agg(
        F.max("covered_members").alias("best_partial"), F.count_if(F.col("covered_members") >= near).alias("near"), F.count("*").alias("incomplete"), (F.lit(target) - F.first("covered")).alias("deficit")
    )
    order = [F.desc("best_partial"), F.desc("near"), F.desc("incomplete"), F.asc("deficit"), F.asc(player)]
    ranked = with_row_id(g, order, "place", 1)
    return ranked.withColumn("place", F.col("place").cast("int"))


def popularity(edges: DataFrame, group: str, member: str) -> DataFrame:
    """group, popularity: sum over distinct members of the number of groups they are in."""
    own = edges.select(group, member).distinct()
    pop = own.groupBy(member).agg(F.count("*").alias("_pop"))
    return own.join(pop, member).groupBy(group).agg(F.sum("_pop").alias("popularity"))


def fixpoint(state: DataFrame, step, ws, most: int | None = None) -> DataFrame:
    """state after applying step (state -> (new state, number of changed rows)) until nothing changes.

    Each state is written to the shared folder, which cuts the lineage and survives lost executors. Where more than
    `most` steps would be needed (None: as many as it takes), RuntimeError: no unfinished state is given out.
    """
    now, k = ws.save(state, "state0"), 0
    while True:
        nxt, changed = step(now)
        if changed == 0:
            return now
        if most is not None and k >= most:
            raise RuntimeError(f"not finished after {most} steps: {changed} rows still change")
        now, k = ws.save(nxt, f"state{k + 1}"), k + 1
        if k > 1:
            ws.drop(f"state{k - 2}")
