"""A ranked ladder as rounds of DataFrame steps: queue, group by rank, decide, move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.numeric import logistic
from quern.functions.ranks import RANKS
from quern.functions.ranks import normal_quantile
from quern.functions.subquery import with_row
from quern.operators import statistics
from quern.operators.choosing import capped_by_order
from quern.operators.relations import with_row_id
from quern.session import Workspace

WIN_LP, LOSS_LP, FULL_LP, DEMOTED_LP = 25.0, 25.0, 100.0, 80.0
MASTER = RANKS.index("Master")
TIER_STARTS = tuple(i for i, r in enumerate(RANKS) if r.endswith(" IV"))


def transition(rank: Column, lp: Column, streak: Column, won: Column, top: int = len(RANKS) - 1) -> tuple[Column, Column, Column]:
    """(rank, lp, streak) after one game.

    A win adds points and promotes at 100. A loss takes points; below 0 the lowest rank stays at 0, the first rank of
    a tier holds a loss of less than 25 points beyond 0, a player at 0 is shielded once, and others fall to 80 points
    of the rank below.
    """
    up = lp + WIN_LP
    promoted = won & (up >= FULL_LP) & (rank < top)
    down = lp - LOSS_LP
    under = ~won & (down < 0)
    at_zero = F.abs(lp) < 1e-6
    losing = F.when(at_zero, streak + 1).otherwise(streak)
    floor = rank.isin(*TIER_STARTS)
    held = under & (rank > 0) & ((floor & (down > -LOSS_LP)) | (at_zero & (losing <= 1)))
    fallen = under & (rank > 0) & ~held
    new_rank = F.when(promoted, rank + 1).when(fallen, rank - 1).otherwise(rank)
    new_lp = F.when(promoted, up - FULL_LP).when(won, up).when(~under, down).when(fallen, DEMOTED_LP).otherwise(0.0)
    new_streak = F.when(won | ~under | fallen, 0).when(rank == 0, streak).otherwise(losing)
    return new_rank, new_lp, new_streak


def _uniform(*parts: Column) -> Column:
    return (F.pmod(F.xxhash64(*parts), F.lit(1_000_003)) + 0.5) / 1_000_003


def initial_state(spark: SparkSession, players: int, seed: int = 1) -> DataFrame:
    """id, skill (standard normal), rank, lp, games, streak of new players."""
    d = spark.range(players).withColumn("skill", normal_quantile(_uniform(F.lit(seed), F.col("id"))))
    return d.select("id", "skill", F.lit(12).alias("rank"), F.lit(0.0).alias("lp"), F.lit(0).alias("games"), F.lit(0).alias("streak"))


def queue_games(queued: DataFrame, order: list, size: int) -> DataFrame:
    """queued players with `_game`, `_side` and `_plays`: of each rank in the given order, `size` to a game.

    Numbers run through the whole rank, whatever its size, and are given within range partitions; only the fewer than
    `size` players left at the end of a rank do not play, as in a plain loop over the shuffled rank.
    """
    by = with_row_id(queued, [F.asc("rank"), *order], "_id")
    ranks = by.groupBy(F.col("rank").alias("_rank")).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    d = by.join(F.broadcast(ranks), F.col("rank") == F.col("_rank")).withColumn("_rn", F.col("_id") - F.col("_first"))
    d = d.withColumn("_game", F.floor(F.col("_rn") / size)).withColumn("_plays", F.col("_game") < F.floor(F.col("_n") / size)).withColumn("_side", F.pmod("_rn", F.lit(2)))
    return d.select(*queued.columns, "_game", "_side", "_plays")


def play_round(state: DataFrame, number: int, team: int = 5, queue_share: float = 0.35, seed: int = 1) -> DataFrame:
    """The state after one round: the queued players of each rank are shuffled into games of two teams."""
    q = state.withColumn("_u", _uniform(F.lit(seed), F.lit(number), F.col("id"))).withColumn("_in", F.col("_u") < queue_share)
    inside = queue_games(q.where("_in"), [F.asc("_u"), F.asc("id")], 2 * team)
    g = Window.partitionBy("rank", "_game")
    gap = F.avg(F.when(F.col("_side") == 0, F.col("skill"))).over(g) - F.avg(F.when(F.col("_side") == 1, F.col("skill"))).over(g)
    first = _uniform(F.lit(seed + 13), F.lit(number), F.col("rank"), F.col("_game")) < logistic(gap)
    d = inside.withColumn("_won", F.when(F.col("_side") == 0, first).otherwise(~first))
    r, lp, s = transition(F.col("rank"), F.col("lp"), F.col("streak"), F.col("_won"))
    moved = d.select("id", "skill", *[F.when(F.col("_plays"), new).otherwise(F.col(old)).alias(old) for old, new in (("rank", r), ("lp", lp))], (F.col("games") + F.col("_plays").cast("int")).alias("games"), F.when(F.col("_plays"), s).otherwise(F.col("streak")).alias("streak"))
    return q.where("not _in").select(*state.columns).unionByName(moved.select(*state.columns))


def apex_capped(state: DataFrame, challenger_cap: int, grandmaster_cap: int) -> DataFrame:
    """The state with the upper ranks dealt out anew: of all players from Master on, those with most points (then most
    games, then the smallest id) are Challenger up to its cap, the next GrandMaster up to its cap, the rest Master."""
    order = [F.desc("lp"), F.desc("games"), F.asc("id")]
    top = capped_by_order(state.where(F.col("rank") >= MASTER), order, [(MASTER + 2, challenger_cap), (MASTER + 1, grandmaster_cap)], MASTER, "_rank")
    top = top.withColumn("rank", F.col("_rank").cast("int")).drop("_rank")
    return state.where(F.col("rank") < MASTER).unionByName(top.select(*state.columns))


def simulate(state: DataFrame, rounds: int, ws: Workspace, every: int = 1, caps: tuple[int, int] | None = None, **options) -> DataFrame:
    """The state after some rounds; every `every` of them it is written to the shared folder, which cuts the lineage.

    caps: places for Challenger and GrandMaster, dealt out after every round; None leaves the ranks as played.
    """
    last = None
    for k in range(rounds):
        state = play_round(state, k, **options)
        if caps is not None:
            state = apex_capped(state, *caps)
        if (k + 1) % every == 0 or k == rounds - 1:
            state = ws.save(state, f"round{k}")
            if last is not None:
                ws.drop(f"round{last}")
            last = k
    return state


def skill_map(state: DataFrame, points=(0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """rank, n, mean, sd, p10.. of the players' skill, and skill_percentile: the share of all players, in percent, whose
    skill is at most the rank's median. Ranks without players have no row."""
    q = statistics.quantile_profile(state, ["rank"], "skill", points)
    # Players are counted once, by the number of medians below their skill; there are no more medians than ranks.
    medians = q.agg(F.sort_array(F.collect_list("p50")).alias("_ms"))
    counts = with_row(state.select("skill"), medians).groupBy(F.size(F.filter("_ms", lambda m: m < F.col("skill"))).alias("_b")).agg(F.count("*").alias("_n"))
    totals = counts.agg(F.map_from_entries(F.collect_list(F.struct("_b", "_n"))).alias("_counts"), F.sum("_n").alias("_all"))
    wide = with_row(with_row(q, medians), totals)
    place = F.array_position("_ms", F.col("p50")) - 1
    below = F.aggregate(F.map_entries("_counts"), F.lit(0).cast("bigint"), lambda s, e: s + F.when(e["key"] <= place, e["value"]).otherwise(0))
    return wide.select(*q.columns, (100.0 * below / F.col("_all")).alias("skill_percentile"))
