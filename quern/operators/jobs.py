"""Job states, queues, rates and incremental refreshes as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.arrays import chunk_number


def latest_states(events: DataFrame, key: str, status: str, order: list[str], running: str = "running", error: str | None = None) -> DataFrame:
    """key, status, attempts, transitions (and last_error, at most 400 characters): the state after all transitions."""
    last = F.max_by(status, F.struct(*order)).alias("status")
    aggs = [last, F.count_if(F.col(status) == running).alias("attempts"), F.count("*").alias("transitions")]
    if error:
        aggs.append(F.substring(F.max_by(error, F.struct(*order)), 1, 400).alias("last_error"))
    return events.groupBy(key).agg(*aggs)


def requeue_stale(jobs: DataFrame, now: Column, limit_s: int, status: str = "status", at: str = "updated_at", stuck: tuple[str, ...] = ("running",), to: str = "pending") -> DataFrame:
    """jobs with stuck states older than the limit set back; `requeued` tells which."""
    stale = F.col(status).isin(*stuck) & (now - F.col(at) > limit_s)
    return jobs.withColumn("requeued", F.coalesce(stale, F.lit(False))).withColumn(status, F.when(F.col("requeued"), to).otherwise(F.col(status)))


def claim_chunks(ids: DataFrame, key: str, at: str, size: int, take: int) -> DataFrame:
    """key, batch: distinct ids in chunks, oldest first; the first `take` batches are claimed."""
    first = ids.groupBy(key).agg(F.min(at).alias("_at"))
    rows = first.orderBy("_at", key).limit(size * take)
    return rows.select(key, chunk_number(F.row_number().over(Window.orderBy("_at", key)), size).alias("batch"))


def apply_outcomes(results: DataFrame, state: DataFrame, key: str, failed: Column) -> DataFrame:
    """outcome, n: results applied, skipped because the state has the key, or failed."""
    j = results.join(state.select(key, F.lit(True).alias("_have")).distinct(), key, "left")
    outcome = F.when(failed, "failed").when(F.col("_have"), "skipped_existing").otherwise("applied")
    return j.select(outcome.alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


def unseen(new: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return new.join(seen.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)


def trailing_counts(events: DataFrame, keys: list[str], seconds: Column, width_s: int, out: str = "trailing") -> DataFrame:
    """events with the number of a key's events in the last width_s seconds up to and with each.

    seconds is a bigint. Rows at the same second count together; rows without a time get null. Events are first
    counted by (key, second), before the shuffle as well; each second then meets only the seconds of its own chunk of
    width_s and of the one before, so that a hot key is spread over time, at most 2 * width_s rows to a window.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    d = events.withColumn("_s", seconds)
    per = d.where(F.col("_s").isNotNull()).groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("_s").alias("_at")).agg(F.count("*").alias("_n"))
    chunk = F.floor(F.col("_at") / width_s)
    both = per.withColumn("_chunk", F.explode(F.array(chunk, chunk + 1))).withColumn("_own", F.col("_chunk") == chunk)
    w = Window.partitionBy(*names, "_chunk").orderBy("_at").rangeBetween(-width_s + 1, 0)
    summed = both.withColumn(out, F.sum("_n").over(w)).where("_own").select(*names, "_at", out)
    same = F.col("_s") == F.col("_at")
    for k, n in zip(keys, names):
        same = same & F.col(k).eqNullSafe(F.col(n))
    return d.join(summed, same, "left").select(*events.columns, out)


def tumbling(events: DataFrame, at: str, width: str, keys: list[str], value: str) -> DataFrame:
    g = events.groupBy(F.window(F.col(at).cast("timestamp"), width), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return g.select(F.col("window.start").alias("start"), *keys, "n", "mean")


# What a refused request multiplies the rate by, by kind of limit, and bounds of the rate.
REFUSED, SLOWEST, FASTEST = {"service": 0.55, "method": 0.65, "other": 0.7}, 0.2, 1.0
BUSY_USAGE, BUSY_SCALE, BUSY_FACTOR, RECOVERY = 0.9, 0.45, 0.92, 0.02


def rate_scale(outcomes: Column, start: float = 0.65) -> Column:
    """Rate after an ordered array of struct(refused: string or null, usage: double): a fold over the array."""

    def step(scale: Column, o: Column) -> Column:
        factor = F.coalesce(F.create_map(*[F.lit(x) for kv in REFUSED.items() for x in kv])[o["refused"]], F.lit(REFUSED["other"]))
        eased = F.when((o["usage"] > BUSY_USAGE) & (scale > BUSY_SCALE), scale * BUSY_FACTOR).otherwise(scale + RECOVERY)
        return F.least(F.greatest(F.when(o["refused"].isNotNull(), scale * factor).otherwise(eased), F.lit(SLOWEST)), F.lit(FASTEST))

    return F.aggregate(outcomes, F.lit(float(start)), step)
