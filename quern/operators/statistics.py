"""Aggregations and statistics, from group means to models from sufficient statistics."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.subquery import with_row
from quern.operators.quantiles import quantiles


def status_pivot(df: DataFrame, key: str, status: str, values: list[str]) -> DataFrame:
    """key and one count column for each listed status, 0 where there is none."""
    return df.groupBy(key).agg(*[F.count_if(F.col(status) == v).alias(f"n_{v}".lower()) for v in values])


def subset_summary(df: DataFrame, subsets: dict[str, Column], value: str) -> DataFrame:
    """subset, n, mean, total, low, high for each named condition, in one scan; a row may be in several."""
    tags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in subsets.items()]))
    d = df.select(F.explode(tags).alias("subset"), F.col(value).alias("v"))
    return d.groupBy("subset").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"))


def mean_ci(df: DataFrame, keys: list[str], value: str, z: float = 1.96) -> DataFrame:
    """n, mean, se, ci_low, ci_high of each group; se is null for one row."""
    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"))
    return g.withColumn("ci_low", F.col("mean") - z * F.col("se")).withColumn("ci_high", F.col("mean") + z * F.col("se"))


def mode_by_order(df: DataFrame, keys: list[str], value: str, order: Column, default: str = "UNKNOWN") -> DataFrame:
    """keys, mode: the most frequent non-null value, the one first in order at a tie; default where all are null."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    best = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct("_n", (-order).alias("_o"), F.col(value).alias("_v"))))
    return counts.groupBy(*keys).agg(F.coalesce(best, F.lit(default)).alias("mode"))


def quantile_profile(df: DataFrame, keys: list[str], value: str, points=(0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """n, mean, population deviation and exact linear quantiles p10.. of each group."""
    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    q = quantiles(df, keys, value, list(points), "_q")
    if keys:
        q = q.select(*[F.col(k).alias(f"_key_{k}") for k in keys], "_q")
        g = g.join(q, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]), "left")
    else:
        g = with_row(g, q)
    return g.select(*keys, "n", "mean", "sd", *[F.get("_q", F.lit(i)).alias(f"p{round(p * 100)}") for i, p in enumerate(points)])


def shares(df: DataFrame, keys: list[str]) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def fit_metrics(df: DataFrame, actual: str, target: str) -> DataFrame:
    """One row: weighted_rmse (weights 1/sqrt(target + 0.001), normalised), chi2, mae, worst, of shares in percent."""
    d = F.col(actual) - F.col(target)
    w = 1 / F.sqrt(F.col(target) + 1e-3)
    return df.agg(
        F.sqrt(F.sum(w * d * d) / F.sum(w)).alias("weighted_rmse"), F.sum(d * d / F.greatest(F.col(target), F.lit(1e-9))).alias("chi2"), F.avg(F.abs(d)).alias("mae"), F.max(F.abs(d)).alias("worst")
    )


def regression_profile(df: DataFrame, truth: str, predicted: str, within=(0.25, 0.5)) -> DataFrame:
    """One row: n, rmse, mae, r2, corr, slope and intercept of truth on prediction, absolute error quantiles, shares within."""
    e = F.col(truth) - F.col(predicted)
    one = df.agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (1 - F.sum(e * e) / F.nullif(F.regr_syy(truth, predicted), F.lit(0.0))).alias("r2"),
        F.corr(truth, predicted).alias("corr"),
        F.regr_slope(truth, predicted).alias("slope"),
        F.regr_intercept(truth, predicted).alias("intercept"),
        *[F.avg((F.abs(e) <= w).cast("double")).alias(f"within_{w}".replace(".", "_")) for w in within],
    )
    points = (0.5, 0.9, 0.95)
    wide = with_row(one, quantiles(df.select(F.abs(e).alias("_e")), [], "_e", list(points), "_q"))
    return wide.select(*one.columns, *[F.get("_q", F.lit(i)).alias(f"abs_p{round(p * 100)}") for i, p in enumerate(points)])


def calibration(df: DataFrame, bin_column: str, truth: str, predicted: str) -> DataFrame:
    """Per bin: n, mean truth and prediction, rmse, mae, lowest and highest prediction."""
    e = F.col(truth) - F.col(predicted)
    return df.groupBy(bin_column).agg(
        F.count("*").alias("n"), F.avg(truth).alias("mean_truth"), F.avg(predicted).alias("mean_predicted"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.min(predicted).alias("low"), F.max(predicted).alias("high")
    )


def complete_groups(df: DataFrame, keys: list[str], fold: str, folds: int, metric: str) -> DataFrame:
    """keys, mean, sd of a metric over folds, for groups that have all of them."""
    g = df.groupBy(*keys).agg(F.count_distinct(fold).alias("_f"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"))
    return g.where(F.col("_f") == folds).drop("_f")


def explained_gap(df: DataFrame, condition: Column, raw: str, left: str) -> DataFrame:
    """One row: raw_gap, left_gap between rows with and without the condition, explained = 1 - |left| / |raw|."""
    both = [(F.avg(F.when(condition, F.col(c))) - F.avg(F.when(~condition, F.col(c)))).alias(n) for c, n in ((raw, "raw_gap"), (left, "left_gap"))]
    share = F.when(F.abs("raw_gap") > 1e-12, 1 - F.abs("left_gap") / F.abs("raw_gap"))
    return df.agg(*both).withColumn("explained", share)


def pooled_shares(players: DataFrame, group: str, flags: list[str], games: str, eligible_games: int, least_players: int) -> DataFrame:
    """Per group over players with enough games: eligible, games, pooled share and population deviation of shares of each flag.

    Groups with fewer than least_players such players keep only `eligible`; the rest is null.
    """
    ok = F.col(games) >= eligible_games
    aggs = [F.count_if(ok).alias("eligible"), F.sum(F.when(ok, F.col(games))).alias("games")]
    for f in flags:
        aggs += [(F.sum(F.when(ok, F.col(f))) / F.sum(F.when(ok, F.col(games)))).alias(f"{f}_share"), F.stddev_pop(F.when(ok, F.col(f) / F.col(games))).alias(f"{f}_std")]
    g = players.groupBy(group).agg(*aggs)
    enough = F.col("eligible") >= least_players
    return g.select(group, "eligible", *[F.when(enough, F.col(c)).alias(c) for c in g.columns if c not in (group, "eligible")])


def counter_delta(before: DataFrame, after: DataFrame, key: str, n: str) -> DataFrame:
    """key, before, after, delta of two counters; 0 where a side lacks the key."""
    j = before.select(key, F.col(n).alias("b")).join(after.select(key, F.col(n).alias("a")), key, "full")
    z = j.select(key, F.coalesce("b", F.lit(0)).alias("before"), F.coalesce("a", F.lit(0)).alias("after"))
    return z.withColumn("delta", F.col("after") - F.col("before"))


def stratum_summary(df: DataFrame, strata: list[str]) -> DataFrame:
    g = df.groupBy(*strata).agg(F.count("*").alias("n"))
    return g.agg(F.count("*").alias("strata"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.percentile("n", F.lit(0.5)).alias("median"))


def gram(df: DataFrame, x: list[str], y: str, keys: list[str] | None = None) -> DataFrame:
    """Sufficient statistics in long form: keys, i, j, value of Z'Z with Z = (1, x..., y).

    Each Arrow batch adds up its own matrix in numpy; the matrices are summed by cell. Rows with a null are left out.
    """
    keys = keys or []
    names = ["1", *x, y]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields), "i int, j int, value double"])
    kinds = df.select(*keys).schema

    def partial(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        for b in batches:
            t = pa.Table.from_batches([b]).to_pandas()
            for key, part in t.groupby(keys, dropna=False) if keys else [((), t)]:
                z = np.column_stack([np.ones(len(part)), part[[*x, y]].to_numpy(np.float64)])
                m = z.T @ z
                i, j = np.triu_indices(len(names))
                cols = [pa.array([k] * len(i), to_arrow_type(f.dataType)) for k, f in zip(key, kinds)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(m[i, j])], names=[*keys, "i", "j", "value"])

    rows = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in [*x, y]]).dropna(subset=[*x, y])
    return rows.mapInArrow(partial, schema).groupBy(*keys, "i", "j").agg(F.sum("value").alias("value"))


class Summary:
    """Z'Z of one set of rows: adds and subtracts, so that training sets are totals less a fold."""

    def __init__(self, m: np.ndarray):
        self.m = m

    @classmethod
    def of(cls, rows, size: int) -> Summary:
        m = np.zeros((size, size))
        for r in rows:
            m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["value"]
        return cls(m)

    def __add__(self, o: Summary) -> Summary:
        return Summary(self.m + o.m)

    def __sub__(self, o: Summary) -> Summary:
        return Summary(self.m - o.m)

    @property
    def n(self) -> float:
        return float(self.m[0, 0])

    def centred(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """(X'X, X'y, mean of x, mean of y), the products about the means."""
        s = self.m[0] / self.n
        c = self.m - self.n * np.outer(s, s)
        return c[1:-1, 1:-1], c[1:-1, -1], s[1:-1], float(s[-1])

    def sse(self, intercept: float, beta: np.ndarray) -> float:
        v = np.concatenate([[-intercept], -beta, [1.0]])
        return max(0.0, float(v @ self.m @ v))

    def metrics(self, intercept: float, beta: np.ndarray) -> dict[str, float]:
        total = float(self.m[-1, -1] - self.m[0, -1] ** 2 / self.n)
        sse = self.sse(intercept, beta)
        return {"rmse": (sse / self.n) ** 0.5, "r2": 1 - sse / total if total > 0 else float("nan")}


def summaries(df: DataFrame, x: list[str], y: str, fold: str) -> dict:
    """Summary of each fold; (folds × columns²) numbers come to the driver."""
    rows = gram(df, x, y, [fold]).collect()
    return {f: Summary.of([r for r in rows if r[fold] == f], len(x) + 2) for f in {r[fold] for r in rows}}


def fit_ols(s: Summary) -> tuple[float, np.ndarray]:
    xx, xy, mx, my = s.centred()
    beta = np.linalg.pinv(xx) @ xy
    return my - float(mx @ beta), beta


def _scales(xx: np.ndarray, n: float) -> np.ndarray:
    d = np.sqrt(np.maximum(np.diag(xx), 0) / n)
    return np.where(d > 0, d, 1.0)


def fit_ridge(s: Summary, alpha: float, per_row: bool = True) -> tuple[float, np.ndarray]:
    """Ridge on standardised columns: (Z'Z / n + alpha I) b = Z'y / n, or without the division by n."""
    xx, xy, mx, my = s.centred()
    d = _scales(xx, s.n)
    k = s.n if per_row else 1.0
    b = np.linalg.solve(xx / np.outer(d, d) / k + alpha * np.eye(len(d)), xy / d / k)
    beta = b / d
    return my - float(mx @ beta), beta


def ridge_grid(s: Summary, low: float = -6, high: float = 4, n: int = 17) -> np.ndarray:
    xx, _, _, _ = s.centred()
    d = _scales(xx, s.n)
    return float(np.median(np.diag(xx / np.outer(d, d) / s.n))) * np.logspace(low, high, n)


def fit_lasso(s: Summary, alpha: float, start: np.ndarray | None = None, tolerance: float = 1e-7, most: int = 5000) -> tuple[float, np.ndarray, bool, np.ndarray]:
    """(intercept, beta, converged, standardised beta): cyclic coordinate descent on the Gram matrix."""
    xx, xy, mx, my = s.centred()
    d = _scales(xx, s.n)
    g, c = xx / np.outer(d, d) / s.n, xy / d / s.n
    b = np.zeros(len(d)) if start is None else start.copy()
    diag = np.maximum(np.diag(g), 1e-12)
    for _ in range(most):
        moved = 0.0
        for j in range(len(b)):
            r = c[j] - g[j] @ b + diag[j] * b[j]
            new = np.sign(r) * max(abs(r) - alpha, 0.0) / diag[j]
            moved, b[j] = max(moved, abs(new - b[j])), new
        if moved <= tolerance:
            break
    beta = b / d
    return my - float(mx @ beta), beta, moved <= tolerance, b


def lasso_grid(s: Summary, n: int = 25, smallest: float = 1e-4) -> np.ndarray:
    xx, xy, _, _ = s.centred()
    top = float(np.max(np.abs(xy / _scales(xx, s.n) / s.n)))
    return np.geomspace(top, top * smallest, n)


def cross_validate(folds: dict, fit) -> list[dict]:
    """Metrics of a fit on all folds but one, on that one: training sums are the total less the fold."""
    total = Summary(sum(s.m for s in folds.values()))
    out = []
    for k, s in sorted(folds.items()):
        intercept, beta = fit(total - s)[:2]
        out.append({"fold": k, **s.metrics(intercept, beta)})
    return out


def predict(df: DataFrame, x: list[str], intercept: float, beta, out: str = "predicted") -> DataFrame:
    e = F.lit(float(intercept))
    for c, b in zip(x, beta):
        e = e + F.col(c) * float(b)
    return df.withColumn(out, e)


def two_feature_fit(df: DataFrame, a: str, b: str, y: str, alpha: float | None = None, keys: list[str] | None = None) -> DataFrame:
    """Closed form of a fit on two columns: keys, n, intercept, beta_a, beta_b; alpha gives ridge on standardised columns."""
    k = keys or []
    c = lambda p, q: F.covar_pop(p, q)
    g = df.groupBy(*k).agg(
        F.count("*").alias("n"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.avg(y).alias("my"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"), c(a, b).alias("ab"), c(a, y).alias("ay"), c(b, y).alias("by")
    )
    l = float(alpha or 0.0)  # noqa: E741
    va, vb = F.col("va") * (1 + l), F.col("vb") * (1 + l)
    det = va * vb - F.col("ab") * F.col("ab")
    ba = (F.col("ay") * vb - F.col("by") * F.col("ab")) / det
    bb = (F.col("by") * va - F.col("ay") * F.col("ab")) / det
    return g.select(*k, "n", (F.col("my") - ba * F.col("ma") - bb * F.col("mb")).alias("intercept"), ba.alias("beta_a"), bb.alias("beta_b"))


def naive_by_fold(df: DataFrame, fold: str, y: str) -> DataFrame:
    """fold, rmse, mae of predicting each fold by the mean of the others."""
    sums = df.groupBy(fold).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    every = Window.partitionBy()
    means = sums.withColumn("m", (F.sum("s").over(every) - F.col("s")) / (F.sum("n").over(every) - F.col("n"))).select(fold, "m")
    e = F.col(y) - F.col("m")
    return df.join(F.broadcast(means), fold).groupBy(fold).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def group_mean_ladder(df: DataFrame, specs: dict[str, list[str]], y: str) -> DataFrame:
    """model, rmse, lift over the worst model (the overall mean, where listed): one-hot models of the given columns, which predict group means."""
    out = []
    for name, keys in specs.items():
        m = _with_group_mean(df, keys, y)
        out.append(m.agg(F.lit(name).alias("model"), F.sqrt(F.avg((F.col(y) - F.col("_p")) ** 2)).alias("rmse")))
    every = reduce(DataFrame.unionByName, out)
    return every.withColumn("lift", F.max("rmse").over(Window.partitionBy()) - F.col("rmse"))


def _with_group_mean(df: DataFrame, keys: list[str], y: str) -> DataFrame:
    if not keys:
        return with_row(df, df.agg(F.avg(y).alias("_p")))
    return df.join(df.groupBy(*keys).agg(F.avg(y).alias("_p")), keys)
