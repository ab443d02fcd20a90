"""Boosted-tree searches: sampled parameters, a trial table, ranking, focused boxes, cross-validation."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds (low, high, scale) of each parameter.
SPACE = {"maxDepth": (2, 5, "int"), "maxIter": (5, 20, "int"), "stepSize": (0.03, 0.3, "log"), "subsamplingRate": (0.5, 1.0, "linear")}


def signature(params: dict) -> str:
    return hashlib.sha1(json.dumps(params, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def draw(seed: int, space: dict = SPACE) -> dict:
    """Parameters of one trial; the same for the same seed everywhere."""
    out = {}
    for name, (low, high, scale) in sorted(space.items()):
        u = int.from_bytes(hashlib.sha256(f"{seed}:{name}".encode()).digest()[:8], "big") / 2**64
        if scale == "int":
            out[name] = low + min(int(u * (high - low + 1)), high - low)
        else:
            out[name] = round(math.exp(math.log(low) + u * (math.log(high) - math.log(low))) if scale == "log" else low + u * (high - low), 6)
    return out


def unique_trials(n: int, seed: int, space: dict = SPACE, seen: set[str] | None = None) -> list[dict]:
    """n trials with new signatures; draws that repeat one are listed as duplicates, as a log would.

    ValueError where 1,000 draws in a row bring nothing new: the space is used up.
    """
    seen, out, k, done, since = set(seen or ()), [], 0, 0, 0
    while done < n:
        if since > 1000:
            raise ValueError(f"the space has only {done} new trials of the {n} asked for, or next to no more")
        params = draw(seed + k, space)
        sig = signature(params)
        fresh = sig not in seen
        out.append({"trial_id": k, "trial_seed": seed + k, "signature": sig, "outcome": "completed" if fresh else "duplicate_skipped", "params": params})
        done, k, since = done + fresh, k + 1, 0 if fresh else since + 1
        seen.add(sig)
    return out


def focused_space(trials: DataFrame, space: dict = SPACE, top: int = 3, pad: float = 0.25) -> dict:
    """The box around the best `top` trials (columns of space, rmse, trial_id), padded and within the space."""
    best = trials.orderBy("rmse", "trial_id").limit(top).collect()
    out = {}
    for name, (low, high, scale) in space.items():
        f, g = (math.log, math.exp) if scale == "log" else (float, float)
        vs = [f(r[name]) for r in best]
        width = (max(vs) - min(vs)) * pad
        a, b = max(g(min(vs) - width), low), min(g(max(vs) + width), high)
        out[name] = (math.floor(a), math.ceil(b), scale) if scale == "int" else (a, b, scale)
    return out


def fit_trial(train: DataFrame, test: DataFrame, x: list[str], y: str, params: dict, seed: int) -> dict:
    """rmse on train and test of one parameter set."""
    v = VectorAssembler(inputCols=x, outputCol="_x")
    model = GBTRegressor(featuresCol="_x", labelCol=y, seed=seed, **params).fit(v.transform(train))
    e = RegressionEvaluator(labelCol=y, metricName="rmse")
    return {"train_rmse": float(e.evaluate(model.transform(v.transform(train)))), "rmse": float(e.evaluate(model.transform(v.transform(test))))}


def search(spark: SparkSession, df: DataFrame, x: list[str], y: str, fold: str, trials: list[dict], validation_fold: int = 0) -> DataFrame:
    """Trial table: trial_id, signature, parameters, train_rmse, rmse, gap, place, of completed trials."""
    train, test = df.where(F.col(fold) != validation_fold).cache(), df.where(F.col(fold) == validation_fold).cache()
    rows = []
    for t in trials:
        if t["outcome"] == "completed":
            m = fit_trial(train, test, x, y, t["params"], t["trial_seed"])
            rows.append((t["trial_id"], t["signature"], *[float(t["params"][k]) for k in sorted(t["params"])], m["train_rmse"], m["rmse"], m["rmse"] - m["train_rmse"]))
    train.unpersist()
    test.unpersist()
    names = sorted(trials[0]["params"])
    out = spark.createDataFrame(rows, "trial_id int, signature string, " + ", ".join(f"{n} double" for n in names) + ", train_rmse double, rmse double, gap double")
    from pyspark.sql import Window

    return out.withColumn("place", F.row_number().over(Window.orderBy("rmse", "gap", "trial_id")))
