import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import jobs, simulate, statistics, trees
from quern.session import Workspace
from tests.conftest import rows


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 3)) * [1, 5, 0.2] + [0, 10, 3]
    y = 2 + x @ [1.5, -0.3, 4] + r.normal(size=400) * 0.1
    df = spark.createDataFrame([(*map(float, a), float(b), i % 5) for i, (a, b) in enumerate(zip(x, y))], "a double, b double, c double, y double, fold int")
    return df, x, y


def test_models_equal_numpy(data):
    df, x, y = data
    folds = statistics.summaries(df, ["a", "b", "c"], "y", "fold")
    total = statistics.Summary(sum(s.m for s in folds.values()))
    z = np.column_stack([np.ones(len(x)), x])
    want = np.linalg.lstsq(z, y, rcond=None)[0]
    intercept, beta = statistics.fit_ols(total)
    assert np.allclose([intercept, *beta], want)
    assert total.metrics(intercept, beta)["rmse"] == pytest.approx(float(np.sqrt(np.mean((y - z @ want) ** 2))), rel=1e-6)
    part = total - folds[0]
    keep = np.arange(400) % 5 != 0
    assert np.allclose(statistics.fit_ols(part)[1], np.linalg.lstsq(z[keep], y[keep], rcond=None)[0][1:])
    s = (x - x.mean(0)) / x.std(0)
    b = np.linalg.solve(s.T @ s / 400 + 0.7 * np.eye(3), s.T @ (y - y.mean()) / 400)
    assert np.allclose(statistics.fit_ridge(total, 0.7)[1], b / x.std(0))
    b = np.linalg.solve(s.T @ s + 10 * np.eye(3), s.T @ (y - y.mean()))
    assert np.allclose(statistics.fit_ridge(total, 10, per_row=False)[1], b / x.std(0))


def test_lasso(data):
    df, _, _ = data
    s = statistics.Summary.of(statistics.gram(df, ["a", "b", "c"], "y").collect(), 5)
    assert not statistics.fit_lasso(s, statistics.lasso_grid(s)[0] * 1.0001)[1].any()
    intercept, beta, done, _ = statistics.fit_lasso(s, 1e-9)
    assert done and np.allclose(beta, statistics.fit_ols(s)[1], atol=1e-5)


def test_gram_leaves_out_nulls(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0), (4.0, None)], "x double, y double")
    assert statistics.Summary.of(statistics.gram(df, ["x"], "y").collect(), 3).n == 1
    assert statistics.gram(df.limit(0), ["x"], "y").count() == 0


def test_single_rows_and_ties(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, "x"), ("b", 4.0, "y"), ("c", 1.0, None)], "k string, v double, m string")
    ci = {r["k"]: r["se"] for r in statistics.mean_ci(df, ["k"], "v").collect()}
    assert ci["a"] is None and ci["b"] == pytest.approx(1.0)
    order = F.array_position(F.array(F.lit("y"), F.lit("x")), F.col("m"))
    assert {r["k"]: r["mode"] for r in statistics.mode_by_order(df, ["k"], "m", order).collect()} == {"a": "x", "b": "y", "c": "UNKNOWN"}


# Rank, points, streak, won, and what comes after.
MOVES = [
    (10, 10.0, 0, False, 9, 80.0, 0), (8, 10.0, 0, False, 8, 0.0, 0), (8, 0.0, 0, False, 8, 0.0, 1), (8, 0.0, 1, False, 7, 80.0, 0),
    (15, 90.0, 0, True, 16, 15.0, 0), (0, 10.0, 1, False, 0, 0.0, 1), (30, 95.0, 2, True, 30, 120.0, 0), (5, 50.0, 1, False, 5, 25.0, 0),
]


def test_transitions(spark):
    df = spark.createDataFrame([(i, *m[:4]) for i, m in enumerate(MOVES)], "i int, r int, lp double, s int, w boolean")
    got = df.select("i", *simulate.transition(F.col("r"), F.col("lp"), F.col("s"), F.col("w"))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [m[4:] for m in MOVES]


def test_simulation_keeps_players(spark):
    s = simulate.initial_state(spark, 600)
    end = simulate.simulate(s, 3, Workspace(spark, "sim"), every=2).persist()
    assert end.count() == 600 and end.select("id").distinct().count() == 600
    assert end.agg(F.sum("games")).first()[0] % 10 == 0 and end.agg(F.max("games")).first()[0] >= 1
    again = simulate.simulate(s, 3, Workspace(spark, "sim"), every=1)
    assert rows(again) == rows(end)


def test_trials():
    t = trees.unique_trials(4, 1)
    assert [x["outcome"] for x in t] == ["completed"] * 4 and t == trees.unique_trials(4, 1)
    seen = {t[0]["signature"]}
    assert trees.unique_trials(2, 1, seen=seen)[0]["outcome"] == "duplicate_skipped"


def test_rate_scale(spark):
    o = F.array(*[F.struct(F.lit(r).cast("string").alias("refused"), F.lit(float(u)).alias("usage")) for r, u in (("service", 0), (None, 0.95), (None, 0.1))])
    got = spark.range(1).select(jobs.rate_scale(o, 1.0)).first()[0]
    assert got == pytest.approx(0.55 * 0.92 + 0.02)


def test_latest_state(spark):
    e = spark.createDataFrame([("a", 1, "pending", None), ("a", 2, "running", None), ("a", 3, "failed", "x" * 999), ("b", 1, "running", None)], "k string, t int, s string, err string")
    got = {r["k"]: (r["status"], r["attempts"], len(r["last_error"] or "")) for r in jobs.latest_states(e, "k", "s", ["t"], error="err").collect()}
    assert got == {"a": ("failed", 1, 400), "b": ("running", 1, 0)}


def test_quantiles_of_hot_groups(spark):
    import numpy as np
    from quern.operators.quantiles import quantiles

    r = np.random.default_rng(3)
    data = [("a", float(x)) for x in r.normal(size=700)] + [("b", 5.0)] * 900 + [("c", None), (None, 1.0), (None, 3.0), ("d", 2.0)]
    df = spark.createDataFrame(data, "k string, v double")
    points = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {x["k"]: x["q"] for x in quantiles(df, ["k"], "v", points, "q").collect()}
    assert set(got) == {"a", "b", "d", None}
    for k in got:
        assert np.allclose(got[k], np.quantile([v for g, v in data if g == k and v is not None], points), atol=1e-12)
    every = quantiles(df, [], "v", points, "q").collect()
    assert len(every) == 1 and np.allclose(every[0]["q"], np.quantile([v for _, v in data if v is not None], points))
    assert [x["q"] for x in quantiles(df.limit(0), [], "v", points, "q").collect()] == [None]


def test_fixpoint_goes_to_the_end_or_says_so(spark):
    import pytest
    from quern.operators.labels import fixpoint

    start = spark.createDataFrame([(0,)], "n int")

    def step(d):
        n = d.first()["n"]
        return d.selectExpr("least(n + 1, 60) as n"), int(n < 60)

    assert rows(fixpoint(start, step, Workspace(spark, "fix"))) == [(60,)]
    with pytest.raises(RuntimeError):
        fixpoint(start, step, Workspace(spark, "fix"), most=5)


def test_used_up_spaces_are_reported():
    import pytest

    space = {"maxDepth": (2, 3, "int")}
    assert sum(t["outcome"] == "completed" for t in trees.unique_trials(2, 1, space)) == 2
    with pytest.raises(ValueError):
        trees.unique_trials(3, 1, space)


def test_all_queued_players_but_a_rest_of_a_rank_play(spark):
    """However crowded a rank is, fewer players than one game are left out of it."""
    from pyspark.sql import functions as F

    q = spark.range(1234).select("id", F.when(F.col("id") < 1207, 3).otherwise(9).alias("rank"), F.xxhash64("id").alias("_u"))
    g = simulate.queue_games(q, [F.asc("_u")], 10)
    assert rows(g.groupBy("rank").agg(F.count_if(~F.col("_plays")))) == [(3, 7), (9, 7)]
    sizes = g.where("_plays").groupBy("rank", "_game").agg(F.count("*").alias("n"), F.sum("_side").alias("s"))
    assert rows(sizes.select("n", "s").distinct()) == [(10, 5)]


def test_apex_caps_and_skill_map(spark):
    state = spark.createDataFrame([(i, float(i), 28 if i % 2 else 30, float(i % 7), 0, 0) for i in range(20)] + [(99, -1.0, 4, 50.0, 0, 0)], "id bigint, skill double, rank int, lp double, games int, streak int")
    capped = simulate.apex_capped(state, 3, 5)
    assert rows(capped.groupBy("rank").count()) == [(28, 12), (29, 5), (30, 3), (4, 1)]
    order = sorted(range(20), key=lambda i: (-(i % 7), 0, i))
    assert sorted(r["id"] for r in capped.where("rank = 30").collect()) == sorted(order[:3])
    m = {r["rank"]: r for r in simulate.skill_map(capped).collect()}
    assert m[4]["n"] == 1 and m[4]["p50"] == -1.0 and abs(m[4]["skill_percentile"] - 100 / 21) < 1e-9
    alone = simulate.simulate(state, 1, Workspace(spark, "sim"), caps=(3, 5))
    assert alone.count() == 21 and alone.where("rank = 30").count() <= 3


def test_trailing_counts_of_hot_keys(spark):
    from pyspark.sql import functions as F

    data = [("a", s) for s in (0, 0, 5, 9, 10, 11, 3600, 3605, 7000)] + [(None, 3), (None, 4), ("b", None)]
    got = rows(jobs.trailing_counts(spark.createDataFrame(data, "k string, s bigint"), ["k"], F.col("s"), 10))
    want = [(k, s, None if s is None else sum(1 for kk, ss in data if kk == k and ss is not None and s - 10 < ss <= s)) for k, s in data]
    assert got == sorted(want, key=repr)
