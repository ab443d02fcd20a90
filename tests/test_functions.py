import hashlib
import statistics as stats

import pytest
from pyspark.sql import functions as F

from quern.functions import arrays, bins, clock, hashing, ids, numeric, text
from quern.functions import ranks as R
from quern.operators.labels import probits
from tests.conftest import rows


def one(spark, c, **values):
    kinds = {str: "string", int: "bigint", float: "double", bool: "boolean"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items()) or "z int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(c.alias("c")).first()[0]


@pytest.mark.parametrize("raw", ["EUW1_1234567890", " euw1_1234567890", "EUW1-1234567890", "matches/EUW1_1234567890.json", "Euw1_1234567890\t", "euw1_1234567890.JSON", "EUW1_1234567890.json.zst", "EUW1_1234567890\n"])
def test_match_ids(spark, raw):
    assert one(spark, ids.clean_match_id(F.col("v")), v=raw) == "EUW1_1234567890"


@pytest.mark.parametrize("raw", ["kr_prod_8e", " kr_prod_8e", "kr_prod_8e ", "kr_prod_8e/", "./kr_prod_8e", "prod/kr_prod_8e/", "KR_PROD_8E"])
def test_bundles(spark, raw):
    assert one(spark, ids.clean_bundle(F.col("v")), v=raw) == "kr_prod_8e"


@pytest.mark.parametrize("raw", ["", "  ", " ", "BOT", " bot ", "0" * 48, None, "null", "-"])
def test_no_player(spark, raw):
    assert one(spark, ids.clean_player(F.col("v")), v=raw) is None


# Rank, points, effective rank, percentile and probit of the default ladder.
LADDER = [
    ("Iron IV", 0.0, 0.01, -3.719016), ("Iron IV", -5.0, 0.01, -3.719016), ("Gold IV", 50.0, 49.181871, -0.020509), ("Emerald I", 100.0, 95.395646, 1.684490),
    ("Master", 400.0, 99.285013, 2.449644), ("Master", 1300.0, 99.955939, 3.325938), ("GrandMaster", 900.0, 99.861809, 2.992855),
    ("GrandMaster", 1250.0, 99.955939, 3.325938), ("Challenger", 5000.0, 99.99, 3.719016),
]


def test_ladder(spark):
    df = spark.createDataFrame([(i, r, lp) for i, (r, lp, _, _) in enumerate(LADDER)], "i int, rank string, lp double")
    got = probits(df, "rank", "lp", F.lit("XX"), R.ladder(spark)).orderBy("i").collect()
    for g, (_, _, pct, z) in zip(got, LADDER):
        assert g["percentile"] == pytest.approx(pct, abs=1e-6) and g["probit"] == pytest.approx(z, abs=1e-6)


def test_normal(spark):
    n = stats.NormalDist()
    ps = [1e-12, 1e-6, 0.001, 0.07, 0.3, 0.5, 0.8, 0.999, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    for r in df.select("p", R.normal_quantile(F.col("p")).alias("q")).collect():
        assert r["q"] == pytest.approx(n.inv_cdf(r["p"]), abs=1e-9)
    xs = [-8.0, -3.5, -2.9, -0.3, 0.0, 1.0, 2.999, 3.0, 6.0]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", R.normal_cdf(F.col("x")).alias("c")).collect():
        assert r["c"] == pytest.approx(n.cdf(r["x"]), abs=1e-12)
    assert one(spark, R.normal_quantile(F.col("v")), v=0.0) is None


def test_rank_names(spark):
    for tier, div, want in ((" gold ", "iv", "Gold IV"), ("GOLD", None, None), ("master", None, "Master"), ("GRANDMASTER", "I", "GrandMaster"), ("WOOD", "I", None), (None, None, None)):
        df = spark.createDataFrame([(tier, div)], "t string, d string")
        assert df.select(R.rank_name(F.col("t"), F.col("d"))).first()[0] == want


def test_clock_windows(spark):
    for h, start, end, want in ((6.999, 1.0, 7.0, True), (7.0, 1.0, 7.0, False), (23.0, 23.0, 7.0, True), (6.5, 23.0, 7.0, True), (12.0, 23.0, 7.0, False)):
        assert one(spark, clock.in_clock_window(F.col("h"), start, end), h=h) is want


def test_zones(spark):
    df = spark.createDataFrame([("EUW1", "x"), ("ZZ", "eune_prod"), ("ZZ", "abc"), ("KR9", "zz"), (None, None)], "s string, f string")
    zone, flag = clock.zone_of(F.col("s"), F.col("f"))
    assert [tuple(r) for r in df.select(zone, flag).collect()] == [("Europe/Amsterdam", 0), ("Europe/Warsaw", 1), ("UTC", 1), ("Asia/Seoul", 1), ("UTC", 1)]


def test_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 11)], "v double")
    edges = F.array(*[F.lit(x) for x in (3.0, 7.0)])
    got = df.select(bins.left_closed_bin(F.col("v"), edges), bins.right_closed_bin(F.col("v"), edges)).collect()
    assert [tuple(r) for r in got][2] == (1, 1) and [tuple(r) for r in got][3] == (1, 2)


def test_numbers(spark):
    assert one(spark, numeric.half_even(F.col("v")), v=2.5) == 2
    assert one(spark, numeric.number(F.col("v")), v="x") == 0
    assert one(spark, numeric.safe_div(F.lit(1.0), F.col("v")), v=-2.0) == 0
    assert one(spark, numeric.flag(F.col("v") > 1, F.lit(None)), v=2) == 1
    assert one(spark, numeric.tier_index(F.col("v")), v=27) == 6 and one(spark, numeric.tier_index(F.col("v")), v=30) == 9


def test_text(spark):
    assert one(spark, text.prefix_or_empty(F.col("v")), v="abc") == "" and one(spark, text.prefix_or_whole(F.col("v")), v="abc") == "abc"
    assert one(spark, text.patch_of(F.col("v")), v="14.2.3") == "14.2" and one(spark, text.patch_of(F.col("v")), v="14") == "14"
    assert one(spark, text.recency(F.col("v")), v="KR_12x") == -1 and one(spark, text.recency(F.col("v")), v="KR_12") == 12
    assert one(spark, text.rate_pairs(F.col("v")), v="20:1,100:120,x") == {1: 20, 120: 100}
    assert one(spark, text.rate_usage(F.col("v"), F.lit("5:1,50:120")), v="20:1,100:120") == {1: 0.25, 120: 0.5}
    assert one(spark, text.retry_after(F.col("v"), F.lit(0)), v="7") == 7
    assert one(spark, text.retry_after(F.col("v"), F.lit(784111767)), v="Sun, 06 Nov 1994 08:49:37 GMT") == 10
    assert one(spark, text.fixed(F.col("v"), 2, True), v=0.1234) == "12.34%" and one(spark, text.fixed(F.col("v")), v=float("nan")) == ""
    assert one(spark, text.stack_name(F.col("v"))["region"], v="EUNE_prod_0a1b2c3d") == "eune"
    assert one(spark, text.stack_name(F.col("v")), v="plain") is None


def test_hashes(spark):
    want = int(hashlib.sha256(b"KR_1").hexdigest()[:16], 16)
    assert int(one(spark, hashing.u64(F.col("v")), v="KR_1")) == want
    assert one(spark, hashing.u64_mod(F.col("v"), 105), v="KR_1") == want % 105
    assert one(spark, hashing.seeded_order(F.col("v"), 42), v="a") == hashlib.sha1(b"42::a").hexdigest()


def test_arrays(spark):
    df = spark.createDataFrame([(["b", "a", None, "", "b"],)], "a array<string>")
    assert df.select(arrays.distinct_in_order(F.col("a"))).first()[0] == ["b", "a"]
    assert one(spark, arrays.json_list(F.col("v")), v="[1,") == [] and one(spark, arrays.json_list(F.col("v")), v='["x"]') == ["x"]
    assert rows(df.select(arrays.one_each(F.array(F.lit("x"), F.lit("y")), ["y", "x"]))) == [(True,)]
