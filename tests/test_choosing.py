import random

from pyspark.sql import functions as F

from quern.operators import choosing, relations
from tests.conftest import rows


def test_apportion(spark):
    g = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3)], "k string, n int")
    quota = lambda t: {r["k"]: r["quota"] for r in choosing.apportion(g, "n", t, [F.col("k")]).collect()}
    assert quota(10) == {"a": 4, "b": 3, "c": 3}
    assert quota(99) == {"a": 5, "b": 3, "c": 3} and quota(0) == quota(-3) == {"a": 0, "b": 0, "c": 0}


def test_weighted_pick_needs_known_weights(spark):
    d = spark.createDataFrame([("g", 1, 35), ("g", 2, 35), ("g", 3, 30), ("h", 1, 5), ("h", 2, None)], "k string, i int, w int")
    got = rows(choosing.weighted_pick(d, ["k"], "w", ["i"], F.col("k")))
    assert len(got) == 1 and got[0][0] == "g"
    many = spark.range(3000).select(F.col("id").cast("string").alias("k")).crossJoin(d.where("k = 'g'").select("i", "w"))
    n = {r["i"]: r["count"] for r in choosing.weighted_pick(many, ["k"], "w", ["i"], F.col("k")).groupBy("i").count().collect()}
    assert sum(n.values()) == 3000 and abs(n[3] / 3000 - 0.3) < 0.03


def test_sources(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2)], "k string, v int")
    b = spark.createDataFrame([("x", 9), ("y", 8)], "k string, v int")
    got = choosing.coalesce_sources([("a", a), ("b", b)], ["k"]).select("k", "v", "source")
    assert rows(got) == [("x", 1, "a"), ("y", 8, "b")]
    assert rows(choosing.first_filled_source([a.limit(0), b])) == rows(b)


def test_first_and_last(spark):
    d = spark.createDataFrame([("x", 1, "a"), ("x", 2, None), ("y", None, "c"), (None, 3, "d")], "k string, t int, v string")
    assert rows(choosing.last_wins(d, ["k"], [F.col("t")])) == sorted([("x", 2, None), ("y", None, "c"), (None, 3, "d")], key=repr)
    kept, counts = choosing.first_wins(d, ["k"], ["t"])
    assert kept.count() == 3 and rows(counts) == [(3, 1)]


def test_split_and_row_ids(spark):
    ids = list(range(1000))
    random.Random(1).shuffle(ids)
    d = spark.createDataFrame([(i,) for i in ids], "i int").repartition(7)
    assert [r["n"] for r in relations.with_row_id(d, ["i"], "n").orderBy("i").collect()] == list(range(1000))
    s = choosing.sequential_split(d, "i")
    assert s.where("is_train").agg(F.max("i"), F.count("*")).first() == (749, 750)


def test_folds_are_exact_in_each_stratum(spark):
    d = spark.range(103).select(F.col("id"), (F.col("id") % 2).alias("s"))
    f = choosing.stratified_folds(d, ["s"], F.sha1(F.col("id").cast("string")), 5, 0.1)
    for r in f.groupBy("s", "fold").count().collect():
        assert r["count"] in (10, 11)
    assert {r["count"] for r in f.where("is_test").groupBy("s").count().collect()} == {5}


def test_caps_and_spill(spark):
    d = spark.createDataFrame([(i, "ab"[i % 2], float(i)) for i in range(20)], "i int, t string, lp double")
    c = choosing.capped_by_order(d, [F.desc("lp"), F.asc("i")], [("top", 2), ("next", 3)], "rest")
    assert {r["label"]: r["count"] for r in c.groupBy("label").count().collect()} == {"top": 2, "next": 3, "rest": 15}
    q = choosing.quota_with_spill(d, "t", {"a": 2}, 5, [F.desc("lp")])
    assert rows(q.select("i", "picked_as")) == [(13, "spill"), (15, "spill"), (16, "quota"), (17, "spill"), (18, "quota"), (19, "spill")][1:] or q.count() == 5


def test_prefixes(spark):
    d = spark.createDataFrame([("EUW1_2",), ("EU_2",), ("X",), (None,)], "id string")
    p = spark.createDataFrame([("EU", "a"), ("EUW", "b")], "p string, v string")
    assert rows(relations.longest_prefix(d, "id", p, "p", "v", ["id"])) == sorted([("EUW1_2", "b"), ("EU_2", "a"), ("X", None), (None, None)], key=repr)


def test_sets(spark):
    a, b = spark.range(5), spark.range(3, 8)
    assert not relations.equal_sets(a, b) and relations.equal_sets(a, spark.range(5))
    assert [r["status"] for r in relations.compare_sets(a, b, "id").orderBy("id").collect()] == ["missing"] * 3 + ["shared"] * 2 + ["extra"] * 3


def test_health_alignment_and_children(spark):
    from quern.operators.audit import document_health

    r = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x"]), ("c", ["x"]), ("d", None)], "k string, members array<string>")
    d = spark.createDataFrame([("a", "a", ["y", "x", "x"], 5, False), ("b", "z", ["x"], 0, False), ("d", "d", None, None, True)], "k string, doc_key string, members array<string>, created bigint, load_error boolean")
    got = {x["k"]: (x["complete"], x["file_present"], x["id_agrees"]) for x in document_health(r, d, "k", "members", 2).collect()}
    assert got == {"a": (True, True, True), "b": (False, True, False), "c": (False, False, False), "d": (False, True, True)}
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (5, 1.0)], "i int, v double")
    b = spark.createDataFrame([(1, 1.0), (2, 2.5), (3, None), (4, 1.0)], "i int, v double")
    assert rows(relations.alignment(a, b, "i", "v")) == [(1, 1, 1)]
    kids = spark.createDataFrame([("p", 1), ("p", 2), ("q", 3)], "k string, c int")
    assert rows(relations.replace_children(kids, spark.createDataFrame([("p", 9)], "k string, c int"), "k")) == [("p", 9), ("q", 3)]


def test_repeated_rows_have_one_place_each(spark):
    """Equal rows: as many rows out as in, caps kept, whatever the order of input."""
    data = [(7, 100.0), (7, 100.0), (7, 100.0), (8, 50.0), (8, 50.0), (None, None)]
    for rows_in in (data, data[::-1]):
        d = spark.createDataFrame(rows_in, "i int, lp double")
        got = rows(choosing.capped_by_order(d, [F.desc("lp"), F.asc("i")], [("top", 2), ("next", 2)], "rest"))
        assert got == sorted([(7, 100.0, "top"), (7, 100.0, "top"), (7, 100.0, "next"), (8, 50.0, "next"), (8, 50.0, "rest"), (None, None, "rest")], key=repr)


def test_repeated_rows_in_every_choice(spark):
    d = spark.createDataFrame([("a", 1, 2), ("a", 1, 2), ("b", 5, 1), ("b", 5, 1), (None, 3, 3), (None, 3, 3)], "k string, v int, w int")
    once = sorted([("a", 1, 2), ("b", 5, 1), (None, 3, 3)], key=repr)
    assert rows(choosing.best_of_group(d, ["k"], [F.desc("v")])) == once
    assert rows(choosing.best_struct(d, ["k"], [F.col("v")])) == once and rows(choosing.last_wins(d, ["k"], [F.col("v")])) == once
    kept, counts = choosing.first_wins(d, ["k"], [F.col("v")])
    assert rows(kept) == once and rows(counts) == [(3, 3)]
    assert rows(choosing.coalesce_sources([("x", d), ("y", d)], ["k"]).select("k", "v", "w")) == once
    ranked = choosing.winners_and_losers(d, ["k"], [F.desc("v")], [F.desc("v")])
    assert rows(ranked.groupBy("k").agg(F.sum("rank"), F.count_if("tied"))) == sorted([("a", 3, 2), ("b", 3, 2), (None, 3, 2)], key=repr)
    assert choosing.weighted_pick(d, ["k"], "w", ["v"], F.col("v")).count() == 3
    assert choosing.hash_top_k(d, ["k"], 1, F.col("v"), ["w"]).count() == 3
    assert choosing.stratified_slice(d, ["k"], F.col("v"), 4, [F.col("w")]).where("k is not null").count() <= 4
    picked = choosing.quota_with_spill(d, "k", {"a": 1}, 3, [F.desc("v"), F.asc("w")])
    assert picked.count() == 3 and picked.where("picked_as = 'quota'").count() == 1
    assert choosing.band_fallthrough(d.where("k is not null"), ["k"], F.col("v")).count() == 4
    assert rows(choosing.stratified_folds(d, ["k"], F.col("v"), 2).groupBy("k").agg(F.count_distinct("fold"))) == sorted([("a", 2), ("b", 2), (None, 2)], key=repr)
    assert choosing.seeded_sample(d, "v", 1, 4).count() == 4
    ids = d.withColumn("id", F.col("v"))
    assert rows(choosing.first_per_signature(ids.where("k is not null"), "k", "id").select("k", "duplicate_of").distinct()) == [("a", None), ("b", None)]
    assert choosing.sequential_split(d.where("k is not null"), "v").where("is_train").count() == 3


def test_streaks_over_partitions(spark):
    import itertools
    import random

    r = random.Random(4)
    data = [(r.choice("aab") if i % 50 else None, i, r.choice([1, 1, 1, 2, None])) for i in range(3000)] + [("hot", 5000 + i, 1) for i in range(2000)]
    want = []
    for k, own in itertools.groupby(sorted(data, key=lambda x: (x[0] is not None, x[0] or "", x[1])), key=lambda x: x[0]):
        for n, (v, run) in enumerate(itertools.groupby(own, key=lambda x: x[2]), 1):
            want.append((k, v, len(list(run)), n))
    df = spark.createDataFrame(data, "k string, at int, v int").repartition(7)
    assert rows(choosing.streaks(df, ["k"], ["at"], "v")) == sorted(want, key=repr)
    assert rows(choosing.streaks(df.limit(0), ["k"], ["at"], "v")) == []
