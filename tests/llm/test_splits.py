import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quern.llm.splits import ComponentStore, assign_splits, components, match_links, update_components, workspace
from tests.conftest import rows

LINKS = "node string, h1 bigint, h2 bigint"


def brute(links):
    up = {n: n for n, _, _ in links if n is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    by = {}
    for n, h1, h2 in links:
        if n is not None and h1 is not None:
            by.setdefault((h1, h2), []).append(n)
    for ns in by.values():
        for n in ns[1:]:
            a, b = sorted((root(ns[0]), root(n)))
            up[b] = a
    return sorted(((n, root(n)) for n in up), key=repr)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.one_of(st.none(), st.sampled_from([f"m{i:02}" for i in range(25)])), st.one_of(st.none(), st.integers(0, 12)), st.just(0)), max_size=45))
def test_components(spark, links):
    df = spark.createDataFrame(links, LINKS)
    assert rows(components(df, workspace(spark))) == brute(links)


def test_long_chain_in_random_order(spark):
    names = [f"m{i:03}" for i in range(120)]
    random.Random(3).shuffle(names)
    links = [(n, k, 0) for i, n in enumerate(names) for k in (i, i + 1)]
    assert {c for _, c in rows(components(spark.createDataFrame(links, LINKS), workspace(spark)))} == {"m000"}


def test_hot_link(spark):
    links = [(f"m{i:04}", 1 if i % 3 else i + 10, 0) for i in range(900)]
    assert rows(components(spark.createDataFrame(links, LINKS), workspace(spark))) == brute(links)


def test_participants(spark):
    a, b = "a" * 48, "b" * 48
    data = [("KR_2", a, 1), ("KR_1", f" {a} ", 1), ("KR_3", "BOT", 1), ("KR_4", "BOT", 1), ("KR_5", None, 1), (None, b, 1), ("KR_6", "", 1), ("KR_7", "0" * 48, 1), ("KR_8", "0" * 48, 1), ("KR_2", a, 1)]
    df = spark.createDataFrame(data, "match_id string, puuid string, h1 int")
    got = update_components(None, match_links(df), workspace(spark)).select("node", "component")
    assert rows(got) == [("KR_1", "KR_1"), ("KR_2", "KR_1"), *[(f"KR_{i}", f"KR_{i}") for i in range(3, 9)]]


def test_empty(spark):
    assert rows(components(spark.createDataFrame([], LINKS), workspace(spark))) == []
    t = spark.createDataFrame([], "node string, component string, old string")
    assert rows(assign_splits(t)) == []


def test_old_components_keep_their_split_and_conflicts_are_set_aside(spark):
    known = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "d"), ("e", "d")], "node string, component string")
    splits = spark.createDataFrame([("a", "train"), ("c", "test"), ("d", "test")], "component string, split string")
    links = spark.createDataFrame([("b", 1, 0), ("c", 1, 0), ("f", 2, 0), ("e", 2, 0), ("g", 3, 0)], LINKS)
    now = update_components(known, links, workspace(spark))
    assert rows(now) == sorted([("a", "a", "a"), ("b", "a", "a"), ("c", "a", "c"), ("d", "d", "d"), ("e", "d", "d"), ("f", "d", None), ("g", "g", None)], key=repr)
    got = {r["node"]: r["split"] for r in assign_splits(now, splits).collect()}
    assert {got[n] for n in "abc"} == {"quarantine"} and {got[n] for n in "def"} == {"test"} and got["g"] in ("train", "validation")


def test_proportions(spark):
    data = [(f"n{i}", f"c{i // 3}", None) for i in range(9000)] + [(f"big{i}", "big", None) for i in range(2000)]
    t = spark.createDataFrame(data, "node string, component string, old string")
    s = assign_splits(t).persist()
    counts = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert abs(counts["train"] / 11000 - 0.8) < 0.02 and abs(counts["test"] / 11000 - 0.1) < 0.02
    assert s.groupBy("component").agg({"split": "count"}).count() == s.select("component", "split").distinct().count()
    assert rows(s) == rows(assign_splits(t))
    s.unpersist()


def test_store_in_batches(spark, tmp_path):
    links = [(f"m{i:02}", i // 2, 0) for i in range(30)] + [(f"m{i:02}", (i + 1) // 2 + 100, 0) for i in range(0, 30, 3)]
    random.Random(8).shuffle(links)
    store = ComponentStore(spark, str(tmp_path / "s"))
    assert store.table() is None
    splits: dict = {}
    for k in range(0, len(links), 14):
        now = {r["node"]: (r["component"], r["split"]) for r in store.update(spark.createDataFrame(links[k : k + 14], LINKS)).collect()}
        for node, split in splits.items():
            assert now[node][1] in (split, "quarantine")
        splits = {n: s for n, (_, s) in now.items()}
        assert all(len({s for c, s in now.values() if c == one}) == 1 for one, _ in now.values())
    assert sorted((n, c) for n, (c, _) in now.items()) == brute(links)
    assert ComponentStore(spark, str(tmp_path / "s")).version == store.version


def test_update_in_proportion_to_the_batch(spark, tmp_path):
    """A small batch writes only what it touches, merges old components and keeps their names and splits right."""
    links = [(f"m{i:04}", i // 3, 0) for i in range(600)]
    store = ComponentStore(spark, str(tmp_path / "s"))
    before = {r["node"]: (r["component"], r["split"]) for r in store.update(spark.createDataFrame(links, LINKS)).collect()}
    more = [("m0599", 999, 0), ("m0300", 999, 0), ("a", 999, 0), ("new", 1000, 0), ("m0003", 1, 0), (None, 5, 0), ("alone", None, None), ("m0003", 1, 0)]
    now = {r["node"]: (r["component"], r["split"]) for r in store.update(spark.createDataFrame(more, LINKS)).collect()}
    assert sorted((n, c) for n, (c, _) in now.items()) == brute(links + more)
    assert {n for n in before if now[n] != before[n]} <= {n for n in now if now[n][0] == "a"}
    read = lambda name: spark.read.parquet(f"{tmp_path}/s/v2/{name}")
    assert rows(read("nodes").select("node")) == [("a",), ("alone",), ("new",)] and read("keys").count() == 2
    assert read("renames").count() == 2 and read("groups").count() == 4
    third = store.update(spark.createDataFrame([("0", 7, 0), ("0", 999, 0)], LINKS))
    assert sorted((r["node"], r["component"]) for r in third.collect()) == brute(links + more + [("0", 7, 0), ("0", 999, 0)])
    counts = {r["split"]: r["count"] for r in third.groupBy("split").count().collect()}
    assert counts == {k: n for k, n in store._sums().items() if n}
    assert rows(store.update(spark.createDataFrame([], LINKS))) == rows(third)
