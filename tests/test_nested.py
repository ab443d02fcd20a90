import json

from quern.operators.nested import bridge, documents_in, match_children, objects, rebuild, roots, shred, unwrapped
from tests.conftest import rows

SCHEMA = "record_id bigint, payload string, source_file string, hash string, role string"
DOC = {
    "metadata": {"matchId": "KR_0000000001"},
    "info": {
        "gameVersion": "14.2.3", "queueId": "420",
        "participants": [{"puuid": " p1 ", "challenges": {"a": 1, "b": None, "c": {"d": 1}}}, None, {"puuid": None, "challenges": None}, {"challenges": "x"}],
        "teams": [{"teamId": 100, "objectives": {"baron": {"kills": 1}, "dragon": None}}, {"teamId": 200, "objectives": None}],
    },
}
WANT = {
    ("participant", 0, "p1"), ("challenge", 0, "a"), ("challenge", 0, "c"), ("participant", 2, ""), ("participant", 3, ""),
    ("team", 0, "100"), ("objective", 0, "baron"), ("team", 1, "200"),
}


def nodes(spark, payloads, file="KR_0000000009.json.zst"):
    data = [(i, p, file, "x", "y") for i, p in enumerate(payloads)]
    return shred(spark.createDataFrame(data, SCHEMA), "record_id", "payload", "source_file")


def test_layouts(spark):
    t = json.dumps(DOC)
    packed = [t, f"﻿{t}", json.dumps(t), json.dumps([DOC, DOC]), json.dumps({"count": 1, "matches": [DOC]}), json.dumps({"batch": 3, "payload": {"x": t}})]
    got = rows(match_children(nodes(spark, packed)))
    assert {(r[3], r[4], r[5]) for r in got} == WANT and {r[:3] for r in got} == {("KR_0000000001", "14.2", 420)}
    by_key = json.loads(t)
    by_key["info"]["participants"] = {str(i): p for i, p in enumerate(DOC["info"]["participants"])}
    assert rows(match_children(nodes(spark, [json.dumps(by_key)]))) == got


def test_absent_parts(spark):
    payloads = [json.dumps(x) for x in ({"info": {"participants": [{}], "teams": None}}, {"metadata": {"matchId": ""}, "info": {"gameVersion": None, "queueId": None, "participants": [{"puuid": 7}]}})]
    assert rows(match_children(nodes(spark, payloads))) == [("KR_0000000009", "", 0, "participant", 0, ""), ("KR_0000000009", "", 0, "participant", 0, "7")]


def test_unreadable(spark):
    bad = [None, "", "  ", "null", "[]", "{}", "3", '{"info": {"participants": [', json.dumps({"info": None}), json.dumps({"metadata": {}}), "[" * 5000, '"' + "x" * 100_000 + '"']
    assert rows(match_children(nodes(spark, bad))) == []
    assert nodes(spark, []).count() == 0


def test_round_trip_and_sharing(spark):
    odd = {"info": {"a": [1, [2, {"z": None}], {"z": None}], "e": [], "o": {}, "f": 1.5, "t": True, "s": "x\u0000é", "big": 10**20}}
    n = nodes(spark, [json.dumps(DOC), json.dumps(odd), json.dumps(odd)]).persist()
    table = {bytes(r["hash"]): (r["fields"], [tuple(p) for p in r["parts"]]) for r in objects(n).collect()}
    back = {r["record_id"]: rebuild(bytes(r["hash"]), table) for r in roots(n).collect()}
    assert back[1] == odd and back[2] == odd
    want = json.loads(json.dumps(DOC))
    assert back[0] == want
    assert len({bytes(r["hash"]) for r in roots(n).collect()}) == 2
    assert objects(n, "$.info.a").count() == 1 and bridge(n, "$.info").where("field = 'a'").count() == 3
    n.unpersist()


def test_field_order_and_whole_floats_do_not_matter(spark):
    n = nodes(spark, ['{"info": {"a": 1, "b": 2}}', '{"info": {"b": 2.0, "a": 1.0}}'])
    assert len({bytes(r["hash"]) for r in roots(n).collect()}) == 1


def test_any_depth_of_wrapping():
    x = {"info": {}}
    for _ in range(500):
        x = {"w": x}
    assert list(documents_in(x, "info")) == [{"info": {}}]
    for k in range(20):
        x = json.dumps(x) if k % 5 == 0 else [[x]]
    assert list(documents_in(x, "info")) == [{"info": {}}]


def test_deep_documents_and_those_too_deep(spark):
    inner: object = 1
    for _ in range(600):
        inner = {"d": inner}
    deep = json.dumps({"metadata": {"matchId": "KR_0000000005"}, "info": {"gameVersion": "1.2.3", "x": inner, "participants": [{"puuid": "p"}]}})
    too_deep = '{"info": {"x": ' + "[" * 200_000 + "]" * 200_000 + "}}"
    n = nodes(spark, [deep, too_deep, None, "{broken"]).persist()
    assert rows(match_children(n)) == [("KR_0000000005", "1.2", 0, "participant", 0, "p")]
    assert rows(n.where("kind = 'unreadable'").select("record_id", "context")) == [(1, "KR_0000000009.json.zst")]
    n.unpersist()


def test_texts_that_look_like_separators(spark):
    """Objects whose joined texts would be the same are told apart."""
    pairs = [({"a": "x\u0000sy", "b": "z"}, {"a": "x", "b": "y\u0000sz"}), ({"a": "1\u0001"}, {"a": "1"}), ({"a\u0000b": 1, "c": 2}, {"a": 1, "b\u0000c": 2}), ({"a": "x", "p": [1]}, {"a": "x[('p', 0, None, 'n1')]"}), ({}, {"": ""})]
    n = nodes(spark, [json.dumps({"info": x}) for pair in pairs for x in pair])
    assert len({bytes(r["hash"]) for r in roots(n).collect()}) == 2 * len(pairs)


def test_unwrapped(spark):
    spelled = {**DOC, "info": {**DOC["info"], "participants": {str(i): x for i, x in enumerate(DOC["info"]["participants"])}}}
    plain = json.dumps(DOC)
    wraps = [plain, json.dumps({"response": {"body": DOC}}), json.dumps(plain), json.dumps([DOC, {"match": DOC}]), json.dumps(spelled), "{broken", None, '{"metadata": {"matchId": "x"}}']
    df = spark.createDataFrame([(i, w) for i, w in enumerate(wraps)], "n int, payload string")
    got = unwrapped(df, "payload").collect()
    docs = {n: [json.loads(r["payload"]) for r in got if r["n"] == n] for n in range(5)}
    assert docs == {0: [DOC], 1: [DOC], 2: [DOC], 3: [DOC, DOC], 4: [DOC]}
    assert [[r["payload"] for r in got if r["n"] == n] for n in (0, 5, 6, 7)] == [[plain], ["{broken"], [None], [wraps[7]]]


def test_features_of_wrapped_documents(spark, tmp_path):
    from quern.plans.domain_queries import QUERIES

    records = [(json.dumps(DOC), "a", "1"), (json.dumps({"response": DOC}), "a", "2"), (json.dumps(json.dumps(DOC)), "a", "3"), ("{}", "a", "4")]
    spark.createDataFrame(records, "payload string, source_folder string, source_file string").write.parquet(f"{tmp_path}/raw_match_docs.parquet")
    assert rows(QUERIES["f_match_reasons"](spark, str(tmp_path))) == [("missing_info_or_metadata", 1), ("participant_count_not_10", 3)]


def test_marked_and_padded_payloads_are_read(spark):
    plain = json.dumps(DOC)
    df = spark.createDataFrame([(0, "\ufeff" + plain), (1, "  " + plain + "\n")], "n int, payload string")
    assert [json.loads(r["payload"]) for r in unwrapped(df, "payload").collect()] == [DOC, DOC]
