import itertools

from pyspark.sql import functions as F

from quern.llm.survivors import survive_fields, surviving_bundle
from tests.conftest import rows

OCC = "match_id string, bundle string, worth string"
HEAD = "match_id string, bundle string, valid_for_pipeline int, participant_count int, fetched_at_utc bigint, listed int"


def found(spark, occ, head):
    return rows(surviving_bundle(spark.createDataFrame(occ, OCC), spark.createDataFrame(head, HEAD)))


def test_order_of_preference(spark):
    occ = [("KR_1", b, None) for b in "abc"]
    worse = [("KR_1", "a", 0, 99, 99, 1), ("KR_1", "b", 1, 9, 99, 1), ("KR_1", "b", None, 10, 1, 1), ("KR_1", "c", 1, 10, 1, None)]
    for order in itertools.permutations(worse):
        assert found(spark, occ, list(order)) == [("KR_1", "c", 3)]


def test_ties_nulls_and_caps(spark):
    occ = [("KR_1", "b", None), ("KR_1", "a", None)]
    assert found(spark, occ, []) == [("KR_1", "a", 2)]
    assert found(spark, occ, [("KR_1", "b", None, None, None, 1)]) == [("KR_1", "b", 2)]
    assert found(spark, occ, [("KR_1", "a", 1, 12, 5, 1), ("KR_1", "b", 1, 10, 5, 1)]) == [("KR_1", "a", 2)]
    assert found(spark, occ, [("KR_1", "a", 1, 0, 5, 1), ("KR_1", "b", 1, None, 6, 1)]) == [("KR_1", "b", 2)]
    assert found(spark, occ, [("KR_1", "a", 1, 10, None, 1), ("KR_1", "b", 1, 10, 0, 1)]) == [("KR_1", "b", 2)]
    assert found(spark, occ, [("KR_1", "z", 1, 10, 9, 1)]) == [("KR_1", "a", 2)]


def test_spelling_repeats_and_blanks(spark):
    occ = [("kr_1", " X_1/", None), ("KR-1.json", "./x_1", None), ("KR_1", None, None), (None, "x_1", None), ("KR_1", " ", None)]
    assert found(spark, occ, []) == []
    assert found(spark, [*occ, ("KR_1", "prod/Y_1/", None)], [("KR_1", "y_1", 1, 10, 1, 1)]) == [("KR_1", "y_1", 2)]
    assert found(spark, [], []) == []


def test_fields(spark):
    data = [("k", None, "old", 1, 5, "z"), ("k", 7, "new", 1, 9, "z"), ("k", None, "best", 2, 1, None), ("e", None, None, 1, 1, None), (None, 1, None, 1, 1, None)]
    df = spark.createDataFrame(data, "k string, a int, b string, p int, t int, value string")
    got = survive_fields(df, ["k"], ["a", "b"], [F.col("p")], F.col("t"))
    assert rows(got) == sorted([("k", 7, "best"), ("e", None, None), (None, 1, None)], key=repr)
    assert rows(survive_fields(df.limit(0), ["k"], ["a"], [F.col("p")], F.col("t"))) == []
