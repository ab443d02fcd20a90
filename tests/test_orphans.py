from pyspark.sql import functions as F

from quern.operators.orphans import match_reference_orphans, orphan_counts, orphans_by_period
from tests.conftest import rows

A, B, C = "a" * 48, "b" * 48, "c" * 48
PAIRS, RANKS = "match_id string, puuid string, key string", "puuid string, fetched_at_utc bigint, match_id int"
HEADS, LABELS = "match_id string, fetched_at_utc bigint, game_creation_utc_ms bigint, month string", "match_id string, mapped_participants int, mapped string"
DAY = 86_400


def find(spark, pairs, ranks, heads, labels):
    tables = [spark.createDataFrame(d, s) for d, s in ((pairs, PAIRS), (ranks, RANKS), (heads, HEADS), (labels, LABELS))]
    return match_reference_orphans(*tables)


def test_cases(spark):
    pairs = [("KR_1", A, None), ("KR_1", f" {A}\r\n", "x"), ("KR_1", B, None), ("KR_2", A, None), ("KR_1", "BOT", None), ("KR_1", None, None), ("KR_1", " ", None), (None, C, None), ("KR_3", A, None)]
    ranks = [(A, 100 * DAY, 1), (A, 90 * DAY, None), (C, None, 1), (C, 5_000_000, 1), ("BOT", 1, 1), (None, 1, 1)]
    heads = [("KR_1", 80 * DAY, 1_700_000_000_000, None), ("KR_1", 81 * DAY, 0, None), ("KR_3", None, None, None), (None, 1, 1, None)]
    labels = [("KR_1", 2, None), ("KR_1", None, None), ("KR_3", 1, None), ("KR_9", 3, None), ("KR_9", 3, None), (None, 9, None)]
    got = find(spark, pairs, ranks, heads, labels)
    assert rows(got) == sorted(
        [
            ("match_participants.match_id", "KR_2", "", "missing", "unknown"),
            ("match_participants.puuid", "KR_1", B, "missing", "2023-11"),
            ("match_participants.puuid", "KR_1", A, "late", "2023-11"),
            ("player_ranks.puuid", "", C, "missing", "1970-02"),
            ("skill_targets.match_id", "KR_9", "", "missing", "unknown"),
            ("skill_targets.mapped_participants", "KR_1", "", "overcount", "2023-11"),
            ("skill_targets.mapped_participants", "KR_9", "", "overcount", "unknown"),
        ],
        key=repr,
    )
    assert sum(r["orphans"] for r in orphans_by_period(got).collect()) == 7


def test_late_limits(spark):
    heads = [("KR_1", 0, 1_700_000_000_000, None)]
    for fetched, late in ((604_800, False), (604_801, True)):
        got = find(spark, [("KR_1", A, None)], [(A, fetched, 1)], heads, [])
        assert (len(rows(got)) == 1) is late
    assert rows(find(spark, [("KR_1", A, None)], [(A, 10**9, 1), (A, None, 1)], heads, [])) == []


def test_empty_tables(spark):
    assert rows(find(spark, [], [], [], [])) == []
    assert rows(find(spark, [("KR_1", A, None)], [], [], [])) == [("match_participants.match_id", "KR_1", "", "missing", "unknown"), ("match_participants.puuid", "KR_1", A, "missing", "unknown")]


def test_counts(spark):
    kids = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (None, "x"), (3, "y")], "k int, period string")
    olds = spark.createDataFrame([(3,), (None,)], "k int")
    got = orphan_counts([("t", kids, F.col("k"), F.col("period"))], [("t", olds, F.col("k"))])
    assert rows(got) == [("t", "unknown", 1, 1), ("t", "x", 2, 1)]
