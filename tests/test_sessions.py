from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quern.operators.sessions import chunked_sessions, play_sessions, usable_match_times
from tests.conftest import rows


def brute(events, gap):
    out, by = [], {}
    for k, t in events:
        if t is not None:
            by.setdefault(k, []).append(t)
    for k, ts in by.items():
        ts.sort()
        run = [ts[0]]
        for t in ts[1:]:
            if t - run[-1] <= gap:
                run.append(t)
            else:
                out.append((k, run[0], run[-1], run[-1] - run[0], len(run)))
                run = [t]
        out.append((k, run[0], run[-1], run[-1] - run[0], len(run)))
    return sorted(out, key=repr)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-50, 200))), max_size=60), st.integers(1, 9), st.integers(1, 40))
def test_any_chunks_give_the_same_sessions(spark, events, gap, chunk):
    df = spark.createDataFrame(events, "k string, t bigint")
    assert rows(chunked_sessions(df, ["k"], "t", gap, chunk)) == brute(events, gap)


def test_session_over_many_chunks(spark):
    events = [("a", t) for t in range(0, 1000, 2)] + [("a", 1003), ("a", 1006)]
    df = spark.createDataFrame(events, "k string, t bigint")
    assert rows(chunked_sessions(df, ["k"], "t", 2, 10)) == brute(events, 2)


P = "p" * 48
TIMES = "match_id string, game_creation_utc_ms bigint, updated_at_utc bigint, at_ms string"
HISTORY = "puuid string, match_id string, h1 int, puuid2 string"


def test_times(spark):
    t = [
        ("EUW1_0000000001", 1_500_000_000_123, 1_500_000_001, None),
        (" euw1-0000000001.json", 1_500_000_000, 1_500_000_002, "x"),
        ("EUW1_0000000001", 9_999_999_999_999, 1_500_000_009, None),
        ("KR_0000000002", 1_500_000_000_123_456, 1_500_000_001, None),
        ("KR_0000000003", 1_500_000_000_123_456_789, 1_500_000_001, None),
        ("KR_0000000004", 1_500_000_001_001, 1_500_000_001, None),
        ("KR_0000000005", 1_500_000_001_000, 1_500_000_001, None),
        ("KR_0000000006", 86_400_000, 1_500_000_001, None),
        ("KR_0000000007", None, 1_500_000_001, None),
        ("KR_0000000008", 1_500_000_000_000, None, None),
        (None, 1_500_000_000_000, 1_500_000_001, None),
        ("  ", 1_500_000_000_000, 1_500_000_001, None),
    ]
    assert rows(usable_match_times(spark.createDataFrame(t, TIMES))) == [
        ("EUW1_0000000001", 1_500_000_000_000),
        ("KR_0000000002", 1_500_000_000_123),
        ("KR_0000000003", 1_500_000_000_123),
        ("KR_0000000005", 1_500_000_001_000),
    ]


def test_plays(spark):
    h = [
        (P, "EUW1_0000000001", 1, "a"), (f" {P} ", "matches/euw1_0000000001.json.zst", None, None), (P, "EUW1_0000000002\n", 1, None),
        ("BOT", "EUW1_0000000001", 1, None), (None, "EUW1_0000000001", 1, None), ("0" * 48, "EUW1_0000000001", 1, None), (P, None, 1, None), (P, "EUW1_0000000009", 1, None),
    ]
    t = [("EUW1_0000000001", 1_500_000_000_000, 1_600_000_000, None), ("EUW1_0000000002", 1_500_007_200_000, 1_600_000_000, None)]
    s = play_sessions(spark.createDataFrame(h, HISTORY), spark.createDataFrame(t, TIMES))
    assert rows(s) == [(P, 1_500_000_000_000, 1_500_007_200_000, 7_200_000, 2)]


def test_empty_tables(spark):
    h, t = spark.createDataFrame([], HISTORY), spark.createDataFrame([], TIMES)
    assert rows(play_sessions(h, t)) == []
    assert rows(chunked_sessions(spark.createDataFrame([], "k string, t bigint"), ["k"], "t", 5)) == []
