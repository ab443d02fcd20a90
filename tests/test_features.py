import json

import pytest

from quern.operators.features import MATCH_SCHEMA, POSITIONS, drop_reason, feature_columns, match_features
from quern.sources.files import csv_ids, json_lines, json_map, match_files, sources_with
from quern.sources.sinks import create_table, export_csv, manifest, replace_partitions, reusable, stage
from tests.conftest import rows


def document(match_id="KR_0000000001", **info):
    players = [
        {"puuid": f"p{t}{i}", "teamId": t, "teamPosition": p, "win": t == 100, "kills": i + (3 if t == 100 else 0), "goldEarned": 1000 * (i + 1), "firstBloodKill": t == 200 and i == 1,
         "challenges": {"soloKills": i, "earliestBaron": 100 * i, "earliestDragonTakedown": 50 * i, "turretsTakenWithRiftHerald": 5 if t == 100 else 0, "riftHeraldTakedowns": i % 2, "fistBumpParticipation": 1}}
        for t in (100, 200) for i, p in enumerate(POSITIONS)
    ]
    teams = [{"teamId": t, "objectives": {"dragon": {"kills": 3 if t == 100 else 1, "first": t == 200}}} for t in (100, 200)]
    base = {"gameDuration": 1200, "gameStartTimestamp": 1_700_000_000_000, "gameVersion": "14.2.1.9", "queueId": 420, "mapId": 11, "participants": players, "teams": teams}
    return {"metadata": {"matchId": match_id}, "info": {**base, **info}}


def read(spark, tmp_path, docs):
    (tmp_path / "f_prod_x").mkdir(exist_ok=True)
    (tmp_path / "f_prod_x" / "matches").mkdir(exist_ok=True)
    for name, d in docs.items():
        (tmp_path / "f_prod_x" / "matches" / name).write_bytes(d if isinstance(d, bytes) else json.dumps(d).encode())
    return match_files(spark, str(tmp_path))


def test_columns(spark, tmp_path):
    names = feature_columns()
    assert len(names) == len(set(names)) == 475
    f = match_features(read(spark, tmp_path, {"KR_0000000001.json": document()}))
    assert f.columns == names
    r = f.first().asDict()
    assert all(v is not None for v in r.values())
    assert (r["match_id"], r["patch"], r["server"], r["source_folder"]) == ("KR_0000000001", "14.2", "KR", "f_prod_x")
    assert r["top_kills_pm_avg"] == pytest.approx((3 + 0) / 20 / 2) and r["top_kills_pm_delta"] == pytest.approx(3 / 20)
    assert r["jungle_first_blood_delta"] == -1 and r["jungle_gold_share_avg"] == pytest.approx(2 / 15)
    assert r["winner_earliest_baron"] == 400 and r["winner_earliest_dragon_takedown"] == 50
    assert r["turrets_taken_with_rift_herald_delta"] == 1 and r["first_dragon_delta"] == -1
    assert r["team_dragon_kills_pm_avg"] == pytest.approx(0.1) and r["fist_bump_participation_match_avg"] == 1


def test_reasons(spark, tmp_path):
    d = document()["info"]
    cases = {
        "ok": document(), "missing_info_or_metadata": {"metadata": {"matchId": "x"}}, "participant_count_not_10": document(participants=d["participants"][:9]),
        "invalid_team_payload": document(teams=d["teams"][:1]), "invalid_team_positions": document(participants=[{**p, "teamPosition": "TOP"} for p in d["participants"]]),
        "invalid_win_flags": document(participants=[{**p, "win": True} for p in d["participants"]]), "invalid_duration": document(gameDuration=0, gameStartTimestamp=0),
    }
    m = read(spark, tmp_path, {f"{k}.json": v for k, v in cases.items()})
    got = {r["source_file"][:-5]: r["r"] for r in m.select("source_file", drop_reason().alias("r")).collect()}
    assert got == {k: k for k in cases}
    late = document(gameDuration=0, gameEndTimestamp=1_700_000_900_000)
    assert match_features(read(spark, tmp_path, {"late.json": late})).where("source_file = 'late.json'").first()["game_duration_sec"] == 900


def test_files(spark, tmp_path):
    import zstandard

    packed = zstandard.ZstdCompressor().compress(json.dumps(document("KR_2")).encode())
    m = read(spark, tmp_path, {"a.json": document("KR_1"), "a.json.zst": packed, "bad.json": b'{"info": ', "b.json": document("KR_3")})
    got = {r["source_file"]: (r["metadata"] and r["metadata"]["matchId"], r["load_error"]) for r in m.collect()}
    assert got == {"a.json.zst": ("KR_2", False), "bad.json": (None, True), "b.json": ("KR_3", False)}


def test_small_sources(spark, tmp_path):
    (tmp_path / "ids.csv").write_text("id,x\n3,a\n4,b\n")
    assert rows(csv_ids(spark, str(tmp_path / "ids.csv"), "id", "bigint")) == [(3,), (4,)]
    (tmp_path / "twice.csv").write_text("id\n3\n3\n")
    with pytest.raises(ValueError, match="repeats"):
        csv_ids(spark, str(tmp_path / "twice.csv"), "id")
    with pytest.raises(ValueError, match="no column"):
        csv_ids(spark, str(tmp_path / "ids.csv"), "y")
    (tmp_path / "m.json").write_text('{"k": ["a", "b"], "e": []}')
    assert rows(json_map(spark, str(tmp_path / "m.json"), "k", "v")) == [("k", "a"), ("k", "b")]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert rows(json_lines(spark, str(tmp_path / "l.jsonl"), "a int")) == [(1,), (2,)]
    have = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "a")], "source string, file string")
    assert rows(sources_with(have, ["a", "b"])) == [("s", True, []), ("t", False, ["b"])]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, "x"), (2, "y")], "k int, p string")
    assert rows(create_table(d, str(tmp_path / "t"), ["k"], ["p"])) == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError, match="repeated"):
        create_table(d.union(d), str(tmp_path / "t"), ["k"])
    replace_partitions(spark.createDataFrame([(9, "y")], "k int, p string"), str(tmp_path / "t"), ["p"])
    assert rows(spark.read.parquet(str(tmp_path / "t"))) == [(1, "x"), (9, "y")]
    calls = []
    for _ in range(2):
        t, _ = stage(spark, str(tmp_path), "s", "abc", lambda: calls.append(1) or d)
    assert rows(t) == rows(d) and calls == [1] and reusable(spark, str(tmp_path / "t")) and not reusable(spark, str(tmp_path / "none"))
    export_csv(d, str(tmp_path / "c"))
    files = spark.read.format("binaryFile").load(str(tmp_path / "c") + "/*.csv")
    assert manifest(files).where("length(sha256) = 64 and bytes > 0").count() == files.count()


def test_pages(spark, tmp_path):
    from quern.sources.files import PageSource

    (tmp_path / "0.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "2.json").write_text("[broken")
    (tmp_path / "4.json").write_text('[{"a": 5}]')
    spark.dataSource.register(PageSource)
    d = spark.read.format("paged_json").option("path", str(tmp_path)).option("total", "6").option("count", "2").load()
    assert rows(d.where("error is null").drop("error")) == [(0, '{"a": 1}'), (0, '{"a": 2}'), (4, '{"a": 5}')]
    assert rows(d.where("error is not null").select("start", "row")) == [(2, None)]
