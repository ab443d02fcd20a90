"""Wide feature rows generated from specifications: averages and differences of two sides by position.

Two forms: `wide_from_long` pivots rows (match, side, position, metrics) with one aggregation, `match_features` works
within each nested match document and needs no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructField, StructType

from quern.functions.clock import duration_s, local_time_columns
from quern.functions.numeric import flag, safe_div
from quern.functions.text import id_of_file, patch_of, prefix_or_whole
from quern.operators.audit import first_reason

# Positions as written in documents, and in column names.
POSITIONS = {"TOP": "top", "JUNGLE": "jungle", "MIDDLE": "middle", "BOTTOM": "bottom", "UTILITY": "support"}
# Metric name and the document field that is divided by the minutes played.
PER_MINUTE = {
    "gold": "goldEarned", "xp": "champExperience", "lane_cs": "totalMinionsKilled", "jungle_cs": "neutralMinionsKilled", "kills": "kills", "deaths": "deaths",
    "assists": "assists", "dmg_to_champs": "totalDamageDealtToChampions", "dmg_taken": "totalDamageTaken", "vision": "visionScore", "heal": "totalHeal",
    "damage_mitigated": "damageSelfMitigated", "total_time_spent_dead": "totalTimeSpentDead", "wards_placed": "wardsPlaced", "wards_killed": "wardsKilled",
    "control_wards": "detectorWardsPlaced", "cc_time": "timeCCingOthers", "damage_to_objectives": "damageDealtToObjectives",
    "damage_to_turrets": "damageDealtToTurrets", "turret_takedowns": "turretTakedowns", "dragon_kills": "dragonKills",
    "enemy_missing_pings": "enemyMissingPings", "need_vision_pings": "needVisionPings",
}
# The ping counters that make up total_pings.
PINGS = ("allIn", "assistMe", "basic", "command", "danger", "enemyMissing", "enemyVision", "getBack", "hold", "needVision", "onMyWay", "push", "retreat", "visionCleared")
# Share name, fields of the player summed, field of the team.
SHARES = {
    "dmg_taken": (("totalDamageTaken",), "totalDamageTaken"), "kp": (("kills", "assists"), "kills"),
    "damage": (("totalDamageDealtToChampions",), "totalDamageDealtToChampions"), "vision": (("visionScore",), "visionScore"),
    "gold": (("goldEarned",), "goldEarned"), "control_wards": (("detectorWardsPlaced",), "detectorWardsPlaced"),
}
JUNGLE_PER_MINUTE = {"objectives_stolen": "objectivesStolen", "enemy_jungle_cs": "totalEnemyJungleMinionsKilled"}
FLAGS = {"first_blood": ("firstBloodKill", "firstBloodAssist"), "first_tower": ("firstTowerKill", "firstTowerAssist")}
ALL = tuple(POSITIONS)
# Column name, challenge, positions; names ending in _pm are divided by the minutes played.
CHALLENGES = (
    ("teleport_takedowns_pm", "teleportTakedowns", ("TOP", "MIDDLE")),
    ("lane_minions_first_10_minutes", "laneMinionsFirst10Minutes", ("TOP", "MIDDLE", "BOTTOM")),
    ("turret_plates_taken", "turretPlatesTaken", ALL),
    ("k_turrets_destroyed_before_plates_fall", "kTurretsDestroyedBeforePlatesFall", ALL),
    ("kills_near_enemy_turret_pm", "killsNearEnemyTurret", ALL),
    ("enemy_champion_immobilizations_pm", "enemyChampionImmobilizations", ALL),
    ("effective_heal_and_shielding_pm", "effectiveHealAndShielding", ALL),
    ("solo_kills_pm", "soloKills", ALL),
    ("kills_under_own_turret_pm", "killsUnderOwnTurret", ALL),
    ("wards_guarded_pm", "wardsGuarded", ALL),
    ("control_ward_time_coverage_in_river_or_enemy_half", "controlWardTimeCoverageInRiverOrEnemyHalf", ALL),
    ("two_wards_one_sweeper_count_pm", "twoWardsOneSweeperCount", ("JUNGLE", "UTILITY")),
    ("baron_takedowns", "baronTakedowns", ALL),
    ("dragon_takedowns_pm", "dragonTakedowns", ALL),
    ("jungle_scuttle_crab_kills_pm", "scuttleCrabKills", ("JUNGLE",)),
    ("jungle_jungler_kills_early_jungle", "junglerKillsEarlyJungle", ("JUNGLE",)),
    ("jungle_kills_on_laners_early_jungle_as_jungler", "killsOnLanersEarlyJungleAsJungler", ("JUNGLE",)),
    ("jungle_cs_before_10_minutes", "jungleCsBefore10Minutes", ("JUNGLE",)),
    ("jungle_initial_buff_count", "initialBuffCount", ("JUNGLE",)),
    ("jungle_initial_crab_count", "initialCrabCount", ("JUNGLE",)),
    ("jungle_epic_monster_kills_near_enemy_jungler_pm", "epicMonsterKillsNearEnemyJungler", ("JUNGLE",)),
    ("jungle_epic_monster_kills_within_30_seconds_of_spawn_pm", "epicMonsterKillsWithin30SecondsOfSpawn", ("JUNGLE",)),
)
# Team objectives in documents, and in column names.
OBJECTIVES = {"baron": "baron", "dragon": "dragon", "riftHerald": "rift_herald", "tower": "tower", "inhibitor": "inhibitor", "horde": "grubs"}

_NUMBERS = sorted({*PER_MINUTE.values(), *JUNGLE_PER_MINUTE.values(), *(f"{p}Pings" for p in PINGS)})
MATCH_SCHEMA = (
    "metadata struct<matchId:string>, info struct<gameDuration:double,gameStartTimestamp:bigint,gameEndTimestamp:bigint,gameCreation:bigint,"
    "gameVersion:string,queueId:int,mapId:int,participants:array<struct<puuid:string,teamId:int,teamPosition:string,win:boolean,"
    + ",".join(f"{n}:double" for n in _NUMBERS)
    + ",firstBloodKill:boolean,firstBloodAssist:boolean,firstTowerKill:boolean,firstTowerAssist:boolean,challenges:map<string,double>>>,"
    "teams:array<struct<teamId:int,objectives:map<string,struct<kills:double,first:boolean>>>>>"
)


def _as_text(kind: DataType) -> DataType:
    """A type with text for every scalar in it."""
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, _as_text(f.dataType)) for f in kind.fields])
    if isinstance(kind, ArrayType):
        return ArrayType(_as_text(kind.elementType))
    if isinstance(kind, MapType):
        return MapType(kind.keyType, _as_text(kind.valueType))
    return StringType()


def read_documents(spark: SparkSession, payload: Column, schema: str = MATCH_SCHEMA) -> Column:
    """A JSON text as a struct of a schema, whatever way its scalars are written: 7, 7.0 and "7" are one number.

    Read with text for every scalar and cast after; what cannot be cast is null by itself, and nothing around it is.
    """
    kind = spark.createDataFrame([], schema).schema
    return F.from_json(payload, _as_text(kind)).try_cast(kind)


def drop_reason() -> Column:
    """First reason for which a match document (MATCH_SCHEMA) makes no feature row; 'ok' if there is none."""
    p, t = F.col("info.participants"), F.col("info.teams")
    sides = F.array(F.lit(100), F.lit(200))
    places = F.array_sort(F.transform(p, lambda x: F.concat_ws("/", x["teamId"].cast("string"), F.coalesce(x["teamPosition"], F.lit("")))))
    want = F.array(*[F.lit(v) for v in sorted(f"{s}/{q}" for s in (100, 200) for q in POSITIONS)])
    wins = lambda s: F.array_distinct(F.transform(F.filter(p, lambda x: x["teamId"] == s), lambda x: F.coalesce(x["win"], F.lit(False))))
    one = (F.size(wins(100)) == 1) & (F.size(wins(200)) == 1) & (wins(100) != wins(200))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return first_reason(
        [
            ("missing_info_or_metadata", F.col("info").isNull() | F.col("metadata").isNull()),
            ("participant_count_not_10", no(F.size(p) == 10)),
            ("invalid_team_payload", no(F.size(t) == 2) | no(F.array_sort(F.transform(t, lambda x: x["teamId"])) == sides)),
            ("invalid_team_positions", no(places == want)),
            ("invalid_win_flags", no(one)),
            ("invalid_duration", duration_s(F.col("info.gameDuration"), F.col("info.gameStartTimestamp"), F.col("info.gameEndTimestamp")) <= 0),
        ]
    )


def match_id_of() -> Column:
    """The id in a document's metadata, else the one in its file name."""
    return F.coalesce(F.nullif(F.col("metadata.matchId"), F.lit("")), id_of_file(F.col("source_file")))


def feature_columns() -> list[str]:
    """Names of all columns of `match_features`, in order."""
    out = ["match_id", "source_folder", "source_file", "game_version", "patch", "queue_id", "map_id", "server_timezone_fallback_used", "game_duration_sec", "server", "is_weekend", "local_time_sin", "local_time_cos"]
    return out + [n for n, _ in _position_features()] + [n for n, _ in _team_features()]


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _position_features() -> list[tuple[str, Column]]:
    out: list[tuple[str, Column]] = []
    minutes = F.col("_minutes")

    def both(name: str, value, kinds: str) -> None:
        w, l = (value(F.col(f"_{s}_{position}"), F.col(f"_team_{s}")) for s in ("w", "l"))  # noqa: E741
        if "a" in kinds:
            out.append((f"{name}_avg", (w + l) / 2))
        if "d" in kinds:
            out.append((f"{name}_delta", w - l))

    for api, position in POSITIONS.items():
        for name, field in PER_MINUTE.items():
            both(f"{position}_{name}_pm", lambda p, _, f=field: safe_div(_zero(p[f]), minutes), "ad")
        both(f"{position}_total_pings_pm", lambda p, _: safe_div(sum((_zero(p[f"{x}Pings"]) for x in PINGS[1:]), _zero(p[f"{PINGS[0]}Pings"])), minutes), "ad")
        for name, (own, team) in SHARES.items():
            both(f"{position}_{name}_share", lambda p, t, o=own, m=team: safe_div(sum((_zero(p[x]) for x in o[1:]), _zero(p[o[0]])), t[m]), "a")
        if api == "JUNGLE":
            for name, field in JUNGLE_PER_MINUTE.items():
                both(f"{position}_{name}_pm", lambda p, _, f=field: safe_div(_zero(p[f]), minutes), "ad")
        for name, fields in FLAGS.items():
            both(f"{position}_{name}", lambda p, _, f=fields: flag(*[p[x] for x in f]), "d")
        for name, source, positions in CHALLENGES:
            if api in positions:
                per = (lambda v: safe_div(v, minutes)) if name.endswith("_pm") else (lambda v: v)
                both(f"{position}_{name}", lambda p, _, s=source, q=per: q(_zero(p["challenges"][s])), "ad")
        both(f"{position}_rift_herald_takedown", lambda p, _: (_zero(p["challenges"]["riftHeraldTakedowns"]) > 0).cast("double"), "d")
    return out


def _team_features() -> list[tuple[str, Column]]:
    def values(side: str, source: str) -> Column:
        return F.transform(F.col(f"_players_{side}"), lambda p: _zero(p["challenges"][source]))

    def most(side: str, source: str) -> Column:
        return F.greatest(_zero(F.array_max(values(side, source))), F.lit(float("-inf")))

    def least(side: str, source: str) -> Column:
        return _zero(F.array_min(F.filter(values(side, source), lambda v: v > 0)))

    def any_of(side: str, source: str) -> Column:
        return (most(side, source) > 0).cast("double")

    def objective(side: str, name: str, what: str) -> Column:
        o = F.col(f"_objectives_{side}")[name]
        return _zero(o["kills"]) if what == "kills" else flag(o["first"])

    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    elder = most("w", "teamElderDragonKills"), most("l", "teamElderDragonKills")
    out = [
        ("perfect_dragon_souls_taken_delta", any_of("w", "perfectDragonSoulsTaken") - any_of("l", "perfectDragonSoulsTaken")),
        ("team_elder_dragon_kills_avg", (elder[0] + elder[1]) / 2),
        ("team_elder_dragon_kills_delta", elder[0] - elder[1]),
        ("first_turret_killed_time", F.greatest(most("w", "firstTurretKilledTime"), most("l", "firstTurretKilledTime"))),
    ]
    for name, source, rule in (("earliest_baron", "earliestBaron", most), ("earliest_dragon_takedown", "earliestDragonTakedown", least), ("earliest_elder_dragon", "earliestElderDragon", most)):
        out += [(f"winner_{name}", rule("w", source)), (f"loser_{name}", rule("l", source))]
    out += [
        ("turrets_taken_with_rift_herald_delta", most("w", "turretsTakenWithRiftHerald") / 5 - most("l", "turretsTakenWithRiftHerald") / 5),
        ("winner_had_open_nexus", any_of("w", "hadOpenNexus")),
        ("winner_lost_an_inhibitor", any_of("w", "lostAnInhibitor")),
        ("winner_fountain_takedowns_sum", total(values("w", "takedownsInEnemyFountain"))),
    ]
    for name, label in OBJECTIVES.items():
        w, l = objective("w", name, "kills"), objective("l", name, "kills")  # noqa: E741
        if name == "riftHerald":
            out.append(("rift_herald_kills_delta", w - l))
            continue
        out += [(f"team_{label}_kills_avg", (w + l) / 2), (f"team_{label}_kills_delta", w - l)]
        if name == "dragon":
            out += [("team_dragon_kills_pm_avg", safe_div((w + l) / 2, F.col("_minutes"))), ("team_dragon_kills_pm_delta", safe_div(w - l, F.col("_minutes")))]
        out.append((f"first_{label}_delta", objective("w", name, "first") - objective("l", name, "first")))
    everyone = F.concat(values("w", "fistBumpParticipation"), values("l", "fistBumpParticipation"))
    return [*out, ("fist_bump_participation_match_avg", total(everyone) / 10)]


def match_features(matches: DataFrame, folder: str = "source_folder", file: str = "source_file") -> DataFrame:
    """One wide row for each valid match document (MATCH_SCHEMA and the two named columns): `feature_columns`.

    Documents with a drop reason are left out; missing numbers count as 0. Everything happens within a document:
    no shuffle. Repeated documents give repeated rows (see `choosing.first_wins`).
    """
    d = matches.withColumn("_reason", drop_reason()).where("_reason = 'ok'")
    p = F.col("info.participants")
    side = lambda won: F.filter(p, lambda x: F.coalesce(x["win"], F.lit(False)) == won)
    d = d.select(
        "metadata", "info", F.col(folder).alias("source_folder"), F.col(file).alias("source_file"), side(True).alias("_players_w"), side(False).alias("_players_l"),
        (duration_s(F.col("info.gameDuration"), F.col("info.gameStartTimestamp"), F.col("info.gameEndTimestamp")) / 60).alias("_minutes"),
    )
    team_fields = sorted({t for _, t in SHARES.values()})

    def summed(s: str, field: str) -> Column:
        return F.aggregate(F.col(f"_players_{s}"), F.lit(0.0), lambda total, x: total + _zero(x[field]))

    def team(s: str) -> Column:
        return F.struct(*[summed(s, f).alias(f) for f in team_fields])

    def player(s: str, api: str) -> Column:
        return F.get(F.filter(F.col(f"_players_{s}"), lambda x: x["teamPosition"] == api), F.lit(0))

    def objectives(s: str) -> Column:
        own = F.get(F.col(f"_players_{s}"), F.lit(0))["teamId"]
        return F.get(F.filter(F.col("info.teams"), lambda t: t["teamId"] == own), F.lit(0))["objectives"]

    picked = [player(s, api).alias(f"_{s}_{name}") for s in "wl" for api, name in POSITIONS.items()]
    d = d.select("*", *picked, *[team(s).alias(f"_team_{s}") for s in "wl"], *[objectives(s).alias(f"_objectives_{s}") for s in "wl"])
    match_id = match_id_of()
    version = F.coalesce("info.gameVersion", F.lit(""))
    clock = local_time_columns(F.col("info.gameStartTimestamp"), prefix_or_whole(match_id), F.col("source_folder"))
    head = {
        "match_id": match_id, "source_folder": F.col("source_folder"), "source_file": F.col("source_file"), "game_version": version, "patch": patch_of(version),
        "queue_id": F.coalesce("info.queueId", F.lit(0)), "map_id": F.coalesce("info.mapId", F.lit(0)),
        "server_timezone_fallback_used": clock["server_timezone_fallback_used"], "game_duration_sec": F.col("_minutes") * 60, "server": prefix_or_whole(match_id),
        "is_weekend": clock["is_weekend"], "local_time_sin": clock["local_time_sin"], "local_time_cos": clock["local_time_cos"],
    }
    return d.select(*[c.alias(n) for n, c in head.items()], *[c.alias(n) for n, c in [*_position_features(), *_team_features()]])


def wide_from_long(rows: DataFrame, key: str, side: str, sides: tuple[str, str], position: str, positions: dict, metrics: dict[str, str]) -> DataFrame:
    """One row for each key with {position}_{metric}_avg and _delta of the two sides (first less second).

    Repeated rows of a cell are summed, an absent cell counts as 0. One aggregation, combined before the shuffle.
    metrics maps names to columns, positions maps values to names.
    """
    cells = {
        (s, p, m): F.coalesce(F.sum(F.when((F.col(side) == sv) & (F.col(position) == pv), F.col(c))), F.lit(0.0))
        for s, sv in zip("wl", sides) for pv, p in positions.items() for m, c in metrics.items()
    }
    wide = rows.groupBy(key).agg(*[c.alias(f"_{s}_{p}_{m}") for (s, p, m), c in cells.items()])
    out = []
    for p in positions.values():
        for m in metrics:
            w, l = F.col(f"_w_{p}_{m}"), F.col(f"_l_{p}_{m}")  # noqa: E741
            out += [((w + l) / 2).alias(f"{p}_{m}_avg"), (w - l).alias(f"{p}_{m}_delta")]
    return wide.select(key, *out)
