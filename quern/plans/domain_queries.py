"""Queries of the reference's own computations on the domain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import ranks as R
from quern.functions.clock import clock_hour, local_time, zone_of
from quern.functions.ids import clean_match_id, clean_player
from quern.functions.oracle_text import epoch_ms_sql, match_id_sql, normal_quantile_sql, player_sql
from quern.functions.subquery import with_row
from quern.functions.text import prefix_or_whole
from quern.operators import audit, choosing, labels, nested, relations, statistics
from quern.operators.features import drop_reason, match_features, match_id_of, read_documents
from quern.operators.quantiles import quantiles
from quern.operators.sessions import usable_match_times
from quern.plans.registry import Registry
from quern.plans.window_queries import _BINS

R_ = Registry()
QUERIES, ORACLES = R_.queries, R_.sql

_CUTOFFS = "cut(server, gm, ch, top) as (values " + ", ".join(f"('{s}', {g}::double, {c}::double, {t}::double)" for s, (g, c, t) in R.SERVER_CUTOFFS.items()) + ")"
_RANKED = f"""
s as (select {player_sql('puuid')} p, upper(trim(solo_tier)) t, upper(trim(solo_rank)) d, greatest(coalesce(solo_lp, 0), 0)::double lp, coalesce(fetched_at_utc, -1) at_s from player_ranks),
n as (select *, case t when 'MASTER' then 'Master' when 'GRANDMASTER' then 'GrandMaster' when 'CHALLENGER' then 'Challenger' else case when t in ('IRON','BRONZE','SILVER','GOLD','PLATINUM','EMERALD','DIAMOND') and d in ('IV','III','II','I') then upper(t[1]) || lower(t[2:]) || ' ' || d end end rank from s where p is not null),
k as (select p, rank, lp from n where rank is not null qualify row_number() over (partition by p order by at_s desc, rank desc, lp desc) = 1),
mp as (select distinct match_id m, {player_sql('puuid')} p, upper(split_part(match_id, '_', 1)) sv from match_participants where match_id is not null),
w as (select m, mp.p, sv, rank, lp, coalesce(gm, 1000) gm, coalesce(ch, 1250) ch, coalesce(top, 2400) top from mp left join k using (p) left join cut on sv = server where mp.p is not null),
e as (select *, case when rank = 'Master' and lp >= gm then 'GrandMaster' when rank = 'GrandMaster' and lp >= ch then 'Challenger' else rank end eff from w),
f as (select *, case eff when 'Master' then lp / gm when 'GrandMaster' then (lp - gm) / (ch - gm) when 'Challenger' then (lp - ch) / (top - ch) else lp / 100 end raw from e),
z as (select m, sv, least(greatest(lo + least(greatest(raw, 0), 1) * (up - lo), 0.01), 99.99) / 100 q from f left join lad on lad.rank = eff)"""


def _last_ranks(t):
    """The last known rank of each player."""
    r = t.player_ranks.select(
        clean_player(F.col("puuid")).alias("puuid"), R.rank_name(F.col("solo_tier"), F.col("solo_rank")).alias("rank"), F.greatest(F.coalesce("solo_lp", F.lit(0)), F.lit(0)).cast("double").alias("lp"), F.coalesce("fetched_at_utc", F.lit(-1)).alias("at_s")
    )
    return choosing.last_wins(r.where(F.col("puuid").isNotNull() & F.col("rank").isNotNull()), ["puuid"], [F.col("at_s"), F.col("rank"), F.col("lp")])


@R_.add(f"""
with {_BINS}, {_CUTOFFS}, {_RANKED}, y as (select m, sv, case when q is not null then {normal_quantile_sql('q')} end z from z),
g as (select m, sv, avg(z) a, count(z) mapped, count(*) n from y group by 1, 2)
select m match_id, round(a, 8) average_skill_level, mapped mapped_participants, n unique_participants, sv skill_server from g where n >= 10 and mapped >= 9""")
def r_match_labels(t):
    """Labels of all matches, each on its own server's cut-offs; ladders other than the default are a parameter."""
    m = t.match_participants.select("match_id", clean_player(F.col("puuid")).alias("puuid"))
    s = labels.server_labels(m, _last_ranks(t), R.ladder(t.spark), R.cutoffs(t.spark))
    return s.withColumn("average_skill_level", F.round("average_skill_level", 8))


@R_.add(f"""
with tm as (select {match_id_sql('match_id')} m, {epoch_ms_sql('game_creation_utc_ms')} ms, updated_at_utc u from match_time_cache),
best as (select m, arg_max(ms, (u, ms)) ms from tm where m is not null and ms >= 1262304000000 and ms <= u * 1000 group by m),
e as (select distinct {player_sql('puuid')} p, {match_id_sql('match_id')} m from player_match_ids_cache),
h as (select p, ms, extract(hour from make_timestamp(ms * 1000)) + extract(minute from make_timestamp(ms * 1000)) / 60.0 + extract(microseconds from make_timestamp(ms * 1000)) / 3600e6 hr from e left join best using (m) where p is not null and e.m is not null)
select p puuid, count(*) games, count(ms) timed, count(*) filter (hr >= 1 and hr < 7) night, count(*) filter (hr >= 2 and hr < 8.5) under from h group by 1""")
def h_player_history(t):
    """Games, timed games and games in two clock windows (UTC) of every player's history."""
    e = t.player_match_ids_cache.select(clean_player(F.col("puuid")).alias("puuid"), clean_match_id(F.col("match_id")).alias("match_id"))
    e = e.where(F.col("puuid").isNotNull() & F.col("match_id").isNotNull()).distinct().join(usable_match_times(t.match_time_cache), "match_id", "left")
    return labels.player_counters(e, ["puuid"], local_time(F.col("at_ms"), F.lit("UTC")), {"night": (1.0, 7.0), "under": (2.0, 8.5)})


@R_.add()
def h_match_windows(t):
    """Timed games by server and local hour: the server's zone, from the match id."""
    times = usable_match_times(t.match_time_cache).withColumn("server", prefix_or_whole(F.col("match_id")))
    zone, _ = zone_of(F.col("server"), F.lit(""))
    hour = F.floor(clock_hour(local_time(F.col("at_ms"), zone))).cast("int")
    return times.groupBy("server", hour.alias("hour")).agg(F.count("*").alias("games"))


@R_.add(f"""
with x as (select match_id m, max(average_skill_level) a, max(mapped_participants) n from skill_targets group by 1), f as (select distinct match_id m from match_table_v1)
select count(*) filter (x.m is null) only_left, count(*) filter (f.m is null) only_right from f full join x using (m)""")
def v_label_overlap(t):
    f = t.match_table_v1.select("match_id").distinct().withColumn("v", F.lit(0.0))
    x = t.skill_targets.select("match_id").distinct().withColumn("v", F.lit(0.0))
    return relations.alignment(f, x, "match_id", "v").select("only_left", "only_right")


@R_.add("""
with a as (select match_id m, max(average_skill_level) v from skill_targets where match_id is not null group by 1), b as (select match_id m, round(min(average_skill_level), 1) v from skill_targets where mapped_participants > 8 and match_id is not null group by 1)
select count(*) filter (b.m is null) only_left, count(*) filter (a.m is null) only_right, count(*) filter (a.v is distinct from b.v and not coalesce(abs(a.v - b.v) <= 0.02, false) and a.m is not null and b.m is not null) differing from a full join b using (m)""")
def v_label_differences(t):
    """Labels of all rows against rounded ones of rows with enough participants: how many differ by more than the tolerance."""
    s = t.skill_targets.where(F.col("match_id").isNotNull())
    a = s.groupBy("match_id").agg(F.max("average_skill_level").alias("v"))
    b = s.where("mapped_participants > 8").groupBy("match_id").agg(F.round(F.min("average_skill_level"), 1).alias("v"))
    return relations.alignment(a, b, "match_id", "v", 0.02).select("only_left", "only_right", "differing")


@R_.add("""
with j as (select distinct match_id, max(game_duration_sec) over (partition by match_id) d from match_table_v1), s as (select match_id, max(average_skill_level) y from skill_targets where match_id is not null group by 1)
select count(*) n, round(avg(y), 8) mean, round(min(y), 8) low, round(max(y), 8) high, round(quantile_cont(y, 0.9), 8) p90 from j join s using (match_id)""")
def a_joined_summary(t):
    """Features joined with labels, one row for each match, and the labels summed up."""
    x = t.match_table_v1.groupBy("match_id").agg(F.max("game_duration_sec").alias("d"))
    y = t.skill_targets.groupBy("match_id").agg(F.max("average_skill_level").alias("y"))
    j = relations.inner_on(x, y, ["match_id"])
    g = j.agg(F.count("*").alias("n"), *[F.round(f("y"), 8).alias(n) for n, f in (("mean", F.avg), ("low", F.min), ("high", F.max))])
    wide = with_row(g, quantiles(j, [], "y", [0.9], "q"))
    return wide.select(*g.columns, F.round(F.get("q", F.lit(0)), 8).alias("p90"))


@R_.add("""
select event_type, (user_id % 3)::int endpoint, count(*) n, count(*) filter (value > 90) failed, round(count(*) filter (value > 90) / count(*), 6) rate from events group by rollup (event_type, user_id % 3)""")
def a_rollup(t):
    e = t.events.select("event_type", (F.col("user_id") % 3).cast("int").alias("endpoint"), "value")
    g = e.rollup("event_type", "endpoint").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 90).alias("failed"))
    return g.withColumn("rate", F.round(F.col("failed") / F.col("n"), 6))


@R_.add("""
with imp as (select s_suppkey o, round(s_acctbal)::bigint sc, row_number() over (order by s_acctbal desc, s_suppkey) pl from supplier),
own as (select distinct l_partkey c, l_suppkey o, l_partkey % 17 r from lineitem),
g as (select c, sum(sc)::bigint score, min(pl) first_seen, min((pl, -r, c)) k from own join imp using (o) group by 1)
select c l_partkey, score, first_seen, row_number() over (order by score desc, k)::int rank from g""")
def w_candidate_scores(t):
    imp = relations.with_row_id(t.supplier, [F.desc("s_acctbal"), F.asc("s_suppkey")], "pl", 1)
    imp = imp.select(F.col("s_suppkey").alias("l_suppkey"), F.round("s_acctbal").cast("bigint").alias("sc"), F.col("pl").cast("int").alias("pl"))
    own = t.lineitem.select("l_partkey", "l_suppkey", (F.col("l_partkey") % 17).alias("r"))
    return relations.candidate_scores(own, imp, "l_partkey", "l_suppkey", "sc", "pl", "r")


@R_.add("""
with u as (select l_orderkey k, l_linenumber + 100 n from lineitem where l_orderkey % 50 = 0 and l_quantity > 25), o as (select l_orderkey k, l_linenumber n from lineitem)
select k, n, count(*) copies from (select * from o where k not in (select k from u) union all select * from u) group by 1, 2""")
def k_replace_children(t):
    old = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))
    new = t.lineitem.where("l_orderkey % 50 = 0 and l_quantity > 25").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") + 100).alias("n"))
    return relations.replace_children(old, new, "k").groupBy("k", "n").agg(F.count("*").alias("copies"))


def _documents(t, *more: str):
    """metadata, info, doc_no, folder and file of every received document, and further columns of its record."""
    columns = ["source_folder", "source_file", *more]
    d = nested.unwrapped(t.raw_match_docs.select("payload", *columns), "payload", place="doc_no")
    return d.withColumn("m", read_documents(t.spark, F.col("payload"))).select("m.metadata", "m.info", "doc_no", *columns)


# The received documents in SQL, unwrapped: d (record, place, match, folder, file, at, j), reasons and the players of the
# usable documents, one of each match: pl (m, won, pos, j).
_DOCS = r"""
raw as (select record_id r, source_folder folder, source_file file, received_at got, ltrim(trim(payload), chr(65279)) x from raw_match_docs),
w(r, folder, file, got, path, j) as (
  select r, folder, file, got, []::int[], case when json_valid(x) then x::json end from raw
  union all
  select r, folder, file, got, list_append(path, k), e from (
    select *, unnest(kids) e, unnest(range(len(kids)))::int k from (
      select *, case json_type(j)
        when 'VARCHAR' then case when json_valid(j->>'$') and ltrim(j->>'$')[1] in ('{', '[', '"') then [(j->>'$')::json] else [] end
        when 'ARRAY' then json_extract(j, '$[*]')
        when 'OBJECT' then case when json_type(j, '$.info') = 'OBJECT' then [] else json_extract(j, '$.*') end
        else [] end kids from w where j is not null))),
d as (select r, folder, file, got, path, j, coalesce(nullif(j->>'$.metadata.matchId', ''), regexp_replace(file, '\.json(\.zst)?$', '')) m,
  case json_type(j, '$.info.participants') when 'ARRAY' then json_extract(j, '$.info.participants[*]') when 'OBJECT' then json_extract(j, '$.info.participants.*') end ps,
  case json_type(j, '$.info.teams') when 'ARRAY' then json_extract(j, '$.info.teams[*]') when 'OBJECT' then json_extract(j, '$.info.teams.*') end ts,
  try_cast(j->>'$.info.gameDuration' as double) dur, try_cast(j->>'$.info.gameStartTimestamp' as bigint) gs, try_cast(j->>'$.info.gameEndTimestamp' as bigint) ge
  from w where json_type(j) = 'OBJECT' and json_type(j, '$.info') = 'OBJECT'),
e as (select *, case when dur > 0 then dur when ge > gs and gs > 0 then (ge - gs) / 1000.0 else 0.0 end secs,
  list_sort(list_transform(ps, lambda x: concat(coalesce(try_cast(x->>'$.teamId' as int)::varchar || '/', ''), coalesce(x->>'$.teamPosition', '')))) places,
  list_distinct(list_transform(list_filter(ps, lambda x: try_cast(x->>'$.teamId' as int) = 100), lambda x: coalesce(try_cast(x->>'$.win' as boolean), false))) w1,
  list_distinct(list_transform(list_filter(ps, lambda x: try_cast(x->>'$.teamId' as int) = 200), lambda x: coalesce(try_cast(x->>'$.win' as boolean), false))) w2 from d),
g as (select *, case when coalesce(json_type(j, '$.metadata'), 'NULL') <> 'OBJECT' then 'missing_info_or_metadata' when coalesce(len(ps), 0) <> 10 then 'participant_count_not_10'
  when coalesce(len(ts), 0) <> 2 or list_sort(list_transform(ts, lambda x: try_cast(x->>'$.teamId' as int))) <> [100, 200] then 'invalid_team_payload'
  when places <> ['100/BOTTOM', '100/JUNGLE', '100/MIDDLE', '100/TOP', '100/UTILITY', '200/BOTTOM', '200/JUNGLE', '200/MIDDLE', '200/TOP', '200/UTILITY'] then 'invalid_team_positions'
  when len(w1) <> 1 or len(w2) <> 1 or w1 = w2 then 'invalid_win_flags' when secs <= 0 then 'invalid_duration' else 'ok' end reason from e)"""


@R_.add(f"""
with recursive {_DOCS}
select reason, count(*) n from (select reason from g union all select 'missing_info_or_metadata' from raw where r not in (select r from d)) group by 1""")
def f_match_reasons(t):
    """Drop reasons of the received documents, however wrapped, read with the fixed schema."""
    return audit.reason_counts(_documents(t).withColumn("reason", drop_reason()))


@R_.add()
def f_match_features(t):
    """The 475-column rows of the received documents, one for each match: of its usable documents the first by folder,
    file, time of receipt, record and place in the record. The document is chosen first, its row made after."""
    d = _documents(t, "record_id", "received_at").withColumn("_reason", drop_reason()).where("_reason = 'ok'").drop("_reason").withColumn("_match", match_id_of())
    order = F.struct(*[F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("v")).alias(c) for c in ("source_folder", "source_file", "received_at", "record_id", "doc_no")])
    first = d.groupBy("_match").agg(F.min_by(F.struct("metadata", "info", "source_folder", "source_file"), order).alias("d"))
    return match_features(first.select("d.*"))


@R_.add(f"""
with m as (select {match_id_sql('match_id')} m, bundle b, valid_for_pipeline is not distinct from 1 v, least(coalesce(participant_count, 0), 10) c, coalesce(game_creation_utc_ms, 0) > 0 h from matches where match_id is not null and bundle is not null),
s as (select b, count(*) size from m group by 1), r as (select m.*, size from m join s using (b)),
w as (select *, row_number() over (partition by m order by c = 10 and v desc, v desc, c desc, h desc, size, b) rn, count(*) over (partition by m) n, bool_or(c = 10 and v) over (partition by m) usable from r)
select m match_id, b bundle, n copies, usable plan from w where rn = 1 and n > 1""".replace("order by c = 10 and v desc", "order by (c = 10 and v) desc"))
def w_dedupe_plan(t):
    """The winning copy of each repeated match by the six-key order, and whether a plan may be made for its group."""
    m = t.matches.where(F.col("bundle").isNotNull()).select(
        clean_match_id(F.col("match_id")).alias("match_id"), "bundle", F.coalesce(F.col("valid_for_pipeline") == 1, F.lit(False)).alias("v"), F.least(F.coalesce("participant_count", F.lit(0)), F.lit(10)).alias("c"), (F.coalesce("game_creation_utc_ms", F.lit(0)) > 0).alias("h")
    ).where(F.col("match_id").isNotNull())
    m = m.join(m.groupBy("bundle").agg(F.count("*").alias("size")), "bundle").withColumn("full", (F.col("c") == 10) & F.col("v"))
    order = [F.desc("full"), F.desc("v"), F.desc("c"), F.desc("h"), F.asc("size"), F.asc("bundle")]
    first = choosing.best_of_group(m, ["match_id"], order)
    g = m.groupBy("match_id").agg(F.count("*").alias("copies"), F.max("full").alias("plan")).where("copies > 1")
    return first.join(g, "match_id").select("match_id", "bundle", "copies", "plan")


@R_.add("""
with x as (select patch, server, game_duration_sec y from match_table_v1 where patch is not null and server is not null)
select patch, server, count(*) n, round(avg(y), 6) mean, round(stddev_samp(y) / sqrt(count(*)), 6) se from x group by 1, 2""")
def a_patch_server_means(t):
    x = t.match_table_v1.where(F.col("patch").isNotNull() & F.col("server").isNotNull())
    g = statistics.mean_ci(x, ["patch", "server"], "game_duration_sec")
    return g.select("patch", "server", "n", F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"))


def _families() -> tuple[list[str], str]:
    """Columns of every family of `match_features`, and their SQL, written for each from its definition."""

    def n(f):
        return f"coalesce(try_cast(j->>'$.{f}' as double), 0)"

    def at(side, pos, v):
        return f"max({v}) filter ({'' if side == 'w' else 'not '}won and pos = '{pos}')"

    def team(side, v, how="sum"):
        return f"{how}({v}) filter ({'' if side == 'w' else 'not '}won)"

    def pm(v):
        return f"({v}) / (secs / 60)"

    def both(pos, v, kind, q=lambda x: x):
        w, l = q(at("w", pos, v)), q(at("l", pos, v))  # noqa: E741
        return f"({w} + {l}) / 2" if kind == "avg" else f"{w} - {l}"

    def share(pos, own, total):
        one = [f"coalesce({at(s, pos, own)} / nullif(greatest({team(s, n(total))}, 0), 0), 0)" for s in "wl"]
        return f"({one[0]} + {one[1]}) / 2"

    def yes(v):
        return f"case when coalesce(try_cast(j->>'$.{v}' as boolean), false) then 1.0 else 0.0 end"

    def either(a, b):
        return f"greatest({yes(a)}, {yes(b)})"

    def objective(side, name, what):
        return f"coalesce(try_cast({side}t->>'$.objectives.{name}.{what}' as double), 0)" if what == "kills" else f"case when coalesce(try_cast({side}t->>'$.objectives.{name}.first' as boolean), false) then 1.0 else 0.0 end"

    def most(side, c):
        return team(side, n(f"challenges.{c}"), "max")

    def two(name, kind):
        w, l = objective("w", name, "kills"), objective("l", name, "kills")  # noqa: E741
        return f"({w} + {l}) / 2" if kind == "avg" else f"{w} - {l}"

    pings = "allIn assistMe basic command danger enemyMissing enemyVision getBack hold needVision onMyWay push retreat visionCleared".split()
    columns = {
        "top_gold_pm_avg": both("TOP", n("goldEarned"), "avg", pm), "jungle_kills_pm_delta": both("JUNGLE", n("kills"), "delta", pm), "support_vision_pm_avg": both("UTILITY", n("visionScore"), "avg", pm),
        "bottom_dmg_to_champs_pm_delta": both("BOTTOM", n("totalDamageDealtToChampions"), "delta", pm), "middle_xp_pm_delta": both("MIDDLE", n("champExperience"), "delta", pm),
        "jungle_enemy_missing_pings_pm_avg": both("JUNGLE", n("enemyMissingPings"), "avg", pm), "middle_total_pings_pm_avg": both("MIDDLE", " + ".join(n(f"{x}Pings") for x in pings), "avg", pm),
        "top_kp_share_avg": share("TOP", n("kills") + " + " + n("assists"), "kills"), "middle_gold_share_avg": share("MIDDLE", n("goldEarned"), "goldEarned"),
        "bottom_damage_share_avg": share("BOTTOM", n("totalDamageDealtToChampions"), "totalDamageDealtToChampions"), "support_vision_share_avg": share("UTILITY", n("visionScore"), "visionScore"),
        "jungle_enemy_jungle_cs_pm_delta": both("JUNGLE", n("totalEnemyJungleMinionsKilled"), "delta", pm),
        "top_first_blood_delta": both("TOP", either("firstBloodKill", "firstBloodAssist"), "delta"), "jungle_first_tower_delta": both("JUNGLE", either("firstTowerKill", "firstTowerAssist"), "delta"),
        "top_teleport_takedowns_pm_avg": both("TOP", n("challenges.teleportTakedowns"), "avg", pm), "bottom_turret_plates_taken_delta": both("BOTTOM", n("challenges.turretPlatesTaken"), "delta"),
        "middle_solo_kills_pm_avg": both("MIDDLE", n("challenges.soloKills"), "avg", pm), "support_wards_guarded_pm_delta": both("UTILITY", n("challenges.wardsGuarded"), "delta", pm),
        "top_effective_heal_and_shielding_pm_avg": both("TOP", n("challenges.effectiveHealAndShielding"), "avg", pm), "jungle_baron_takedowns_avg": both("JUNGLE", n("challenges.baronTakedowns"), "avg"),
        "jungle_jungle_scuttle_crab_kills_pm_avg": both("JUNGLE", n("challenges.scuttleCrabKills"), "avg", pm),
        "middle_rift_herald_takedown_delta": both("MIDDLE", f"case when {n('challenges.riftHeraldTakedowns')} > 0 then 1.0 else 0.0 end", "delta"),
        "winner_earliest_baron": most("w", "earliestBaron"), "loser_earliest_baron": most("l", "earliestBaron"), "first_turret_killed_time": f"greatest({most('w', 'firstTurretKilledTime')}, {most('l', 'firstTurretKilledTime')})",
        "team_elder_dragon_kills_avg": f"({most('w', 'teamElderDragonKills')} + {most('l', 'teamElderDragonKills')}) / 2", "winner_fountain_takedowns_sum": team("w", n("challenges.takedownsInEnemyFountain")),
        "team_dragon_kills_avg": two("dragon", "avg"), "team_dragon_kills_pm_delta": pm(two("dragon", "delta")), "first_dragon_delta": f"{objective('w', 'dragon', 'first')} - {objective('l', 'dragon', 'first')}",
        "team_tower_kills_delta": two("tower", "delta"), "rift_herald_kills_delta": two("riftHerald", "delta"), "team_grubs_kills_avg": two("horde", "avg"),
        "fist_bump_participation_match_avg": f"sum({n('challenges.fistBumpParticipation')}) / 10",
    }
    return list(columns), ", ".join(f"round({v}, 6) {k}" for k, v in columns.items())


_FAMILY_COLUMNS, _FAMILY_SQL = _families()


@R_.add(f"""
with recursive {_DOCS},
one as (select * from g where reason = 'ok' qualify row_number() over (partition by m order by folder nulls last, file nulls last, got nulls last, r nulls last, path) = 1),
ex as (select *, unnest(ps) pj from one),
pl as (select m, folder, secs, ts, coalesce(j->>'$.info.gameVersion', '') v, coalesce(try_cast(j->>'$.info.queueId' as int), 0) q, coalesce(try_cast(pj->>'$.win' as boolean), false) won, pj->>'$.teamPosition' pos, try_cast(pj->>'$.teamId' as int) tid, pj from ex),
pw as (select *, max(tid) filter (won) over (partition by m) wt, max(tid) filter (not won) over (partition by m) lt from pl),
pt as (select m, folder, secs, v, q, won, pos, pj j, list_filter(ts, lambda x: try_cast(x->>'$.teamId' as int) = wt)[1] wt, list_filter(ts, lambda x: try_cast(x->>'$.teamId' as int) = lt)[1] lt from pw)
select m match_id, folder source_folder, v game_version, case when contains(v, '.') then split_part(v, '.', 1) || '.' || split_part(v, '.', 2) else v end patch, q queue_id, split_part(m, '_', 1) server, round(secs, 6) game_duration_sec, {_FAMILY_SQL}
from pt group by m, folder, secs, v, q, wt, lt""")
def f_match_families(t):
    """Columns of every family of the feature rows, one row for each match."""
    d = f_match_features(t)
    return d.select("match_id", "source_folder", "game_version", "patch", "queue_id", "server", F.round("game_duration_sec", 6).alias("game_duration_sec"), *[F.round(c, 6).alias(c) for c in _FAMILY_COLUMNS])
