"""Queries of the general data problems: sessions, orphan references, nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.oracle_text import epoch_ms_sql, match_id_sql, player_sql
from quern.operators.nested import match_children, objects, shred_and_keep
from quern.operators.orphans import match_reference_orphans, orphan_counts, orphans_by_period
from quern.operators.sessions import chunked_sessions, play_sessions
from quern.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    s = play_sessions(table(spark, d, "player_match_ids_cache"), table(spark, d, "match_time_cache"))
    return s.select("puuid", "session_start_ms", "session_end_ms", "games")


def p1_event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of `events` by user with a gap of six hours, in microseconds."""
    e = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return chunked_sessions(e, ["user_id"], "at", 6 * 3_600_000_000, 7 * 86_400_000_000)


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return match_reference_orphans(*(table(spark, d, t) for t in ("match_participants", "player_ranks", "matches", "skill_targets")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p3_by_period(spark: SparkSession, d: str) -> DataFrame:
    return orphans_by_period(_orphans(spark, d))


def p3_line_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Order lines whose supplier or part, and orders whose customer, is outside a filtered parent table, by month."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    month = F.date_format("l_shipdate", "yyyy-MM")
    return orphan_counts(
        [("supplier", li, F.col("l_suppkey"), month), ("part", li, F.col("l_partkey"), month), ("customer", o, F.col("o_custkey"), F.date_format("o_orderdate", "yyyy-MM"))],
        [("supplier", table(spark, d, "supplier").where("s_acctbal > 0"), F.col("s_suppkey")), ("part", table(spark, d, "part").where("p_size > 5"), F.col("p_partkey")), ("customer", table(spark, d, "customer").where("c_acctbal > 0"), F.col("c_custkey"))],
    )


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return shred_and_keep(table(spark, d, "raw_match_docs"), "record_id", "payload", "source_file")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return match_children(_nodes(spark, d))


def p4_tables(spark: SparkSession, d: str) -> DataFrame:
    """Distinct objects and bridge rows by role: the sizes of the flat tables."""
    nodes = _nodes(spark, d)
    sizes = objects(nodes).groupBy("role").agg(F.count("*").alias("objects"), F.sum(F.size("parts")).alias("bridge_rows"))
    return sizes.select("role", "objects", "bridge_rows")


QUERIES = {"p4_found": p4_found, "p4_tables": p4_tables, "p1_found": p1_found, "p1_event_sessions": p1_event_sessions, "p3_found": p3_found, "p3_by_period": p3_by_period, "p3_line_orphans": p3_line_orphans}

_P3 = f"""
with pr as (select distinct {match_id_sql('match_id')} m, {player_sql('puuid')} p from match_participants),
pairs as (select * from pr where m is not null and p is not null),
r as (select {player_sql('puuid')} p, min(fetched_at_utc) f, bool_or(fetched_at_utc is null) u from player_ranks group by 1),
ranks as (select * from r where p is not null),
mt as (select {match_id_sql('match_id')} m, min(fetched_at_utc) f, min(case when game_creation_utc_ms > 0 then game_creation_utc_ms end) c from matches where match_id is not null group by 1),
mm as (select m, f, coalesce(strftime(make_timestamp(c * 1000), '%Y-%m'), 'unknown') mo from mt),
st as (select {match_id_sql('match_id')} m, max(mapped_participants) n from skill_targets where match_id is not null group by 1),
found as (
select distinct 'match_participants.match_id' ref_field, m match_id, '' puuid, 'missing' orphan_state, 'unknown' orphan_month from pr where m is not null and m not in (select m from mm)
union all select 'match_participants.puuid', pairs.m, pairs.p, 'missing', coalesce(mo, 'unknown') from pairs left join mm on pairs.m = mm.m where not exists (select 1 from ranks where ranks.p = pairs.p)
union all select 'match_participants.puuid', pairs.m, pairs.p, 'late', mo from pairs join mm on pairs.m = mm.m join ranks on ranks.p = pairs.p where not ranks.u and ranks.f - mm.f > 604800
union all select 'player_ranks.puuid', '', ranks.p, 'missing', coalesce(strftime(make_timestamp(ranks.f * 1000000), '%Y-%m'), 'unknown') from ranks where not exists (select 1 from pairs where pairs.p = ranks.p)
union all select 'skill_targets.match_id', m, '', 'missing', 'unknown' from st where m not in (select m from mm)
union all select 'skill_targets.mapped_participants', st.m, '', 'overcount', coalesce(mo, 'unknown') from st left join mm on st.m = mm.m
  where st.n > (select count(*) from pairs join ranks on pairs.p = ranks.p where pairs.m = st.m))
"""

ORACLES = {
    "p1_found": f"""
with t as (select {match_id_sql('match_id')} m, {epoch_ms_sql('game_creation_utc_ms')} ms, updated_at_utc u from match_time_cache),
best as (select m, arg_max(ms, (u, ms)) ms from t where m is not null and ms >= 1262304000000 and ms <= u * 1000 group by m),
g as (select distinct {player_sql('puuid')} p, {match_id_sql('match_id')} m from player_match_ids_cache),
x as (select p, ms, row_number() over (partition by p order by ms) rn from g join best using (m) where p is not null),
y as (select *, case when ms - lag(ms) over (partition by p order by rn) <= 7200000 then 0 else 1 end new from x),
z as (select *, sum(new) over (partition by p order by rn) run from y)
select p puuid, min(ms) session_start_ms, max(ms) session_end_ms, count(*) games from z group by p, run""",
    "p1_event_sessions": """
with y as (select user_id, epoch_us(ts) t, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) <= 21600000000 then 0 else 1 end new, event_id from events),
z as (select *, sum(new) over (partition by user_id order by t, event_id) run from y)
select user_id, min(t) session_start, max(t) session_end, max(t) - min(t) session_duration, count(*) events from z group by user_id, run""",
    "p3_found": _P3 + "select * from found",
    "p3_by_period": _P3 + "select ref_field, orphan_state, orphan_month, count(*) orphans from found group by 1, 2, 3",
    "p3_line_orphans": """
with x as (
select 'supplier' parent_table, l_suppkey k, strftime(l_shipdate, '%Y-%m') period from lineitem where l_suppkey not in (select s_suppkey from supplier where s_acctbal > 0)
union all select 'part', l_partkey, strftime(l_shipdate, '%Y-%m') from lineitem where l_partkey not in (select p_partkey from part where p_size > 5)
union all select 'customer', o_custkey, strftime(o_orderdate, '%Y-%m') from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0))
select parent_table, period, count(*) orphan_rows, count(distinct k) orphan_keys from x group by 1, 2""",
}
