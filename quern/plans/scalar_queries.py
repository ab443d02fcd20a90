"""Queries of the scalar functions, sources and sinks on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import arrays, bins, clock, hashing, numeric, text
from quern.functions import ranks as R
from quern.functions.subquery import with_row
from quern.operators import choosing, relations
from quern.plans.registry import Registry
from quern.sources import files, sinks

R_ = Registry()
QUERIES, ORACLES = R_.queries, R_.sql


@R_.add("""
with a as (select l_partkey k, round(avg(l_extendedprice), 4) price from lineitem where l_partkey % 3 <> 0 group by 1),
u as (select *, 0 s, 'lines' source from a union all select p_partkey, round(p_retailprice, 4), 1, 'catalogue' from part),
w as (select * from u qualify row_number() over (partition by k order by s) = 1)
select source, count(*) n, round(sum(price), 2) total from w group by 1""")
def s_priority_coalesce(t):
    a = t.lineitem.where("l_partkey % 3 <> 0").groupBy(F.col("l_partkey").alias("k")).agg(F.round(F.avg("l_extendedprice"), 4).alias("price"))
    b = t.part.select(F.col("p_partkey").alias("k"), F.round("p_retailprice", 4).alias("price"))
    return choosing.coalesce_sources([("lines", a), ("catalogue", b)], ["k"]).groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))


@R_.add("""select distinct o_custkey custkey, l_suppkey suppkey from orders join lineitem on o_orderkey = l_orderkey where l_returnflag = 'A' or o_orderstatus = 'F'""")
def s_union_edges(t):
    j = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    e = j.select(F.col("o_custkey").alias("custkey"), F.col("l_suppkey").alias("suppkey"), "l_returnflag", "o_orderstatus")
    return relations.edges_of([e.where("l_returnflag = 'A'").select("custkey", "suppkey"), e.where("o_orderstatus = 'F'").select("custkey", "suppkey")])


@R_.add("""
with s as (select c_mktsegment segment, count(*) n, round(avg(c_acctbal), 2) mean from customer group by 1)
select segment, cast(n as varchar) n, cast(mean as varchar) mean from s""")
def s_markdown_table(t):
    s = t.customer.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 2).alias("mean"))
    return files.markdown_table(sinks.markdown_lines(s, ["segment", "n", "mean"], ["segment"]), ["segment", "n", "mean"])


@R_.add("""select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1""")
def k_upsert_latest(t):
    e = t.events.select("user_id", "event_type", "ts", "event_id", "value")
    return choosing.last_wins(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@R_.add("""
with n as (select row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity) rn from lineitem)
select count(*) filter (rn = 1) kept, count(*) filter (rn > 1) ignored from n""")
def k_insert_or_ignore(t):
    return choosing.first_wins(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity"])[1]


@R_.add("""
with g as (select o_orderkey from orders where o_orderstatus = 'P')
select (select count(*) from orders where o_orderkey in (from g)) parent_deleted, (select count(*) from lineitem where l_orderkey in (from g)) child_deleted""")
def k_delete_cascade(t):
    parent, child = t.orders.withColumnRenamed("o_orderkey", "k"), t.lineitem.withColumnRenamed("l_orderkey", "k")
    return relations.delete_cascade(parent, child, "k", parent.where("o_orderstatus = 'P'"))[2]


@R_.add("""
with e as (select c_nationkey nation, count(*) expected from customer group by 1),
b as (select c_nationkey nation, count(*) built from customer where c_acctbal > -900 or c_nationkey % 2 = 0 group by 1)
select nation, coalesce(expected, 0) expected, coalesce(built, 0) built, coalesce(expected, 0) = coalesce(built, 0) complete from e full join b using (nation)""")
def k_shard_complete(t):
    c = t.customer.withColumnRenamed("c_nationkey", "nation")
    return sinks.shard_status(c, c.where("c_acctbal > -900 or nation % 2 = 0"), "nation")


@R_.add("""
select n id, split_part(n, '#', 1) whole, case when contains(n, '#') then split_part(n, '#', 1) else '' end empty,
case when strpos(n, '#') > 1 then upper(split_part(n, '#', 1)) else 'NONE' end fallback
from (select c_name n from customer union all select s_name from supplier union all select p_brand from part)""")
def p_id_prefix_variants(t):
    n = t.customer.select(F.col("c_name").alias("n")).union(t.supplier.select("s_name")).union(t.part.select("p_brand"))
    return n.select(F.col("n").alias("id"), text.prefix_or_whole(F.col("n"), "#").alias("whole"), text.prefix_or_empty(F.col("n"), "#").alias("empty"), text.prefix_or(F.col("n"), F.lit("NONE"), "#").alias("fallback"))


@R_.add("""
with v as (select p_partkey, case when p_size % 5 = 0 then p_size::varchar else p_size || '.' || p_partkey % 7 || '.' || p_brand end v from part)
select p_partkey, case when contains(v, '.') then split_part(v, '.', 1) || '.' || split_part(v, '.', 2) else v end patch from v""")
def p_version_patch(t):
    v = F.when(F.col("p_size") % 5 == 0, F.col("p_size").cast("string")).otherwise(F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 7).cast("string"), "p_brand"))
    return t.part.select("p_partkey", text.patch_of(v).alias("patch"))


@R_.add("""select p_partkey, coalesce(nullif(regexp_extract(p_brand, '#([2-9]\\d*)$', 1), ''), 'unknown') brand_no, regexp_replace('f_' || substr(sha256(p_name), 1, 8), '_[0-9a-f]{8}$', '') folder from part""")
def p_regex_extract_default(t):
    return t.part.select("p_partkey", text.extract_or(F.col("p_brand"), r"#([2-9]\d*)$", "unknown").alias("brand_no"), text.without_hash_suffix(F.concat(F.lit("f_"), F.substring(F.sha2("p_name", 256), 1, 8))).alias("folder"))


@R_.add("""
with b as (select distinct bundle from matches where bundle is not null),
x as (select bundle, regexp_extract(bundle, '^(.+)_prod_[0-9a-f]{8}$', 1) crawler, string_split(bundle, '__') parts from b),
y as (select bundle, case when len(parts) = 3 then lower(parts[1]) else lower(crawler) end head, case when len(parts) = 3 then parts[1] else lower(crawler) end crawler, case when len(parts) = 3 then parts[3] end keyns, len(parts) = 3 or crawler <> '' ok from x)
select bundle, case when ok then case when starts_with(head, 'eune') then 'eune' when starts_with(head, 'euw') then 'euw' when starts_with(head, 'na') then 'na' when starts_with(head, 'br') then 'br' when starts_with(head, 'lan') then 'lan'
when starts_with(head, 'las') then 'las' when starts_with(head, 'kr') then 'kr' when starts_with(head, 'jp') then 'jp' when starts_with(head, 'tw') then 'tw' when starts_with(head, 'sg') then 'sg' when starts_with(head, 'oce') then 'oce'
when starts_with(head, 'tr') then 'tr' when starts_with(head, 'vn') then 'vn' when starts_with(head, 'ru') then 'ru' when starts_with(head, 'me') then 'me' end end region, case when ok then crawler end crawler, case when ok then keyns end keyns from y""")
def p_structured_name(t):
    b = t.matches.select("bundle").where(F.col("bundle").isNotNull()).distinct().withColumn("n", text.stack_name(F.col("bundle")))
    return b.select("bundle", "n.region", "n.crawler", "n.keyns")


@R_.add("""
with x as (select distinct upper(trim(solo_tier)) t, upper(trim(solo_rank)) d from player_ranks),
y as (select *, case t when 'MASTER' then 'Master' when 'GRANDMASTER' then 'GrandMaster' when 'CHALLENGER' then 'Challenger' else case when t in ('IRON','BRONZE','SILVER','GOLD','PLATINUM','EMERALD','DIAMOND') and d in ('IV','III','II','I') then upper(t[1]) || lower(t[2:]) || ' ' || d end end name,
case when t in ('MASTER','GRANDMASTER','CHALLENGER') then t when nullif(t, '') is not null and nullif(d, '') is not null then t || '_' || d else coalesce(nullif(t, ''), 'UNKNOWN') end bucket from x)
select name, bucket, case when bucket = 'UNKNOWN' then 999 else coalesce(nullif(list_position(['IRON','BRONZE','SILVER','GOLD','PLATINUM','EMERALD','DIAMOND','MASTER','GRANDMASTER','CHALLENGER'], split_part(bucket, '_', 1)), 0) - 1, 998) end tier,
coalesce(nullif(list_position(['IV','III','II','I'], list_last(string_split(bucket, '_'))), 0) - 1, 0) division from y group by all""")
def p_rank_normalise_bucket(t):
    x = t.player_ranks.select(R.rank_name(F.col("solo_tier"), F.col("solo_rank")).alias("name"), R.rank_bucket(F.lit(None).cast("string"), F.col("solo_tier"), F.col("solo_rank")).alias("bucket")).distinct()
    o = R.bucket_order(F.col("bucket"))
    return x.select("name", "bucket", o["tier"].alias("tier"), o["division"].alias("division"))


@R_.add("""select match_id, coalesce(try_cast(list_last(string_split(match_id, '_')) as bigint), -1) recency from matches where match_id is not null group by 1, 2 order by recency desc, match_id limit 20""")
def p_recency_key(t):
    m = t.matches.select("match_id").where(F.col("match_id").isNotNull()).distinct()
    return m.withColumn("recency", text.recency(F.col("match_id"))).orderBy(F.desc("recency"), "match_id").limit(20)


@R_.add("""
with d(prefix, label) as (values ('EU', 'europe'), ('EUW', 'west'), ('KR', 'asia'), ('JP', 'asia'), ('NA', 'america'), ('LA', 'america'), ('LA2', 'south')),
m as (select distinct match_id from matches where match_id is not null)
select match_id, (select label from d where starts_with(match_id, prefix) order by length(prefix) desc limit 1) label from m""")
def p_prefix_longest_match(t):
    d = t.spark.createDataFrame([("EU", "europe"), ("EUW", "west"), ("KR", "asia"), ("JP", "asia"), ("NA", "america"), ("LA", "america"), ("LA2", "south")], "prefix string, label string")
    return relations.longest_prefix(t.matches.select("match_id").where(F.col("match_id").isNotNull()).distinct(), "match_id", d, "prefix", "label", ["match_id"])


@R_.add("""
with s as (select sha256('{"p_brand":"' || p_brand || '","p_size":' || p_size || ',"p_type":"' || p_type || '"}') sig from part)
select sig, count(*) n from s group by 1""")
def p_signature(t):
    return t.part.select(text.signature(["p_type", "p_size", "p_brand"]).alias("sig")).groupBy("sig").agg(F.count("*").alias("n"))


_ZONES = ["UTC", "America/Chicago", "Europe/Warsaw", "Asia/Seoul", "Australia/Sydney", "America/Sao_Paulo"]


@R_.add(f"""
with z as (select event_id, timezone({_ZONES!r}[(user_id % 6 + 1)::int], timezone('UTC', ts)) l from events)
select event_id, (isodow(l) >= 6)::int is_weekend, round(sin(2 * pi() * (hour(l) * 3600 + minute(l) * 60 + floor(second(l))) / 86400), 9) + 0 local_sin,
round(cos(2 * pi() * (hour(l) * 3600 + minute(l) * 60 + floor(second(l))) / 86400), 9) + 0 local_cos from z""")
def p_local_time_features(t):
    zone = F.get(F.array(*[F.lit(z) for z in _ZONES]), (F.col("user_id") % 6).cast("int"))
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone)
    sin, cos = clock.day_angle(F.col("l"))
    e = t.events.select("event_id", local.alias("l"))
    return e.select("event_id", (F.weekday("l") >= 5).cast("int").alias("is_weekend"), (F.round(sin, 9) + 0).alias("local_sin"), (F.round(cos, 9) + 0).alias("local_cos"))


@R_.add("""
with h as (select hour(ts) + minute(ts) / 60.0 + extract('microseconds' from ts) / 3600e6 h from events)
select (floor(h) % 24)::int hour_bucket, count(*) n, count(*) filter (h >= 23 or h < 7) night, count(*) filter (h >= 2 and h < 8.5) under from h group by 1""")
def p_clock_window(t):
    h = t.events.select(clock.clock_hour(F.col("ts").cast("timestamp")).alias("h"))
    g = h.groupBy((F.floor("h") % 24).cast("int").alias("hour_bucket"))
    return g.agg(F.count("*").alias("n"), F.count_if(clock.in_clock_window(F.col("h"), 23, 7)).alias("night"), F.count_if(clock.in_clock_window(F.col("h"), 2, 8.5)).alias("under"))


@R_.add("""
with s as (select l_orderkey k, sum(round(l_extendedprice * 100)::bigint * (round(l_discount * 100)::bigint - 3)) rev, sum(round(l_extendedprice * 100)::bigint) price from lineitem group by 1)
select k orderkey, round(case when rev <= 0 then 0.0 else price::double / rev::double end, 6) ratio from s""")
def p_safe_div_share(t):
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.sum(cents("l_extendedprice") * (cents("l_discount") - 3)).alias("rev"), F.sum(cents("l_extendedprice")).alias("price"))
    return s.select("orderkey", F.round(numeric.safe_div(F.col("price"), F.col("rev")), 6).alias("ratio"))


@R_.add("""select c_custkey, cast(concat('0x', sha256(c_name)[1:16])::ubigint as varchar) u64, (concat('0x', sha256(c_name)[1:16])::ubigint % 100)::bigint bucket from customer""")
def p_u64_hash(t):
    return t.customer.select("c_custkey", hashing.u64(F.col("c_name")).cast("string").alias("u64"), hashing.u64_mod(F.col("c_name"), 100).alias("bucket"))


@R_.add("""
with e as (select quantile_cont(o_totalprice, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) edges from orders)
select len(list_filter(edges, lambda x: x <= o_totalprice))::int decile, count(*) n from orders, e group by 1""")
def p_decile_left_closed(t):
    return bins.with_bins(t.orders, "o_totalprice", 10, "decile").groupBy("decile").agg(F.count("*").alias("n"))


@R_.add("""
with e as (select quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) edges from orders where o_orderstatus = 'F')
select (len(list_filter(edges, lambda x: x < o_totalprice)) + 1)::int quartile, count(*) n from orders, e group by 1""")
def p_quartile_right_closed(t):
    return bins.with_bins(t.orders, "o_totalprice", 4, "quartile", t.orders.where("o_orderstatus = 'F'"), "right").groupBy("quartile").agg(F.count("*").alias("n"))


@R_.add("""
with s as (select o_orderstatus, dense_rank() over (order by o_orderstatus) - 1 c from (select distinct o_orderstatus from orders)),
p as (select o_orderpriority, dense_rank() over (order by o_orderpriority) - 1 c from (select distinct o_orderpriority from orders)),
e as (select quantile_cont(o_totalprice, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) edges from orders)
select ((s.c * (select count(*) from p) + p.c) * 10 + len(list_filter(edges, lambda x: x <= o_totalprice)))::bigint code, count(*) n from orders join s using (o_orderstatus) join p using (o_orderpriority), e group by 1""")
def p_strata_code(t):
    o = bins.with_bins(t.orders, "o_totalprice", 10, "decile")
    s, p = bins.dense_codes(t.orders, "o_orderstatus", "s"), bins.dense_codes(t.orders, "o_orderpriority", "p")
    n = p.count()
    j = o.join(F.broadcast(s), "o_orderstatus").join(F.broadcast(p), "o_orderpriority")
    return j.groupBy(bins.mixed_radix([(F.col("s"), 1), (F.col("p"), n), (F.col("decile"), 10)]).alias("code")).agg(F.count("*").alias("n"))


@R_.add("""
with x as (select l_orderkey, list(l_suppkey::varchar order by l_linenumber, l_partkey, l_suppkey, l_quantity) a from lineitem group by 1),
d as (select l_orderkey, list_filter(a, lambda v, i: list_position(a, v) = i) d from x)
select l_orderkey orderkey, len(d)::int distinct_suppliers, array_to_string(d, ',') suppliers from d""")
def p_array_dedupe(t):
    x = t.lineitem.groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("a"))
    d = x.withColumn("d", arrays.distinct_in_order(F.transform("a", lambda v: v["l_suppkey"].cast("string"))))
    return d.select("orderkey", F.size("d").alias("distinct_suppliers"), F.array_join("d", ",").alias("suppliers"))


@R_.add("""select event_type, round(sum(coalesce(try_cast(json_extract_string(props, '$.k') as double), 0)), 4) k_sum, round(sum(coalesce(try_cast(json_extract_string(props, '$.absent') as double), 2.5)), 4) absent_sum from events group by 1""")
def p_json_get_default(t):
    return t.events.groupBy("event_type").agg(F.round(F.sum(arrays.json_number(F.col("props"), "$.k")), 4).alias("k_sum"), F.round(F.sum(arrays.json_number(F.col("props"), "$.absent", 2.5)), 4).alias("absent_sum"))


@R_.add("""select user_id, round(max(value - 50), 6) high, round(coalesce(min(case when value > 50 then value - 50 end), 0), 6) least_positive, round(sum(value - 50), 4) total, round(avg(value - 50), 6) mean from events group by 1""")
def p_min_positive(t):
    v = F.col("value") - 50
    return t.events.groupBy("user_id").agg(F.round(F.max(v), 6).alias("high"), F.round(arrays.positive_min(v), 6).alias("least_positive"), F.round(F.sum(v), 4).alias("total"), F.round(F.avg(v), 6).alias("mean"))


@R_.add("""select c_mktsegment || '_h' || lpad((c_custkey % 24)::varchar, 2, '0') label, regexp_replace(c_name || '.json.zst', '\\.json(\\.zst)?$', '') id, count(*) n from customer group by 1, 2""")
def p_composite_labels(t):
    return t.customer.groupBy(text.label(F.col("c_mktsegment"), F.col("c_custkey") % 24).alias("label"), text.id_of_file(F.concat("c_name", F.lit(".json.zst"))).alias("id")).agg(F.count("*").alias("n"))


@R_.add("""
with s as (select l_orderkey k, count(*) lines, epoch_ms(min(l_shipdate)) a, epoch_ms(max(l_shipdate)) b from lineitem group by 1),
d as (select k, lines, case when k % 3 = 0 then (k % 50)::double else 0 end given, a, b from s),
e as (select k, lines, case when given > 0 then given when b > a and a > 0 then (b - a) / 1000.0 else 0.0 end dur from d)
select k orderkey, round(dur, 3) duration_s, round(lines / nullif(dur, 0), 9) rate, round((10 - lines) / nullif(lines / nullif(dur, 0), 0), 3) remaining_s from e""")
def p_duration_eta(t):
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.count("*").alias("lines"), F.unix_millis(F.min("l_shipdate").cast("timestamp")).alias("a"), F.unix_millis(F.max("l_shipdate").cast("timestamp")).alias("b"))
    given = F.when(F.col("orderkey") % 3 == 0, (F.col("orderkey") % 50).cast("double"))
    d = s.withColumn("dur", clock.duration_s(given, F.col("a"), F.col("b")))
    e = clock.eta(F.col("lines"), F.lit(10), F.col("dur"))
    return d.select("orderkey", F.round("dur", 3).alias("duration_s"), F.round(e["rate"], 9).alias("rate"), F.round(e["remaining_s"], 3).alias("remaining_s"))


@R_.add("""select l_returnflag, sum(case when l_returnflag = 'A' or l_linestatus = 'F' then 1.0 else 0.0 end) flagged, round(sum(l_quantity + l_discount + l_tax + l_linenumber + l_extendedprice), 2) total from lineitem group by 1""")
def p_flags_sum(t):
    five = sum((F.col(c) for c in ("l_discount", "l_tax", "l_linenumber", "l_extendedprice")), F.col("l_quantity"))
    return t.lineitem.groupBy("l_returnflag").agg(F.sum(numeric.flag(F.col("l_returnflag") == "A", F.col("l_linestatus") == "F")).alias("flagged"), F.round(F.sum(five), 2).alias("total"))


@R_.add("""
with top as (select min(p_retailprice) lo, max(p_retailprice) hi from (select p_retailprice from part order by p_size, p_partkey limit 10)),
box as (select greatest(lo - (hi - lo) * 0.25, 100) a, least(hi + (hi - lo) * 0.25, 2500) b from top)
select p_partkey, round(a, 6) low, round(b, 6) high from part, box where p_retailprice between a and b""")
def p_range_expand(t):
    top = t.part.orderBy("p_size", "p_partkey").limit(10).agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    a, b = numeric.padded_range(F.col("lo"), F.col("hi"), 100, 2500)
    box = top.select(a.alias("a"), b.alias("b"))
    return with_row(t.part, box).where(F.col("p_retailprice").between(F.col("a"), F.col("b"))).select("p_partkey", F.round("a", 6).alias("low"), F.round("b", 6).alias("high"))


@R_.add("""select p_partkey, round_even(p_size / 2.0, 0) half_even, abs(p_retailprice - round(p_retailprice, 1)) <= 0.02 near, (case when p_size < 28 then p_size // 4 else p_size - 21 end)::int tier from part""")
def p_isclose_round(t):
    return t.part.select("p_partkey", numeric.half_even(F.col("p_size") / 2).alias("half_even"), numeric.close(F.col("p_retailprice"), F.round("p_retailprice", 1), 0.02).alias("near"), numeric.tier_index(F.col("p_size")).alias("tier"))


@R_.add("""
with x as (select *, value - avg(value) over (partition by event_type) d from events)
select event_id, round(1 / (1 + exp(-d / 25)), 9) p, case when value < 20 then 0.1 when value < 60 then 0.5 else 1.0 end step from x""")
def p_logistic_step(t):
    return relations.less_group_mean(t.events, "event_type", "value", "d").select("event_id", F.round(numeric.logistic(F.col("d") / 25), 9).alias("p"), numeric.step_table(F.col("value"), [(20, 0.1), (60, 0.5)], 1.0).alias("step"))


@R_.add("""
with g as (select user_id, count(*) filter (event_type = 'click') a, count(*) filter (event_type = 'view') b, count(*) n from events group by 1),
s as (select user_id, a * 100000.0 + b * 30000.0 + n * 500.0 - (100 - n) * 400.0 score from g)
select user_id, score, ((row_number() over (order by score desc, user_id) - 1) // 7)::int chunk from s""")
def p_impact_score(t):
    g = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("a"), F.count_if(F.col("event_type") == "view").alias("b"), F.count("*").alias("n"))
    s = g.select("user_id", numeric.impact_score(nines=F.col("a"), eights=F.col("b"), incomplete=F.col("n"), deficit=100 - F.col("n")).alias("score"))
    return relations.with_row_id(s, [F.desc("score"), F.asc("user_id")], "n", 1).select("user_id", "score", arrays.chunk_number(F.col("n"), 7).alias("chunk"))


@R_.add("""
with x as (select l_orderkey k, list(l_returnflag) f, list(l_quantity order by l_quantity) q from lineitem group by 1)
select k orderkey, len(f) = 4 four, list_sort(list_distinct(f)) = ['A','N','R'] all_flags, len(list_filter(q, lambda v: v > 5)) = len(q) big, list_filter(q, lambda v: v > 25)[1] first_large from x""")
def p_array_predicates(t):
    x = t.lineitem.groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.collect_list("l_returnflag").alias("f"), F.array_sort(F.collect_list("l_quantity")).alias("q"))
    flags = F.array(F.lit("A"), F.lit("N"), F.lit("R"))
    return x.select("orderkey", arrays.exactly(F.col("f"), 4).alias("four"), arrays.same_set(F.col("f"), flags).alias("all_flags"), F.forall("q", lambda v: v > 5).alias("big"), arrays.first_where(F.col("q"), lambda v: v > 25).alias("first_large"))


@R_.add("""select c_custkey, sha1('42::' || c_custkey) h from customer order by h, c_custkey limit 100""")
def p_seeded_order(t):
    s = choosing.seeded_sample(t.customer, "c_custkey", 42, 100)
    return s.select("c_custkey", hashing.seeded_order(F.col("c_custkey"), 42).alias("h"))


@R_.add("""
with e as (select quantile_cont(l_extendedprice, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) edges from lineitem),
x as (select least(len(list_filter(edges, lambda v: v < l_extendedprice)), 9) a, least(len(list_filter(edges, lambda v: v < l_quantity * 1000)), 9) b from lineitem, e)
select round(avg(abs(a - b)), 6) mean_gap, round(avg((a = b)::int), 6) exact, round(avg((abs(a - b) <= 1)::int), 6) within_1 from x""")
def p_searchsorted_left(t):
    x = with_row(t.lineitem, bins.quantile_edges(t.lineitem, "l_extendedprice", 10))
    g = F.abs(bins.bin_before(F.col("l_extendedprice"), F.col("edges"), 10) - bins.bin_before(F.col("l_quantity") * 1000, F.col("edges"), 10))
    x = x.select(g.alias("g"))
    return x.agg(F.round(F.avg("g"), 6).alias("mean_gap"), F.round(F.avg((F.col("g") == 0).cast("int")), 6).alias("exact"), F.round(F.avg((F.col("g") <= 1).cast("int")), 6).alias("within_1"))


@R_.add("""
with s as (select avg(c_acctbal) m, stddev_pop(c_acctbal) s from customer where c_mktsegment <> 'BUILDING')
select c_custkey, case when c_mktsegment = 'BUILDING' then 1.0 else 0.0 end c_mktsegment_BUILDING, case when c_mktsegment = 'MACHINERY' then 1.0 else 0.0 end c_mktsegment_MACHINERY, round((c_acctbal - m) / s, 6) z from customer, s""")
def p_one_hot_scale(t):
    c = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    z = bins.standardised(c, ["c_acctbal"], c.where("c_mktsegment <> 'BUILDING'"))
    return z.select("c_custkey", *bins.one_hot("c_mktsegment", ["BUILDING", "MACHINERY"]), F.round("c_acctbal", 6).alias("z"))


@R_.add("""
with x as (select p_retailprice v, p_type || case p_size % 5 when 0 then '_pm_avg' when 1 then '_pm_delta' when 2 then '_share_avg' when 3 then '_delta' else '' end n from part)
select case when ends_with(n, '_pm_avg') then 'per_minute_avg' when ends_with(n, '_pm_delta') then 'per_minute_delta' when ends_with(n, '_share_avg') then 'share_avg' when ends_with(n, '_delta') then 'delta' when ends_with(n, '_avg') then 'avg' else 'other' end family,
count(*) n, round(sum(abs(v - 1000)), 2) abs_sum from x group by 1""")
def p_name_taxonomy(t):
    suffix = F.get(F.array(*[F.lit(s) for s in ("_pm_avg", "_pm_delta", "_share_avg", "_delta", "")]), (F.col("p_size") % 5).cast("int"))
    return t.part.groupBy(text.name_class(F.concat("p_type", suffix)).alias("family")).agg(F.count("*").alias("n"), F.round(F.sum(F.abs(F.col("p_retailprice") - 1000)), 2).alias("abs_sum"))
