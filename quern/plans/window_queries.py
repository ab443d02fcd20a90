"""Queries of windows, sampling, ladder labels, models, jobs and streams on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import hashing
from quern.functions import ranks as R
from quern.functions.oracle_text import normal_quantile_sql
from quern.functions.subquery import with_row
from quern.operators import audit, choosing, jobs, labels, sessions, simulate, statistics, trees
from quern.plans.registry import Registry
from quern.session import Workspace
from quern.streaming import streams

R_ = Registry()
QUERIES, ORACLES = R_.queries, R_.sql

_ORDER = "l_returnflag = 'N' desc, l_discount desc, l_quantity desc, l_tax, l_suppkey, l_partkey, l_extendedprice"


def _line_order() -> list:
    return [F.desc(F.col("l_returnflag") == "N"), F.desc("l_discount"), F.desc("l_quantity"), F.asc("l_tax"), F.asc("l_suppkey"), F.asc("l_partkey"), F.asc("l_extendedprice")]


@R_.add(f"""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() over (partition by l_orderkey, l_linenumber order by {_ORDER})::int rank,
dense_rank() over (partition by l_orderkey, l_linenumber order by l_returnflag = 'N' desc, l_discount desc) = 1 tied from lineitem""")
def w_best_of_group(t):
    d = choosing.winners_and_losers(t.lineitem, ["l_orderkey", "l_linenumber"], _line_order(), _line_order()[:2])
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "rank", "tied")


@R_.add("""
with x as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) rn from lineitem),
r as (select *, sum(l_quantity) over (partition by l_orderkey order by rn) run, sum(l_quantity) over (partition by l_orderkey) total from x)
select l_orderkey, l_linenumber, l_suppkey from r where run > concat('0x', sha256(l_orderkey::varchar)[1:16])::ubigint % total::ubigint and run - l_quantity <= concat('0x', sha256(l_orderkey::varchar)[1:16])::ubigint % total::ubigint""")
def w_weighted_hash_pick(t):
    d = choosing.weighted_pick(t.lineitem, ["l_orderkey"], "l_quantity", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], F.col("l_orderkey"))
    return d.select("l_orderkey", "l_linenumber", "l_suppkey")


@R_.add("select c_mktsegment, c_custkey from customer qualify row_number() over (partition by c_mktsegment order by sha256(c_name)[1:16], c_custkey desc) <= 20")
def w_hash_topk_stratum(t):
    return choosing.hash_top_k(t.customer.select("c_mktsegment", "c_custkey", "c_name"), ["c_mktsegment"], 20, hashing.u64_order(F.col("c_name")), [F.desc("c_custkey")]).select("c_mktsegment", "c_custkey")


_APPORTION = """
g as (select o_orderpriority p, o_orderstatus s, count(*) n from orders group by 1, 2), r as (select *, 1000.0 * n / sum(n) over () raw from g),
f as (select *, floor(raw) fl, 1000 - sum(floor(raw)) over () left_over, row_number() over (order by raw - floor(raw) desc, p, s) place from r),
q as (select p, s, n, least(n, fl + case when place <= left_over then 1 else 0 end)::bigint quota from f)"""


@R_.add(f"with {_APPORTION} select p o_orderpriority, s o_orderstatus, n, quota from q")
def w_apportion(t):
    g = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return choosing.apportion(g, "n", 1000, [F.col("o_orderpriority"), F.col("o_orderstatus")])


@R_.add(f"""with {_APPORTION}
select o_orderkey, o_orderpriority, o_orderstatus from orders join q on p = o_orderpriority and s = o_orderstatus qualify row_number() over (partition by o_orderpriority, o_orderstatus order by sha1('7::' || o_orderkey), o_orderkey) <= max(quota) over (partition by o_orderpriority, o_orderstatus)""")
def w_stratified_slice(t):
    o = t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return choosing.stratified_slice(o, ["o_orderpriority", "o_orderstatus"], hashing.seeded_order(F.col("o_orderkey"), 7), 1000, [F.col("o_orderkey")]).select("o_orderkey", "o_orderpriority", "o_orderstatus")


@R_.add("select l_partkey, l_suppkey from lineitem qualify row_number() over (partition by l_partkey order by l_shipdate desc, l_orderkey desc, l_linenumber desc, l_suppkey desc) = 1")
def w_last_wins(t):
    d = t.lineitem.select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")
    return choosing.last_wins(d, ["l_partkey"], [F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")]).select("l_partkey", "l_suppkey")


@R_.add("""
with e as (select distinct l_suppkey p, l_orderkey m from lineitem), k as (select l_suppkey p, count(*) filter (l_returnflag = 'R') covered from lineitem group by 1),
pm as (select m, count(*) filter (covered >= 200) c from e join k using (p) group by 1),
g as (select p, max(c) best_partial, count(*) filter (c >= 3) near, count(*) incomplete, 200 - first(covered) deficit from e join pm using (m) join k using (p) where c < 10 and covered < 200 group by 1)
select p l_suppkey, best_partial, near, incomplete, deficit, row_number() over (order by best_partial desc, near desc, incomplete desc, deficit, p)::int place from g""")
def w_priority_rank(t):
    e = t.lineitem
    players, per, _ = labels.coverage(e, "l_suppkey", "l_orderkey", F.col("l_returnflag") == "R", 200)
    return labels.priorities(e, "l_suppkey", "l_orderkey", players, per, 200, 10, 3)


@R_.add("""
with b as (select c_mktsegment, c_custkey, case when c_acctbal between 9900 and 9960 then 0 when c_acctbal between 9800 and 9900 then 1 when c_acctbal > 0 then 2 end band from customer)
select c_mktsegment, band, c_custkey from b where band is not null qualify band = min(band) over (partition by c_mktsegment)""")
def w_band_fallthrough(t):
    a = F.col("c_acctbal")
    band = F.when(a.between(9900, 9960), 0).when(a.between(9800, 9900), 1).when(a > 0, 2)
    return choosing.band_fallthrough(t.customer.select("c_mktsegment", "c_custkey", "c_acctbal"), ["c_mktsegment"], band).select("c_mktsegment", "band", "c_custkey")


@R_.add("""select p_partkey, nullif(min(p_partkey) over (partition by p_brand, p_type, p_size), p_partkey) duplicate_of from part""")
def w_first_per_signature(t):
    d = t.part.select("p_partkey", F.concat_ws("|", "p_brand", "p_type", F.col("p_size").cast("string")).alias("sig"))
    return choosing.first_per_signature(d, "sig", "p_partkey").select("p_partkey", "duplicate_of")


@R_.add("""
with x as (select c_custkey, row_number() over (order by c_acctbal desc, c_custkey) rn from customer)
select c_custkey, case when rn <= 44 then 'challenger' when rn <= 138 then 'grandmaster' else 'master' end label from x""")
def w_caps_by_order(t):
    c = t.customer.select("c_custkey", "c_acctbal")
    return choosing.capped_by_order(c, [F.desc("c_acctbal"), F.asc("c_custkey")], [("challenger", 44), ("grandmaster", 94)], "master").select("c_custkey", "label")


@R_.add("""
with n as (select c_custkey, c_mktsegment, c_acctbal, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) rn from customer),
q as (select *, rn <= case c_mktsegment when 'BUILDING' then 30 when 'MACHINERY' then 10 else 0 end inside from n)
select c_custkey, 'quota' picked_as from q where inside union all
select c_custkey, 'spill' from (select c_custkey, row_number() over (order by c_acctbal desc, c_custkey) p from q where not inside) where p <= 100 - (select count(*) from q where inside)""")
def w_quota_spill(t):
    c = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    return choosing.quota_with_spill(c, "c_mktsegment", {"BUILDING": 30, "MACHINERY": 10}, 100, [F.desc("c_acctbal"), F.asc("c_custkey")]).select("c_custkey", "picked_as")


@R_.add("""
with x as (select user_id, event_type, ts, event_id, row_number() over (partition by user_id order by ts, event_id) - row_number() over (partition by user_id, event_type order by ts, event_id) g from events),
r as (select user_id, event_type, g, count(*) n from x group by 1, 2, 3)
select user_id, max(n) longest, count(*) runs from r group by 1""")
def w_streaks(t):
    s = choosing.streaks(t.events, ["user_id"], ["ts", "event_id"], "event_type")
    return s.groupBy("user_id").agg(F.max("length").alias("longest"), F.count("*").alias("runs"))


@R_.add("""
with g as (select o_orderpriority, count(*) n from orders group by 1), c as (select *, 100.0 * sum(n) over (order by o_orderpriority) / sum(n) over () upper_pct from g)
select o_orderpriority, round(lag(upper_pct, 1, 0) over (order by o_orderpriority), 6) lower_pct, round(upper_pct, 6) upper_pct from c""")
def w_cumulative_bounds(t):
    w = Window.orderBy("o_orderpriority")
    g = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    c = g.withColumn("u", 100.0 * F.sum("n").over(w) / F.sum("n").over(Window.partitionBy()))
    return c.select("o_orderpriority", F.round(F.lag("u", 1, 0.0).over(w), 6).alias("lower_pct"), F.round("u", 6).alias("upper_pct"))


@R_.add("""
with x as (select o_orderstatus, o_orderpriority, row_number() over (partition by o_orderstatus, o_orderpriority order by sha1('9::' || o_orderkey)) rn, count(*) over (partition by o_orderstatus, o_orderpriority) n from orders)
select o_orderstatus, o_orderpriority, ((rn - 1) % 5)::int fold, count(*) n, count(*) filter (rn <= round_even(n * 0.1, 0)) test from x group by 1, 2, 3""")
def w_stratified_folds(t):
    d = choosing.stratified_folds(t.orders, ["o_orderstatus", "o_orderpriority"], hashing.seeded_order(F.col("o_orderkey"), 9), 5, 0.1)
    return d.groupBy("o_orderstatus", "o_orderpriority", "fold").agg(F.count("*").alias("n"), F.count_if("is_test").alias("test"))


@R_.add("""
with g as (select l_orderkey, l_linenumber, count(*) n, bool_or(l_returnflag = 'N') c from lineitem group by 1, 2 having count(*) > 1)
select case when c then 'plan' else 'skip' end action, count(*) groups, sum(n - 1)::bigint losers from g group by 1""")
def w_plan_skip_groups(t):
    g = audit.duplicate_groups(t.lineitem.withColumn("c", F.col("l_returnflag") == "N"), ["l_orderkey", "l_linenumber"])
    c = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_returnflag") == "N").alias("c"))
    d = g.join(c, ["l_orderkey", "l_linenumber"])
    return d.groupBy(F.when(F.col("c"), "plan").otherwise("skip").alias("action")).agg(F.count("*").alias("groups"), F.sum(F.col("copies") - 1).alias("losers"))


@R_.add("select p_partkey, row_number() over (order by p_retailprice, abs(p_size - 25), p_partkey)::int place from part qualify place <= 50")
def w_leaderboard(t):
    top = t.part.orderBy("p_retailprice", F.abs(F.col("p_size") - 25), "p_partkey").limit(50)
    return top.select("p_partkey", F.row_number().over(Window.orderBy("p_retailprice", F.abs(F.col("p_size") - 25), "p_partkey")).alias("place"))


@R_.add("""
with x as (select *, row_number() over (order by o_orderkey) <= floor(0.75 * count(*) over ()) is_train from orders)
select is_train, count(*) n, round(avg(o_totalprice), 4) mean from x group by 1""")
def w_sequential_split(t):
    return choosing.sequential_split(t.orders, "o_orderkey").groupBy("is_train").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


# The default ladder as SQL values, for the oracle queries below.
_BINS = "b0(ord, rank, share) as (values " + ", ".join(f"({i}, '{r}', {s})" for i, (r, s) in enumerate(zip(R.RANKS, R.DEFAULT_SHARES))) + "), bins as (select rank, 100.0::double * sum(share::double) over (order by ord) / sum(share::double) over () up, ord from b0), lad as (select ord, rank, up, lag(up, 1, 0) over (order by ord) lo from bins)"
_PCT = """r as (select c_custkey, c_nationkey, case c_custkey % 6 when 0 then 'Iron IV' when 1 then 'Gold IV' when 2 then 'Emerald I' when 3 then 'Master' when 4 then 'GrandMaster' else 'Challenger' end rank, greatest(c_acctbal, 0) lp from customer),
e as (select *, case when rank = 'Master' and lp >= 1000 then 'GrandMaster' when rank = 'GrandMaster' and lp >= 1250 then 'Challenger' else rank end eff from r),
f as (select *, case eff when 'Master' then lp / 1000 when 'GrandMaster' then (lp - 1000) / 250 when 'Challenger' then (lp - 1250) / 1150 else lp / 100 end raw from e),
p as (select c_custkey, c_nationkey, least(greatest(lo + least(greatest(raw, 0), 1) * (up - lo), 0.01), 99.99) pct from f join lad on lad.rank = eff)"""


def _ranked(t):
    names = F.array(*[F.lit(x) for x in ("Iron IV", "Gold IV", "Emerald I", "Master", "GrandMaster", "Challenger")])
    c = t.customer.select("c_custkey", "c_nationkey", F.get(names, (F.col("c_custkey") % 6).cast("int")).alias("rank"), F.col("c_acctbal").alias("lp"))
    return labels.probits(c, "rank", "lp", F.lit("default"), R.ladder(t.spark))


@R_.add(f"with {_BINS}, {_PCT} select c_custkey, round(pct, 6) percentile from p")
def r_percentile(t):
    return _ranked(t).select("c_custkey", F.round("percentile", 6).alias("percentile"))


@R_.add(f"with {_BINS}, {_PCT} select c_nationkey, count(*) mapped, round(avg({normal_quantile_sql('(pct / 100)')}), 9) skill from p group by 1 having count(*) >= 30")
def r_probit_label(t):
    g = _ranked(t).groupBy("c_nationkey").agg(F.count("probit").alias("mapped"), F.avg("probit").alias("skill"))
    return g.where("mapped >= 30").select("c_nationkey", "mapped", F.round("skill", 9).alias("skill"))


_DENSITY = "exp(-0.5 * ({0}) * ({0})) / sqrt(2 * pi())"


@R_.add(f"""with {_BINS}, q as (select ord, rank, lo, up, case when lo > 0 then {normal_quantile_sql('(lo / 100)')} end a, case when up < 99.9999999 then {normal_quantile_sql('(up / 100)')} end b from lad)
select rank, ord::int ord, round((case when a is null then 0 else {_DENSITY.format('a')} end - case when b is null then 0 else {_DENSITY.format('b')} end) / ((up - lo) / 100), 6) mean, round(up / 100 - 1e-9, 6) upper from q""")
def r_bin_mean(t):
    mean = R.truncated_mean(F.col("lower_pct"), F.col("upper_pct"))
    upper = R.normal_cdf(R.normal_quantile(F.col("upper_pct") / 100 - 1e-9))
    return R.ladder(t.spark).select("rank", "ord", F.round(mean, 6).alias("mean"), F.round(upper, 6).alias("upper"))


@R_.add("""
with x as (select l_orderkey % 5 fold, [1.0, l_quantity, l_discount, l_tax, l_extendedprice] z from lineitem), c as (select fold, i, j, z[i + 1] * z[j + 1] v from x, range(5) a(i), range(5) b(j) where i <= j)
select fold, i::int i, j::int j, round(sum(v) / 10.0 ** floor(log10(sum(v))), 8) "value" from c group by 1, 2, 3""")
def m_gram(t):
    g = statistics.gram(t.lineitem.withColumn("fold", F.col("l_orderkey") % 5), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", ["fold"])
    return g.select("fold", "i", "j", F.round(F.col("value") / F.pow(F.lit(10.0), F.floor(F.log10("value"))), 8).alias("value"))


_FIT = """
with s as (select l_orderkey % 5 fold, count(*) n, avg(l_quantity) ma, avg(l_discount) mb, avg(l_extendedprice) my, var_pop(l_quantity) * {k} va, var_pop(l_discount) * {k} vb, covar_pop(l_quantity, l_discount) ab, covar_pop(l_quantity, l_extendedprice) ay, covar_pop(l_discount, l_extendedprice) b_y from lineitem group by 1),
b as (select *, (ay * vb - b_y * ab) / (va * vb - ab * ab) ba, (b_y * va - ay * ab) / (va * vb - ab * ab) bb from s)
select fold, n, round(my - ba * ma - bb * mb, 4) intercept, round(ba, 4) beta_a, round(bb, 3) beta_b from b"""


def _fit(t, alpha):
    d = statistics.two_feature_fit(t.lineitem.withColumn("fold", F.col("l_orderkey") % 5), "l_quantity", "l_discount", "l_extendedprice", alpha, ["fold"])
    return d.select("fold", "n", F.round("intercept", 4).alias("intercept"), F.round("beta_a", 4).alias("beta_a"), F.round("beta_b", 3).alias("beta_b"))


@R_.add(_FIT.format(k="1.0"))
def m_ols_two_feature(t):
    return _fit(t, None)


@R_.add(_FIT.format(k="1.5"))
def m_ridge_two_feature(t):
    return _fit(t, 0.5)


@R_.add("""
with p as (select l_returnflag, l_extendedprice y, 120 + 1490 * l_quantity + 50 * l_discount - 20 * l_tax p from lineitem)
select l_returnflag, round(sqrt(avg((y - p) * (y - p))), 4) rmse, round(avg(abs(y - p)), 4) mae from p group by 1""")
def m_predict_dot(t):
    p = statistics.predict(t.lineitem, ["l_quantity", "l_discount", "l_tax"], 120, [1490, 50, -20])
    e = F.col("l_extendedprice") - F.col("predicted")
    return p.groupBy("l_returnflag").agg(F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"), F.round(F.avg(F.abs(e)), 4).alias("mae"))


@R_.add("""
with m as (select value v, avg(value) over () a, avg(value) over (partition by event_type) b, avg(value) over (partition by event_type, hour(ts)) c from events),
r as (select 'mean_only' model, sqrt(avg((v - a) ** 2)) rmse from m union all select 'type', sqrt(avg((v - b) ** 2)) from m union all select 'type_hour', sqrt(avg((v - c) ** 2)) from m)
select model, round(rmse, 6) rmse, round(max(rmse) over () - rmse, 6) lift from r""")
def m_residual_ladder(t):
    l = statistics.group_mean_ladder(t.events.withColumn("h", F.hour("ts")), {"mean_only": [], "type": ["event_type"], "type_hour": ["event_type", "h"]}, "value")  # noqa: E741
    return l.select("model", F.round("rmse", 6).alias("rmse"), F.round("lift", 6).alias("lift"))


_X = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@R_.add()
def m_lasso_path(t):
    """alpha, cv_rmse, nonzero along the grid; folds come from one pass over the data."""
    folds = statistics.summaries(t.lineitem.withColumn("fold", F.col("l_orderkey") % 5), _X, "l_extendedprice", "fold")
    total = statistics.Summary(sum(s.m for s in folds.values()))
    rows = []
    for a in statistics.lasso_grid(total, 9):
        cv = statistics.cross_validate(folds, lambda s, a=a: statistics.fit_lasso(s, a))
        beta = statistics.fit_lasso(total, a)[1]
        rows.append((float(a), sum(r["rmse"] for r in cv) / len(cv), int((abs(beta) > 0).sum())))
    return t.spark.createDataFrame(rows, "alpha double, cv_rmse double, nonzero int")


@R_.add()
def m_gbt_grid(t):
    """Trials of a boosted-tree search on parts, ranked."""
    d = t.part.withColumn("fold", F.pmod(F.xxhash64("p_partkey"), F.lit(5))).withColumn("brand", F.regexp_extract("p_brand", r"(\d+)", 1).cast("double"))
    return trees.search(t.spark, d.select("fold", "brand", F.col("p_size").cast("double").alias("size"), "p_retailprice"), ["brand", "size"], "p_retailprice", "fold", trees.unique_trials(2, 42))


@R_.add("""
with s as (select c_custkey id, (c_custkey % 31)::int rank, (c_custkey % 4) * 25.0 + case when c_custkey % 3 = 0 then 10 else 0 end lp, (c_custkey % 3)::int streak, c_acctbal > 3000 won from customer),
x as (select *, won and lp + 25 >= 100 and rank < 30 promoted, not won and lp - 25 < 0 under, case when abs(lp) < 1e-6 then streak + 1 else streak end losing, rank < 28 and rank % 4 = 0 tier_start from s),
y as (select *, under and rank > 0 and ((tier_start and lp - 25 > -25) or (abs(lp) < 1e-6 and losing <= 1)) held from x),
z as (select *, under and rank > 0 and not held fallen from y)
select id, rank + case when promoted then 1 when fallen then -1 else 0 end new_rank, (case when promoted then lp - 75 when won then lp + 25 when not under then lp - 25 when fallen then 80 else 0 end)::double new_lp,
case when won or not under or fallen then 0 when rank = 0 then streak else losing end new_streak from z""")
def sim_transition(t):
    c = F.col("c_custkey")
    s = t.customer.select(c.alias("id"), (c % 31).cast("int").alias("rank"), ((c % 4) * 25.0 + F.when(c % 3 == 0, 10).otherwise(0)).alias("lp"), (c % 3).cast("int").alias("streak"), (F.col("c_acctbal") > 3000).alias("won"))
    r, lp, k = simulate.transition(F.col("rank"), F.col("lp"), F.col("streak"), F.col("won"))
    return s.select("id", r.alias("new_rank"), lp.alias("new_lp"), k.alias("new_streak"))


@R_.add()
def sim_ladder(t):
    """Players, mean skill and points by rank after eight rounds, as many players as customers."""
    s = simulate.simulate(simulate.initial_state(t.spark, t.customer.count()), 8, Workspace(t.spark, "ladder"), caps=(30, 70))
    return s.groupBy("rank").agg(F.count("*").alias("players"), F.round(F.avg("skill"), 6).alias("skill"), F.round(F.avg("lp"), 6).alias("lp"))


@R_.add("""
with j as (select event_id, case event_type when 'click' then 'running' when 'view' then 'done' when 'error' then 'failed' else 'pending' end status, floor(epoch(ts))::bigint upd from events)
select case when status = 'running' and 1706659200 - upd > 864000 then 'pending' else status end status, status = 'running' and 1706659200 - upd > 864000 requeued, count(*) n from j group by 1, 2""")
def t_stale_requeue(t):
    names = F.create_map(*[F.lit(x) for x in ("click", "running", "view", "done", "error", "failed")])
    j = t.events.select("event_id", F.coalesce(names[F.col("event_type")], F.lit("pending")).alias("status"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("updated_at"))
    return jobs.requeue_stale(j, F.lit(1706659200), 864000).groupBy("status", "requeued").agg(F.count("*").alias("n"))


@R_.add("""
with x as (select user_id, floor(epoch(ts))::bigint s from events), y as (select user_id, count(*) over (partition by user_id order by s range between 3599 preceding and current row) c from x)
select user_id, max(c) busiest from y group by 1""")
def t_sliding_rate(t):
    c = jobs.trailing_counts(t.events, ["user_id"], F.unix_seconds(F.col("ts").cast("timestamp")), 3600)
    return c.groupBy("user_id").agg(F.max("trailing").alias("busiest"))


@R_.add("""
with s as (select distinct o_custkey k from orders where o_orderstatus = 'F')
select case when c_acctbal < 0 then 'failed' when c_custkey in (from s) then 'skipped_existing' else 'applied' end outcome, count(*) n from customer group by 1""")
def t_claim_outcome(t):
    state = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return jobs.apply_outcomes(t.customer, state, "c_custkey", F.col("c_acctbal") < 0)


@R_.add("""
with f as (select user_id, min(ts) first_ts from events where event_type = 'signup' group by 1), n as (select user_id, row_number() over (order by first_ts, user_id) rn from f)
select user_id, ((rn - 1) // 16)::int batch from n where rn <= 64""")
def t_claim_chunks(t):
    return jobs.claim_chunks(t.events.where("event_type = 'signup'"), "user_id", "ts", 16, 4)


@R_.add("""
select user_id, arg_max(event_type, (ts, event_id)) status, count(*) filter (event_type = 'click') attempts, count(*) transitions from events group by 1""")
def t_job_states(t):
    return jobs.latest_states(t.events, "user_id", "event_type", ["ts", "event_id"], "click")


@R_.add("""
with y as (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 6 hour then 0 else 1 end new from events), z as (select *, sum(new) over (partition by user_id order by ts, event_id) run from y)
select user_id, count(distinct run) sessions, max(n) largest from (select user_id, run, count(*) n from z group by 1, 2) group by 1""")
def t_session_gaps(t):
    e = t.events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    s = sessions.chunked_sessions(e, ["user_id"], "at", 6 * 3_600_000_000, 86_400_000_000)
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("events").alias("largest"))


@R_.add("select date_trunc('hour', ts)::timestamp start, event_type, count(*) n, round(avg(floor(value)::bigint), 6) mean from events group by 1, 2")
def t_tumbling(t):
    w = jobs.tumbling(t.events.withColumn("value", F.floor("value")), "ts", "1 hour", ["event_type"], "value")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


@R_.add("""
with d as (select distinct l_suppkey p, l_orderkey m from lineitem), k as (select l_suppkey p, count(*) filter (l_returnflag = 'R') c from lineitem group by 1),
u as (select p from k where c < 200), cand as (select m, count(*) owners from d join u using (p) group by 1)
select (select count(*) from u) unresolved, count(*) candidates, max(owners) most_owners from cand""")
def t_fixpoint_step(t):
    players, _, _ = labels.coverage(t.lineitem, "l_suppkey", "l_orderkey", F.col("l_returnflag") == "R", 200)
    open_ = players.where("not is_covered").select("l_suppkey")
    cand = t.lineitem.select("l_suppkey", "l_orderkey").distinct().join(open_, "l_suppkey").groupBy("l_orderkey").agg(F.count("*").alias("owners"))
    return with_row(open_.agg(F.count("*").alias("unresolved")), cand.agg(F.count("*").alias("candidates"), F.max("owners").alias("most_owners")))


def _drained(t, df, purpose, mode="append"):
    return streams.drain(df, Workspace(t.spark, purpose).root, mode)


@R_.add("select date_trunc('hour', ts)::timestamp start, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2")
def st_tumbling(t):
    d = _drained(t, streams.tumbling(streams.event_stream(t.spark, t.folder), "1 hour", ["event_type"], "value"), "stream", "complete")
    return d.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@R_.add("""
with x as (select date_trunc('hour', ts) - k * interval 1 hour start, event_type, value from events, range(2) r(k))
select start::timestamp start, event_type, count(*) n, round(sum(value), 4) total from x group by 1, 2""")
def st_sliding(t):
    d = _drained(t, streams.tumbling(streams.event_stream(t.spark, t.folder), "2 hours", ["event_type"], "value", "1 hour"), "stream", "complete")
    return d.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@R_.add("""
with y as (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 6 hour then 0 else 1 end new from events), z as (select *, sum(new) over (partition by user_id order by ts, event_id) run from y)
select user_id, min(ts)::timestamp start, (max(ts) + interval 6 hour)::timestamp "end", count(*) events from z group by user_id, run""")
def st_session(t):
    d = _drained(t, streams.sessions(streams.event_stream(t.spark, t.folder), "6 hours", ["user_id"]), "stream", "complete")
    return d.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "events")


@R_.add("select distinct event_id from events")
def st_dedup_watermark(t):
    e = streams.event_stream(t.spark, t.folder)
    return _drained(t, streams.distinct_events(e.union(e), ["event_id"]).select("event_id"), "stream")


@R_.add("select event_id, c_mktsegment from events left join customer on user_id = c_custkey")
def st_stream_static(t):
    e = streams.with_dimension(streams.event_stream(t.spark, t.folder), t.customer.select("c_custkey", "c_mktsegment"), "user_id", "c_custkey")
    return _drained(t, e.select("event_id", "c_mktsegment"), "stream")
