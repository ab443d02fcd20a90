"""Queries of joins, set operations, validation and aggregation on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import bins
from quern.functions.subquery import with_row
from quern.operators import audit, features, labels, relations, statistics
from quern.operators.quantiles import quantiles
from quern.plans.registry import Registry

R_ = Registry()
QUERIES, ORACLES = R_.queries, R_.sql

_CELLS = [(m, c) for m, c in (("qty", "l_quantity"), ("price", "l_extendedprice"), ("disc", "l_discount"))]
_POS = {"A": "accepted", "N": "none", "R": "returned"}


def _cell(side: str, flag: str, c: str) -> str:
    return f"coalesce(sum({c}) filter (l_linestatus = '{side}' and l_returnflag = '{flag}'), 0)"


@R_.add("select l_orderkey, " + ", ".join(
    f"round(({_cell('F', f, c)} + {_cell('O', f, c)}) / 2, 6) + 0 {p}_{m}_avg, round({_cell('F', f, c)} - {_cell('O', f, c)}, 6) + 0 {p}_{m}_delta" for f, p in _POS.items() for m, c in _CELLS
) + " from lineitem group by 1")
def f_wide_avg_delta(t):
    w = features.wide_from_long(t.lineitem, "l_orderkey", "l_linestatus", ("F", "O"), "l_returnflag", _POS, dict(_CELLS))
    return w.select("l_orderkey", *[(F.round(c, 6) + 0).alias(c) for c in w.columns[1:]])


@R_.add("""
with x as (select l_orderkey k, l_linestatus s, sum(l_extendedprice) price, max(l_discount) top_disc, coalesce(min(l_tax) filter (l_tax > 0), 0) min_tax, sum(l_quantity) qty, bool_or(l_returnflag = 'R') ret from lineitem group by 1, 2),
y as (select k, coalesce(sum(price) filter (s = 'F'), 0) pf, sum(price) p, coalesce(max(top_disc) filter (s = 'F'), 0) df, coalesce(max(top_disc) filter (s = 'O'), 0) d_o, coalesce(min(min_tax) filter (s = 'F'), 0) tf, sum(qty) qty, coalesce(max(ret::int) filter (s = 'F'), 0) - coalesce(max(ret::int) filter (s = 'O'), 0) rd from x group by 1)
select k orderkey, round(case when p <= 0 then 0 else pf / p end, 6) f_share, round(df - d_o, 6) disc_delta, tf f_min_tax, qty total_qty, rd::double returned_delta from y""")
def f_wide_context(t):
    x = t.lineitem.groupBy(F.col("l_orderkey").alias("orderkey"), "l_linestatus").agg(
        F.sum("l_extendedprice").alias("price"), F.max("l_discount").alias("disc"), F.coalesce(F.min(F.when(F.col("l_tax") > 0, F.col("l_tax"))), F.lit(0.0)).alias("tax"), F.sum("l_quantity").alias("qty"), F.max((F.col("l_returnflag") == "R").cast("double")).alias("ret")
    )
    side = lambda s, c, f=F.max: F.coalesce(f(F.when(F.col("l_linestatus") == s, F.col(c))), F.lit(0.0))
    y = x.groupBy("orderkey").agg(side("F", "price", F.sum).alias("pf"), F.sum("price").alias("p"), (side("F", "disc") - side("O", "disc")).alias("dd"), side("F", "tax", F.min).alias("tf"), F.sum("qty").alias("qty"), (side("F", "ret") - side("O", "ret")).alias("rd"))
    from quern.functions.numeric import safe_div

    return y.select("orderkey", F.round(safe_div(F.col("pf"), F.col("p")), 6).alias("f_share"), F.round("dd", 6).alias("disc_delta"), F.col("tf").alias("f_min_tax"), F.col("qty").alias("total_qty"), F.col("rd").alias("returned_delta"))


_REASON = """case when o_custkey % 97 = 0 then 'no_customer' when not exists (select 1 from lineitem where l_orderkey = o_orderkey) then 'no_lines' when o_orderstatus = 'P' then 'pending' when o_totalprice <= 2000 then 'cheap' else 'ok' end"""


def _reasons(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("has", F.lit(True))
    o = t.orders.join(lines, "o_orderkey", "left")
    rules = [("no_customer", F.col("o_custkey") % 97 == 0), ("no_lines", F.col("has").isNull()), ("pending", F.col("o_orderstatus") == "P"), ("cheap", F.col("o_totalprice") <= 2000)]
    return o.withColumn("reason", audit.first_reason(rules))


@R_.add(f"select {_REASON} reason, count(*) n from orders group by 1")
def v_drop_reason(t):
    return audit.reason_counts(_reasons(t))


@R_.add(f"with r as (select {_REASON} reason, o_orderkey from orders) select reason, o_orderkey, row_number() over (partition by reason order by o_orderkey)::int place from r qualify place <= 5")
def v_reason_examples(t):
    return audit.reason_examples(_reasons(t), "reason", "o_orderkey")


@R_.add("""
with g as (select l_orderkey, count(distinct l_suppkey) u, count(*) filter (l_quantity >= 10) v from lineitem group by 1)
select l_orderkey, u unique_members, v valid_members, u >= 3 has_unique, v >= 2 has_valid, case when u < 3 then 'too_few_unique' when v < 2 then 'too_few_valid' else 'ok' end exclude_reason from g""")
def v_exact_n_unique(t):
    return audit.group_flags(t.lineitem, ["l_orderkey"], "l_suppkey", F.col("l_quantity") >= 10, 3, 2)


@R_.add("""
with w as (select o_orderkey, l_quantity, l_shipdate, c_name from orders left join lineitem on o_orderkey = l_orderkey and l_quantity > 45 left join customer on o_custkey = c_custkey and c_acctbal > 0)
select 'o_orderkey' "column", count(*) - count(o_orderkey) nulls, count(*) "rows" from w union all select 'l_quantity', count(*) - count(l_quantity), count(*) from w
union all select 'l_shipdate', count(*) - count(l_shipdate), count(*) from w union all select 'c_name', count(*) - count(c_name), count(*) from w""")
def v_null_audit(t):
    li = t.lineitem.where("l_quantity > 45")
    w = t.orders.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(t.customer.where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return audit.null_audit(w, ["o_orderkey", "l_quantity", "l_shipdate", "c_name"])


@R_.add("""
with h as (select hour(ts)::int h, count(*) n, count(*) filter (event_type = 'error') e, avg(value) v from events group by 1)
select h, n, round(e / n, 6) error_rate, list_filter([case when e / n > 0.2 then 'error_rate' end, case when n < 410 then 'few_events' end, case when v > 51 then 'high_value' end], lambda x: x is not null) alerts from h""")
def v_alerts(t):
    h = t.events.groupBy(F.hour("ts").alias("h")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("e"), F.avg("value").alias("v"))
    rules = [("error_rate", F.col("e") / F.col("n") > 0.2), ("few_events", F.col("n") < 410), ("high_value", F.col("v") > 51)]
    return h.select("h", "n", F.round(F.col("e") / F.col("n"), 6).alias("error_rate"), audit.alerts(rules).alias("alerts"))


@R_.add("""
with l as (select l_orderkey, count(*) lines, count(distinct l_linenumber) d, min(l_shipdate) s, sum(l_extendedprice) p from lineitem group by 1),
r as (select case when lines is null then 'no_lines' when lines <> d then 'repeated_line' when s < o_orderdate then 'shipped_before_ordered' when p < o_totalprice * 0.5 then 'price_too_low' else 'ok' end reason from orders left join l on o_orderkey = l_orderkey)
select reason, count(*) n from r group by 1""")
def v_record_audit(t):
    li = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.count_distinct("l_linenumber").alias("d"), F.min("l_shipdate").alias("s"), F.sum("l_extendedprice").alias("p"))
    o = t.orders.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rules = [("no_lines", F.col("lines").isNull()), ("repeated_line", F.col("lines") != F.col("d")), ("shipped_before_ordered", F.col("s") < F.col("o_orderdate")), ("price_too_low", F.col("p") < F.col("o_totalprice") * 0.5)]
    return audit.reason_counts(o.withColumn("reason", audit.first_reason(rules)))


@R_.add("""
select s_suppkey k from supplier where s_suppkey not in (select l_suppkey from lineitem where l_quantity = 50 and l_discount = 0.1) and s_suppkey in (select l_suppkey from lineitem)
and s_suppkey in (select l_suppkey from lineitem where l_tax > 0.07) and s_suppkey not in (select l_suppkey from lineitem where l_tax > 0.07 and l_extendedprice > 97000)""")
def v_eligibility(t):
    li = t.lineitem.withColumnRenamed("l_suppkey", "k")
    taken = li.where("l_quantity = 50 and l_discount = 0.1")
    return audit.eligible(t.supplier.select(F.col("s_suppkey").alias("k")), "k", [taken], li, li.where("l_tax > 0.07"), F.col("l_extendedprice") <= 97000)


@R_.add("""
with x as (select event_type, try_cast(case when event_id % 7 = 0 then 'n/a' else json_extract_string(props, '$.k') end as double) k from events)
select event_type, count(*) n, round(sum(k), 4) total from x where k is not null group by 1""")
def v_dropna_cast(t):
    raw = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.get_json_object("props", "$.k"))
    d = audit.numeric_rows(t.events, {"k": raw}, ["k"])
    return d.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("k"), 4).alias("total"))


@R_.add("""select o_orderkey, o_totalprice, c_mktsegment from orders join customer on o_custkey = c_custkey""")
def j_inner_xy(t):
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return relations.inner_on(t.orders.select("o_orderkey", "o_totalprice", "o_custkey"), c, ["o_custkey"]).select("o_orderkey", "o_totalprice", "c_mktsegment")


@R_.add("select c_custkey k from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 200000)")
def j_left_anti(t):
    return relations.without_match(t.customer.select(F.col("c_custkey").alias("k")), t.orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("k")), ["k"])


@R_.add("""
with a as (select l_orderkey, l_linenumber, min(l_suppkey) s from lineitem group by 1, 2), b as (select l_orderkey, l_linenumber, max(l_suppkey) s from lineitem group by 1, 2)
select l_orderkey, l_linenumber, a.s left_value, b.s right_value from a join b using (l_orderkey, l_linenumber) where a.s <> b.s""")
def j_inner_mismatch(t):
    g = t.lineitem.groupBy("l_orderkey", "l_linenumber")
    return relations.mismatches(g.agg(F.min("l_suppkey").alias("s")), g.agg(F.max("l_suppkey").alias("s")), ["l_orderkey", "l_linenumber"], "s")


@R_.add("select c_custkey k, c_name from customer where c_custkey in (select o_custkey from orders where o_orderkey in (select l_orderkey from lineitem group by 1 having count(*) >= 8))")
def j_semi_exists(t):
    big = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n")).where("n >= 8")
    o = relations.with_match(t.orders, big, ["o_orderkey"]).select(F.col("o_custkey").alias("k"))
    return relations.with_match(t.customer.select(F.col("c_custkey").alias("k"), "c_name"), o, ["k"])


@R_.add("""
with a as (select o_orderkey from orders where o_orderstatus = 'F'), b as (select o_orderkey from orders where o_totalprice > 150000)
select o_orderkey, case when b.k is null then 'missing' when a.k is null then 'extra' else 'shared' end status from (select o_orderkey, o_orderkey k from a) a full join (select o_orderkey, o_orderkey k from b) b using (o_orderkey)""")
def j_full_outer_compare(t):
    return relations.compare_sets(t.orders.where("o_orderstatus = 'F'"), t.orders.where("o_totalprice > 150000"), "o_orderkey")


@R_.add("""
with h as (select user_id, ts, hour(ts) + minute(ts) / 60.0 + extract('microseconds' from ts) / 3600e6 h from events)
select user_id, count(*) games, count(ts) timed, count(*) filter (h >= 1 and h < 7) night, count(*) filter (h >= 2 and h < 8.5) under from h group by 1""")
def j_history_time(t):
    return labels.player_counters(t.events, ["user_id"], F.col("ts").cast("timestamp"), {"night": (1.0, 7.0), "under": (2.0, 8.5)})


@R_.add("""
with i as (select *, row_number() over (order by o_orderkey) - 1 row_id from orders)
select row_id, o_orderkey, o_totalprice * 2 double_price, o_orderstatus || '/' || o_orderpriority code from i""")
def j_three_way_rowid(t):
    i = relations.with_row_id(t.orders, ["o_orderkey"])
    a, b, c = i.select("row_id", "o_orderkey"), i.select("row_id", (F.col("o_totalprice") * 2).alias("double_price")), i.select("row_id", F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("code"))
    return a.join(b, "row_id").join(c, "row_id")


@R_.add("select o_orderkey k, (select count(distinct l_suppkey) from lineitem where l_orderkey = o_orderkey) suppliers from orders")
def j_correlated_count(t):
    return relations.correlated_count(t.orders.select(F.col("o_orderkey").alias("k")), t.lineitem.withColumnRenamed("l_orderkey", "k"), "k", F.col("l_suppkey"), "suppliers")


@R_.add("""
with e as (select quantile_cont(c_acctbal, [0.1, 0.3, 0.6, 0.85]) edges from customer)
select least(len(list_filter(edges, lambda x: x < c_acctbal)), 4)::int bin, count(*) n from customer, e group by 1""")
def j_bin_range(t):
    e = quantiles(t.customer, [], "c_acctbal", [0.1, 0.3, 0.6, 0.85], "edges")
    return with_row(t.customer, e).groupBy(bins.bin_before(F.col("c_acctbal"), F.col("edges"), 5).alias("bin")).agg(F.count("*").alias("n"))


@R_.add("""
with i as (select row_number() over (order by p_partkey) - 1 i, p_retailprice y, p_size * 10 p from part), n as (select count(*) n from part),
s as (select unnest([1, 7, 101]) shift),
j as (select abs(a.y - b.y) gap, case when a.p = b.p then 0.5 when sign(a.p - b.p) = sign(a.y - b.y) then 1.0 else 0.0 end score from i a, s, n, i b where b.i = (a.i + shift) % n.n and a.i <> b.i and a.y <> b.y),
t as (select unnest([0.0, 50.0, 200.0]) min_gap)
select min_gap::double min_gap, count(*) pairs, round(avg(score), 9) accuracy from j, t where gap >= min_gap group by 1""")
def j_pair_ordering(t):
    i = relations.with_row_id(t.part.select("p_partkey", F.col("p_retailprice").alias("y"), (F.col("p_size") * 10).alias("p")), ["p_partkey"])
    a = relations.ordering_agreement(relations.shifted_pairs(i, "row_id", ["y", "p"], [1, 7, 101]), "y", "p", [0.0, 50.0, 200.0])
    return a.select("min_gap", "pairs", F.round("accuracy", 9).alias("accuracy"))


@R_.add("select o_orderkey, coalesce(n_name, 'nowhere') nation from orders left join customer on o_custkey = c_custkey and c_acctbal > 0 left join nation on c_nationkey = n_nationkey")
def j_lookup_default(t):
    c = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("ck"), "c_nationkey")
    o = t.orders.join(c, F.col("o_custkey") == F.col("ck"), "left")
    return relations.lookup(o, t.nation, "c_nationkey", "n_nationkey", "n_name", "nowhere", "nation", small=True).select("o_orderkey", "nation")


@R_.add("""
with a as (select distinct c_nationkey k from customer where c_acctbal > 9000), b as (select distinct s_nationkey k from supplier where s_acctbal > 5000)
select (select count(*) from a) left_keys, (select count(*) from b) right_keys, (select count(*) from a join b using (k)) "both" """)
def j_overlap_counts(t):
    return relations.overlap(t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")), t.supplier.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")), "k")


@R_.add("""
with g as (select l_orderkey, count(*) n, list_sort(list(distinct l_returnflag)) s from lineitem group by 1)
select o_orderkey k, coalesce(n, 0) children, coalesce(s, []) child_set, coalesce(len(s), 0)::int distinct_children from orders left join g on l_orderkey = o_orderkey""")
def j_merge_children(t):
    return relations.children_of(t.orders.select(F.col("o_orderkey").alias("k")), t.lineitem.withColumnRenamed("l_orderkey", "k"), "k", "l_returnflag")


@R_.add("select o_orderpriority, count(*) filter (o_orderstatus = 'F') n_f, count(*) filter (o_orderstatus = 'O') n_o, count(*) filter (o_orderstatus = 'P') n_p, count(*) filter (o_orderstatus = 'X') n_x from orders group by 1")
def a_status_pivot(t):
    return statistics.status_pivot(t.orders, "o_orderpriority", "o_orderstatus", ["F", "O", "P", "X"])


@R_.add("""
select 'all' subset, count(*) n, round(avg(c_acctbal), 6) mean, round(sum(c_acctbal), 2) total, min(c_acctbal) low, max(c_acctbal) high from customer
union all select 'building', count(*), round(avg(c_acctbal), 6), round(sum(c_acctbal), 2), min(c_acctbal), max(c_acctbal) from customer where c_mktsegment = 'BUILDING'""")
def a_two_subset_summary(t):
    s = statistics.subset_summary(t.customer, {"all": F.lit(True), "building": F.col("c_mktsegment") == "BUILDING"}, "c_acctbal")
    return s.select("subset", "n", F.round("mean", 6).alias("mean"), F.round("total", 2).alias("total"), "low", "high")


@R_.add("""
with g as (select o_orderpriority, count(*) n, avg(o_totalprice) m, stddev_samp(o_totalprice) / sqrt(count(*)) se from orders group by 1)
select o_orderpriority, n, round(m, 4) mean, round(se, 4) se, round(m - 1.96 * se, 4) ci_low, round(m + 1.96 * se, 4) ci_high from g""")
def a_group_mean_ci(t):
    g = statistics.mean_ci(t.orders, ["o_orderpriority"], "o_totalprice")
    return g.select("o_orderpriority", "n", *[F.round(c, 4).alias(c) for c in ("mean", "se", "ci_low", "ci_high")])


@R_.add("select l_orderkey, l_linenumber, count(*) copies from lineitem group by 1, 2 having count(*) > 1")
def a_dup_groups(t):
    return audit.duplicate_groups(t.lineitem, ["l_orderkey", "l_linenumber"])


@R_.add("""
with p as (select user_id, event_type, count(*) games, count(*) filter (hour(ts) between 1 and 6) night from events group by 1, 2),
g as (select event_type, count(*) filter (games >= 12) eligible, sum(games) filter (games >= 12) games, sum(night) filter (games >= 12) / sum(games) filter (games >= 12) share, stddev_pop(night / games) filter (games >= 12) sd from p group by 1)
select event_type, eligible, case when eligible >= 8 then games::bigint end games, round(case when eligible >= 8 then share end, 6) night_share, round(case when eligible >= 8 then sd end, 6) night_std from g""")
def a_pooled_share_std(t):
    p = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("games"), F.count_if(F.hour("ts").between(1, 6)).alias("night"))
    g = statistics.pooled_shares(p, "event_type", ["night"], "games", 12, 8)
    return g.select("event_type", "eligible", "games", F.round("night_share", 6).alias("night_share"), F.round("night_std", 6).alias("night_std"))


@R_.add("""
with c as (select l_orderkey, l_returnflag f, count(*) n from lineitem group by 1, 2)
select l_orderkey, f mode from c qualify row_number() over (partition by l_orderkey order by n desc, list_position(['R','A','N'], f)) = 1""")
def a_mode_ordinal(t):
    order = F.array_position(F.array(F.lit("R"), F.lit("A"), F.lit("N")), F.col("l_returnflag"))
    return statistics.mode_by_order(t.lineitem, ["l_orderkey"], "l_returnflag", order)


@R_.add("""select c_mktsegment, count(*) n, round(avg(c_acctbal), 4) mean, round(stddev_pop(c_acctbal), 4) sd, round(quantile_cont(c_acctbal, 0.1), 4) p10, round(quantile_cont(c_acctbal, 0.25), 4) p25, round(quantile_cont(c_acctbal, 0.5), 4) p50, round(quantile_cont(c_acctbal, 0.75), 4) p75, round(quantile_cont(c_acctbal, 0.9), 4) p90 from customer group by 1""")
def a_quantile_profile(t):
    g = statistics.quantile_profile(t.customer, ["c_mktsegment"], "c_acctbal")
    return g.select("c_mktsegment", "n", *[F.round(c, 4).alias(c) for c in g.columns[2:]])


@R_.add("""
with s as (select count(*) * 100.0 / sum(count(*)) over () a, 20.0 t from customer group by c_mktsegment), w as (select *, 1 / sqrt(t + 0.001) w, a - t d from s)
select round(sqrt(sum(w * d * d) / sum(w)), 6) weighted_rmse, round(sum(d * d / t), 6) chi2, round(avg(abs(d)), 6) mae, round(max(abs(d)), 6) worst from w""")
def a_fit_metrics(t):
    s = statistics.shares(t.customer, ["c_mktsegment"]).select((F.col("share") * 100).alias("a"), F.lit(20.0).alias("t"))
    m = statistics.fit_metrics(s, "a", "t")
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@R_.add("""
with x as (select l_extendedprice t, l_quantity * 1500 p from lineitem), e as (select t, p, abs(t - p) e from x)
select count(*) n, round(sqrt(avg(e * e)), 4) rmse, round(avg(e), 4) mae, round(1 - sum(e * e) / regr_syy(t, p), 6) r2, round(corr(t, p), 6) corr, round(regr_slope(t, p), 6) slope, round(regr_intercept(t, p), 4) intercept,
round(quantile_cont(e, 0.5), 4) abs_p50, round(quantile_cont(e, 0.9), 4) abs_p90, round(quantile_cont(e, 0.95), 4) abs_p95, round(avg((e <= 5000)::int), 6) within_5000, round(avg((e <= 20000)::int), 6) within_20000 from e""")
def a_regression_profile(t):
    x = t.lineitem.select(F.col("l_extendedprice").alias("t"), (F.col("l_quantity") * 1500).alias("p"))
    m = statistics.regression_profile(x, "t", "p", (5000, 20000))
    digits = {"n": 0, "rmse": 4, "mae": 4, "intercept": 4, "abs_p50": 4, "abs_p90": 4, "abs_p95": 4}
    return m.select(*[(F.col(c) if c == "n" else F.round(c, digits.get(c, 6))).alias(c) for c in m.columns])


@R_.add("""
with e as (select quantile_cont(l_quantity, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) edges from lineitem),
x as (select len(list_filter(edges, lambda v: v <= l_quantity))::int bin, l_extendedprice t, l_quantity * 1500 p from lineitem, e)
select bin, count(*) n, round(avg(t), 4) mean_truth, round(avg(p), 4) mean_predicted, round(sqrt(avg((t - p) * (t - p))), 4) rmse, round(avg(abs(t - p)), 4) mae, min(p) low, max(p) high from x group by 1""")
def a_calibration_bins(t):
    x = bins.with_bins(t.lineitem, "l_quantity", 10).select("bin", F.col("l_extendedprice").alias("t"), (F.col("l_quantity") * 1500).alias("p"))
    c = statistics.calibration(x, "bin", "t", "p")
    return c.select("bin", "n", *[F.round(k, 4).alias(k) for k in ("mean_truth", "mean_predicted", "rmse", "mae")], "low", "high")


@R_.add("""
with f as (select p_brand, p_partkey % 5 fold, avg(p_retailprice) m from part group by 1, 2)
select p_brand, round(avg(m), 4) mean, round(stddev_samp(m), 4) sd from f group by 1 having count(distinct fold) = 5""")
def a_cv_complete_groups(t):
    f = t.part.groupBy("p_brand", (F.col("p_partkey") % 5).alias("fold")).agg(F.avg("p_retailprice").alias("m"))
    return statistics.complete_groups(f, ["p_brand"], "fold", 5, "m").select("p_brand", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


@R_.add("""
with m as (select *, avg(value) over (partition by event_type) p from events),
g as (select avg(value) filter (hour(ts) < 8) - avg(value) filter (hour(ts) >= 8) r, avg(value - p) filter (hour(ts) < 8) - avg(value - p) filter (hour(ts) >= 8) l from m)
select round(r, 8) raw_gap, round(l, 8) left_gap, round(case when abs(r) > 1e-12 then 1 - abs(l) / abs(r) end, 6) explained from g""")
def a_gap_explained(t):
    m = relations.less_group_mean(t.events, "event_type", "value", "left")
    g = statistics.explained_gap(m, F.hour("ts") < 8, "value", "left")
    return g.select(F.round("raw_gap", 8).alias("raw_gap"), F.round("left_gap", 8).alias("left_gap"), F.round("explained", 6).alias("explained"))


@R_.add("""
with s as (select l_suppkey, count(*) filter (l_returnflag = 'R') covered from lineitem group by 1),
o as (select l_orderkey, count(*) filter (covered >= 200) c from (select distinct l_orderkey, l_suppkey from lineitem) join s using (l_suppkey) group by 1)
select count(*) matches, count(*) filter (c >= 2) at_least_low, count(*) filter (c >= 4) at_least_high from o""")
def a_coverage_two_level(t):
    return labels.coverage(t.lineitem, "l_suppkey", "l_orderkey", F.col("l_returnflag") == "R", 200, (2, 4))[2]


@R_.add("""
with d as (select distinct l_orderkey, l_suppkey from lineitem), p as (select l_suppkey, count(*) pop from d group by 1)
select l_orderkey, sum(pop)::bigint popularity from d join p using (l_suppkey) group by 1""")
def a_popularity(t):
    return labels.popularity(t.lineitem, "l_orderkey", "l_suppkey")


@R_.add("""
select event_type, count(*) filter (ts < '2024-01-15') "before", count(*) filter (ts >= '2024-01-15') "after", count(*) filter (ts >= '2024-01-15') - count(*) filter (ts < '2024-01-15') delta from events group by 1""")
def a_counter_delta(t):
    half = lambda c: t.events.where(c).groupBy("event_type").agg(F.count("*").alias("n"))
    return statistics.counter_delta(half("ts < timestamp_ntz'2024-01-15'"), half("ts >= timestamp_ntz'2024-01-15'"), "event_type", "n")


@R_.add("""
select c_mktsegment, count(*) n, count(distinct c_nationkey) nations, round(count(*) / sum(count(*)) over (), 9) share, len(list(distinct c_custkey % 11))::int set_size from customer group by 1""")
def a_distinct_share(t):
    g = t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_distinct("c_nationkey").alias("nations"), F.size(F.collect_set(F.col("c_custkey") % 11)).alias("set_size"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9))


@R_.add("""
with g as (select count(*) n from orders group by o_orderstatus, o_orderpriority, o_custkey % 4)
select count(*) strata, min(n) smallest, max(n) largest, quantile_cont(n, 0.5) median from g""")
def a_stratum_summary(t):
    return statistics.stratum_summary(t.orders.withColumn("c", F.col("o_custkey") % 4), ["o_orderstatus", "o_orderpriority", "c"])


@R_.add("""
with s as (select l_orderkey % 5 fold, sum(l_extendedprice) s, count(*) n from lineitem group by 1), m as (select fold, (sum(s) over () - s) / (sum(n) over () - n) m from s)
select l_orderkey % 5 fold, round(sqrt(avg((l_extendedprice - m) * (l_extendedprice - m))), 4) rmse, round(avg(abs(l_extendedprice - m)), 4) mae from lineitem join m on l_orderkey % 5 = fold group by 1""")
def a_naive_baseline(t):
    b = statistics.naive_by_fold(t.lineitem.withColumn("fold", F.col("l_orderkey") % 5), "fold", "l_extendedprice")
    return b.select("fold", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"))


@R_.add("""
with c as (select distinct c_nationkey k from customer where c_acctbal > 9500), s as (select distinct s_nationkey k from supplier where s_acctbal > 8000)
select 'union' op, k from (select k from c union select k from s) union all select 'intersect', k from (select k from c intersect select k from s) union all select 'except', k from (select k from c except select k from s)""")
def u_setops(t):
    c = t.customer.where("c_acctbal > 9500").select(F.col("c_nationkey").alias("k"))
    s = t.supplier.where("s_acctbal > 8000").select(F.col("s_nationkey").alias("k"))
    parts = [("union", relations.edges_of([c, s])), ("intersect", c.intersect(s)), ("except", c.subtract(s))]
    out = [d.select(F.lit(n).alias("op"), "k") for n, d in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])
