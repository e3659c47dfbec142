"""Reductions, windows, sorting, searching and sets over the driver tables."""

from __future__ import annotations

import functools

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabulon.catalog import register
from tabulon.operators import ordering, reduce, sets, window
from tabulon.session import table

reduce_frames = lambda frames: functools.reduce(lambda a, b: a.unionByName(b), frames)
R = lambda c, k=4: F.round(c, k)
N = lambda c: c.cast("long")


@register(
    "reduce_all_lineitem",
    """SELECT round(sum(x),2) AS sum, round(avg(x),4) AS mean, min(x) AS min, max(x) AS max, round(sqrt(sum(x*x)),2) AS l2_norm, round(sum(abs(x)),2) AS asum, round(avg(abs(x)),4) AS mean_abs, round(sum(x*x)/1e6,2) AS sumsq_m,
  max(x)-min(x) AS ptp, count(*) FILTER (WHERE x<>0) AS count_nonzero, bool_or(x<>0) AS any_nonzero, bool_and(x<>0) AS all_nonzero, bool_or(isnan(x)) AS has_nan, bool_and(isfinite(x)) AS all_finite, round(sum(x),2) AS nansum FROM (SELECT l_extendedprice AS x FROM lineitem)""",
)
def reduce_all(spark, sf):
    b = reduce.basic(F.col("l_extendedprice"))
    digits = {"sum": 2, "mean": 4, "l2_norm": 2, "asum": 2, "mean_abs": 4, "nansum": 2}
    cols = [(R(v, digits[k]) if k in digits else v).alias(k) for k, v in b.items() if k != "sumsq"]
    return table(spark, sf, "lineitem").agg(*cols, R(b["sumsq"] / 1e6, 2).alias("sumsq_m"))


@register("reduce_with_nan", "SELECT l_linenumber%3 AS k, bool_or(isnan(x)) AS has_nan, bool_and(isfinite(x)) AS all_finite, round(sum(CASE WHEN isnan(x) THEN 0 ELSE x END),2) AS nansum FROM (SELECT l_linenumber, CASE WHEN l_linenumber=3 AND l_orderkey%4=0 THEN 'nan'::DOUBLE WHEN l_linenumber=4 AND l_orderkey%4=0 THEN 'inf'::DOUBLE ELSE l_quantity END AS x FROM lineitem) GROUP BY 1")
def reduce_nan(spark, sf):
    c = F.col
    odd = F.when((c("l_linenumber") == 3) & (c("l_orderkey") % 4 == 0), float("nan")).when((c("l_linenumber") == 4) & (c("l_orderkey") % 4 == 0), float("inf")).otherwise(c("l_quantity"))
    b = reduce.basic(F.col("x"))
    return table(spark, sf, "lineitem").select((c("l_linenumber") % 3).alias("k"), odd.alias("x")).groupBy("k").agg(b["has_nan"].alias("has_nan"), b["all_finite"].alias("all_finite"), R(b["nansum"], 2).alias("nansum"))


@register("reduce_dot_product", "SELECT round(sum(l_quantity*l_discount),3) AS dot, round(product(1+l_discount/1000),6) AS prod FROM lineitem")
def reduce_dot(spark, sf):
    return table(spark, sf, "lineitem").agg(R(F.sum(F.col("l_quantity") * F.col("l_discount")), 3).alias("dot"), R(F.product(1 + F.col("l_discount") / 1000), 6).alias("prod"))


@register("reduce_var_std", "SELECT l_returnflag, round(var_pop(l_quantity),5) AS var_pop, round(var_samp(l_quantity),5) AS var_samp, round(stddev_pop(l_quantity),5) AS std_pop, round(stddev_samp(l_quantity),5) AS std_samp, round(var_pop(l_quantity)*count(*),2) AS sumsqdev FROM lineitem GROUP BY 1")
def reduce_var(spark, sf):
    m = reduce.moments(F.col("l_quantity"))
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(*[R(v, 2 if k == "sumsqdev" else 5).alias(k) for k, v in m.items()])


@register("reduce_logsumexp", "SELECT l_returnflag, round(m+ln(sum(exp(x-m))),6) AS logsumexp FROM (SELECT l_returnflag, l_tax*10 AS x, max(l_tax*10) OVER (PARTITION BY l_returnflag) AS m FROM lineitem) GROUP BY l_returnflag, m")
def reduce_lse(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_tax") * 10).alias("x"))
    return reduce.logsumexp(df, "x", ["l_returnflag"]).withColumn("logsumexp", R(F.col("logsumexp"), 6))


@register("reduce_columns_by_row", "SELECT l_orderkey, l_linenumber, round(l_quantity+l_discount+l_tax,6) AS row_sum, greatest(l_quantity,l_discount,l_tax) AS row_max, least(l_quantity,l_discount,l_tax) AS row_min, round(ln(exp(l_quantity)+exp(l_discount)+exp(l_tax)),6) AS row_lse FROM lineitem")
def reduce_rows(spark, sf):
    from tabulon.operators.neural import log_sum_exp

    v = F.array("l_quantity", "l_discount", "l_tax")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", R(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6).alias("row_sum"), F.array_max(v).alias("row_max"), F.array_min(v).alias("row_min"), R(log_sum_exp(v), 6).alias("row_lse"))


@register("segment_sum_max", "SELECT s.segment, coalesce(round(sum(l_quantity),2),0.0) AS segment_sum, coalesce(max(l_quantity),-1.7976931348623157e308) AS segment_max FROM generate_series(0,(SELECT max(s_suppkey) FROM supplier)) AS s(segment) LEFT JOIN lineitem ON l_suppkey=s.segment GROUP BY 1")
def segment(spark, sf):
    n = table(spark, sf, "supplier").agg(F.max("s_suppkey")).first()[0] + 1
    return reduce.segment(table(spark, sf, "lineitem"), "l_suppkey", "l_quantity", n).withColumn("segment_sum", R(F.col("segment_sum"), 2))


@register("count_distinct_parts", "SELECT count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem")
def count_distinct(spark, sf):
    return table(spark, sf, "lineitem").agg(F.countDistinct("l_partkey").alias("n_parts"), F.countDistinct("l_suppkey").alias("n_suppliers"))


@register("hist_uniform_quantity", "SELECT b.bin, count(l_quantity) AS n FROM generate_series(0,9) AS b(bin) LEFT JOIN lineitem ON l_quantity BETWEEN 1 AND 50 AND least(floor((l_quantity-1)/4.9),9)=b.bin GROUP BY 1")
def hist(spark, sf):
    return reduce.histogram(table(spark, sf, "lineitem"), "l_quantity", 1.0, 50.0, 10)


@register("bincount_linenumber", "SELECT b.bin, count(l_linenumber) AS n FROM generate_series(0,9) AS b(bin) LEFT JOIN lineitem ON l_linenumber=b.bin GROUP BY 1")
def bincount(spark, sf):
    return reduce.bincount(table(spark, sf, "lineitem"), "l_linenumber", 10)


@register("grad_clip_norm", "SELECT event_id, round(value*least(1,10/sqrt((SELECT sum(value*value) FROM events))),8) AS value FROM events")
def clip(spark, sf):
    return reduce.clip_by_norm(table(spark, sf, "events").select("event_id", "value"), "value", 10.0).withColumn("value", R(F.col("value"), 8))


@register("metrics_fused", "SELECT round(avg((p-y)*(p-y)),6) AS mse, round(1-sum((y-p)*(y-p))/(sum(y*y)-sum(y)*sum(y)/count(*)),6) AS r2, round(sum((y-p)*(y-p)),4) AS ss_res, round(avg(((p>=0.5)=(y>=0.5))::INT),6) AS accuracy FROM (SELECT l_tax*10 AS p, (l_quantity/50) AS y FROM lineitem)")
def metrics(spark, sf):
    from tabulon.operators.metrics import accuracy, mse, r2, ss_res

    d = table(spark, sf, "lineitem").select((F.col("l_tax") * 10).alias("p"), (F.col("l_quantity") / 50).alias("y"))
    p, y = F.col("p"), F.col("y")
    return d.agg(R(mse(p, y), 6).alias("mse"), R(r2(p, y), 6).alias("r2"), R(ss_res(p, y), 4).alias("ss_res"), R(accuracy(p, y), 6).alias("accuracy"))


@register("metric_balanced_accuracy", "SELECT round(avg(r),6) AS balanced_accuracy FROM (SELECT avg((l_linestatus=CASE WHEN l_returnflag='N' THEN 'O' ELSE 'F' END)::INT) AS r FROM lineitem GROUP BY l_linestatus)")
def balanced(spark, sf):
    from tabulon.operators.metrics import balanced_accuracy

    d = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("y"), F.when(F.col("l_returnflag") == "N", "O").otherwise("F").alias("p"))
    return balanced_accuracy(d, "y", "p").withColumn("balanced_accuracy", R(F.col("balanced_accuracy"), 6))


W_SQL = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
B_SQL = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@register("running_events", f"SELECT event_id, round(sum(value) {W_SQL},5) AS cumsum, coalesce(round(sum(value) {B_SQL},5),0) AS excl_sum, round(product(1+value/1e4) {W_SQL},6) AS cumprod, coalesce(round(product(1+value/1e4) {B_SQL},6),1) AS excl_prod, max(value) {W_SQL} AS cummax, min(value) {W_SQL} AS cummin FROM events")
def running(spark, sf):
    w = window.along(["user_id"], ["ts", "event_id"])
    a, b = window.running(F.col("value"), w), window.running(1 + F.col("value") / 1e4, w)
    return table(spark, sf, "events").select("event_id", R(a["cumsum"], 5).alias("cumsum"), R(a["excl_sum"], 5).alias("excl_sum"), R(b["cumprod"], 6).alias("cumprod"), R(b["excl_prod"], 6).alias("excl_prod"), a["cummax"].alias("cummax"), a["cummin"].alias("cummin"))


@register("logcumsumexp_events", f"SELECT event_id, round(ln(sum(exp(v-m)) {W_SQL})+m,6) AS logcumsumexp FROM (SELECT *, value/100 AS v, max(value/100) OVER (PARTITION BY user_id) AS m FROM events)")
def lcse(spark, sf):
    d = table(spark, sf, "events").select("event_id", "user_id", "ts", (F.col("value") / 100).alias("v"))
    return window.log_cumsum_exp(d, ["user_id"], ["ts", "event_id"], "v").select("event_id", R(F.col("logcumsumexp"), 6).alias("logcumsumexp"))


@register(
    "linear_recurrence_events",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  h AS (SELECT user_id, event_id, k, value::DOUBLE AS h FROM e WHERE k=1 UNION ALL SELECT e.user_id, e.event_id, e.k, 0.5::DOUBLE*h.h+e.value FROM h JOIN e ON e.user_id=h.user_id AND e.k=h.k+1) SELECT event_id, round(h+1e-8,5) AS h FROM h""",
)
def recur(spark, sf):
    d = table(spark, sf, "events").select("user_id", "ts", "event_id", "value", F.lit(0.5).alias("a"))
    return window.recurrence(d, ["user_id"], ["ts", "event_id"], "a", "value").select("event_id", R(F.col("h") + 1e-8, 5).alias("h"))


@register(
    "discounted_returns_events",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events),
  h AS (SELECT user_id, event_id, k, value::DOUBLE AS h FROM e WHERE k=1 UNION ALL SELECT e.user_id, e.event_id, e.k, 0.9::DOUBLE*h.h+e.value FROM h JOIN e ON e.user_id=h.user_id AND e.k=h.k+1) SELECT event_id, round(h+1e-8,5) AS g FROM h""",
)
def returns(spark, sf):
    d = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    return window.discounted(d, ["user_id"], ["ts", "event_id"], "value", 0.9).select("event_id", R(F.col("g") + 1e-8, 5).alias("g"))


@register("local_peaks_events", "SELECT event_id, coalesce((value>p AND value>n)::INT,0) AS is_max, coalesce((value<p AND value<n)::INT,0) AS is_min FROM (SELECT event_id, value, lag(value) OVER w AS p, lead(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def peaks(spark, sf):
    p = window.local_peaks(F.col("value"), window.along(["user_id"], ["ts", "event_id"]))
    return table(spark, sf, "events").select("event_id", *[v.alias(k) for k, v in p.items()])


@register("run_lengths_events", f"SELECT user_id, run::BIGINT AS run, any_value(event_type) AS value, count(*) AS length FROM (SELECT *, sum(s) {W_SQL} AS run FROM (SELECT *, coalesce((lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)<>event_type)::INT,1) AS s FROM events)) GROUP BY 1,2")
def run_lengths(spark, sf):
    return window.runs(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@register("td_targets_events", "SELECT event_id, round(value+0.99*coalesce(lead(value) OVER (PARTITION BY user_id ORDER BY ts,event_id),0)*(1-(lead(value) OVER (PARTITION BY user_id ORDER BY ts,event_id) IS NULL)::INT),5) AS target FROM events")
def td(spark, sf):
    nxt = F.lead("value").over(window.along(["user_id"], ["ts", "event_id"]))
    return table(spark, sf, "events").select("event_id", R(window.td_targets(F.col("value"), F.coalesce(nxt, F.lit(0.0)), nxt.isNull().cast("int"), 0.99), 5).alias("target"))


@register(
    "gae_events",
    """WITH RECURSIVE d AS (SELECT user_id, event_id, ts, value+0.9::DOUBLE*coalesce(lead(value/2) OVER (PARTITION BY user_id ORDER BY ts,event_id),0)-value/2 AS d FROM events),
  e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM d),
  h AS (SELECT user_id, event_id, k, d::DOUBLE AS h FROM e WHERE k=1 UNION ALL SELECT e.user_id, e.event_id, e.k, 0.72::DOUBLE*h.h+e.d FROM h JOIN e ON e.user_id=h.user_id AND e.k=h.k+1) SELECT event_id, round(h,4) AS advantage FROM h""",
)
def gae(spark, sf):
    d = table(spark, sf, "events").select("user_id", "ts", "event_id", "value", (F.col("value") / 2).alias("v"))
    return window.gae(d, ["user_id"], ["ts", "event_id"], "value", "v", 0.9, 0.8).select("event_id", R(F.col("advantage"), 4).alias("advantage"))


@register("sort_topk_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk(spark, sf):
    return ordering.top_k(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], 20, tie=["o_orderkey"])


@register("sort_argsort_orders", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey)-1 AS place FROM orders")
def argsort(spark, sf):
    return ordering.argsort(table(spark, sf, "orders"), "o_totalprice", "o_orderkey").select("o_orderkey", "place")


@register("sort_kth_median", "SELECT (SELECT o_totalprice FROM orders ORDER BY 1 LIMIT 1 OFFSET 99) AS kth, round(median(o_totalprice),4) AS median FROM orders")
def kth(spark, sf):
    d = table(spark, sf, "orders")
    median = ordering.quantiles(d, "o_totalprice", [0.5])[0]
    return spark.range(1).select(F.round(F.lit(median), 4).alias("median"), ordering.kth_smallest(d, "o_totalprice", 100).alias("kth"))


@register("sort_by_key_orders", "SELECT row_number() OVER (ORDER BY o_orderpriority, o_orderkey)-1 AS place, o_orderpriority, o_orderkey FROM orders")
def sort_by_key(spark, sf):
    return ordering.sort_by_key(table(spark, sf, "orders"), "o_orderpriority", "o_orderkey", ["o_orderkey"])


@register("search_find_and_select", "SELECT 'first' AS what, o_orderkey AS pos FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus='P' ORDER BY 1 LIMIT 5) UNION ALL SELECT 'nonzero', event_id FROM events WHERE floor(value)%3<>0 UNION ALL SELECT 'masked', event_id FROM events WHERE event_type='click' UNION ALL SELECT 'argmax_abs', (SELECT c_custkey FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 1)")
def find_and_select(spark, sf):
    o, e, c = (table(spark, sf, t) for t in ("orders", "events", "customer"))
    parts = {
        "first": ordering.find_n(o, "o_orderkey", F.col("o_orderstatus") == "P", 5),
        "nonzero": ordering.nonzero(e.withColumn("v", F.floor("value") % 3), "event_id", "v"),
        "masked": ordering.masked_select(e, (F.col("event_type") == "click").cast("int")).select("event_id"),
        "argmax_abs": ordering.argmax_abs(c, "c_acctbal", "c_custkey"),
    }
    return reduce_frames([df.toDF("pos").select(F.lit(k).alias("what"), "pos") for k, df in parts.items()])


@register("segment_sort_lineitem", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber)-1 AS place FROM lineitem")
def segment_sort(spark, sf):
    return ordering.argsort(table(spark, sf, "lineitem"), "l_extendedprice", "l_linenumber", by=["l_orderkey"]).select("l_orderkey", "l_linenumber", "place")


@register("search_extremes_orders", "SELECT (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS argmax, (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1) AS argmin, (SELECT min(o_orderkey) FROM orders WHERE o_totalprice>=200000) AS partition_point, (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus='F') AS first_f")
def extremes(spark, sf):
    return ordering.extremes(table(spark, sf, "orders"), "o_totalprice", "o_orderkey", pivot=200000.0, find=F.col("o_orderstatus") == "F").withColumnRenamed("found", "first_f")


@register("search_searchsorted", "SELECT l_orderkey, l_linenumber, len(list_filter([10.0,20.0,30.0,40.0], lambda e: e < l_quantity)) AS lo, len(list_filter([10.0,20.0,30.0,40.0], lambda e: e <= l_quantity)) AS hi FROM lineitem")
def searchsorted(spark, sf):
    e = F.array(*[F.lit(float(x)) for x in (10, 20, 30, 40)])
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ordering.searchsorted(e, F.col("l_quantity")).cast("long").alias("lo"), ordering.searchsorted(e, F.col("l_quantity"), "right").cast("long").alias("hi"))


@register("search_sorted_mismatch", "SELECT user_id, bool_and(coalesce(value>=p,true)) AS is_sorted, min(k) FILTER (WHERE value<p) AS sorted_until, min(k) FILTER (WHERE value<>100) AS mismatch, count(*) FILTER (WHERE value<>0) AS nonzero FROM (SELECT user_id, value, lag(value) OVER w AS p, row_number() OVER w - 1 AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY 1")
def is_sorted(spark, sf):
    return ordering.sortedness(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value", F.lit(100.0))


@register("set_unique_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def unique_counts(spark, sf):
    return sets.unique_counts(table(spark, sf, "events"), "event_type")


@register("set_unique_dates", "SELECT DISTINCT l_shipdate FROM lineitem")
def unique(spark, sf):
    return sets.unique(table(spark, sf, "lineitem"), "l_shipdate")


@register("set_unique_consecutive", "SELECT event_id, event_type FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts,event_id) AS p FROM events) WHERE p IS NULL OR p<>event_type")
def unique_consecutive(spark, sf):
    return sets.unique_consecutive(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "event_type")


@register("set_isin", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS has_orders FROM customer")
def isin(spark, sf):
    return sets.isin(table(spark, sf, "customer").select("c_custkey"), "c_custkey", table(spark, sf, "orders"), "o_custkey", "has_orders")


@register("set_algebra", "SELECT c_nationkey AS k, 'both' AS part FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier UNION ALL (SELECT c_nationkey, 'only customer' FROM customer EXCEPT SELECT s_nationkey, 'only customer' FROM supplier)")
def algebra(spark, sf):
    return sets.algebra(table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")), "only customer")
