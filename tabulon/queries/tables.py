"""Typing, encoding, joins, shape and distances over the driver tables, and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.catalog import register
from tabulon.operators import distance, encode, joins, ordering, shape
from tabulon.session import ensure_checkpoint_dir, table
from tabulon.sources import tables as tables_source

R = lambda c, k=6: F.round(c, k)


@register(
    "flagship_feature_means",
    """WITH e AS (SELECT l_linestatus, l_quantity AS q, l_extendedprice AS p, l_discount AS d, l_tax AS t, (l_returnflag='A')::INT::DOUBLE AS a, (l_returnflag='N')::INT::DOUBLE AS n, (l_returnflag='R')::INT::DOUBLE AS r,
  year(l_shipdate)*365.25::DOUBLE+month(l_shipdate)*30.44::DOUBLE+day(l_shipdate) AS s FROM lineitem WHERE l_quantity IS NOT NULL),
 z AS (SELECT l_linestatus, """ + ", ".join(f"({c}-avg({c}) OVER ())/sqrt(var_pop({c}) OVER ()+1e-8) AS {c}" for c in "qpdtanrs") + """ FROM e)
 SELECT l_linestatus, count(*) AS n_rows, round(avg(q),5) AS l_quantity, round(avg(p),5) AS l_extendedprice, round(avg(d),5) AS l_discount, round(avg(t),5) AS l_tax, round(avg(a),5) AS flag_a, round(avg(n),5) AS flag_n, round(avg(r),5) AS flag_r, round(avg(s),5) AS ship_days FROM z GROUP BY 1""",
)
def flagship(spark, sf):
    """lineitem -> typed columns -> one-hot, pseudo-days -> rows with a target, mean-imputed -> z-scores -> means per line status."""
    raw = table(spark, sf, "lineitem").select("l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    flags = [F.coalesce((F.col("l_returnflag") == v).cast("double"), F.lit(0.0)).alias(f"flag_{v.lower()}") for v in ("A", "N", "R")]
    x = raw.select("l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax", *flags, encode.days(raw, "l_shipdate").alias("ship_days"))
    cols = [c for c in x.columns if c != "l_linestatus"]
    x = encode.drop_bad_targets(x, "l_quantity")
    z = encode.impute_zscore(x, cols)
    return z.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n_rows"), *[R(F.avg(c), 5).alias(c) for c in cols])


@register("encode_onehot_returnflag", "SELECT l_orderkey, l_linenumber, (l_returnflag='A')::INT::DOUBLE AS flag_a, (l_returnflag='N')::INT::DOUBLE AS flag_n, (l_returnflag='R')::INT::DOUBLE AS flag_r FROM lineitem")
def onehot(spark, sf):
    d = table(spark, sf, "lineitem")
    made = encode.one_hot(F.col("l_returnflag"), encode.vocabulary(d, "l_returnflag"), "f")
    return d.select("l_orderkey", "l_linenumber", *[m.alias(n) for m, n in zip(made, ("flag_a", "flag_n", "flag_r"))])


@register("encode_ordinal_priority", "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority)-1)::DOUBLE AS priority FROM orders")
def ordinal(spark, sf):
    d = table(spark, sf, "orders")
    return d.select("o_orderkey", encode.ordinal(F.col("o_orderpriority"), encode.vocabulary(d, "o_orderpriority")).alias("priority"))


@register("encode_temporal_days", "SELECT o_orderkey, round(year(o_orderdate)*365.25+month(o_orderdate)*30.44+day(o_orderdate),4)::DOUBLE AS days FROM orders")
def temporal(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", R(encode.pseudo_days(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")), 4).alias("days"))


@register("encode_text_tokens", "SELECT p_partkey, len(t) AS n_tokens, array_to_string(t,' ') AS tokens FROM (SELECT p_partkey, list_filter(regexp_split_to_array(translate(p_name,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\\p{L}\\p{N}]+'), lambda x: x<>'') AS t FROM part)")
def text_tokens(spark, sf):
    t = encode.tokens(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", F.size(t).cast("long").alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@register("encode_vocabulary", "SELECT token, row_number() OVER (ORDER BY token) AS id FROM (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(translate(p_name,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\\p{L}\\p{N}]+'), lambda x: x<>'')) AS token FROM part)")
def vocab(spark, sf):
    from tabulon.operators.ordering import argsort

    v = table(spark, sf, "part").select(F.explode(encode.tokens(F.col("p_name"))).alias("token")).distinct()
    return argsort(v, "token", "token", out="id").select("token", (F.col("id") + 1).alias("id"))


@register("encode_impute_mean", "SELECT event_id, round(coalesce(v, avg(v) OVER ()),6) AS value FROM (SELECT event_id, CASE WHEN event_type='click' THEN NULL ELSE value END AS v FROM events)")
def impute(spark, sf):
    d = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") != "click", F.col("value")).alias("value"))
    return encode.impute_mean(d, ["value"]).withColumn("value", R(F.col("value")))


@register("encode_zscore", "SELECT event_id, round((value-avg(value) OVER ())/sqrt(var_pop(value) OVER ()+1e-8),6) AS value FROM events")
def zscore(spark, sf):
    return encode.zscore(table(spark, sf, "events").select("event_id", "value"), ["value"]).withColumn("value", R(F.col("value")))


@register("encode_exact_split", "SELECT o_orderkey, row_number() OVER (ORDER BY ('0x'||substr(md5('42:'||o_orderkey),1,8))::BIGINT/4294967296.0::DOUBLE, o_orderkey) <= round((SELECT count(*) FROM orders)*0.8) AS in_train FROM orders")
def split(spark, sf):
    return encode.exact_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.8)


@register("encode_exclude_columns", "SELECT s_suppkey, s_acctbal FROM supplier")
def exclude(spark, sf):
    return encode.exclude(table(spark, sf, "supplier"), ["s_name", "s_nationkey"])


@register("encode_bin_edges", "SELECT b, round(lo+(hi-lo)*b/8,4) AS uniform, round(quantile_cont(x, b/8.0),4) AS quantile FROM (SELECT l_extendedprice AS x FROM lineitem), (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), generate_series(0,8) AS g(b) GROUP BY b, lo, hi".replace("quantile_cont(x, b/8.0)", "quantile_cont(x, [0,0.125,0.25,0.375,0.5,0.625,0.75,0.875,1.0])[b+1]"))
def edges(spark, sf):
    x = F.col("l_extendedprice")
    lines = table(spark, sf, "lineitem")
    quantiles = ordering.quantiles(lines, "l_extendedprice", [k / 8 for k in range(9)])
    d = lines.agg(encode.bin_edges_uniform(F.min(x), F.max(x), 8).alias("u")).withColumn("q", F.array(*[F.lit(v) for v in quantiles]))
    return d.select(F.posexplode(F.arrays_zip("u", "q")).alias("b", "z")).select(F.col("b").cast("long").alias("b"), R(F.col("z.u"), 4).alias("uniform"), R(F.col("z.q"), 4).alias("quantile"))


@register("encode_quantize", "SELECT l_orderkey, l_linenumber, least(greatest(len(list_filter([1.0,11.0,21.0,31.0,41.0,51.0], lambda e: e<=l_quantity))-1,0),4) AS bin, least(greatest(round(l_discount/0.002)+3,-128),127)::DOUBLE AS q8, round((least(greatest(round(l_discount/0.01)+0,-8),7)-0)*0.01,6)::DOUBLE AS fake4 FROM lineitem")
def quantize(spark, sf):
    q4 = encode.quantize_int(F.col("l_discount"), 0.01, 0, -8, 7) * 0.01
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", encode.quantize(F.col("l_quantity"), [1, 11, 21, 31, 41, 51]).cast("long").alias("bin"), encode.quantize_int(F.col("l_discount"), 0.002, 3, -128, 127).alias("q8"), R(q4).alias("fake4"))


@register("encode_ordered_target_stats", "SELECT event_id, round((coalesce(sum(value) OVER w,0)+0.5*2)/(count(value) OVER w+2)+1e-8,6) AS ts FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def target_stats(spark, sf):
    d = table(spark, sf, "events")
    return encode.ordered_target_stats(d, "event_type", "value", ["event_id"], 0.5, 2.0).select("event_id", R(F.col("ts") + 1e-8).alias("ts"))


@register("encode_byte_tokens", "SELECT n_nationkey, len(n_name)::BIGINT AS n_bytes, ord(n_name[1])+1 AS first_id, 0 AS last_id FROM nation")
def byte_tokens(spark, sf):
    b = encode.byte_tokens([F.col("n_name")])
    return table(spark, sf, "nation").select("n_nationkey", F.size(F.filter(b, lambda x: x > 0)).cast("long").alias("n_bytes"), F.get(b, F.lit(0)).alias("first_id"), F.get(b, F.lit(255)).alias("last_id"))


@register("encode_missing_tokens", "SELECT event_id, (event_type IN ('','NA','NaN','nan','N/A','NULL','null','None','none','?','.','-')) AS missing, CASE WHEN regexp_full_match(value::VARCHAR,'[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN value END AS number FROM events")
def missing(spark, sf):
    from tabulon.functions.guards import strict_double

    return table(spark, sf, "events").select("event_id", encode.is_missing(F.col("event_type")).alias("missing"), strict_double(F.col("value").cast("string")).alias("number"))


def _written(df):
    """df as a folder of CSV parts under the shared folder, quoted where its cells need it."""
    import uuid

    path = f"{ensure_checkpoint_dir(df.sparkSession)}/csv-{uuid.uuid4().hex}"
    df.write.option("header", "true").option("quote", '"').option("escape", '"').option("quoteAll", "false").csv(path)
    return path


@register("source_csv_round_trip", "SELECT p_partkey::VARCHAR AS key, p_name||', \"'||p_type||'\"'||chr(10)||p_brand AS words, CASE WHEN p_size%5=0 THEN '' ELSE p_size::VARCHAR END AS size FROM part")
def csv_round_trip(spark, sf):
    """Cells with separators, quotes and line breaks, and missing ones, written and read again."""
    c = F.col
    words = F.concat("p_name", F.lit(', "'), "p_type", F.lit('"\n'), "p_brand")
    d = table(spark, sf, "part").select(c("p_partkey").cast("string").alias("key"), words.alias("words"), F.when(c("p_size") % 5 == 0, "NA").otherwise(c("p_size").cast("string")).alias("size"))
    return tables_source.read_csv(spark, _written(d))


@register("source_csv_headless", "SELECT l_orderkey::VARCHAR AS col_0, l_linenumber::VARCHAR AS col_1, l_quantity::INT::VARCHAR AS col_2 FROM lineitem")
def csv_headless(spark, sf):
    import uuid

    path = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int")).write.csv(path)
    return tables_source.read_csv(spark, path, multiline=False)


def _kind_sql(column: str) -> str:
    number = r"regexp_full_match(x,'[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?')"
    return rf"""SELECT '{column}' AS "column", CASE WHEN missing=n THEN 'numeric' WHEN images>=0.95 THEN 'image' WHEN dates>=0.95 THEN 'temporal' WHEN numbers=1 AND d<=2 THEN 'categorical' WHEN numbers=1 AND whole AND d BETWEEN 3 AND 10 AND hi-lo+1=d THEN 'ordinal'
 WHEN numbers=1 THEN 'numeric' WHEN d<=0.5*n AND d<=200 AND mean_tokens<=4 THEN 'categorical' ELSE 'text' END AS kind FROM (SELECT count(*) AS n, count(*) FILTER (WHERE NOT ok) AS missing, count(DISTINCT x) FILTER (WHERE ok) AS d, avg({number}::INT) FILTER (WHERE ok) AS numbers,
 avg(regexp_matches(x,'^\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}([T ].*)?$')::INT) FILTER (WHERE ok) AS dates, avg(regexp_matches(x,'(?i)\.(jpg|png|gif)$')::INT) FILTER (WHERE ok) AS images, avg(len(list_filter(regexp_split_to_array(x,'[^\p{{L}}\p{{N}}]+'), lambda t: t<>''))) FILTER (WHERE ok) AS mean_tokens,
 bool_and(try_cast(x AS DOUBLE)=floor(try_cast(x AS DOUBLE))) FILTER (WHERE ok) AS whole, min(try_cast(x AS DOUBLE)) AS lo, max(try_cast(x AS DOUBLE)) AS hi FROM (SELECT x, x IS NOT NULL AND x NOT IN ('','NA','NaN','nan','N/A','NULL','null','None','none','?','.','-') AS ok FROM (SELECT {column}::VARCHAR AS x FROM lineitem)))"""


LINEITEM = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()


@register("profile_kinds_lineitem", " UNION ALL ".join(map(_kind_sql, LINEITEM)))
def kinds(spark, sf):
    return encode.kinds(encode.profile(table(spark, sf, "lineitem")))


@register("encode_human_bytes", "SELECT o_orderkey, CASE WHEN v>=1073741824 THEN printf('%.2f GB',v/1073741824) WHEN v>=1048576 THEN printf('%.1f MB',v/1048576) ELSE printf('%.1f KB',v/1024) END AS size FROM (SELECT o_orderkey, (o_orderkey*1003)::DOUBLE AS v FROM orders)")
def human(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", encode.human_bytes((F.col("o_orderkey") * 1003).cast("double")).alias("size"))


@register("join_hash_left", "SELECT o_orderkey, c_name, c_acctbal FROM orders LEFT JOIN customer ON o_custkey=c_custkey")
def hash_left(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_acctbal")
    return joins.key_join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey").drop("o_custkey")


@register("join_positional", "SELECT a.event_id, b.event_id AS partner FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) b ON a.user_id=b.user_id AND a.k=b.k")
def positional(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id")
    other = e.withColumnRenamed("event_id", "partner").withColumn("back", -F.col("partner"))
    return joins.positional_join(e, other, "user_id", ["event_id"], ["back"]).select("event_id", "partner")


@register("join_stem_pages", "SELECT page_id, coalesce(regexp_replace(regexp_extract(url,'([^/]*)$',1),'(.)\\.[^.]*$','\\1'),'') AS stem FROM pages")
def stems(spark, sf):
    return table(spark, sf, "pages").select("page_id", joins.stem(F.col("url")).alias("stem"))


@register("join_admission", """WITH a AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS m FROM supplier GROUP BY 1),
 s AS (SELECT count(*) AS shared, coalesce(bool_and(m=1),false) AS is_unique, coalesce(bool_and(n=m),false) AS aligned FROM a JOIN b USING (k))
 SELECT *, CASE WHEN shared=0 THEN 'skip: no shared key' WHEN is_unique THEN 'key' WHEN aligned THEN 'positional' ELSE 'skip: not aligned' END AS verdict FROM s""")
def admission(spark, sf):
    return joins.admission(table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")), "k")


@register("join_lookup_default", "SELECT e.event_id, coalesce(l.quality,-1) AS quality FROM events e LEFT JOIN labels l ON e.event_id=l.doc_id")
def lookup(spark, sf):
    return joins.lookup(table(spark, sf, "events").select("event_id"), "event_id", table(spark, sf, "labels"), "doc_id", "quality", -1).select("event_id", "quality")


@register("join_range_lookup", "SELECT p_partkey, CASE WHEN p_retailprice<950 THEN 0 WHEN p_retailprice<1200 THEN 1 ELSE 2 END AS band FROM part")
def range_lookup(spark, sf):
    from tabulon.operators.ordering import searchsorted

    return table(spark, sf, "part").select("p_partkey", searchsorted(F.array(F.lit(950.0), F.lit(1200.0)), F.col("p_retailprice"), "right").alias("band"))


@register("index_gather_scatter", "SELECT n_nationkey, count(c_custkey) AS bag_n, coalesce(round(sum(c_acctbal),2),0) AS bag_sum FROM nation LEFT JOIN customer ON c_nationkey=n_nationkey GROUP BY 1")
def gather_scatter(spark, sf):
    base = table(spark, sf, "nation").select("n_nationkey", F.lit(0.0).alias("bag_sum"), F.lit(0.0).alias("bag_n"))
    c = table(spark, sf, "customer").select("c_nationkey", "c_acctbal", F.lit(1.0).alias("one"))
    out = shape.scatter_add(shape.scatter_add(base, "n_nationkey", "bag_sum", c, "c_nationkey", "c_acctbal"), "n_nationkey", "bag_n", c, "c_nationkey", "one")
    return out.select("n_nationkey", F.col("bag_n").cast("long").alias("bag_n"), R(F.col("bag_sum"), 2).alias("bag_sum"))


@register("index_embedding_bag", "SELECT o_orderstatus, round(sum(c_acctbal),2) AS bag_sum, round(avg(c_acctbal),4) AS bag_mean FROM orders LEFT JOIN customer ON o_custkey=c_custkey GROUP BY 1")
def bag(spark, sf):
    b = shape.embedding_bag(table(spark, sf, "orders"), "o_orderstatus", "o_custkey", table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_custkey", "c_acctbal")
    return b.select("o_orderstatus", R(F.col("bag_sum"), 2).alias("bag_sum"), R(F.col("bag_mean"), 4).alias("bag_mean"))


M_SQL = "WITH m AS (SELECT o_orderkey%50 AS i, o_custkey%40 AS j, round(sum(o_totalprice),2) AS v FROM orders GROUP BY 1,2) "


def matrix(spark, sf):
    return table(spark, sf, "orders").groupBy((F.col("o_orderkey") % 50).alias("i"), (F.col("o_custkey") % 40).alias("j")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))


def _shape(name, sql, fn):
    register(name, M_SQL + sql)(lambda spark, sf: fn(matrix(spark, sf)))


_shape("shape_transpose", "SELECT j AS i, i AS j, v FROM m", shape.transpose)
_shape("shape_flip", "SELECT 49-i AS i, j, v FROM m", lambda m: shape.flip_rows(m, 50))
_shape("shape_roll", "SELECT (i+7)%50 AS i, j, v FROM m", lambda m: shape.roll(m, "i", 7, 50))
_shape("shape_triu", "SELECT i, j, CASE WHEN j>=i+1 THEN v ELSE 0 END AS v FROM m", lambda m: shape.triangle(m, 1))
_shape("shape_tril", "SELECT i, j, CASE WHEN j<=i THEN v ELSE 0 END AS v FROM m", lambda m: shape.triangle(m, 0, False))
_shape("shape_diagonal", "SELECT i, j, CASE WHEN i=j THEN v+1.5 ELSE v END AS v FROM m WHERE j=i", lambda m: shape.add_diagonal(shape.diagonal(m), 1.5))
_shape("shape_slice", "SELECT i, j, v FROM m WHERE i BETWEEN 10 AND 19", lambda m: shape.slice_rows(m, "i", 10, 10))
_shape("shape_repeat_tile", "SELECT 3*i+a AS i, j+40*b AS j, v FROM m, generate_series(0,2) AS x(a), generate_series(0,1) AS y(b)", lambda m: shape.tile_rows(shape.repeat_rows(m, "i", 3), "j", 40, 2))
_shape("shape_broadcast_ops", "SELECT i, j, round(v-avg(v) OVER (PARTITION BY j)+1e-5,3) AS v FROM m", lambda m: shape.broadcast(m, m.groupBy("j").agg((F.avg("v") - 1e-5).alias("w")), "j", "sub").withColumn("v", R(F.col("v"), 3)))

for _rule, _expr in (("constant", "CASE WHEN k BETWEEN 0 AND 4 THEN k+100 ELSE 0 END"), ("replicate", "least(greatest(k,0),4)+100"), ("circular", "(k+10)%5+100"), ("reflect", "least((k+16)%8,8-(k+16)%8)+100")):

    def _pad(spark, sf, rule=_rule):
        d = table(spark, sf, "region").select(F.col("r_regionkey").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("pos"))
        return shape.pad(d.withColumn("v", (F.col("pos") + 100).cast("double")), ["g"], "pos", "v", 5, 3, 3, rule)

    register(f"shape_pad_{_rule}", f"SELECT r_regionkey AS g, k+3 AS pos, ({_expr})::DOUBLE AS v FROM region, generate_series(-3,7) AS s(k)")(_pad)


@register("array_ops_embeddings", "SELECT vec_id, embedding[1:3]::DOUBLE[] AS lead, round(list_sum(list_reverse(embedding)[1:2])::DOUBLE,5) AS flip2, len(embedding)*2 AS twice_n, round(embedding[len(embedding)-4]::DOUBLE+2*embedding[1]::DOUBLE,5) AS rolled, round(embedding[2]::DOUBLE,6) AS taken FROM embeddings".replace("embedding[1:3]::DOUBLE[] AS lead", "round(embedding[1]::DOUBLE+embedding[2]::DOUBLE+embedding[3]::DOUBLE,5) AS lead3"))
def array_ops(spark, sf):
    v = F.col("embedding").cast("array<double>")
    o = shape.array_ops(v, 5)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf, "embeddings").select("vec_id", R(total(o["lead"]), 5).alias("lead3"), R(total(F.slice(o["flip"], 1, 2)), 5).alias("flip2"), F.size(o["twice"]).cast("long").alias("twice_n"), R(F.get(o["rolled"], F.lit(0)) + 2 * F.get(o["rolled"], F.lit(5)), 5).alias("rolled"), R(F.get(shape.take_along(v, F.array(F.lit(1))), F.lit(0)), 6).alias("taken"))


def _pairs(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("q"), F.col("v").alias("qv")), e.select(F.col("vec_id").alias("t"), F.col("v").alias("tv"))


P_SQL = "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS q, b.vec_id AS t, a.v AS x, b.v AS y FROM e a, e b WHERE a.vec_id%20=0) "
Z = "list_transform(list_zip(x,y), lambda z: {})"
PAIR_SQL = {
    "l2": f"list_sum({Z.format('(z[1]-z[2])*(z[1]-z[2])')})", "l1": f"list_sum({Z.format('abs(z[1]-z[2])')})", "cosine": "list_cosine_similarity(x,y)", "chebyshev": f"list_max({Z.format('abs(z[1]-z[2])')})",
    "minkowski": f"power(list_sum({Z.format('power(abs(z[1]-z[2]),3)')}),1.0/3)", "canberra": f"list_sum({Z.format('CASE WHEN abs(z[1])+abs(z[2])>0 THEN abs(z[1]-z[2])/(abs(z[1])+abs(z[2])) ELSE 0 END')})",
    "braycurtis": f"list_sum({Z.format('abs(z[1]-z[2])')})/list_sum({Z.format('abs(z[1]+z[2])')})", "hamming": f"list_sum({Z.format('(z[1]<>z[2])::INT')})/len(x)",
}
for _m, _s in PAIR_SQL.items():

    def _query(spark, sf, m=_m):
        q, t = _pairs(spark, sf)
        if m in distance.BLOCK_METRICS:
            return distance.all_pairs(q, t, distance.BLOCK_METRICS[m], {"d": distance.METRICS[m](F.col("qv"), F.col("tv"))}, {"d": 5})
        return distance.query_pairs(q, t).select("q", "t", R(distance.METRICS[m](F.col("qv"), F.col("tv")), 5).alias("d"))

    register(f"pairwise_{_m}", P_SQL + f"SELECT q, t, round({_s},5) AS d FROM p")(_query)


@register("knn_topk", P_SQL + f"SELECT q, t, place FROM (SELECT q, t, row_number() OVER (PARTITION BY q ORDER BY {PAIR_SQL['l2']}, t) AS place FROM p WHERE q<>t) WHERE place<=10")
def knn(spark, sf):
    return distance.nearest(*_pairs(spark, sf), 10).select("q", "t", F.col("place").cast("long").alias("place"))


@register("fixed_radius", P_SQL + f"SELECT q, t FROM p WHERE {PAIR_SQL['l2']}<=1.0")
def radius(spark, sf):
    return distance.within_radius(*_pairs(spark, sf), 1.0)


@register("core_distance", P_SQL + f"SELECT q, round(sqrt(d),5) AS core_distance FROM (SELECT q, {PAIR_SQL['l2']} AS d, row_number() OVER (PARTITION BY q ORDER BY {PAIR_SQL['l2']}, t) AS place FROM p WHERE q<>t) WHERE place=5")
def core(spark, sf):
    return distance.core_distance(*_pairs(spark, sf), 5).withColumn("core_distance", R(F.col("core_distance"), 5))


@register("window_tumbling_events", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY 1,2")
def tumbling(spark, sf):
    from tabulon.streaming.events import tumbling

    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return tumbling(e, "ts", "event_type", "value", "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", R(F.col("total"), 4).alias("total"))
