"""Learners, graphs, matrices, softmax and normalisation over the driver tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from tabulon.catalog import register
from tabulon.operators import distance, ml, neural
from tabulon.session import cut, table

R = lambda c, k=6: F.round(c, k)
TOK = r"list_filter(regexp_split_to_array(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\p{L}\p{N}]+'), lambda x: x<>'')"
NB_SQL = f"WITH t AS (SELECT quality AS cls, unnest({TOK}) AS token FROM documents JOIN labels USING (doc_id)), n AS (SELECT cls, token, count(*) AS n FROM t GROUP BY 1,2) "


def nb_tokens(spark, sf):
    from tabulon.operators.encode import tokens

    d = table(spark, sf, "documents").select("doc_id", "text").join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("cls")), "doc_id")
    return d.select("cls", F.explode(tokens(F.col("text"))).alias("token"))


@register("nb_count_table", NB_SQL + "SELECT cls, token, n FROM n")
def nb_counts(spark, sf):
    return ml.nb_counts(nb_tokens(spark, sf), "cls", "token")


@register("nb_feature_log_prob", NB_SQL + "SELECT cls, token, round(ln(n+1)-ln(sum(n) OVER (PARTITION BY cls)+(SELECT count(DISTINCT token) FROM n)),6) AS logp FROM n")
def nb_logp(spark, sf):
    c = ml.nb_counts(nb_tokens(spark, sf), "cls", "token")
    k = c.select("token").distinct().count()
    return ml.nb_log_prob(c, "cls", "token", k).withColumn("logp", R(F.col("logp")))


@register(
    "nb_multinomial_score",
    NB_SQL + f""", v AS (SELECT count(DISTINCT token) AS k FROM n), s AS (SELECT cls, sum(n) AS t FROM n GROUP BY 1), p AS (SELECT quality AS cls, ln(count(*)/(SELECT count(*) FROM labels JOIN documents USING (doc_id))) AS prior FROM labels JOIN documents USING (doc_id) GROUP BY 1),
 d AS (SELECT doc_id, token, count(*) AS m FROM (SELECT doc_id, unnest({TOK}) AS token FROM documents) GROUP BY 1,2)
 SELECT doc_id, s.cls, round(any_value(prior)+sum(m*(ln(coalesce(n.n,0)+1)-ln(t+k))),3) AS score FROM d CROSS JOIN s CROSS JOIN v JOIN p ON p.cls=s.cls LEFT JOIN n ON n.cls=s.cls AND n.token=d.token GROUP BY doc_id, s.cls""",
)
def nb_score(spark, sf):
    from tabulon.operators.encode import tokens

    c = cut(ml.nb_counts(nb_tokens(spark, sf), "cls", "token"))
    k = c.select("token").distinct().count()
    docs = table(spark, sf, "documents").select("doc_id", "text")
    lab = docs.select("doc_id").join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("cls")), "doc_id")
    n = lab.count()
    priors = lab.groupBy("cls").agg(F.ln(F.count(F.lit(1)) / F.lit(float(n))).alias("prior"))
    unseen = c.groupBy("cls").agg((-F.ln(F.sum("n") + F.lit(k))).alias("floor"))
    toks = docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))
    out = ml.multinomial_nb(toks, "doc_id", "token", ml.nb_log_prob(c, "cls", "token", k), priors, unseen, "cls")
    return out.withColumn("score", R(F.col("score"), 3))


PAIRS_SQL = "WITH i AS (SELECT DISTINCT l_orderkey AS b, l_suppkey AS x FROM lineitem), p AS (SELECT u.x AS a, v.x AS b, count(*) AS support FROM i u JOIN i v ON u.b=v.b AND u.x<v.x GROUP BY 1,2 HAVING count(*)>=3) "


def _pairs(spark, sf):
    return ml.apriori_pairs(table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey", 3)


@register("apriori_pairs", PAIRS_SQL + "SELECT a, b, support FROM p")
def apriori(spark, sf):
    return _pairs(spark, sf)


@register("apriori_candidates", PAIRS_SQL + "SELECT p.a, p.b, q.b AS c FROM p JOIN p q ON p.a=q.a AND p.b<q.b")
def apriori_candidates(spark, sf):
    return ml.candidates(_pairs(spark, sf))


@register("apriori_support", "SELECT l_suppkey, count(DISTINCT l_orderkey) AS support FROM lineitem GROUP BY 1")
def support(spark, sf):
    return ml.item_support(table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey")


def edges(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))


@register("graph_degree", "SELECT s_suppkey AS node, count(l_partkey) AS degree FROM supplier LEFT JOIN lineitem ON l_suppkey=s_suppkey GROUP BY 1")
def degree(spark, sf):
    return ml.degree(edges(spark, sf), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node")))


@register("graph_neighbour_mean", "SELECT l_suppkey AS node, round(sum(p_retailprice),2) AS total, round(avg(p_retailprice),5) AS mean FROM lineitem JOIN part ON p_partkey=l_partkey GROUP BY 1")
def neighbour(spark, sf):
    f = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("x"))
    return ml.neighbours(edges(spark, sf), f).select("node", R(F.col("total"), 2).alias("total"), R(F.col("mean"), 5).alias("mean"))


@register("graph_gcn_norm", "SELECT s_suppkey AS node, round(CASE WHEN count(l_partkey)>0 THEN s_acctbal/sqrt(count(l_partkey)) ELSE s_acctbal END,6) AS x FROM supplier LEFT JOIN lineitem ON l_suppkey=s_suppkey GROUP BY s_suppkey, s_acctbal")
def gcn(spark, sf):
    s = table(spark, sf, "supplier")
    d = ml.degree(edges(spark, sf), s.select(F.col("s_suppkey").alias("node")))
    return ml.gcn_norm(s.select(F.col("s_suppkey").alias("node"), F.col("s_acctbal").alias("x")), d).withColumn("x", R(F.col("x")))


EDGES_SQL = "WITH RECURSIVE k AS (SELECT o_orderkey AS n FROM orders WHERE o_orderkey%7<>3), e AS (SELECT a.n AS src, b.n AS dst FROM k a JOIN k b ON b.n=a.n+1 OR b.n=a.n+5 AND a.n%4=0), "


def chain_edges(spark, sf):
    """Order keys without every seventh, linked to the next key and some to the fifth after it."""
    k = table(spark, sf, "orders").select(F.col("o_orderkey").alias("n")).filter("n % 7 <> 3")
    step = F.explode(F.when(F.col("n") % 4 == 0, F.array(F.lit(1), F.lit(5))).otherwise(F.array(F.lit(1))))
    return k.select(F.col("n").alias("src"), step.alias("s")).select("src", (F.col("src") + F.col("s")).alias("dst")).join(k.select(F.col("n").alias("dst")), "dst").select("src", "dst")


@register("graph_components", EDGES_SQL + "both_ AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), g AS (SELECT src, src AS node FROM (SELECT DISTINCT src FROM both_ b WHERE NOT EXISTS (SELECT 1 FROM both_ x WHERE x.src=b.src AND x.dst>b.src)) UNION SELECT g.src, b.dst FROM g JOIN both_ b ON b.src=g.node) SELECT node, max(src) AS component FROM g GROUP BY node")
def components(spark, sf):
    return ml.components(chain_edges(spark, sf))


@register("graph_spanning_forest", EDGES_SQL + "z AS (SELECT 1) SELECT count(*) AS n_edges, sum(w) AS weight FROM (SELECT (dst-src)::DOUBLE AS w, src, dst FROM e WHERE dst-src=1 UNION ALL SELECT (dst-src)::DOUBLE, src, dst FROM e WHERE dst-src=5 AND EXISTS (SELECT 1 FROM generate_series(1,4) AS s(i) WHERE (src+i)%7=3 OR src+i NOT IN (SELECT n FROM k)))")
def forest(spark, sf):
    e = chain_edges(spark, sf).withColumn("w", (F.col("dst") - F.col("src")).cast("double"))
    return ml.spanning_forest(e).agg(F.count(F.lit(1)).alias("n_edges"), F.sum("w").alias("weight"))


@register("sparse_spmv", "SELECT o_orderkey%50 AS i, round(sum(o_totalprice*(o_custkey%7)),2) AS y FROM orders GROUP BY 1")
def spmv(spark, sf):
    o = table(spark, sf, "orders")
    m = o.select((F.col("o_orderkey") % 50).alias("i"), F.col("o_custkey").alias("j"), F.col("o_totalprice").alias("v"))
    return ml.spmv(m, o.select(F.col("o_custkey").alias("j"), (F.col("o_custkey") % 7).alias("x")).distinct()).withColumn("y", R(F.col("y"), 2))


C_SQL = "WITH m AS (SELECT vec_id AS i, d-1 AS j, embedding[d]::DOUBLE AS v FROM embeddings, generate_series(1, (SELECT max(len(embedding)) FROM embeddings)) AS s(d)) "


def coo(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode(F.col("embedding").cast("array<double>")).alias("j", "v"))


@register("matrix_gram_lower", C_SQL + "SELECT a.j AS i, b.j AS j, round(sum(a.v*b.v),5) AS v FROM m a JOIN m b ON a.i=b.i WHERE b.j<=a.j GROUP BY 1,2")
def gram(spark, sf):
    return ml.gram(coo(spark, sf)).withColumn("v", R(F.col("v"), 5))


@register("matrix_gemm", C_SQL + ", g AS (SELECT a.j AS i, b.j AS j, sum(a.v*b.v) AS v FROM m a JOIN m b ON a.i=b.i GROUP BY 1,2) SELECT m.i, g.j, round(sum(m.v*g.v),4) AS v FROM m JOIN g ON m.j=g.i GROUP BY 1,2")
def gemm(spark, sf):
    m = coo(spark, sf)
    return ml.gemm(m, ml.gram(m, lower=False)).withColumn("v", R(F.col("v"), 4))


@register("matrix_column_stats", C_SQL + "SELECT j, round(sum(v),5) AS s, round(avg(v),6) AS m, round(var_pop(v),6) AS var, max(v) AS hi, min(v) AS lo FROM m GROUP BY 1")
def column_stats(spark, sf):
    v = F.col("v")
    return coo(spark, sf).groupBy("j").agg(R(F.sum(v), 5).alias("s"), R(F.avg(v)).alias("m"), R(F.var_pop(v)).alias("var"), F.max(v).alias("hi"), F.min(v).alias("lo"))


G_SQL = "WITH b AS (SELECT l_linenumber%2 AS node, floor(l_quantity/5)::INT AS qty_bin, floor(l_discount*100+0.5)::INT AS disc_bin, l_tax*10-0.4::DOUBLE AS g, 1.0::DOUBLE AS h FROM lineitem), z AS (SELECT node, 'qty_bin' AS feature, qty_bin AS bin, g, h FROM b UNION ALL SELECT node, 'disc_bin', disc_bin, g, h FROM b), hs AS (SELECT node, feature, bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM z GROUP BY 1,2,3) "


def binned(spark, sf):
    c = F.col
    return table(spark, sf, "lineitem").select((c("l_linenumber") % 2).alias("node"), F.floor(c("l_quantity") / 5).cast("int").alias("qty_bin"), F.floor(c("l_discount") * 100 + 0.5).cast("int").alias("disc_bin"), (c("l_tax") * 10 - 0.4).alias("g"), F.lit(1.0).alias("h"))


@register("gbdt_histogram", G_SQL + "SELECT node, feature, bin, round(g,5) AS g, h, n FROM hs")
def histogram(spark, sf):
    return ml.histograms(binned(spark, sf), "node", ["qty_bin", "disc_bin"], "g", "h").withColumn("g", R(F.col("g"), 5))


@register(
    "gbdt_best_split",
    G_SQL + """, r AS (SELECT node, feature, bin, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY node, feature) AS gt, sum(h) OVER (PARTITION BY node, feature) AS ht FROM hs WINDOW w AS (PARTITION BY node, feature ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 s AS (SELECT *, round(gl*gl/(hl+1)+(gt-gl)*(gt-gl)/(ht-hl+1)-gt*gt/(ht+1),9) AS gain FROM r WHERE hl>=1e-3 AND ht-hl>=1e-3)
 SELECT node, feature, bin, round(gain,6) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, bin) AS k FROM s WHERE gain>0) WHERE k=1""",
)
def split(spark, sf):
    h = ml.histograms(binned(spark, sf), "node", ["qty_bin", "disc_bin"], "g", "h")
    return ml.best_split(h, "node").withColumn("gain", R(F.col("gain")))


@register("gbdt_leaf_values", G_SQL + "SELECT node, round(-sum(g)/(sum(h)+1),7) AS value FROM b GROUP BY 1")
def leaves(spark, sf):
    return ml.leaf_values(binned(spark, sf), "node", "g", "h").withColumn("value", R(F.col("value"), 7))


@register("gbdt_multiclass_grad", "SELECT l_orderkey, l_linenumber, k, round(p-(k=y)::INT,6) AS grad, round(least(greatest(p*(1-p),1e-3),1e6),6) AS hess FROM (SELECT *, exp(z)/(exp(l_tax*10)+exp(l_discount*10)+exp(0.5::DOUBLE)) AS p FROM (SELECT l_tax, l_discount, l_orderkey, l_linenumber, l_linenumber%3 AS y, k, CASE k WHEN 0 THEN l_tax*10 WHEN 1 THEN l_discount*10 ELSE 0.5::DOUBLE END AS z FROM lineitem, generate_series(0,2) AS s(k)))")
def multiclass(spark, sf):
    z = F.array(F.col("l_tax") * 10, F.col("l_discount") * 10, F.lit(0.5))
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 3).alias("y"), F.posexplode(neural.softmax(z)).alias("k", "p"))
    return d.select("l_orderkey", "l_linenumber", "k", R(F.col("p") - (F.col("k") == F.col("y")).cast("int")).alias("grad"), R(F.least(F.greatest(F.col("p") * (1 - F.col("p")), F.lit(1e-3)), F.lit(1e6))).alias("hess"))


@register("gbdt_route_rows", "SELECT l_orderkey, l_linenumber, 2*(l_linenumber%2)+CASE WHEN floor(l_quantity/5)<=4 THEN 1 ELSE 2 END AS leaf FROM lineitem")
def route(spark, sf):
    from tabulon.operators.boost import route_rows

    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 2).alias("node"), F.floor(F.col("l_quantity") / 5).cast("int").alias("qty_bin"))
    return route_rows(d, "node", {0: ("qty_bin", 4), 1: ("qty_bin", 4)}).select("l_orderkey", "l_linenumber", F.col("node").alias("leaf"))


@register("goss_sample_events", "WITH c AS (SELECT quantile_cont(abs(value),0.8) AS c FROM events) SELECT event_id, CASE WHEN abs(value)>=c THEN 1.0::DOUBLE ELSE 8.0::DOUBLE END AS weight FROM events, c WHERE abs(value)>=c OR ('0x'||substr(md5('42:'||event_id),1,8))::BIGINT/4294967296.0::DOUBLE<0.1")
def goss(spark, sf):
    from tabulon.operators.encode import uniform

    out = ml.goss(table(spark, sf, "events").select("event_id", "value"), "value", uniform(F.col("event_id")), 0.2, 0.1)
    return out.select("event_id", R(F.col("weight")).alias("weight"))


K_SQL = "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_sum(list_transform(embedding::DOUBLE[], lambda x: (x-0.1)*(x-0.1))) AS d0, list_sum(list_transform(embedding::DOUBLE[], lambda x: (x+0.1)*(x+0.1))) AS d1 FROM embeddings), a AS (SELECT *, CASE WHEN d0<=d1 THEN 0 ELSE 1 END AS cluster FROM e) "


@register("kmeans_step", K_SQL + "SELECT cluster, d-1 AS dim, round(avg(v[d]),6) AS x, count(*) AS n FROM a, generate_series(1,(SELECT max(len(v)) FROM a)) AS s(d) GROUP BY 1,2")
def kmeans(spark, sf):
    p = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    dim = p.agg(F.max(F.size("v"))).first()[0]
    return ml.centroid_step(p, [[0.1] * dim, [-0.1] * dim])[1].withColumn("x", R(F.col("x")))


E_SQL = "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) "
LONG = "FROM (SELECT vec_id, unnest({}) AS x, generate_subscripts(v,1)-1 AS j FROM e)"


def _rows(name, sql, fn):
    @register(name, E_SQL + f"SELECT vec_id, j, round(x,6) AS x FROM (SELECT vec_id, unnest({sql}) AS x, generate_subscripts(v,1)-1 AS j FROM e)")
    def query(spark, sf):
        return table(spark, sf, "embeddings").select("vec_id", F.posexplode(fn(F.col("embedding").cast("array<double>"))).alias("j", "x")).withColumn("x", R(F.col("x")))


_rows("softmax_rows", "list_transform(v, lambda x: exp(x-list_max(v))/list_sum(list_transform(v, lambda y: exp(y-list_max(v)))))", neural.softmax)
_rows("log_softmax_rows", "list_transform(v, lambda x: x-list_max(v)-ln(list_sum(list_transform(v, lambda y: exp(y-list_max(v))))))", neural.log_softmax)
_rows("softmin_rows", "list_transform(v, lambda x: exp(list_min(v)-x)/list_sum(list_transform(v, lambda y: exp(list_min(v)-y))))", neural.softmin)
_rows("layernorm_rows", "list_transform(v, lambda x: (x-list_avg(v))/sqrt(list_var_pop(v)+1e-5))", neural.layernorm)
_rows("rmsnorm_rows", "list_transform(v, lambda x: x/sqrt(list_avg(list_transform(v, lambda y: y*y))+1e-5))", neural.rmsnorm)
_rows("l2_normalize_rows", "list_transform(v, lambda x: x/sqrt(list_sum(list_transform(v, lambda y: y*y))))", neural.l2_normalize)


@register("batchnorm_columns", E_SQL + f"SELECT vec_id, j, round((x-avg(x) OVER w)/sqrt(var_pop(x) OVER w+1e-5),6) AS x {LONG.format('v')} WINDOW w AS (PARTITION BY j)")
def batchnorm(spark, sf):
    return neural.batchnorm(coo(spark, sf).select(F.col("i").alias("vec_id"), "j", F.col("v").alias("x")), "j", "x").withColumn("x", R(F.col("x")))


@register("avg_max_pool_1d", E_SQL + f"SELECT vec_id, j//4 AS p, round(avg(x),6) AS avg, max(x) AS max {LONG.format('v')} GROUP BY 1,2")
def pool(spark, sf):
    return neural.pool_1d(coo(spark, sf).select(F.col("i").alias("vec_id"), "j", F.col("v").alias("x")), "vec_id", "j", "x", 4).withColumn("avg", R(F.col("avg")))


@register("conv_1d_valid", E_SQL + f"SELECT vec_id, j, round(y,6) AS y FROM (SELECT vec_id, j-2 AS j, 0.25*lag(x,2) OVER w+0.5*lag(x,1) OVER w+0.25*x AS y {LONG.format('v')} WINDOW w AS (PARTITION BY vec_id ORDER BY j)) WHERE y IS NOT NULL")
def conv(spark, sf):
    return neural.conv_1d(coo(spark, sf).select(F.col("i").alias("vec_id"), "j", F.col("v").alias("x")), "vec_id", "j", "x", [0.25, 0.5, 0.25]).withColumn("y", R(F.col("y")))


@register("positional_encoding", "SELECT pos, i, round(CASE WHEN i%2=0 THEN sin(pos/power(10000,(i-i%2)/8.0)) ELSE cos(pos/power(10000,(i-i%2)/8.0)) END,6) AS v FROM generate_series(0,31) AS a(pos), generate_series(0,7) AS b(i)")
def positional(spark, sf):
    return neural.positional_encoding(spark, 32, 8).withColumn("v", R(F.col("v")))


@register("cross_entropy_rows", E_SQL + ", l AS (SELECT vec_id, label FROM embeddings) SELECT e.vec_id, round(ln(list_sum(list_transform(v, lambda y: exp(y-list_max(v)))))+list_max(v)-v[label%len(v)+1],6) AS loss FROM e JOIN l USING (vec_id)")
def cross_entropy(spark, sf):
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select("vec_id", R(neural.cross_entropy(v, F.col("label") % F.size(v))).alias("loss"))


@register("metric_losses_embeddings", E_SQL + ", q AS (SELECT a.vec_id, list_cosine_similarity(a.v,b.v) AS c, list_sum(list_transform(list_zip(a.v,b.v), lambda z: (z[1]-z[2])*(z[1]-z[2]))) AS d FROM e a JOIN e b ON b.vec_id=a.vec_id+1) SELECT vec_id, round(1-c,6) AS cosine_pos, round(greatest(0,c-0.2),6) AS cosine_neg, round(d,5) AS contrastive_pos, round(power(greatest(0,1-sqrt(d)),2),5) AS contrastive_neg FROM q")
def metric_losses(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")
    c, d = distance.cosine(F.col("v"), F.col("w")), distance.squared_l2(F.col("v"), F.col("w"))
    return j.select("vec_id", R(1 - c).alias("cosine_pos"), R(F.greatest(F.lit(0.0), c - 0.2)).alias("cosine_neg"), R(d, 5).alias("contrastive_pos"), R(F.pow(F.greatest(F.lit(0.0), 1 - F.sqrt(d)), F.lit(2.0)), 5).alias("contrastive_neg"))


@register("generators_sequences", "SELECT i, 2.0+0.5*i AS arange, round(1+9.0*i/15,6) AS linspace, round(power(10,2.0*i/15),6) AS logspace, round(power(100,i/15.0),6) AS geomspace FROM generate_series(0,15) AS s(i)")
def sequences(spark, sf):
    i = F.col("i")
    return spark.range(16).withColumnRenamed("id", "i").select("i", (2.0 + 0.5 * i).alias("arange"), R(1 + 9.0 * i / 15).alias("linspace"), R(F.pow(F.lit(10.0), 2.0 * i / 15)).alias("logspace"), R(F.pow(F.lit(100.0), i / 15.0)).alias("geomspace"))


@register("generators_random", "SELECT o_orderkey, ('0x'||substr(md5('42:'||o_orderkey),1,8))::BIGINT/4294967296.0::DOUBLE AS u, ('0x'||substr(md5('42:'||o_orderkey),1,8))::BIGINT/4294967296.0::DOUBLE<0.3 AS b, CASE WHEN ('0x'||substr(md5('42:'||o_orderkey),1,8))::BIGINT/4294967296.0::DOUBLE<0.3 THEN 0 ELSE round(o_totalprice/0.7,4) END AS dropout FROM orders")
def random_(spark, sf):
    from tabulon.operators.encode import uniform

    u = uniform(F.col("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", u.alias("u"), (u < 0.3).alias("b"), F.when(u < 0.3, 0.0).otherwise(R(F.col("o_totalprice") / 0.7, 4)).alias("dropout"))


@register("kernel_matrix_rbf", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS q, b.vec_id AS t, list_sum(list_transform(list_zip(a.v,b.v), lambda z: (z[1]-z[2])*(z[1]-z[2]))) AS d, list_inner_product(a.v,b.v) AS s FROM e a, e b WHERE a.vec_id%20=0) SELECT q, t, round(exp(-0.5*d),6) AS rbf, round(s,5) AS linear, round(power(s+1,2),5) AS poly, round(tanh(0.1*s),6) AS sig FROM p")
def kernels(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q, t = e.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("q"), F.col("v").alias("qv")), e.select(F.col("vec_id").alias("t"), F.col("v").alias("tv"))
    s = distance.dot(F.col("qv"), F.col("tv"))
    columns = {"rbf": F.exp(-0.5 * distance.squared_l2(F.col("qv"), F.col("tv"))), "linear": s, "poly": F.pow(s + 1, F.lit(2.0)), "sig": F.tanh(0.1 * s)}
    return distance.all_pairs(q, t, distance.kernels, columns, {"rbf": 6, "linear": 5, "poly": 5, "sig": 6})


@register("special_gamma", "SELECT p_partkey, round(lgamma(p_size+0.5),6) AS lgamma, round(gamma(p_size/10.0+0.5),6) AS gamma FROM part")
def gamma(spark, sf):
    from tabulon.functions.special import special

    return table(spark, sf, "part").select("p_partkey", R(special("lgamma", F.col("p_size") + 0.5)).alias("lgamma"), R(special("gamma", F.col("p_size") / 10.0 + 0.5)).alias("gamma"))


# Integrals over [0, pi] of periodic integrands by 200 midpoints; the other integrals by Simpson's rule; psi and Y by the difference quotient and Neumann's series of the same sums.
_X = "WITH x AS (SELECT p_partkey, p_size/10.0::DOUBLE+0.05 AS x FROM part), d AS (SELECT DISTINCT x FROM x), t AS (SELECT (k+0.5::DOUBLE)*pi()/200 AS t FROM generate_series(0,199) AS s(k)), u AS (SELECT k/400.0::DOUBLE AS u, CASE WHEN k=0 OR k=400 THEN 1 WHEN k%2=1 THEN 4 ELSE 2 END/1200.0::DOUBLE AS w FROM generate_series(0,400) AS s(k)), "
_F = (
    _X + "b AS (SELECT x, avg(cos(x*sin(t))) AS j0, avg(cos(t-x*sin(t))) AS j1, avg(exp(x*cos(t))) AS i0, avg(exp(x*cos(t))*cos(t)) AS i1 FROM d, t GROUP BY x), "
    "n AS (SELECT x, k, avg(cos(2*k*t-x*sin(t))) AS even, avg((cos((2*k-1)*t-x*sin(t))-cos((2*k+1)*t-x*sin(t)))/2) AS slope FROM d, t, generate_series(1,20) AS s(k) GROUP BY x, k), "
    "y AS (SELECT x, sum(CASE WHEN k%2=0 THEN 1 ELSE -1 END*even/k) AS s0, sum(CASE WHEN k%2=0 THEN 1 ELSE -1 END*slope/k) AS s1 FROM n GROUP BY x), "
    "e AS (SELECT x, 2/sqrt(pi())*x*sum(w*exp(-x*x*u*u)) AS erf, sum(w*2/sqrt(pi())*8*exp(-64*u*u-2*x*8*u)) AS erfcx, 0.5+x/sqrt(2*pi())*sum(w*exp(-x*x*u*u/2)) AS ndtr FROM d, u GROUP BY x), "
    "g AS (SELECT x, ln(x+40)-1/(2*(x+40))-1/(12*(x+40)*(x+40))+1/(120*power(x+40,4))-(SELECT sum(1/(d.x+k)) FROM generate_series(0,39) AS s(k)) AS digamma FROM d) "
)


@register("special_functions", _F + "SELECT p_partkey, round(erf,6) AS erf, round(1-erf,6) AS erfc, round(erfcx,5) AS erfcx, round(ndtr,6) AS ndtr, round(gamma(x.x),6) AS gamma, round(lgamma(x.x),6) AS lgamma, round(digamma,6) AS digamma, round(x.x*ndtr,6) AS gelu_exact, round(i0,4) AS i0, round(i1,4) AS i1, round(i0*exp(-x.x),6) AS i0e, round(i1*exp(-x.x),6) AS i1e, round(j0,6) AS j0, round(j1,6) AS j1, round(2/pi()*(ln(x.x/2)+0.5772156649015329)*j0-4/pi()*s0,5) AS y0, round(2/pi()*(ln(x.x/2)+0.5772156649015329)*j1-2/(pi()*x.x)*j0+4/pi()*s1,5) AS y1, round(x.x/6,6) AS ndtri_back, round(x.x/6,6) AS erfinv_back FROM x JOIN b USING (x) JOIN y USING (x) JOIN e USING (x) JOIN g USING (x)")
def specials(spark, sf):
    from tabulon.functions.special import NAMES, special

    x = F.col("p_size") / 10.0 + 0.05
    digits = {"erfcx": 5, "i0": 4, "i1": 4, "y0": 5, "y1": 5}
    there = [n for n in NAMES if n not in ("erfinv", "ndtri")]
    back = [special("ndtr", special("ndtri", x / 6.0)).alias("ndtri_back"), special("erf", special("erfinv", x / 6.0)).alias("erfinv_back")]
    d = table(spark, sf, "part").select("p_partkey", *[special(n, x).alias(n) for n in there], *back)
    return d.select("p_partkey", *[(R(F.col(n), digits.get(n, 6)) + 0.0).alias(n) for n in [*there, "ndtri_back", "erfinv_back"]])
