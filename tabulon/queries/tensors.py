"""Grids, small dense algebra, generators and the losses and learners that work on arrays, over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.catalog import register
from tabulon.functions import losses
from tabulon.operators import encode, ml, neural, sequence, shape, spatial
from tabulon.session import table

R = lambda c, k=6: F.round(c, k) + 0.0

# Every embedding is a grid of 8 x 8 cells, or of four channels of 4 x 4.
GRID_SQL = "WITH g AS (SELECT vec_id, (k-1)//8 AS y, (k-1)%8 AS x, embedding[k]::DOUBLE AS v FROM embeddings, generate_series(1,64) AS s(k)), c AS (SELECT vec_id, (k-1)//16 AS ch, ((k-1)//4)%4 AS y, (k-1)%4 AS x, embedding[k]::DOUBLE AS v FROM embeddings, generate_series(1,64) AS s(k)) "


def grid(spark, sf):
    d = table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "v"))
    return d.select("vec_id", F.floor(F.col("k") / 8).cast("int").alias("y"), (F.col("k") % 8).alias("x"), "v")


def channels(spark, sf):
    d = table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "v"))
    return d.select("vec_id", F.floor(F.col("k") / 16).cast("int").alias("ch"), (F.floor(F.col("k") / 4) % 4).cast("int").alias("y"), (F.col("k") % 4).alias("x"), "v")


KERNEL = [[0.5, -1.0, 0.25], [1.0, 2.0, -0.5], [0.0, 0.75, 1.5]]
K_SQL = "(VALUES " + ", ".join(f"({i},{j},{w}::DOUBLE)" for i, row in enumerate(KERNEL) for j, w in enumerate(row)) + ") AS k(dy,dx,w)"
ROUNDED = lambda d: d.withColumn("v", R(F.col("v")))


@register("conv_2d_valid", GRID_SQL + f"SELECT vec_id, y-dy AS y, x-dx AS x, round(sum(v*w)+0.1,6) AS v FROM g, {K_SQL} WHERE y-dy BETWEEN 0 AND 5 AND x-dx BETWEEN 0 AND 5 GROUP BY 1,2,3")
def conv_2d(spark, sf):
    return ROUNDED(spatial.conv(grid(spark, sf), ["vec_id"], ["y", "x"], "v", [8, 8], spatial.taps(KERNEL), bias=[0.1]))


@register("conv_2d_stride_dilation", GRID_SQL + f"SELECT vec_id, (y-2*dy)//2 AS y, (x-2*dx)//2 AS x, round(sum(v*w),6) AS v FROM g, {K_SQL} WHERE y-2*dy BETWEEN 0 AND 3 AND x-2*dx BETWEEN 0 AND 3 AND (y-2*dy)%2=0 AND (x-2*dx)%2=0 GROUP BY 1,2,3")
def conv_strided(spark, sf):
    return ROUNDED(spatial.conv(grid(spark, sf), ["vec_id"], ["y", "x"], "v", [8, 8], spatial.taps(KERNEL, dilation=2), stride=2))


PAIR = [[1.0, -0.5], [0.25, 2.0]]
P_SQL = "(VALUES (0,0,1.0::DOUBLE),(0,1,-0.5),(1,0,0.25),(1,1,2.0)) AS k(dy,dx,w)"


@register("conv_2d_depthwise", GRID_SQL + f"SELECT vec_id, ch, y-dy AS y, x-dx AS x, round(sum(v*w*(ch+1)),6) AS v FROM c, {P_SQL} WHERE y-dy BETWEEN 0 AND 2 AND x-dx BETWEEN 0 AND 2 GROUP BY 1,2,3,4")
def conv_depthwise(spark, sf):
    kernels = [[[[w * (k + 1) for w in row] for row in PAIR]] for k in range(4)]
    return ROUNDED(spatial.conv(channels(spark, sf), ["vec_id"], ["y", "x"], "v", [4, 4], spatial.grouped_taps(kernels, 4, 4), "ch"))


@register("conv_2d_grouped", GRID_SQL + f"SELECT vec_id, ch//2 AS ch, y-dy AS y, x-dx AS x, round(sum(v*w*(1+ch%2)),6) AS v FROM c, {P_SQL} WHERE y-dy BETWEEN 0 AND 2 AND x-dx BETWEEN 0 AND 2 GROUP BY 1,2,3,4")
def conv_grouped(spark, sf):
    kernels = [[[[w * (1 + k) for w in row] for row in PAIR] for k in range(2)] for _ in range(2)]
    return ROUNDED(spatial.conv(channels(spark, sf), ["vec_id"], ["y", "x"], "v", [4, 4], spatial.grouped_taps(kernels, 2, 4), "ch"))


@register("conv_3d_valid", GRID_SQL + f"SELECT vec_id, ch-dz AS ch, y-dy AS y, x-dx AS x, round(sum(v*w*(1-2*dz)),6) AS v FROM c, {P_SQL}, (VALUES (0),(1)) AS z(dz) WHERE ch-dz BETWEEN 0 AND 2 AND y-dy BETWEEN 0 AND 2 AND x-dx BETWEEN 0 AND 2 GROUP BY 1,2,3,4")
def conv_3d(spark, sf):
    kernel = [[[s * w for w in row] for row in PAIR] for s in (1, -1)]
    return ROUNDED(spatial.conv(channels(spark, sf), ["vec_id"], ["ch", "y", "x"], "v", [4, 4, 4], spatial.taps(kernel)))


@register("conv_2d_transposed", GRID_SQL + f"SELECT vec_id, y+dy AS y, x+dx AS x, round(sum(v*w),6) AS v FROM g, {K_SQL} GROUP BY 1,2,3")
def conv_transposed(spark, sf):
    return ROUNDED(spatial.conv_transposed(grid(spark, sf), ["vec_id"], ["y", "x"], "v", spatial.taps(KERNEL)))


@register("conv_2d_kernel_grad", GRID_SQL + ", o AS (SELECT vec_id, y, x, v*0.5+0.1 AS u FROM g WHERE y<6 AND x<6) SELECT 3*dy+dx AS tap, round(sum(v*u),4) AS grad FROM g, generate_series(0,2) AS a(dy), generate_series(0,2) AS b(dx), o WHERE o.vec_id=g.vec_id AND o.y=g.y-dy AND o.x=g.x-dx GROUP BY 1")
def conv_grad(spark, sf):
    g = grid(spark, sf)
    out = g.filter("y < 6 and x < 6").select("vec_id", "y", "x", (F.col("v") * 0.5 + 0.1).alias("u"))
    return spatial.conv_kernel_grad(g, out, ["vec_id"], ["y", "x"], "v", "u", spatial.taps(KERNEL)).withColumn("grad", R(F.col("grad"), 4))


@register("morphology_2d", GRID_SQL + f", w AS (SELECT vec_id, y-dy AS y, x-dx AS x, v, w FROM g, {K_SQL} WHERE y-dy BETWEEN 0 AND 5 AND x-dx BETWEEN 0 AND 5) SELECT vec_id, y, x, round(max(v+w),6) AS dilated, round(min(v-w),6) AS eroded FROM w GROUP BY 1,2,3")
def morphology(spark, sf):
    both = [spatial.morphology(grid(spark, sf), ["vec_id"], ["y", "x"], "v", [8, 8], spatial.taps(KERNEL), erode=e).withColumnRenamed("v", n) for n, e in (("dilated", False), ("eroded", True))]
    return both[0].join(both[1], ["vec_id", "y", "x"]).select("vec_id", "y", "x", R(F.col("dilated")).alias("dilated"), R(F.col("eroded")).alias("eroded"))


@register("pool_2d", GRID_SQL + "SELECT vec_id, y//2 AS y, x//2 AS x, round(avg(v),6) AS avg, max(v) AS max, round(power(sum(power(abs(v),3)),1.0/3),6) AS lp FROM g GROUP BY 1,2,3")
def pool_2d(spark, sf):
    return spatial.pool(grid(spark, sf), ["vec_id"], ["y", "x"], "v", 2, 3.0).withColumn("avg", R(F.col("avg"))).withColumn("lp", R(F.col("lp")))


@register("pool_global_channels", GRID_SQL + "SELECT vec_id, ch, round(avg(v),6) AS avg, max(v) AS max, round(sqrt(sum(v*v)),6) AS lp FROM c GROUP BY 1,2")
def pool_global(spark, sf):
    return spatial.pool_global(channels(spark, sf), ["vec_id", "ch"], "v").withColumn("avg", R(F.col("avg"))).withColumn("lp", R(F.col("lp")))


@register("pool_adaptive_1d", GRID_SQL + "SELECT vec_id, y, o AS x, round(avg(v),6) AS avg, max(v) AS max FROM g, generate_series(0,4) AS s(o) WHERE x>=(o*8)//5 AND x<((o+1)*8+4)//5 GROUP BY 1,2,3")
def pool_adaptive(spark, sf):
    return spatial.pool_adaptive(grid(spark, sf), ["vec_id", "y"], "x", "v", 8, 5).withColumn("avg", R(F.col("avg")))


@register("pool_2d_gradients", GRID_SQL + ", b AS (SELECT *, row_number() OVER (PARTITION BY vec_id, y//2, x//2 ORDER BY v DESC, y, x) AS k, max(v) OVER (PARTITION BY vec_id, y//2, x//2)+1 AS u FROM g) SELECT vec_id, y, x, round(CASE WHEN k=1 THEN u ELSE 0 END,6) AS of_max, round(u/4,6) AS of_avg FROM b")
def pool_grads(spark, sf):
    g = grid(spark, sf)
    up = spatial.pool(g, ["vec_id"], ["y", "x"], "v", 2).select("vec_id", "y", "x", (F.col("max") + 1).alias("u"))
    both = [spatial.pool_grad(g, up, ["vec_id"], ["y", "x"], "v", "u", 2, k).withColumnRenamed("grad", f"of_{k}") for k in ("max", "avg")]
    return both[0].join(both[1], ["vec_id", "y", "x"]).select("vec_id", "y", "x", R(F.col("of_max")).alias("of_max"), R(F.col("of_avg")).alias("of_avg"))


_AT = {"constant": "0<=({0}) AND ({0})<=7", "replicate": "least(greatest({0},0),7)", "circular": "(({0})+80)%8", "reflect": "least((({0})+140)%14,14-(({0})+140)%14)"}
for _rule, _at in _AT.items():

    def _pad(spark, sf, rule=_rule):
        return spatial.pad_grid(grid(spark, sf), ["vec_id"], ["y", "x"], "v", [8, 8], [(2, 1), (3, 2)], rule, 9.0)

    _src = "n.y=p.y-2 AND n.x=p.x-3" if _rule == "constant" else f"n.y={_at.format('p.y-2')} AND n.x={_at.format('p.x-3')}"
    register(f"pad_2d_{_rule}", GRID_SQL + f"SELECT p.vec_id, p.y::INT AS y, p.x::INT AS x, coalesce(n.v,9.0) AS v FROM (SELECT DISTINCT vec_id, py AS y, px AS x FROM g, generate_series(0,10) AS a(py), generate_series(0,12) AS b(px)) p LEFT JOIN g n ON n.vec_id=p.vec_id AND {_src}")(_pad)


@register("upsample_nearest_2d", GRID_SQL + "SELECT vec_id, 2*y+a AS y, 3*x+b AS x, v FROM g, generate_series(0,1) AS s(a), generate_series(0,2) AS t(b)")
def upsample(spark, sf):
    return spatial.upsample_nearest(grid(spark, sf), ["y", "x"], [2, 3])


@register("unfold_fold_2d", GRID_SQL + "SELECT vec_id, y, x, round(v*least(y+1,3,8-y)*least(x+1,3,8-x),6) AS v FROM g")
def unfold_fold(spark, sf):
    wide = spatial.unfold(grid(spark, sf), ["vec_id"], ["y", "x"], "v", [8, 8], [3, 3])
    return ROUNDED(spatial.fold(wide, ["vec_id"], ["y", "x"], "v", [3, 3]))


E_SQL = "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT a.vec_id, a.label, a.v AS u, b.v AS w, c.v AS z FROM e a JOIN e b ON b.vec_id=a.vec_id+1 JOIN e c ON c.vec_id=a.vec_id+2) "
_D = "list_sum(list_transform(list_zip({0},{1}), lambda r: (r[1]-r[2])*(r[1]-r[2])))"


@register("losses_on_pairs", E_SQL + f"SELECT vec_id, round(CASE WHEN label%2=1 THEN 1-list_cosine_similarity(u,w) ELSE greatest(list_cosine_similarity(u,w)-0.1,0) END,6) AS cosine, round(greatest({_D.format('u','w')}-{_D.format('u','z')}+0.5,0),5) AS triplet, round((label%2)*{_D.format('u','w')}+(1-label%2)*power(greatest(12-sqrt({_D.format('u','w')}),0),2),5) AS contrastive, round(u[label%64+1]-ln(list_sum(list_transform(u, lambda r: exp(r)))),6) AS logprob FROM q")
def pair_losses(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("u"))
    shifted = lambda k, n: e.select((F.col("vec_id") - k).alias("vec_id"), F.col("u").alias(n))
    q = e.join(shifted(1, "w"), "vec_id").join(shifted(2, "z"), "vec_id")
    u, w, z, y = F.col("u"), F.col("w"), F.col("z"), (F.col("label") % 2).cast("double")
    return q.select("vec_id", R(losses.cosine_embedding(u, w, y, 0.1)).alias("cosine"), R(losses.triplet(u, w, z, 0.5), 5).alias("triplet"), R(losses.contrastive(u, w, y, 12.0), 5).alias("contrastive"), R(losses.categorical_logprob(u, F.col("label") % 64)).alias("logprob"))


@register("vae_latent", "SELECT event_id, round(m+exp(0.5*l)*e,6) AS z, round(g+0.3*m,6) AS grad_mean, round(g*0.5*exp(0.5*l)*e+0.15*(exp(l)-1),6) AS grad_log_var FROM (SELECT event_id, value/50 AS m, (event_id%7)/4.0::DOUBLE-0.5 AS l, (event_id%5)/2.0::DOUBLE-1 AS e, (event_id%3)::DOUBLE-1 AS g FROM events)")
def vae(spark, sf):
    i = F.col("event_id")
    d = table(spark, sf, "events").select("event_id", (F.col("value") / 50).alias("m"), ((i % 7) / 4.0 - 0.5).alias("l"), ((i % 5) / 2.0 - 1).alias("e"), ((i % 3).cast("double") - 1).alias("g"))
    c = F.col
    mean, log_var = losses.vae_latent_grads(c("g"), c("m"), c("l"), c("e"), 0.3)
    return d.select("event_id", R(losses.reparameterize(c("m"), c("l"), c("e"))).alias("z"), R(mean).alias("grad_mean"), R(log_var).alias("grad_log_var"))


@register("cross_entropy_grad_rows", "SELECT vec_id, j, round(p-(j=label%64)::INT,6) AS g FROM (SELECT vec_id, label, k-1 AS j, exp(embedding[k]::DOUBLE)/list_sum(list_transform(embedding::DOUBLE[], lambda r: exp(r))) AS p FROM embeddings, generate_series(1,64) AS s(k))")
def ce_grad(spark, sf):
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(neural.cross_entropy_grad(v, F.col("label") % 64)).alias("j", "g")).withColumn("g", R(F.col("g")))


@register("norms_by_group", "SELECT vec_id, j, round((x-avg(x) OVER w)/sqrt(var_pop(x) OVER w+1e-5),6) AS x FROM (SELECT vec_id, k-1 AS j, embedding[k]::DOUBLE AS x FROM embeddings, generate_series(1,64) AS s(k)) WINDOW w AS (PARTITION BY vec_id, j//16)")
def group_norm(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(neural.groupnorm(F.col("embedding").cast("array<double>"), 4)).alias("j", "x")).withColumn("x", R(F.col("x")))


@register("matrix_concat_slice", "WITH m AS (SELECT o_orderkey%50 AS i, o_custkey%40 AS j, round(sum(o_totalprice),2) AS v FROM orders GROUP BY 1,2) SELECT i, j-30 AS j, v FROM m WHERE j BETWEEN 30 AND 39 UNION ALL SELECT i, j+10, v FROM m WHERE j<20 UNION ALL SELECT i+50, j-30, v FROM m WHERE j BETWEEN 30 AND 39 UNION ALL SELECT i+50, j+10, v FROM m WHERE j<20")
def concat_slice(spark, sf):
    from tabulon.queries.tables import matrix

    m = matrix(spark, sf)
    wide = shape.slice_columns(shape.concat_columns(m, m, 40), 30, 30)
    return shape.concat_rows(wide, wide, 50)


@register("matrix_outer_product", "SELECT a.s_suppkey AS i, b.s_suppkey AS j, round(a.s_acctbal*(b.s_acctbal/1e4::DOUBLE)+1e-7,4) AS v FROM supplier a, supplier b")
def outer(spark, sf):
    s = table(spark, sf, "supplier")
    return shape.outer_rounded(s.select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("v")), s.select(F.col("s_suppkey").alias("j"), (F.col("s_acctbal") / 1e4).alias("w")), 4, 1e-7)


@register("generators_matrices", "SELECT a::BIGINT AS i, b::BIGINT AS j, (a=b)::INT::DOUBLE AS eye, (b<=a+1)::INT::DOUBLE AS tri, 2.5::DOUBLE AS fill FROM generate_series(0,6) AS s(a), generate_series(0,4) AS t(b)")
def matrices(spark, sf):
    parts = [m.withColumnRenamed("v", n) for n, m in (("eye", shape.eye(spark, 7, 5)), ("tri", shape.tri(spark, 7, 5, 1)), ("fill", shape.fill(spark, 7, 5, 2.5)))]
    return parts[0].join(parts[1], ["i", "j"]).join(parts[2], ["i", "j"])


_U = "(('0x'||substr(md5('{0}:'||o_orderkey),1,8))::BIGINT/4294967296.0::DOUBLE)"


@register("generators_normal_permutation", f"SELECT o_orderkey, round(sqrt(-2*ln(1-{_U.format(5)}))*cos(2*pi()*{_U.format(6)}),6) AS z, row_number() OVER (ORDER BY {_U.format(7)}, o_orderkey)-1 AS place FROM orders")
def normal_permutation(spark, sf):
    d = encode.permutation(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 7, "place")
    return d.select("o_orderkey", R(encode.normal(F.col("o_orderkey"), seed=5)).alias("z"), "place")


@register("quantize_round_trip", "SELECT l_orderkey, l_linenumber, round((least(greatest(round(l_discount/0.002)+3,-128),127)-3)*0.002,6) AS back8, round((least(greatest(round(l_tax/0.01)-2,-8),7)+2)*0.01,6) AS fake4 FROM lineitem")
def quantize_trip(spark, sf):
    q = encode.quantize_int(F.col("l_discount"), 0.002, 3, -128, 127)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", R(encode.dequantize_int(q, 0.002, 3)).alias("back8"), R(encode.fake_quantize(F.col("l_tax"), 0.01, -2, -8, 7)).alias("fake4"))


@register("encode_collapse_onehot", "SELECT l_orderkey, l_linenumber, (dense_rank() OVER (ORDER BY l_returnflag)-1)::DOUBLE AS flag, (3+dense_rank() OVER (ORDER BY l_linestatus)-1)::DOUBLE AS status FROM lineitem")
def collapse(spark, sf):
    d = table(spark, sf, "lineitem")
    flags, status = encode.vocabulary(d, "l_returnflag"), encode.vocabulary(d, "l_linestatus")
    wide = d.select("l_orderkey", "l_linenumber", *encode.one_hot(F.col("l_returnflag"), flags, "flag"), *encode.one_hot(F.col("l_linestatus"), status, "status"))
    return encode.collapse_onehot(wide)


@register("encode_text_columns", "WITH t AS (SELECT p_partkey, list_filter(regexp_split_to_array(translate(p_name,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\\p{L}\\p{N}]+'), lambda x: x<>'') AS t FROM part), v AS (SELECT w, row_number() OVER (ORDER BY w) AS id FROM (SELECT DISTINCT unnest(t) AS w FROM t)), u AS (SELECT p_partkey, unnest(t) AS w, generate_subscripts(t,1)-1 AS k FROM t) SELECT p_partkey, k, id::INT AS id FROM u JOIN v USING (w)")
def text_columns(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", "p_name")
    return encode.text_ids(d, "p_name", "ids").select("p_partkey", F.posexplode("ids").alias("k", "id"))


G_SQL = "WITH x AS (SELECT vec_id, label, k-1 AS j, embedding[k]::DOUBLE AS v FROM embeddings, generate_series(1,64) AS s(k)), m AS (SELECT label AS cls, j, avg(v) AS mean, var_pop(v)+1e-9 AS var FROM x GROUP BY 1,2), p AS (SELECT label AS cls, ln(count(*)/(SELECT count(*) FROM embeddings)) AS prior FROM embeddings GROUP BY 1) "


@register("nb_gaussian_score", G_SQL + "SELECT vec_id, m.cls, round(any_value(prior)-0.5*sum(ln(var)+(v-mean)*(v-mean)/var),3) AS score FROM x JOIN m USING (j) JOIN p ON p.cls=m.cls GROUP BY 1,2")
def gaussian(spark, sf):
    e = table(spark, sf, "embeddings")
    x = e.select("vec_id", F.col("label").alias("cls"), F.posexplode(F.col("embedding").cast("array<double>")).alias("j", "v"))
    priors = e.groupBy(F.col("label").alias("cls")).agg(F.ln(F.count(F.lit(1)) / F.lit(float(e.count()))).alias("prior"))
    return ml.gaussian_ll(x, "vec_id", "j", "v", ml.gaussian_stats(x, "cls", "j", "v"), priors, "cls").withColumn("score", R(F.col("score"), 3))


@register("nb_bernoulli_score", "WITH x AS (SELECT vec_id, label, k-1 AS j, embedding[k]>0 AS b FROM embeddings, generate_series(1,64) AS s(k)), m AS (SELECT label AS cls, j, ln((sum(b::INT)+1)/(count(*)+2)) AS lp FROM x GROUP BY 1,2), p AS (SELECT label AS cls, ln(count(*)/(SELECT count(*) FROM embeddings)) AS prior FROM embeddings GROUP BY 1) SELECT vec_id, m.cls, round(any_value(prior)+sum(CASE WHEN b THEN lp ELSE ln(1-exp(lp)) END),4) AS score FROM x JOIN m USING (j) JOIN p ON p.cls=m.cls GROUP BY 1,2")
def bernoulli(spark, sf):
    e = table(spark, sf, "embeddings")
    x = e.select("vec_id", F.col("label").alias("cls"), F.posexplode("embedding").alias("j", "v"))
    logp = x.groupBy("cls", "j").agg(F.ln((F.count_if(F.col("v") > 0) + 1) / (F.count(F.lit(1)) + 2)).alias("logp"))
    priors = e.groupBy(F.col("label").alias("cls")).agg(F.ln(F.count(F.lit(1)) / F.lit(float(e.count()))).alias("prior"))
    present = x.filter("v > 0").select("vec_id", "j")
    return ml.bernoulli_nb(present, e.select("vec_id"), "vec_id", "j", logp, priors, "cls").withColumn("score", R(F.col("score"), 4))


@register("apriori_itemsets", "WITH i AS (SELECT DISTINCT l_orderkey AS b, l_suppkey AS x FROM lineitem), a AS (SELECT x, count(*) AS n FROM i GROUP BY 1 HAVING count(*)>=2), p AS (SELECT u.x AS a, v.x AS b, count(*) AS n FROM i u JOIN i v ON u.b=v.b AND u.x<v.x GROUP BY 1,2 HAVING count(*)>=2), t AS (SELECT u.x AS a, v.x AS b, w.x AS c, count(*) AS n FROM i u JOIN i v ON u.b=v.b AND u.x<v.x JOIN i w ON w.b=u.b AND v.x<w.x GROUP BY 1,2,3 HAVING count(*)>=2) SELECT x::VARCHAR AS items, n AS support FROM a UNION ALL SELECT a||','||b, n FROM p UNION ALL SELECT a||','||b||','||c, n FROM t")
def itemsets(spark, sf):
    found = ml.frequent_itemsets(table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey", 2, 3)
    return found.select(F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"), "support")


@register("forest_random_threshold", "SELECT round(min(o_totalprice)+('0x'||substr(md5('3:o_totalprice'),1,8))::BIGINT/4294967296.0::DOUBLE*(max(o_totalprice)-min(o_totalprice)),6) AS threshold FROM orders")
def threshold(spark, sf):
    return spark.range(1).select(R(ml.random_threshold(table(spark, sf, "orders"), "o_totalprice", 3)).alias("threshold"))


def _systems(spark, sf):
    """Per label a 3 x 3 matrix and its right side: the second moments of the sums of every third dimension."""
    v = F.col("embedding").cast("array<double>")
    third = lambda r: F.aggregate(F.filter(v, lambda x, k: k % 3 == r), F.lit(0.0), lambda s, x: s + x)
    e = table(spark, sf, "embeddings").select("label", F.array(*[third(r) for r in range(3)]).alias("v"))
    both = e.select("label", "v", F.posexplode("v").alias("i", "x")).select("label", "i", "x", F.posexplode("v").alias("j", "y"))
    a = both.groupBy("label", "i", "j").agg(F.avg(F.col("x") * F.col("y")).alias("v"))
    b = a.filter("j = 0").select("label", "i", "j", (F.col("i") + 1.0).alias("v"))
    return a, b


_M = "WITH e AS (SELECT label, [list_sum(embedding[1:64:3]::DOUBLE[]), list_sum(embedding[2:64:3]::DOUBLE[]), list_sum(embedding[3:64:3]::DOUBLE[])] AS v FROM embeddings), a AS (SELECT label, avg(v[1]*v[1]) AS aa, avg(v[1]*v[2]) AS ab, avg(v[1]*v[3]) AS ac, avg(v[2]*v[2]) AS bb, avg(v[2]*v[3]) AS bc, avg(v[3]*v[3]) AS cc FROM e GROUP BY 1), d AS (SELECT *, aa*(bb*cc-bc*bc)-ab*(ab*cc-bc*ac)+ac*(ab*bc-bb*ac) AS det FROM a), "
_X = "s AS (SELECT label, ((bb*cc-bc*bc)+2*(ac*bc-ab*cc)+3*(ab*bc-ac*bb))/det AS x0, ((ac*bc-ab*cc)+2*(aa*cc-ac*ac)+3*(ab*ac-aa*bc))/det AS x1, ((ab*bc-ac*bb)+2*(ab*ac-aa*bc)+3*(aa*bb-ab*ab))/det AS x2 FROM d) "


@register("linalg_solve_by_label", _M + _X + "SELECT label, i::BIGINT AS i, round(CASE i WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END,4) AS v FROM s, generate_series(0,2) AS t(i)")
def solve(spark, sf):
    return sequence.solve_groups(*_systems(spark, sf), "label").select("label", "i", R(F.col("v"), 4).alias("v"))


@register("linalg_cholesky_solve_by_label", _M + _X + "SELECT label, i::BIGINT AS i, round(CASE i WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END,4) AS v FROM s, generate_series(0,2) AS t(i)")
def cholesky_solve(spark, sf):
    return sequence.solve_groups(*_systems(spark, sf), "label", "cholesky").select("label", "i", R(F.col("v"), 4).alias("v"))


def _back(spark, sf, *factors):
    """The product of factors of each label's matrix, in coordinates."""
    a, _ = _systems(spark, sf)
    parts = [(f, t, sequence.per_group(a, "label", f)) for f, t in factors]
    out = None
    for _, turned, m in parts:
        m = m.select("label", F.col("j").alias("i"), F.col("i").alias("j"), "v") if turned else m
        out = m if out is None else out.join(m.select("label", F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("w")), ["label", "j"]).groupBy("label", "i", F.col("k").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return out.select("label", "i", "j", R(F.col("v"), 5).alias("v"))


_FULL = _M + "z AS (SELECT 1) SELECT label, i::BIGINT AS i, j::BIGINT AS j, round(CASE least(i,j)*3+greatest(i,j) WHEN 0 THEN aa WHEN 1 THEN ab WHEN 2 THEN ac WHEN 4 THEN bb WHEN 5 THEN bc ELSE cc END,5) AS v FROM a, generate_series(0,2) AS s(i), generate_series(0,2) AS t(j)"


@register("linalg_qr_product", _FULL)
def qr(spark, sf):
    return _back(spark, sf, ("qr_q", False), ("qr_r", False))


@register("linalg_cholesky_product", _FULL)
def cholesky(spark, sf):
    return _back(spark, sf, ("cholesky", False), ("cholesky", True))


@register("linalg_eigenvectors_orthonormal", "SELECT label, i::BIGINT AS i, j::BIGINT AS j, (i=j)::INT::DOUBLE AS v FROM (SELECT DISTINCT label FROM embeddings), generate_series(0,2) AS s(i), generate_series(0,2) AS t(j)")
def eigenvectors(spark, sf):
    return _back(spark, sf, ("eigenvectors", True), ("eigenvectors", False))


@register("linalg_svd_gram", "SELECT label, i::BIGINT AS i, j::BIGINT AS j, (i=j)::INT::DOUBLE AS v FROM (SELECT DISTINCT label FROM embeddings), generate_series(0,2) AS s(i), generate_series(0,2) AS t(j)")
def svd(spark, sf):
    return _back(spark, sf, ("svd_u", True), ("svd_u", False))


@register("linalg_logdet_by_label", _M + "z AS (SELECT 1) SELECT label, round(ln(abs(det)),5) AS v FROM d")
def logdet(spark, sf):
    return sequence.per_group(_systems(spark, sf)[0], "label", "logdet").select("label", R(F.col("v"), 5).alias("v"))


@register("fft_complex_round_trip", "SELECT vec_id, k-1 AS j, round(32*embedding[k]::DOUBLE,5) AS re, round(32*embedding[k+32]::DOUBLE,5) AS im FROM embeddings, generate_series(1,32) AS s(k)")
def fft_complex(spark, sf):
    v = F.col("embedding").cast("array<double>")
    d = table(spark, sf, "embeddings").select("vec_id", F.slice(v, 1, 32).alias("re"), F.slice(v, 33, 32).alias("im"))
    there = sequence.fft_complex(d, "re", "im").select("vec_id", F.transform("spectrum", lambda z: z["re"]).alias("re"), F.transform("spectrum", lambda z: z["im"]).alias("im"))
    back = sequence.fft_complex(there, "re", "im", inverse=True)
    return back.select("vec_id", F.posexplode("spectrum").alias("j", "z")).select("vec_id", "j", R(F.col("z.re"), 5).alias("re"), R(F.col("z.im"), 5).alias("im"))


@register(
    "diffusion_gated_step",
    """WITH p AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, list_transform(embedding::DOUBLE[], lambda x: exp(6*x)) AS e FROM embeddings), s AS (SELECT vec_id, label, v, list_transform(e, lambda x: x/list_sum(e)) AS q FROM p),
 h AS (SELECT vec_id, label, v, -list_sum(list_transform(q, lambda x: x*ln(x))) AS h FROM s) SELECT vec_id, CASE WHEN h<3.5 THEN list_position(v, list_max(v))-1 ELSE label END::BIGINT AS accepted, (h>=3.5) AS renoise FROM h""",
)
def gated_step(spark, sf):
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: 6 * x)
    token, again = neural.entropy_gated_step(v, F.col("label"), 3.5)
    return table(spark, sf, "embeddings").select("vec_id", token.cast("long").alias("accepted"), again.alias("renoise"))
