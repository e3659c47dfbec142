"""Iterative and sequential operators over the driver tables. SQL has no practical form for them; tests hold them against small oracles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tabulon.catalog import register
from tabulon.operators import boost, ml, sequence
from tabulon.session import table


def _features(spark, sf):
    c = F.col
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", c("l_quantity").alias("qty"), c("l_discount").alias("disc"), c("l_tax").alias("tax"), (c("l_extendedprice") / 1000).alias("price"), (c("l_returnflag") == "R").cast("double").alias("returned"))


def _boost(kind, target, objective="squared", **more):
    def query(spark, sf):
        d = _features(spark, sf)
        b = boost.Booster(kind=kind, rounds=3, depth=3, leaves=6, objective=objective, **more).fit(d, ["qty", "disc", "tax"], target)
        return b.predict(d).select("l_orderkey", "l_linenumber", F.round("prediction", 6).alias("prediction"))

    return query


register("boost_level_wise")(_boost("level", "price"))
register("boost_leaf_wise_goss")(_boost("leaf", "price", goss=(0.3, 0.3)))
register("boost_oblivious_logistic")(_boost("oblivious", "returned", "logistic"))


_E = "WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, CASE WHEN value<50 THEN 0.8::DOUBLE ELSE 0.3 END AS e0, CASE WHEN value<50 THEN 0.2::DOUBLE ELSE 0.7 END AS e1 FROM events), "


@register(
    "hmm_viterbi_events",
    _E + """f AS (SELECT user_id, event_id, k, ln(e0)-ln(2) AS s0, ln(e1)-ln(2) AS s1, 0 AS b0, 0 AS b1 FROM e WHERE k=1
  UNION ALL SELECT e.user_id, e.event_id, e.k, greatest(s0+ln(0.7),s1+ln(0.4))+ln(e0), greatest(s0+ln(0.3),s1+ln(0.6))+ln(e1), (s1+ln(0.4)>s0+ln(0.7))::INT, (s1+ln(0.6)>s0+ln(0.3))::INT FROM f JOIN e ON e.user_id=f.user_id AND e.k=f.k+1),
 b AS (SELECT user_id, event_id, k, (s1>s0)::INT AS state, CASE WHEN s1>s0 THEN b1 ELSE b0 END AS prev FROM f WHERE (user_id,k) IN (SELECT user_id, max(k) FROM f GROUP BY 1)
  UNION ALL SELECT f.user_id, f.event_id, f.k, b.prev, CASE WHEN b.prev=1 THEN f.b1 ELSE f.b0 END FROM b JOIN f ON f.user_id=b.user_id AND f.k=b.k-1) SELECT user_id, event_id, state::BIGINT AS state FROM b""",
)
def viterbi(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.array(F.when(F.col("value") < 50, 0.8).otherwise(0.3), F.when(F.col("value") < 50, 0.2).otherwise(0.7)).alias("emission"))
    return sequence.decode_groups(e, "user_id", "event_id", "emission", np.array([[0.7, 0.3], [0.4, 0.6]]))


@register(
    "hmm_posterior_events",
    _E + """f AS (SELECT user_id, event_id, k, e0/(e0+e1) AS a0, e1/(e0+e1) AS a1 FROM e WHERE k=1 UNION ALL SELECT user_id, event_id, k, x0/(x0+x1), x1/(x0+x1) FROM (SELECT e.user_id, e.event_id, e.k, (0.7*a0+0.4*a1)*e0 AS x0, (0.3*a0+0.6*a1)*e1 AS x1 FROM f JOIN e ON e.user_id=f.user_id AND e.k=f.k+1)),
 b AS (SELECT user_id, k, 0.5::DOUBLE AS c0, 0.5::DOUBLE AS c1 FROM e WHERE (user_id,k) IN (SELECT user_id, max(k) FROM e GROUP BY 1) UNION ALL SELECT user_id, k, x0/(x0+x1), x1/(x0+x1) FROM (SELECT b.user_id, b.k-1 AS k, 0.7*e0*c0+0.3*e1*c1 AS x0, 0.4*e0*c0+0.6*e1*c1 AS x1 FROM b JOIN e ON e.user_id=b.user_id AND e.k=b.k WHERE b.k>1))
 SELECT f.user_id, f.event_id, round(a0*c0/(a0*c0+a1*c1),6) AS p0 FROM f JOIN b USING (user_id, k)""",
)
def posterior(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.array(F.when(F.col("value") < 50, 0.8).otherwise(0.3), F.when(F.col("value") < 50, 0.2).otherwise(0.7)).alias("emission"))
    return sequence.posterior_groups(e, "user_id", "event_id", "emission", np.array([[0.7, 0.3], [0.4, 0.6]])).select("user_id", "event_id", F.round(F.get("posterior", F.lit(0)), 6).alias("p0"))


# Cells of one antidiagonal follow from the one before; every row also carries its left neighbour's value.
@register(
    "dtw_embeddings",
    """WITH RECURSIVE p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS v, b.embedding::DOUBLE[] AS w, len(a.embedding) AS n FROM embeddings a JOIN embeddings b ON b.vec_id=a.vec_id+1),
 c AS (SELECT vec_id, 2 AS d, 1 AS i, abs(v[1]-w[1]) AS c, 'inf'::DOUBLE AS l FROM p
  UNION ALL SELECT vec_id, d, i, c, l FROM (SELECT s.vec_id, s.d+1 AS d, t.i, abs(p.v[t.i]-p.w[s.d+1-t.i])+min(least(CASE WHEN s.i=t.i THEN s.c ELSE s.c END, CASE WHEN s.i=t.i-1 THEN s.l ELSE 'inf'::DOUBLE END)) AS c, min(CASE WHEN s.i=t.i THEN s.c ELSE 'inf'::DOUBLE END) AS l
   FROM c s JOIN p ON p.vec_id=s.vec_id, (VALUES (0),(1)) AS o(o), LATERAL (SELECT s.i+o AS i) AS t WHERE t.i<=p.n AND s.d+1-t.i BETWEEN 1 AND p.n GROUP BY s.vec_id, s.d, t.i, p.v, p.w))
 SELECT c.vec_id, round(c.c,6) AS dtw FROM c JOIN p ON p.vec_id=c.vec_id WHERE d=2*n AND i=n""",
)
def dtw(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")
    return sequence.dtw_pairs(pairs, "v", "w").select("vec_id", F.round("dtw", 6).alias("dtw"))


@register("fft_embeddings", "SELECT vec_id, b::INT AS bin, round(sum(embedding[k]::DOUBLE*cos(2*pi()*b*(k-1)/64)),6)+0.0 AS re, round(-sum(embedding[k]::DOUBLE*sin(2*pi()*b*(k-1)/64)),6)+0.0 AS im FROM embeddings, generate_series(1,64) AS s(k), generate_series(0,32) AS t(b) GROUP BY 1,2")
def fft(spark, sf):
    d = sequence.fft_rows(table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "v")
    return d.select("vec_id", F.posexplode("spectrum").alias("bin", "z")).select("vec_id", "bin", (F.round("z.re", 6) + 0.0).alias("re"), (F.round("z.im", 6) + 0.0).alias("im"))


@register("linalg_eigenvalues_by_label")
def eigen(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    both = e.select("label", "v", F.posexplode("v").alias("i", "x")).select("label", "i", "x", F.posexplode("v").alias("j", "y"))
    cov = both.groupBy("label", "i", "j").agg(F.avg(F.col("x") * F.col("y")).alias("v"))
    return sequence.per_group(cov, "label", "eigenvalues").withColumn("v", F.round("v", 6))


@register("linalg_eigenvalue_sums", "WITH c AS (SELECT label, i, j, avg(embedding[i]::DOUBLE*embedding[j]::DOUBLE) AS v FROM embeddings, generate_series(1,64) AS s(i), generate_series(1,64) AS t(j) GROUP BY 1,2,3) SELECT label, round(sum(v) FILTER (WHERE i=j),5) AS s1, round(sum(v*v),5) AS s2 FROM c GROUP BY 1")
def eigen_sums(spark, sf):
    """The eigenvalues' sum is the matrix's trace, the sum of their squares that of its elements' squares."""
    e = eigen(spark, sf)
    return e.groupBy("label").agg(F.round(F.sum("v"), 5).alias("s1"), F.round(F.sum(F.col("v") * F.col("v")), 5).alias("s2"))


@register("svm_per_label", "SELECT label, round(0,3)+0.0 AS balance, true AS within FROM embeddings GROUP BY 1")
def svm(spark, sf):
    """One machine per label on the sign of each row's sum: at the optimum the weights balance (the sum of alpha y is 0) and lie in [0, c]."""
    v = F.col("embedding").cast("array<double>")
    side = F.when(F.aggregate(v, F.lit(0.0), lambda a, x: a + x) > 0, 1.0).otherwise(-1.0)
    d = table(spark, sf, "embeddings").select("label", "vec_id", v.alias("x"), side.alias("y"))
    got = sequence.train_svm(d, "label", "x", "y", "vec_id", c=0.5).join(d.select("vec_id", "y"), "vec_id")
    return got.groupBy("label").agg((F.round(F.sum(F.col("alpha") * F.col("y")), 3) + 0.0).alias("balance"), F.bool_and(F.col("alpha").between(-1e-9, 0.5 + 1e-9)).alias("within"))


@register("byte_pairs_parts", "SELECT p_partkey, length(replace(replace(p_name,'th','_'),'in','_'))::BIGINT AS n FROM part")
def byte_pairs(spark, sf):
    pairs = [tuple(b"th"), tuple(b"in")]
    return sequence.encode_byte_pairs(table(spark, sf, "part"), "p_name", pairs).select("p_partkey", F.size("ids").cast("long").alias("n"))


@register("bootstrap_out_of_bag", "SELECT c_custkey AS pos, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT floor(('0x'||substr(md5('7:0:'||s),1,8))::BIGINT/4294967296.0::DOUBLE*(SELECT count(*) FROM customer))::BIGINT FROM generate_series(0,(SELECT count(*)-1 FROM customer)) AS t(s))")
def bootstrap(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("pos"), "c_acctbal")
    drawn = ml.bootstrap(c, "pos", c.count(), 2)
    return ml.out_of_bag(c, "pos", drawn, 0)


@register("model_dense_regression")
def dense(spark, sf):
    from tabulon.plans.api import Data, Model, Train

    d = table(spark, sf, "part").select("p_size", "p_brand", "p_retailprice")
    run = Train().epochs(3).run(spark, Model().layer(8, "relu").layer(1).loss("mse").lr(0.05), Data.load().set(d).target("p_retailprice").split(0.8))
    return run.scored().select("raw", F.col("__train").alias("in_train"), F.round("prediction", 6).alias("prediction"))
