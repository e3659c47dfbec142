"""Mixing sources to target weights by Pareto order sampling.

Targets. Sources in code point order (null last) take the weights in turn and share all words by weight; a target stops at
`most` times its source's size and the excess is shared again by weight. The level at which that settles is found in closed
form from sums over the sources ordered by size per weight.

Documents. A document's expected copies are its source's rate (target / size), tilted by up to `tilt` towards longer documents
so that the expected words stay exactly the target. The whole part is allocated for certain; the fraction is an inclusion
probability p. Documents are ranked by (u / (1 - u)) / (p / (1 - p)) with u uniform from a keyed hash, and the sample is the
prefix that fits the words still missing: fixed in words, unequal in probability. One closing document per source, the one
whose size comes nearest to what is left, is added if that brings the total nearer.

No source is ever sorted in one task: the ranks are cut into ranges, one for every RANGE_ROWS rows of the table, whose word sums are pre-aggregated; only
the range in which the prefix ends is ordered, by itself. All sums are of whole numbers, so reruns agree bit by bit. The sources themselves are
ordered in one task: they may be MAX_SOURCES, more stop the job.

Defined results: null text has size 0; size 0 takes 0. Rows that repeat a doc_id are drawn separately, ties in rank are broken by
doc_id and size; rows that are equal in all three are told apart by a row number, so one of them closes a source and not all. A source without words has target 0. A null source is a source of its own, after all others. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.expr import count_words
from tabulon.session import cut

WEIGHTS = (5, 2, 1)
MOST = 3
TILT = 0.25
#: Size at which the preference for long documents is half way.
HALF_SIZE = 400
#: Ranges of ranks: this many at least, and one for so many rows.
RANGES, RANGE_ROWS = 4096, 20_000
MAX_SOURCES = 1_000_000
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source of sizes(source, size): source, source_size, target. Sources are few beside documents; sums arrive pre-aggregated."""
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.select("*", w.alias("w"), rank.alias("rank")).withColumn("cap", (most * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    every = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum(F.col("source_size").cast("double")).over(every)
    # The level if this source and all with more room per weight stay below their caps.
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    per = per.select("*", level.alias("level")).withColumn("free", F.col("level") * F.col("w") <= F.col("cap"))
    settled = F.max(F.when(F.col("free"), F.struct((-F.col("cap") / F.col("w")).alias("o"), (-F.col("rank")).alias("r"), F.col("level").alias("level")))).over(every)["level"]
    target = F.when(settled.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), settled * F.col("w")))
    return per.select("source", "source_size", target.alias("target"))


def _uniform(doc_id: Column, seed: str) -> Column:
    """In (0, 1), from the first 52 bits of an MD5 over seed and id."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double")
    return (h + 0.5) / float(2**52)


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = SEED, weights=WEIGHTS, most: int = MOST, tilt: float = TILT) -> DataFrame:
    """Per row of df: doc_id, size, source_size, target, taken, copies, source."""
    sizes = cut(df.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), count_words(F.col(text_col)).alias("size")))
    ranges_n = max(RANGES, sizes.count() // RANGE_ROWS)
    lean = F.floor(1000 * F.col("size") / (F.col("size") + HALF_SIZE)).cast("long")
    targets = source_targets(sizes, weights, most)
    leans = sizes.groupBy("source").agg(F.sum(lean * F.col("size")).alias("lean_sum"))
    both = lambda a, b: a.join(b.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    per = cut(both(targets, leans))
    if per.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    room = F.when(rate > 0, F.least(F.lit(tilt), most / rate - 1)).otherwise(F.lit(0.0))
    mean = F.when(F.col("source_size") > 0, F.col("lean_sum") / (1000.0 * F.col("source_size"))).otherwise(F.lit(0.0))
    docs = sizes.join(per.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    # Rounded, so that a rate that is a whole number but for its last bits is that whole number.
    copies = F.round(rate * (1 + F.greatest(F.lit(0.0), room) * (lean / F.lit(1000.0) - mean)), 9)
    docs = docs.withColumn("expected", F.least(F.lit(float(most)), copies)).withColumn("whole", F.floor("expected").cast("long")).withColumn("p", F.col("expected") - F.col("whole"))
    u = _uniform(F.col("doc_id"), seed)
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    docs = docs.withColumn("q", F.when((F.col("p") > 0) & (F.col("size") > 0), odds)).withColumn("b", F.floor(ranges_n * F.col("q") / (1 + F.col("q"))).cast("int"))
    docs = cut(docs.select("rid", "doc_id", "source", "size", "source_size", "target", "whole", "q", "b"))

    # Words still missing after the whole copies, and the range of ranks in which the sample fills them.
    ranges = docs.groupBy("source", "b").agg(F.sum("size").alias("words"), F.sum(F.col("whole") * F.col("size")).alias("sure"), F.first("target").alias("target"))
    by = Window.partitionBy("source")
    ranges = ranges.withColumn("missing", F.col("target") - F.sum("sure").over(by)).filter("b is not null")
    ranges = ranges.withColumn("upto", F.sum("words").over(by.orderBy("b"))).withColumn("before", F.col("upto") - F.col("words"))
    ends = cut(ranges.groupBy("source").agg(F.first("missing").alias("missing"), F.min(F.when(F.col("upto") > F.col("missing"), F.struct("b", "before"))).alias("end")))
    ends = ends.select(F.col("source").alias("__s"), "missing", F.coalesce(F.col("end.b"), F.lit(ranges_n + 1)).alias("end_b"), F.col("end.before").alias("end_before"))
    docs = docs.join(ends, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    inside = docs.filter(F.col("b") == F.col("end_b"))
    order = Window.partitionBy("source").orderBy("q", "doc_id", "size", "rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("picked", (F.col("end_before") + F.sum("size").over(order) <= F.col("missing")).cast("int"))
    rest = docs.filter((F.col("b") != F.col("end_b")) | F.col("b").isNull()).withColumn("picked", F.coalesce((F.col("b") < F.col("end_b")).cast("int"), F.lit(0)))
    drawn = cut(rest.unionByName(inside).drop("end_b", "end_before"))

    # The closing document of each source.
    got = drawn.groupBy("source").agg((F.first("missing") - F.sum(F.col("picked") * F.col("size"))).alias("left_over")).withColumnRenamed("source", "__s")
    open_ = drawn.filter("picked = 0 and q is not null").join(got, F.col("source").eqNullSafe(F.col("__s")))
    gap = F.abs(F.col("left_over") - F.col("size"))
    close = open_.filter(gap < F.abs("left_over")).groupBy("__s").agg(F.min(F.struct(gap.alias("gap"), "q", "doc_id", "size", "rid")).alias("c"))
    close = close.select("__s", F.col("c.rid").alias("__rid"))
    out = drawn.join(close, F.col("source").eqNullSafe(F.col("__s")), "left")
    last = F.coalesce(F.col("rid") == F.col("__rid"), F.lit(False)).cast("int")
    total = (F.col("whole") + F.col("picked") + last).cast("long")
    return out.select("doc_id", "size", "source_size", "target", (total * F.col("size")).alias("taken"), total.alias("copies"), "source")


def apply_mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **settings) -> DataFrame:
    """The rows of df, each repeated as often as the mix takes it, with the columns of df. Documents without words go."""
    names = df.columns
    drawn = mix(df, id_col, source_col, text_col, **settings)
    # Rows of one id and size may be drawn differently; they are numbered on both sides, so each meets its own count.
    number = lambda *key: F.row_number().over(Window.partitionBy(*key).orderBy(*key))
    drawn = drawn.select(F.col("doc_id").alias("__id"), F.col("size").alias("__size"), F.col("source").alias("__src"), "copies").withColumn("__k", number("__id", "__size", "__src"))
    rows = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    i, s, t = (f"c{names.index(x)}" for x in (id_col, source_col, text_col))
    rows = rows.withColumn("__n", count_words(F.col(t))).withColumn("__j", number(i, "__n", s))
    met = rows.join(drawn.filter("copies > 0"), F.col(i).eqNullSafe(F.col("__id")) & (F.col("__n") == F.col("__size")) & F.col(s).eqNullSafe(F.col("__src")) & (F.col("__j") == F.col("__k")))
    out = met.filter("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])


def op3_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
lean AS (SELECT *, floor(1000 * size / (size + 400))::BIGINT AS lean FROM d),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, sum(lean * size)::BIGINT AS lean_sum, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM lean GROUP BY source),
s1 AS (SELECT *, (CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS w, (3 * source_size)::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
s3 AS (SELECT *, arg_min(level, cap / w * 1e6 + rank) FILTER (WHERE level * w <= cap) OVER () AS settled FROM s2),
s4 AS (SELECT *, CASE WHEN settled IS NULL THEN cap ELSE least(cap, settled * w) END AS target FROM s3),
r AS (SELECT l.rid, l.doc_id, l.source, l.size, l.lean, source_size, target, lean_sum,
             CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
             CASE WHEN source_size > 0 THEN lean_sum / (1000.0::DOUBLE * source_size) ELSE 0 END AS mean
      FROM lean l JOIN s4 ON l.source IS NOT DISTINCT FROM s4.source),
e AS (SELECT *, least(3.0::DOUBLE, round(rate * (1 + greatest(0.0::DOUBLE, CASE WHEN rate > 0 THEN least(0.25::DOUBLE, 3 / rate - 1) ELSE 0 END) * (lean / 1000.0::DOUBLE - mean)), 9)) AS expected,
             (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM r),
p AS (SELECT *, floor(expected)::BIGINT AS whole, expected - floor(expected) AS p FROM e),
q AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM p),
m AS (SELECT *, target - sum(whole * size) OVER (PARTITION BY source)::BIGINT AS missing,
             sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM q),
k AS (SELECT *, CASE WHEN q IS NOT NULL AND run <= missing THEN 1 ELSE 0 END AS picked FROM m),
l AS (SELECT *, missing - sum(picked * size) OVER (PARTITION BY source)::BIGINT AS left_over FROM k),
c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN picked = 0 AND q IS NOT NULL AND abs(left_over - size) < abs(left_over) THEN 0 ELSE 1 END, abs(left_over - size), q, doc_id, size) = 1
             AND picked = 0 AND q IS NOT NULL AND abs(left_over - size) < abs(left_over) AS closing FROM l)
SELECT doc_id, size, source_size, target, ((whole + picked + closing::BIGINT) * size)::BIGINT AS taken FROM c
"""
