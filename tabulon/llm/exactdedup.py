"""Exact deduplication by content-defined chunk recipes.

1. Every text is normalised (A-Z lower-cased) and cut where its own content says so: after a short character pattern, not
   before MIN_CHUNK and not after MAX_CHUNK code points. Equal texts give equal cuts, and so do equal long passages.
2. The chunk store keeps one copy of every distinct chunk, found by grouping on (SHA-256, length, content), so a chunk's bytes
   move at most once per map task and never with their document. An identifier is verified when its group holds a single
   content; a second content under one identifier stops the job rather than merging unequal texts.
3. A document is from then on its recipe, the ordered list of identifiers, computed once and stored with the text's digest. Recipes are
   pre-aggregated map-side, grouped, and only groups of two or more are joined back; the commonest of them without a shuffle.

Defined results: null text counts as empty; an empty text has an empty recipe and equals every other empty text. Of equal texts
the row with the largest doc_id stays; null ids lose against others, and are the keep_id only of a group without ids. Rows that
repeat both id and text are one document: `mark_exact` marks all of them alike, `drop_exact` returns one. Very long texts
are cut like others. An empty table gives an empty table. Output columns replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.expr import lower_ascii
from tabulon.llm.skew import join_groups
from tabulon.session import stored

MIN_CHUNK, MAX_CHUNK = 512, 8192
#: A cut may follow this pattern: a letter of a fixed class, a separator, and a letter of another class.
CUT = r"[hlprst][,.;:!?]?[\x20\n][aeio][nr]"


def chunk_pattern(least: int = MIN_CHUNK, most: int = MAX_CHUNK, cut: str = CUT) -> str:
    """A regular expression whose successive matches are the chunks: lazily up to a cut, else up to the largest size."""
    return rf"(?s).{{{least},{most}}}?(?<={cut})|.{{1,{most}}}"


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    return F.regexp_extract_all(text, F.lit(chunk_pattern(least, most)), F.lit(0))


def normalised(text: Column) -> Column:
    return lower_ascii(F.coalesce(text, F.lit("")))


def recipes(df: DataFrame, text: Column, out: str = "recipe") -> DataFrame:
    """Adds the ordered list of chunk identifiers (binary SHA-256), computed where the row is."""
    return df.withColumn(out, F.transform(chunks(text), lambda c: F.unhex(F.sha2(c, 256))))


def chunk_store(df: DataFrame, text: Column) -> DataFrame:
    """One row per distinct chunk: id, chunk, n_refs."""
    parts = df.select(F.explode(chunks(text)).alias("chunk")).withColumn("id", F.unhex(F.sha2("chunk", 256)))
    return parts.groupBy("id", "chunk").agg(F.count(F.lit(1)).alias("n_refs"))


def verified_ids(store: DataFrame) -> DataFrame:
    """One row per identifier: id, n_refs, ok (exactly one content has it)."""
    return store.groupBy("id").agg(F.sum("n_refs").alias("n_refs"), (F.count(F.lit(1)) == 1).alias("ok"))


def mark_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of df: doc_id, keep_id, group_size, kept, text_sha256."""
    text = normalised(F.col(text_col))
    src = df.select(F.col(id_col).alias("doc_id"), text.alias("__text"))
    clashes = verified_ids(chunk_store(src, F.col("__text"))).filter(~F.col("ok")).agg(F.count(F.lit(1)).alias("n"))
    rows = stored(recipes(src, F.col("__text")).select("doc_id", "recipe", F.sha2("__text", 256).alias("text_sha256")), "exact-recipes")
    # The scalar subquery is one number; the job stops if any identifier stands for two contents.
    safe = F.when(clashes.scalar() > 0, F.raise_error(F.lit("two different chunks share one identifier"))).otherwise(F.col("recipe"))
    groups = rows.groupBy("recipe").agg(F.max("doc_id").alias("__keep"), F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    joined = join_groups(rows, stored(groups.withColumn("recipe", safe), "exact-groups"), "recipe", "__n", rows.count())
    keep = F.when(F.col("__n").isNull(), F.col("doc_id")).otherwise(F.col("__keep"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("__n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def _row_key(doc_id: Column, sha: Column) -> Column:
    return F.concat_ws(":", sha, doc_id.cast("string"))


def drop_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, one for each class of equal texts, with the columns of df.

    Only ids and digests decide; each kept text moves once, to meet its key."""
    names = df.columns
    stay = mark_exact(df, id_col, text_col).filter("kept").select(_row_key(F.col("doc_id"), F.col("text_sha256")).alias("__key")).distinct()
    rows = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    key = _row_key(F.col(f"c{names.index(id_col)}"), F.sha2(normalised(F.col(f"c{names.index(text_col)}")), 256))
    kept = rows.withColumn("__key", key).join(stay, "__key").dropDuplicates(["__key"])
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return mark_exact(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP5_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""
