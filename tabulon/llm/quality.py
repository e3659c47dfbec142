"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Each Rule bounds one metric; `compile_rules` turns a table of rules into the list of violated names. Metrics
are ratios of counts taken over the whole text (length, symbols, stop words, lines), so a row's verdict depends on that
row alone: no shuffle, no state, and any executor may be lost.

Defined results: a null or empty text has no words, all counts 0, and fails the base rule. Ratios over zero words or zero
lines are null, and a null metric violates no rule. Repeated rows each get the same verdict. An empty table gives an empty
table. The single output column is named by `out` and replaces a column of that name; other columns pass untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.expr import WORD, split_words

#: Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on are with as be by at from this or an "
    "der die und das den von zu mit ist im ein eine für auf nicht dem des sich "
    "de la le les et des en un une du que qui dans pour est au par sur pas avec "
    "el los las y del se por con una su no lo al es más"
).split()


@dataclass(frozen=True)
class Rule:
    """A row of the threshold table: metric must lie in [low, high]; None leaves that side open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: Production thresholds. Bounds follow the published web-corpus heuristics (word length, symbol ratio, alphabetic words,
#: stop words, bullet and ellipsis lines) and leave ordinary prose of any of the four languages well inside.
RULES = (
    Rule("word_length", "mean_word_chars", 2.5, 12.0),
    Rule("symbols", "symbols_per_word", None, 0.1),
    Rule("alphabetic", "alpha_word_ratio", 0.7, None),
    Rule("stop_words", "n_stop_words", 2, None),
    Rule("shouting", "shout_word_ratio", None, 0.3),
    Rule("exclaiming", "exclaim_word_ratio", None, 0.3),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
    Rule("bullets", "bullet_line_ratio", None, 0.9),
    Rule("ellipses", "ellipsis_line_ratio", None, 0.3),
)

BASE_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(words: Column, order: Column) -> Column:
    """Words covered by a three-word window that occurs at least twice. `order`: windows sorted by (hash, position).

    Equal windows are neighbours in that order; their words are compared, so the hash only brings them together."""
    same = lambda a, b: (
        (a["h"] == b["h"])
        & (F.get(words, a["i"]) == F.get(words, b["i"]))
        & (F.get(words, a["i"] + 1) == F.get(words, b["i"] + 1))
        & (F.get(words, a["i"] + 2) == F.get(words, b["i"] + 2))
    )
    marked = F.transform(order, lambda x, k: F.when(F.coalesce((k > 0) & same(F.get(order, k - 1), x), F.lit(False)) | F.coalesce(same(F.get(order, k + 1), x), F.lit(False)), x["i"]))
    return F.sort_array(F.array_compact(marked))


def _with_metrics(df: DataFrame, text: str, m: str) -> DataFrame:
    """Adds the working columns, named with the prefix m; each step is a projection over the one before."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn(m + "w", split_words(F.col(text))).withColumn(m + "lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)))
    w, lines = F.col(m + "w"), F.col(m + "lines")
    windows = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))
    df = df.withColumn(m + "order", F.sort_array(windows))
    df = df.withColumn(m + "starts", F.coalesce(_repeat_words(w, F.col(m + "order")), F.array().cast("array<int>")))
    starts = F.col(m + "starts")
    covered = F.aggregate(F.transform(starts, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    counts = {
        "n_words": F.size(w),
        "word_chars": F.length(F.concat_ws("", w)),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": covered,
        "n_lines": F.size(lines),
        "n_alpha": F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))),
        "n_stop_words": F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))),
        "n_shout": F.regexp_count(t, F.lit(r"\b[A-Z]{2,}\b")),
        "n_exclaim": F.regexp_count(t, F.lit(r"!+")),
        "n_bullet": F.size(F.filter(lines, lambda x: x.rlike("^[-*•]"))),
        "n_ellipsis": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)$"))),
    }
    # Unnested from an array of one, the counts are an output of their own: a filter on the verdict stops here. Below, it would
    # be pushed through the projections above with their expressions copied into it once for each use.
    return df.select("*", F.explode(F.array(F.struct(*[v.cast("long").alias(k) for k, v in counts.items()]))).alias(m + "c"))


def metric_columns(c: Column) -> dict[str, Column]:
    """The metrics that rules may name, from the struct of counts."""
    per = lambda a, b: F.when(c[b] > 0, c[a].cast("double") / c[b])
    return {
        "mean_word_chars": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "alpha_word_ratio": per("n_alpha", "n_words"),
        "n_stop_words": c["n_stop_words"].cast("double"),
        "shout_word_ratio": per("n_shout", "n_words"),
        "exclaim_word_ratio": per("n_exclaim", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "bullet_line_ratio": per("n_bullet", "n_lines"),
        "ellipsis_line_ratio": per("n_ellipsis", "n_lines"),
    }


def compile_rules(rules, metrics: dict[str, Column]) -> Column:
    """Array of the names of violated rules."""
    bad = []
    for r in rules:
        v = metrics[r.metric]
        parts = [v < r.low] * (r.low is not None) + [v > r.high] * (r.high is not None)
        hit = parts[0] if len(parts) == 1 else parts[0] | parts[1]
        bad.append(F.when(hit, F.lit(r.name)))
    return F.array_compact(F.array(*bad))


def flag_quality(df: DataFrame, text: str = "text", rules=RULES, out: str = "quality") -> DataFrame:
    """Adds the struct column `out`: the base counts, base_failed, violated (rule names) and kept."""
    m = "__quality_"
    names = [c for c in df.columns if c != out]
    wide = _with_metrics(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*names, text])]), f"`{text}`" if text in df.columns else text, m)
    c = F.col(m + "c")
    failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
    violated = compile_rules(rules, metric_columns(c))
    verdict = F.struct(*[c[k].alias(k) for k in BASE_COUNTS], failed.alias("base_failed"), violated.alias("violated"), (~failed & (F.size(violated) == 0)).alias("kept"))
    return wide.select(*[F.col(f"`{n}`") for n in names], verdict.alias(out))


def keep_quality(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows whose verdict is kept, with the columns of df."""
    flag = "__quality_verdict"
    return flag_quality(df, text, rules, flag).filter(F.col(flag)["kept"]).select(*[F.col(f"`{c}`") for c in df.columns])


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    q = flag_quality(docs)
    return q.select("doc_id", *[F.col("quality")[k].alias(k) for k in (*BASE_COUNTS, "base_failed", "kept")])


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
t AS (SELECT rid, unnest(words) AS a, generate_subscripts(words, 1) AS pos FROM d),
tri AS (SELECT rid, pos, a, lead(a, 1) OVER w AS b, lead(a, 2) OVER w AS c FROM t WINDOW w AS (PARTITION BY rid ORDER BY pos)),
twice AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM tri WHERE c IS NOT NULL),
cov AS (SELECT rid, count(DISTINCT pos + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY rid),
f AS (
  SELECT d.rid, doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
         len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) AS n_alpha,
         len(list_filter(words, lambda x: x IN (@STOP@))) AS n_stop,
         len(regexp_extract_all(text, '\b[A-Z]{2,}\b')) AS n_shout,
         len(regexp_extract_all(text, '!+')) AS n_exclaim,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[-*•]'))) AS n_bullet,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)$'))) AS n_ellipsis
  FROM d LEFT JOIN cov USING (rid)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2.5 AND 12.0 AND n_symbols / n_words <= 0.1 AND n_alpha / n_words >= 0.7
       AND n_stop >= 2 AND n_shout / n_words <= 0.3 AND n_exclaim / n_words <= 0.3
       AND coalesce(n_dup_lines / nullif(n_lines, 0) <= 0.5, true) AND coalesce(n_bullet / nullif(n_lines, 0) <= 0.9, true)
       AND coalesce(n_ellipsis / nullif(n_lines, 0) <= 0.3, true) AS kept
FROM g
""".replace("@STOP@", ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS)))
