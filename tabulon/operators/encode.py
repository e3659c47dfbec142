"""Typing, encoding, imputation and splitting of tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.guards import strict_double
from tabulon.session import cut

#: Cells that count as missing, and image file extensions.
MISSING = ("", "NA", "NaN", "nan", "N/A", "NULL", "null", "None", "none", "?", ".", "-")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "gif", "webp", "tiff", "tif", "ico", "pnm", "pbm", "pgm", "ppm", "qoi", "dds", "hdr", "exr", "ff")
DATE = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}([T ].*)?$"
MAX_TOKENS = 256


def is_missing(cell: Column) -> Column:
    return cell.isNull() | cell.isin(*MISSING)


def pseudo_days(cell: Column) -> Column:
    """A number as it is; a date as y * 365.25 + m * 30.44 + d, time of day ignored; anything else NULL."""
    parts = F.transform(F.split(cell, "[-/T ]"), strict_double)
    return F.coalesce(strict_double(cell), F.when(F.size(parts) >= 3, F.get(parts, F.lit(0)) * 365.25 + F.get(parts, F.lit(1)) * 30.44 + F.get(parts, F.lit(2))))


def days(df: DataFrame, name: str) -> Column:
    """pseudo_days of a column: dates and timestamps by their fields, anything else by its text."""
    c, kind = F.col(f"`{name}`"), dict(df.dtypes)[name]
    if kind == "date" or kind.startswith("timestamp"):
        return F.year(c) * 365.25 + F.month(c) * 30.44 + F.dayofmonth(c)
    return pseudo_days(c.cast("string"))


def tokens(text: Column) -> Column:
    """Alphanumeric runs, A-Z lower-cased."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda x: x != "")


def byte_tokens(cells: list[Column], size: int = MAX_TOKENS) -> Column:
    """Bytes of the joined cells plus one, padded with 0 or cut to size."""
    raw = F.hex(F.encode(F.concat_ws("\n", *cells), "UTF-8"))
    ids = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.conv(F.nullif(F.substring(raw, 2 * i + 1, F.lit(2)), F.lit("")), 16, 10).cast("int") + 1, F.lit(0)))
    return ids


def profile(df: DataFrame) -> DataFrame:
    """One row per column: n, missing, distinct, share of numbers, dates, images, and mean tokens; one aggregation over all columns."""
    aggs = []
    for c in df.columns:
        x = F.col(f"`{c}`").cast("string")
        ok = ~is_missing(x)
        share = lambda cond: F.avg(F.when(ok, cond.cast("double")))
        images = "(?i)\\.(" + "|".join(IMAGE_EXTENSIONS) + ")([?#].*)?$"
        number = strict_double(x)
        aggs.append(
            F.struct(
                F.lit(c).alias("column"), F.count(F.lit(1)).alias("n"), F.count_if(~ok).alias("missing"), F.approx_count_distinct(F.when(ok, x)).alias("distinct"),
                F.coalesce(share(number.isNotNull()), F.lit(1.0)).alias("numbers"), F.coalesce(share(x.rlike(DATE)), F.lit(0.0)).alias("dates"), F.coalesce(share(x.rlike(images)), F.lit(0.0)).alias("images"),
                F.coalesce(F.avg(F.when(ok, F.size(tokens(x)).cast("double"))), F.lit(0.0)).alias("mean_tokens"),
                F.coalesce(F.bool_and(F.when(ok, number == F.floor(number))), F.lit(False)).alias("whole"), F.min(F.when(ok, number)).alias("low"), F.max(F.when(ok, number)).alias("high"),
            )
        )
    return df.agg(F.array(*aggs).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def kinds(profiled: DataFrame) -> DataFrame:
    """column, kind by fixed rules on the profile; first match wins. The thresholds are this engine's own."""
    c = F.col
    kind = (
        F.when(c("missing") == c("n"), "numeric")
        .when(c("images") >= 0.95, "image")
        .when(c("dates") >= 0.95, "temporal")
        .when((c("numbers") == 1.0) & (c("distinct") <= 2), "categorical")
        .when((c("numbers") == 1.0) & c("whole") & (c("distinct") <= 10) & (c("distinct") >= 3) & (c("high") - c("low") + 1 == c("distinct")), "ordinal")
        .when(c("numbers") == 1.0, "numeric")
        .when((c("distinct") <= 0.5 * c("n")) & (c("distinct") <= 200) & (c("mean_tokens") <= 4), "categorical")
        .otherwise("text")
    )
    return profiled.select("column", kind.alias("kind"))


def one_hot(x: Column, values: list, prefix: str) -> list[Column]:
    """A column per value; missing and unseen values give all zeros."""
    return [F.coalesce((x == v).cast("double"), F.lit(0.0)).alias(f"{prefix}={v}") for v in values]


def ordinal(x: Column, values: list) -> Column:
    """Place among the sorted distinct values; unseen is NULL."""
    chain = None
    for k, v in enumerate(sorted(values)):
        chain = F.when(x == v, float(k)) if chain is None else chain.when(x == v, float(k))
    return chain if chain is not None else F.lit(None).cast("double")


def vocabulary(df: DataFrame, x: str, most: int = 10_000) -> list:
    """Sorted distinct non-missing values. Refuses a vocabulary over `most`, which would not fit a projection."""
    got = [r[0] for r in df.select(F.col(x)).filter(~is_missing(F.col(x).cast("string"))).distinct().limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"{x} has over {most} values")
    return sorted(got)


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing or infinite values replaced by the mean of the finite ones, 0 if there are none."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    means = df.agg(*[F.coalesce(F.avg(finite(F.col(c))), F.lit(0.0)).alias(c) for c in columns]).first()
    return df.withColumns({c: F.coalesce(finite(F.col(c)), F.lit(means[c])) for c in columns})


def impute_zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """impute_mean, then zscore, with all statistics from one pass: imputed values lie at the mean and add nothing to the squares."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    x = {c: finite(F.col(f"`{c}`").cast("double")) for c in columns}
    parts = [f(x[c]).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("v", F.var_pop), ("n", F.count))]
    s = df.agg(F.count(F.lit(1)).alias("n"), *parts).first()
    out = {}
    for i, c in enumerate(columns):
        mean, var = s[f"m{i}"] or 0.0, (s[f"v{i}"] or 0.0) * s[f"n{i}"] / max(s["n"], 1)
        out[c] = (F.coalesce(x[c], F.lit(mean)) - F.lit(mean)) / F.lit((var + 1e-8) ** 0.5)
    return df.withColumns(out)


def drop_bad_targets(df: DataFrame, target: str) -> DataFrame:
    return df.filter(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double")) & (F.abs(F.col(target)) != float("inf")))


def zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / sqrt(population variance + 1e-8)."""
    s = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("v", F.var_pop))]).first()
    return df.withColumns({c: (F.col(c) - F.lit(s[f"m{i}"])) / F.lit((s[f"v{i}"] + 1e-8) ** 0.5) for i, c in enumerate(columns)})


def uniform(*key: Column, seed: int = 42) -> Column:
    """In [0, 1): 32 bits of an MD5 over seed and key; the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key])), 1, 8), 16, 10).cast("double") / float(1 << 32)


def normal(*key: Column, seed: int = 42) -> Column:
    """Standard normal draws from two uniform ones (of seed and seed + 1)."""
    return F.sqrt(-2.0 * F.ln(1.0 - uniform(*key, seed=seed))) * F.cos(2.0 * math.pi * uniform(*key, seed=seed + 1))


def bernoulli(p: float, *key: Column, seed: int = 42) -> Column:
    return uniform(*key, seed=seed) < p


def dropout(x: Column, p: float, *key: Column, seed: int = 42) -> Column:
    """Zero with probability p, otherwise x / (1 - p)."""
    return F.when(bernoulli(p, *key, seed=seed), 0.0).otherwise(x / (1.0 - p))


def permutation(df: DataFrame, key: str, seed: int = 42, out: str = "place") -> DataFrame:
    """Adds each row's place in a random order, by hash; found by ranges, no task orders the whole table."""
    from tabulon.operators.ordering import argsort

    return argsort(df.withColumn("__u", uniform(F.col(key), seed=seed)), "__u", key, out=out).drop("__u")


def exact_split(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """Adds in_train: exactly round(n * share) rows, chosen by hash.

    The cut value is found from counts of hash ranges; only the range that holds it is ordered."""
    ranges = max(4096, df.count() // 20_000)
    d = df.withColumn("__u", uniform(F.col(key), seed=seed)).withColumn("__r", F.floor(F.col("__u") * ranges))
    per = d.groupBy("__r").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    run = per.withColumn("upto", F.sum("n").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, 0))).withColumn("want", F.round(F.sum("n").over(Window.partitionBy()) * share))
    at = run.filter(F.col("upto") - F.col("n") < F.col("want")).agg(F.max(F.struct("__r", (F.col("want") - F.col("upto") + F.col("n")).alias("left"))).alias("x")).first()["x"]
    if at is None:
        return df.withColumn("in_train", F.lit(False))
    inside = F.row_number().over(Window.partitionBy("__r").orderBy("__u", key)) <= at["left"]
    edge = d.filter(F.col("__r") == at["__r"]).withColumn("in_train", inside)
    rest = d.filter(F.col("__r") != at["__r"]).withColumn("in_train", F.col("__r") < at["__r"])
    return rest.unionByName(edge).drop("__u", "__r")


def bin_edges_uniform(lo: Column, hi: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: lo + (hi - lo) * k / n)


def quantize(x: Column, edges: list[float]) -> Column:
    """Largest b with edge[b] <= x, clamped to the bins."""
    e = F.array(*[F.lit(float(v)) for v in edges])
    return F.least(F.greatest(F.size(F.filter(e, lambda v: v <= x)) - 1, F.lit(0)), F.lit(len(edges) - 2))


def ordered_target_stats(df: DataFrame, cat: str, target: str, order: list[str], prior: float, smoothing: float, out: str = "ts") -> DataFrame:
    """Adds (sum before + prior * smoothing) / (count before + smoothing) along the order within the category.

    Rows are dealt into ranges of the order; a category's sums of the ranges before are added to its running sums inside a range, so that a category of any
    size is spread over all tasks."""
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    per = dealt.groupBy(F.col(cat).alias("__cat"), F.col("__part").alias("__p")).agg(F.sum(target).alias("__s"), F.count(target).alias("__n"))
    before = Window.partitionBy("__cat").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("__cat", "__p", F.coalesce(F.sum("__s").over(before), F.lit(0.0)).alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n"))
    met = dealt.join(per, F.col(cat).eqNullSafe(F.col("__cat")) & (F.col("__part") == F.col("__p")))
    w = Window.partitionBy(cat, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total, count = F.col("__s") + F.coalesce(F.sum(target).over(w), F.lit(0.0)), F.col("__n") + F.count(target).over(w)
    return met.withColumn(out, (total + prior * smoothing) / (count + smoothing)).select(*[F.col(f"`{c}`") for c in df.columns if c != out], out)


def quantize_int(x: Column, scale: float, zero: int, low: int, high: int) -> Column:
    return F.least(F.greatest(F.round(x / scale) + zero, F.lit(float(low))), F.lit(float(high)))


def dequantize_int(q: Column, scale: float, zero: int) -> Column:
    return (q - zero) * scale


def fake_quantize(x: Column, scale: float, zero: int, low: int, high: int) -> Column:
    return dequantize_int(quantize_int(x, scale, zero, low, high), scale, zero)


def onehot_groups(columns: list[str]) -> dict[str, list[str]]:
    """Base name -> its one-hot columns (`base=value`), in order; a column alone is a group of one."""
    out: dict[str, list[str]] = {}
    for c in columns:
        base, mark, _ = c.partition("=")
        if mark:
            out.setdefault(base, []).append(c)
    return out


def token_columns(columns: list[str]) -> dict[str, list[str]]:
    """Base name -> its token columns (`base#t0`, `base#t1`, ...), in order of their number."""
    out: dict[str, list[tuple[int, str]]] = {}
    for c in columns:
        base, mark, k = c.rpartition("#t")
        if mark and k.isdigit():
            out.setdefault(base, []).append((int(k), c))
    return {b: [c for _, c in sorted(x)] for b, x in out.items()}


def collapse_onehot(df: DataFrame) -> DataFrame:
    """One-hot groups back to a column each: the number of the value that is set, counted on over the groups; without one it is 0. Other columns come first."""
    groups = onehot_groups(df.columns)
    members = {c for g in groups.values() for c in g}
    made, start = [], 0
    for base, cols in groups.items():
        hits = [F.when(F.col(f"`{c}`") > 0.5, F.lit(float(start + k))) for k, c in enumerate(cols)]
        made.append(F.coalesce(*hits, F.lit(0.0)).alias(base))
        start += len(cols)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in members], *made)


def token_vocabulary(df: DataFrame, x: str) -> DataFrame:
    """token, id: the distinct tokens of a text column, numbered from 1 in their order, by ranges."""
    from tabulon.operators.ordering import argsort

    v = df.select(F.explode(tokens(F.col(f"`{x}`"))).alias("token")).distinct()
    return argsort(v, "token", "token", out="id").select("token", (F.col("id") + 1).cast("int").alias("id"))


def text_ids(df: DataFrame, x: str, out: str, vocab: DataFrame | None = None, most: int = MAX_TOKENS) -> DataFrame:
    """Adds the ids of the first `most` tokens of a text column as an array; a token that the vocabulary lacks is 0.

    The vocabulary may be of any size: tokens are joined to it, not looked up in a literal."""
    vocab = token_vocabulary(df, x) if vocab is None else vocab
    rows = df.withColumn("__row", F.monotonically_increasing_id())
    rows = cut(rows)
    words = rows.select("__row", F.posexplode(F.slice(tokens(F.col(f"`{x}`")), 1, most)).alias("__k", "token"))
    ids = words.join(vocab, "token", "left").groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("__k", F.coalesce("id", F.lit(0)).alias("id")))).alias("__x"))
    found = rows.join(ids.select("__row", F.transform("__x", lambda z: z["id"]).alias("__ids")), "__row", "left")
    return found.withColumn(out, F.coalesce("__ids", F.array().cast("array<int>"))).drop("__row", "__ids")


def text_columns(df: DataFrame, x: str, vocab: DataFrame | None = None, most: int = MAX_TOKENS) -> tuple[DataFrame, list[str]]:
    """(df with the columns `x#t0`, `x#t1`, ... of token ids, padded with 0, instead of x; their names): as many as the longest text has tokens, at most `most`."""
    found = text_ids(df, x, "__text_ids", vocab, most)
    width = found.agg(F.max(F.size("__text_ids"))).first()[0] or 1
    names = [f"{x}#t{k}" for k in range(max(1, width))]
    return found.select(*[F.col(f"`{c}`") for c in df.columns if c != x], *[F.coalesce(F.get("__text_ids", F.lit(k)), F.lit(0)).cast("double").alias(n) for k, n in enumerate(names)]), names


def exclude(df: DataFrame, patterns: list[str]) -> DataFrame:
    """Drops columns by exact name, `group:*`, bare group, or bare column after a group."""
    def hit(name: str) -> bool:
        group, _, bare = name.rpartition(":")
        return any(p in (name, bare) or (group and p in (group, f"{group}:*")) for p in patterns)

    return df.select(*[F.col(f"`{c}`") for c in df.columns if not hit(c)])


def human_bytes(n: Column) -> Column:
    """1024-based size: KB and MB with one decimal, GB with two."""
    unit = lambda power, digits, name: F.concat(F.format_string(f"%.{digits}f", F.bround(n / float(1024**power), digits)), F.lit(name))
    return F.when(n >= 1024**3, unit(3, 2, " GB")).when(n >= 1024**2, unit(2, 1, " MB")).otherwise(unit(1, 1, " KB"))
