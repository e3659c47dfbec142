"""Reductions: plain aggregates, pre-aggregated map-side by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def basic(x: Column) -> dict[str, Column]:
    """The single-pass reductions of one column. Infinite or missing values follow SQL: NULL is skipped."""
    return {
        "sum": F.sum(x),
        "mean": F.avg(x),
        "min": F.min(x),
        "max": F.max(x),
        "l2_norm": F.sqrt(F.sum(x * x)),
        "asum": F.sum(F.abs(x)),
        "mean_abs": F.avg(F.abs(x)),
        "sumsq": F.sum(x * x),
        "ptp": F.max(x) - F.min(x),
        "count_nonzero": F.count_if(x != 0),
        "any_nonzero": F.bool_or(x != 0),
        "all_nonzero": F.bool_and(x != 0),
        "has_nan": F.bool_or(F.isnan(x)),
        "all_finite": F.bool_and(~F.isnan(x) & (F.abs(x) != float("inf"))),
        "nansum": F.sum(F.nanvl(x, F.lit(0.0))),
    }


def moments(x: Column) -> dict[str, Column]:
    return {"var_pop": F.var_pop(x), "var_samp": F.var_samp(x), "std_pop": F.stddev_pop(x), "std_samp": F.stddev_samp(x), "sumsqdev": F.var_pop(x) * F.count(x)}


def logsumexp(df: DataFrame, x: str, by: list[str] | None = None) -> DataFrame:
    """max + ln(sum(exp(x - max))). Two scans: the maxima, one row a group, which are found first and joined, and the sums; both pre-aggregated."""
    by = by or []
    top = df.groupBy(*by).agg(F.max(x).alias("__m"))
    joined = df.join(top, by) if by else df.withColumn("__m", top.scalar())
    return joined.groupBy(*by, "__m").agg((F.log(F.sum(F.exp(F.col(x) - F.col("__m")))) + F.col("__m")).alias("logsumexp")).drop("__m")


def segment(df: DataFrame, seg: str, x: str, n_segments: int | None = None) -> DataFrame:
    """Sum and max by segment id; with n_segments the ids are dense and empty ones give 0 and the smallest double."""
    per = df.groupBy(F.col(seg).cast("long").alias("segment")).agg(F.sum(x).alias("segment_sum"), F.max(x).alias("segment_max"))
    if n_segments is None:
        return per
    ids = df.sparkSession.range(n_segments).withColumnRenamed("id", "segment")
    return ids.join(per, "segment", "left").select("segment", F.coalesce("segment_sum", F.lit(0.0)).alias("segment_sum"), F.coalesce("segment_max", F.lit(-1.7976931348623157e308)).alias("segment_max"))


def histogram(df: DataFrame, x: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Equal-width counts on [lo, hi]; the right edge is closed, values outside are dropped, empty bins are 0."""
    w = (hi - lo) / bins
    inside = df.filter(F.col(x).between(lo, hi)).select(F.least(F.floor((F.col(x) - lo) / w), F.lit(bins - 1)).cast("long").alias("bin"))
    return _dense(inside, "bin", bins)


def bincount(df: DataFrame, label: str, n: int) -> DataFrame:
    """Counts of the labels 0 ... n-1; others are dropped."""
    return _dense(df.select(F.col(label).cast("long").alias("bin")).filter(F.col("bin").between(0, n - 1)), "bin", n)


def _dense(df: DataFrame, key: str, n: int) -> DataFrame:
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    ids = df.sparkSession.range(n).withColumnRenamed("id", key)
    return ids.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def clip_by_norm(df: DataFrame, x: str, max_norm: float) -> DataFrame:
    """Scales x so that its L2 norm over all rows is at most max_norm."""
    norm = df.agg(F.sqrt(F.sum(F.col(x) * F.col(x))).alias("n")).scalar()
    return df.withColumn(x, F.col(x) * F.least(F.lit(1.0), F.lit(max_norm) / norm))
