"""Row-wise normalisations and small layers as array expressions, windows and aggregates; larger layers are in tabulon.plans.model."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once a row: as the variable of a transform over an array of one. Written out instead, an
    expression inside the lambda of an outer transform is computed again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def _scaled(v: Column) -> Column:
    """Exponentials of what each element is above the largest; v must be bound."""
    return bound(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m)))


def softmax(v: Column) -> Column:
    return bound(v, lambda u: bound(_scaled(u), lambda e: bound(_sum(e), lambda total: F.transform(e, lambda x: x / total))))


def log_softmax(v: Column) -> Column:
    return bound(v, lambda u: bound(log_sum_exp(u), lambda l: F.transform(u, lambda x: x - l)))


def log_sum_exp(v: Column) -> Column:
    return bound(v, lambda u: bound(F.array_max(u), lambda m: m + F.ln(F.aggregate(u, F.lit(0.0), lambda a, x: a + F.exp(x - m)))))


def softmin(v: Column) -> Column:
    return softmax(F.transform(v, lambda x: -x))


def causal_softmax(v: Column, i: Column) -> Column:
    """Softmax over positions 0 ... i; later ones are 0."""
    head = softmax(F.slice(v, F.lit(1), i + 1))
    return F.concat(head, F.transform(F.slice(v, i + 2, F.size(v)), lambda x: F.lit(0.0)))


def _standard(u: Column, eps: float) -> Column:
    """(x - mean) / sqrt(variance + eps) over a bound array."""
    mean = lambda z: _sum(z) / F.size(z)
    spread = lambda m: F.sqrt(mean(F.transform(u, lambda x: (x - m) * (x - m))) + eps)
    return bound(mean(u), lambda m: bound(spread(m), lambda d: F.transform(u, lambda x: (x - m) / d)))


def layernorm(v: Column, eps: float = 1e-5) -> Column:
    return bound(v, lambda u: _standard(u, eps))


def groupnorm(v: Column, groups: int, eps: float = 1e-5) -> Column:
    """Layernorm of each of so many equal parts of the array, put together again."""
    width = lambda u: F.floor(F.size(u) / groups).cast("int")
    part = lambda u, k: bound(F.slice(u, k * width(u) + 1, width(u)), lambda w: _standard(w, eps))
    return bound(v, lambda u: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda k: part(u, k))))


def instancenorm(v: Column, eps: float = 1e-5) -> Column:
    """Every channel (an array in the array) by itself."""
    return F.transform(v, lambda c: layernorm(c, eps))


def inference_norm(x: Column, mean: Column, var: Column, gain: Column, shift: Column, eps: float = 1e-5) -> Column:
    """Batch normalisation with given statistics."""
    return (x - mean) / F.sqrt(var + eps) * gain + shift


def rmsnorm(v: Column, eps: float = 1e-5) -> Column:
    return bound(v, lambda u: bound(F.sqrt(_sum(F.transform(u, lambda x: x * x)) / F.size(u) + eps), lambda d: F.transform(u, lambda x: x / d)))


def l2_normalize(v: Column) -> Column:
    norm = lambda u: F.sqrt(F.aggregate(u, F.lit(0.0), lambda a, x: a + x * x))
    return bound(v, lambda u: bound(norm(u), lambda n: F.transform(u, lambda x: F.when(n > 0, x / n).otherwise(0.0))))


def cross_entropy(v: Column, label: Column) -> Column:
    return bound(v, lambda u: log_sum_exp(u) - F.get(u, label))


def cross_entropy_grad(v: Column, label: Column) -> Column:
    """Softmax minus the one-hot label."""
    return F.transform(softmax(v), lambda x, k: x - (k == label).cast("double"))


def batchnorm(df: DataFrame, feature: str, x: str, eps: float = 1e-5) -> DataFrame:
    """Normalises a long matrix per feature; the statistics are one row per feature."""
    s = df.groupBy(feature).agg(F.avg(x).alias("__m"), F.var_pop(x).alias("__v"))
    return df.join(s, feature).withColumn(x, (F.col(x) - F.col("__m")) / F.sqrt(F.col("__v") + eps)).drop("__m", "__v")


def pool_1d(df: DataFrame, row: str, pos: str, x: str, k: int) -> DataFrame:
    return df.groupBy(row, F.floor(F.col(pos) / k).cast("int").alias("p")).agg(F.avg(x).alias("avg"), F.max(x).alias("max"))


def conv_1d(df: DataFrame, row: str, pos: str, x: str, kernel: list[float]) -> DataFrame:
    """Valid cross-correlation (the kernel is not flipped) along each row."""
    w = Window.partitionBy(row).orderBy(pos)
    n = len(kernel)
    y = sum((F.lag(x, n - 1 - k).over(w) * c if k < n - 1 else F.col(x) * c for k, c in enumerate(kernel)), F.lit(0.0))
    return df.select(row, (F.col(pos) - (n - 1)).alias(pos), y.alias("y")).filter("y is not null")


def positional_encoding(spark: SparkSession, seq: int, dim: int, base: float = 10_000.0) -> DataFrame:
    """pos, i, v: sine at even, cosine at odd columns."""
    grid = spark.range(seq * dim).select(F.floor(F.col("id") / dim).alias("pos"), (F.col("id") % dim).alias("i"))
    angle = F.col("pos") / F.exp(math.log(base) * (F.col("i") - F.col("i") % 2) / dim)
    return grid.select("pos", "i", F.when(F.col("i") % 2 == 0, F.sin(angle)).otherwise(F.cos(angle)).alias("v"))


def entropy(logits: Column) -> Column:
    """Entropy of the softmax, in nats."""
    return -_sum(F.transform(softmax(logits), lambda p: F.when(p > 0, p * F.ln(p)).otherwise(0.0)))


def entropy_gated_step(logits: Column, token: Column, limit: float) -> tuple[Column, Column]:
    """(token, whether it stays open): a position whose entropy is under the limit takes its most likely token, any other keeps the one it has."""
    open_ = entropy(logits) >= limit
    best = bound(logits, lambda u: F.array_position(u, F.array_max(u)) - 1)
    return F.when(open_, token).otherwise(best), open_


def diffusion_sample(canvas: DataFrame, logits_of, limit: float, most: int, pos: str = "pos", token: str = "token") -> tuple[DataFrame, int]:
    """(pos, token; rounds): rounds of gated steps until no position is open or `most` are done. logits_of(canvas) gives pos, logits; settled positions
    keep their token and condition the others."""
    from tabulon.session import cut

    now, rounds = cut(canvas.select(pos, F.col(token).cast("long").alias(token), F.lit(True).alias("__open"))), 0
    while rounds < most and not now.filter("__open").isEmpty():
        rounds += 1
        met = now.join(logits_of(now.select(pos, token)).select(pos, "logits"), pos)
        new, again = entropy_gated_step(F.col("logits"), F.col(token), limit)
        now = cut(met.select(pos, F.when(F.col("__open"), new).otherwise(F.col(token)).cast("long").alias(token), (F.col("__open") & again).alias("__open")))
    return now.select(pos, token), rounds
