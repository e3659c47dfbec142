"""Model metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mse(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def ss_res(p: Column, y: Column) -> Column:
    return F.sum((y - p) * (y - p))


def r2(p: Column, y: Column) -> Column:
    return 1 - ss_res(p, y) / (F.var_pop(y) * F.count(y))


def accuracy(p: Column, y: Column) -> Column:
    return F.avg(((p >= 0.5) == (y >= 0.5)).cast("double"))


def argmax(v: Column) -> Column:
    """0-based first index of the largest element of an array."""
    return F.array_position(v, F.array_max(v)) - 1


def argmax_accuracy(p: Column, y: Column) -> Column:
    return F.avg((argmax(p) == argmax(y)).cast("double"))


def balanced_accuracy(df: DataFrame, y: str, p: str) -> DataFrame:
    """Mean over classes of the recall."""
    per = df.groupBy(y).agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("recall"))
    return per.agg(F.avg("recall").alias("balanced_accuracy"))
