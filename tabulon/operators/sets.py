"""Set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unique(df: DataFrame, x: str) -> DataFrame:
    return df.select(x).distinct().orderBy(x)


def unique_counts(df: DataFrame, x: str) -> DataFrame:
    return df.groupBy(x).agg(F.count(F.lit(1)).alias("n"))


def unique_consecutive(df: DataFrame, by: list[str], order: list[str], x: str) -> DataFrame:
    """Rows that differ from the one before them in their group."""
    prev = F.lag(x).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__p", prev).filter(F.col("__p").isNull() | (F.col("__p") != F.col(x))).drop("__p")


def isin(df: DataFrame, key: str, other: DataFrame, other_key: str, out: str = "isin") -> DataFrame:
    """Membership mask: a left join with the distinct other side."""
    there = other.select(F.col(other_key).alias("__k")).distinct()
    return df.join(there, F.col(key) == F.col("__k"), "left").withColumn(out, F.col("__k").isNotNull()).drop("__k")


def algebra(a: DataFrame, b: DataFrame, only: str) -> DataFrame:
    """Rows of both, and rows of the first only, named in the column part."""
    return a.intersect(b).withColumn("part", F.lit("both")).unionByName(a.subtract(b).withColumn("part", F.lit(only)))
