"""Indexing and shape operators on matrices in long form (i, j, v), on rows with a position, and on array columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gather(idx: DataFrame, key: str, source: DataFrame, id_col: str) -> DataFrame:
    """idx with the source row of each index; an unknown index gives NULLs. Spark picks the join by measured size."""
    return idx.join(source.withColumnRenamed(id_col, "__id"), F.col(key) == F.col("__id"), "left").drop("__id")


def scatter_add(base: DataFrame, id_col: str, value: str, src: DataFrame, key: str, add: str) -> DataFrame:
    """base with value += the sum of src's add by key; repeated keys accumulate."""
    sums = src.groupBy(F.col(key).alias("__k")).agg(F.sum(add).alias("__s"))
    return base.join(sums, F.col(id_col) == F.col("__k"), "left").withColumn(value, F.col(value) + F.coalesce("__s", F.lit(0.0))).drop("__k", "__s")


def embedding_bag(bags: DataFrame, bag: str, key: str, source: DataFrame, id_col: str, value: str) -> DataFrame:
    got = gather(bags, key, source, id_col)
    return got.groupBy(bag).agg(F.sum(value).alias("bag_sum"), F.avg(value).alias("bag_mean"))


def slice_rows(df: DataFrame, pos: str, start: int, count: int) -> DataFrame:
    return df.filter(F.col(pos).between(start, start + count - 1))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def flip_rows(m: DataFrame, rows: int) -> DataFrame:
    return m.withColumn("i", rows - 1 - F.col("i"))


def roll(m: DataFrame, axis: str, shift: int, n: int) -> DataFrame:
    return m.withColumn(axis, F.pmod(F.col(axis) + shift, F.lit(n)))


def triangle(m: DataFrame, k: int = 0, upper: bool = True) -> DataFrame:
    keep = F.col("j") >= F.col("i") + k if upper else F.col("j") <= F.col("i") + k
    return m.withColumn("v", F.when(keep, F.col("v")).otherwise(0.0))


def diagonal(m: DataFrame, k: int = 0) -> DataFrame:
    return m.filter(F.col("j") == F.col("i") + k)


def add_diagonal(m: DataFrame, value: float) -> DataFrame:
    return m.withColumn("v", F.when(F.col("i") == F.col("j"), F.col("v") + value).otherwise(F.col("v")))


def repeat_rows(df: DataFrame, pos: str, times: int) -> DataFrame:
    """Each row `times` times in place: the copy's position is times * pos + copy."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("__c")).withColumn(pos, times * F.col(pos) + F.col("__c")).drop("__c")


def tile_rows(df: DataFrame, pos: str, n: int, times: int) -> DataFrame:
    """The whole block `times` times."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("__c")).withColumn(pos, F.col(pos) + n * F.col("__c")).drop("__c")


def pad_index(i: Column, n: int, rule: str) -> Column:
    """Source index of position i (which may lie outside 0 ... n-1) under an edge rule."""
    if rule == "replicate":
        return F.least(F.greatest(i, F.lit(0)), F.lit(n - 1))
    if rule == "circular":
        return F.pmod(i, F.lit(n))
    period = 2 * (n - 1)  # reflect, the edge is not repeated
    m = F.pmod(i, F.lit(period))
    return F.least(m, period - m)


def pad(df: DataFrame, by: list[str], pos: str, value: str, n: int, left: int, right: int, rule: str, fill: float = 0.0) -> DataFrame:
    """Rows -left ... n-1+right of each group, shifted to start at 0."""
    rows = df.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(F.col(pos).cast("int"), value))).alias("__m"))
    grid = rows.select(*by, "__m", F.explode(F.sequence(F.lit(-left), F.lit(n - 1 + right))).alias("__i"))
    if rule == "constant":
        got = F.coalesce(F.try_element_at("__m", F.col("__i")), F.lit(fill))
    else:
        got = F.try_element_at("__m", pad_index(F.col("__i"), n, rule).cast("int"))
    return grid.select(*by, (F.col("__i") + left).alias(pos), got.alias(value))


def take_along(src: Column, idx: Column) -> Column:
    return F.transform(idx, lambda j: F.get(src, j))


def array_ops(v: Column, shift: int = 2) -> dict[str, Column]:
    """Per-row array operators: slice, flip, roll (the last `shift` elements come first), concatenation with itself."""
    k = F.pmod(F.lit(shift), F.greatest(F.size(v), F.lit(1)))
    return {"lead": F.slice(v, 1, 3), "flip": F.reverse(v), "rolled": F.concat(F.slice(v, F.size(v) - k + 1, k), F.slice(v, F.lit(1), F.size(v) - k)), "twice": F.concat(v, v)}


def concat_columns(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """Two matrices side by side; `width` is the number of columns of the first."""
    return a.unionByName(b.withColumn("j", F.col("j") + width))


def concat_rows(a: DataFrame, b: DataFrame, height: int) -> DataFrame:
    """Two matrices one above the other; `height` is the number of rows of the first."""
    return a.unionByName(b.withColumn("i", F.col("i") + height))


def slice_columns(m: DataFrame, start: int, count: int) -> DataFrame:
    """Columns start ... start + count - 1, numbered from 0."""
    return m.filter(F.col("j").between(start, start + count - 1)).withColumn("j", F.col("j") - start)


def broadcast(m: DataFrame, vector: DataFrame, axis: str, op: str) -> DataFrame:
    """m with its value combined with vector(axis, w) along an axis: add, sub, mul or div."""
    from tabulon.functions.guards import ieee_div

    made = {"add": F.col("v") + F.col("w"), "sub": F.col("v") - F.col("w"), "mul": F.col("v") * F.col("w"), "div": ieee_div(F.col("v"), F.col("w"))}[op]
    return m.join(vector.select(axis, "w"), axis).select("i", "j", made.alias("v"))


def outer(x: DataFrame, y: DataFrame, blocks: int = 64) -> DataFrame:
    """i, j, v = x_i * y_j of x(i, v) and y(j, w): y is dealt to blocks and each row of x meets every block once."""
    right = y.withColumn("__b", F.pmod(F.xxhash64("j"), F.lit(blocks)))
    left = x.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return left.join(right, "__b").select("i", "j", (F.col("v") * F.col("w")).alias("v"))


def outer_rounded(x: DataFrame, y: DataFrame, digits: int, plus: float = 0.0) -> DataFrame:
    """outer() with v = round(x_i * y_j + plus, digits), in blocks of the matrix.

    Rounded as SQL engines do it: the product with a power of ten goes to the nearest whole number, halves away from zero. Among millions of cells some lie so close
    to a half that Spark's rounding, which goes by the decimal form, gives the other neighbour."""
    from tabulon.operators.distance import all_pairs

    def made(a, b):
        v = a * b.T + plus
        return {"v": np.copysign(np.floor(np.abs(v) * 10.0**digits + 0.5) / 10.0**digits, v)}

    q, t = x.select(F.col("i").alias("q"), F.array(F.col("v").cast("double")).alias("qv")), y.select(F.col("j").alias("t"), F.array(F.col("w").cast("double")).alias("tv"))
    cells = all_pairs(q, t, made, {"v": F.get("qv", F.lit(0)) * F.get("tv", F.lit(0)) + plus}, {"v": digits})
    return cells.select(F.col("q").alias("i"), F.col("t").alias("j"), "v")


def matrix(spark, rows: int, columns: int, value: Column) -> DataFrame:
    """i, j, v for all cells; value is an expression of i and j. Eye is i = j, tri is j <= i + k, fill is a literal."""
    grid = spark.range(rows * columns).select(F.floor(F.col("id") / columns).cast("long").alias("i"), (F.col("id") % columns).alias("j"))
    return grid.withColumn("v", value.cast("double"))


def eye(spark, rows: int, columns: int | None = None) -> DataFrame:
    return matrix(spark, rows, columns or rows, (F.col("i") == F.col("j")).cast("double"))


def tri(spark, rows: int, columns: int, k: int = 0) -> DataFrame:
    return matrix(spark, rows, columns, (F.col("j") <= F.col("i") + k).cast("double"))


def fill(spark, rows: int, columns: int, value: float) -> DataFrame:
    return matrix(spark, rows, columns, F.lit(value))


def arange(spark, n: int, start: float = 0.0, step: float = 1.0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), (F.lit(start) + step * F.col("id")).alias("v"))


def linspace(spark, start: float, stop: float, n: int) -> DataFrame:
    """n values from start to stop, both included; one value is the start."""
    return spark.range(n).select(F.col("id").alias("i"), (F.lit(float(start)) + (stop - start) * F.col("id") / max(n - 1, 1)).alias("v"))


def logspace(spark, start: float, stop: float, n: int, base: float = 10.0) -> DataFrame:
    return linspace(spark, start, stop, n).withColumn("v", F.pow(F.lit(float(base)), F.col("v")))


def geomspace(spark, start: float, stop: float, n: int) -> DataFrame:
    """n values from start to stop in equal ratios."""
    return spark.range(n).select(F.col("id").alias("i"), (start * F.pow(F.lit(stop / start), F.col("id") / max(n - 1, 1))).alias("v"))
