"""Sorting, top-k and searching with explicit order keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], k: int, tie: list[str] = ()) -> DataFrame:
    """The k largest rows, largest first; each task keeps k rows only."""
    return df.orderBy(*[F.desc(c) for c in by], *tie).limit(k)


def argsort(df: DataFrame, x: str, tie: str, by: list[str] | None = None, out: str = "place") -> DataFrame:
    """0-based place of each row in ascending order of x.

    Within groups by a window. Over the whole table by range: rows are dealt into sorted ranges, counted, and numbered within their range
    with the count of the ranges before it added, so that no task sees the whole table."""
    if by:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(x, tie)).cast("long") - 1)
    from tabulon.session import cut

    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(df.repartitionByRange(parts, x, tie).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # One row for each range, at most as many as there are partitions.
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(x, tie)) - 1
    return dealt.join(before, "__part").withColumn(out, inside + F.col("__before")).drop("__part", "__before")


#: Values that the driver takes to end a search for order statistics.
FEW = 50_000


def order_statistics(df: DataFrame, x: str, ranks: list[int]) -> dict[int, float | None]:
    """The values at 0-based ranks in ascending order of x (nulls left out); None beyond the last.

    Each round brackets every rank between two approximate quantiles, counts exactly what lies below the bracket, and goes on inside it; when at most FEW
    values are left they are sorted by the driver. No task or buffer sees more than its share."""
    rows = df.select(F.col(x).alias("x")).filter("x is not null")
    n = rows.count()
    out = {r: None for r in ranks}
    todo = sorted({r for r in ranks if 0 <= r < n})
    if n <= FEW:
        values = sorted(v[0] for v in rows.collect()) if todo else []
        return out | {r: values[r] for r in todo}
    spread = 0.002
    at = sorted({0.0, 1.0, *(min(1.0, max(0.0, (r + 0.5) / n + d)) for r in todo for d in (-spread, spread))})
    marks = rows.agg(F.percentile_approx("x", at, 10_000).alias("q")).first()["q"]
    counts = rows.agg(*[F.count_if(F.col("x") < v).alias(f"lt{i}") for i, v in enumerate(marks)], *[F.count_if(F.col("x") <= v).alias(f"le{i}") for i, v in enumerate(marks)]).first()
    below = {v: (counts[f"lt{i}"], counts[f"le{i}"]) for i, v in enumerate(marks)}
    groups: dict[tuple, list[int]] = {}
    for r in todo:
        hit = next((v for v, (a, b) in below.items() if a <= r < b), None)
        if hit is not None:
            out[r] = hit
            continue
        # The marks are approximate, their counts exact; between the least and the largest value every round leaves less.
        lows = [v for v, (_, b) in below.items() if b <= r]
        highs = [v for v, (a, _) in below.items() if a > r]
        groups.setdefault((max(lows, default=None), min(highs, default=None)), []).append(r)
    for (low, high), some in groups.items():
        part = rows if low is None else rows.filter(F.col("x") > low)
        part = part if high is None else part.filter(F.col("x") < high)
        start = below[low][1] if low is not None else 0
        got = order_statistics(part, "x", [r - start for r in some])
        out |= {r: got[r - start] for r in some}
    return out


def quantiles(df: DataFrame, x: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles, interpolated between neighbours; NULLs are left out."""
    n = df.select(x).filter(F.col(x).isNotNull()).count()
    at = [s * (n - 1) for s in shares]
    ranks = sorted({r for p in at for r in (int(p), min(int(p) + 1, n - 1))}) if n else []
    v = order_statistics(df, x, ranks)
    out = []
    for p in at:
        low, high = (v[int(p)], v[min(int(p) + 1, n - 1)]) if n else (None, None)
        out.append(None if low is None else float(low) + (p - int(p)) * (float(high) - float(low)))
    return out


def kth_smallest(df: DataFrame, x: str, k: int) -> Column:
    """The k-th smallest value (1-based) as a literal; NULL if there are fewer."""
    return F.lit(order_statistics(df, x, [k - 1])[k - 1]).cast(dict(df.dtypes)[x])


def sort_by_key(df: DataFrame, key: str, tie: str, values: list[str], out: str = "place") -> DataFrame:
    """place, key and values in ascending order of the key (ties by tie)."""
    return argsort(df, key, tie, out=out).select(out, key, *values)


def find_n(df: DataFrame, pos: str, condition: Column, n: int) -> DataFrame:
    """The first n positions at which the condition holds."""
    return df.filter(condition).select(pos).orderBy(pos).limit(n)


def nonzero(df: DataFrame, pos: str, x: str) -> DataFrame:
    """The positions of the values that are not zero (NaN is none)."""
    return df.filter(F.col(x) != 0).select(pos)


def masked_select(df: DataFrame, mask: Column) -> DataFrame:
    """The rows whose mask is neither zero nor NULL."""
    return df.filter(mask.cast("double") != 0)


def argmax_abs(df: DataFrame, x: str, pos: str) -> DataFrame:
    """The first position of the largest magnitude."""
    return df.agg(F.min(F.struct(-F.abs(F.col(x)), F.col(pos).alias("p")))["p"].alias("argmax_abs"))


def extremes(df: DataFrame, x: str, pos: str, pivot: float, find: Column) -> DataFrame:
    """argmax, argmin (ties: smallest pos), the first pos with x >= pivot, and the first pos where find holds: one pass."""
    return df.agg(
        F.min(F.struct(-F.col(x), F.col(pos).alias("p")))["p"].alias("argmax"),
        F.min(F.struct(F.col(x), F.col(pos).alias("p")))["p"].alias("argmin"),
        F.min(F.when(F.col(x) >= pivot, F.col(pos))).alias("partition_point"),
        F.min(F.when(find, F.col(pos))).alias("found"),
    )


def searchsorted(edges: Column, x: Column, side: str = "left") -> Column:
    """Where x belongs among sorted edges (an array column)."""
    return F.size(F.filter(edges, (lambda e: e < x) if side == "left" else (lambda e: e <= x)))


def sortedness(df: DataFrame, by: list[str], order: list[str], x: str, other: Column) -> DataFrame:
    """Per group: is_sorted, the first index that breaks the order, the first index where x differs from other, and the number of non-zeros."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.select(*by, F.col(x).alias("x"), other.alias("o"), F.lag(x).over(w).alias("p"), (F.row_number().over(w) - 1).cast("long").alias("k"))
    return rows.groupBy(*by).agg(
        F.bool_and(F.coalesce(F.col("x") >= F.col("p"), F.lit(True))).alias("is_sorted"),
        F.min(F.when(F.col("x") < F.col("p"), F.col("k"))).alias("sorted_until"),
        F.min(F.when(F.col("x") != F.col("o"), F.col("k"))).alias("mismatch"),
        F.count_if(F.col("x") != 0).alias("nonzero"),
    )


def top_k_per_row(df: DataFrame, row: str, dist: str, col: str, k: int) -> DataFrame:
    """Per row the k nearest columns, ascending by distance; ties by column."""
    place = F.row_number().over(Window.partitionBy(row).orderBy(dist, col))
    return df.withColumn("place", place).filter(F.col("place") <= k)
