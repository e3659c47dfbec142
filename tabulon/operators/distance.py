"""Distances between array columns, and all-pairs search of a query set in blocks."""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
#: Queries and train rows of one group of block_pairs: a million pairs at a time.
GROUP_QUERIES, GROUP_TRAIN = 512, 2048


def _fold(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a, b):
    return _fold(a, b, lambda x, y: (x - y) * (x - y))


def l1(a, b):
    return _fold(a, b, lambda x, y: F.abs(x - y))


def dot(a, b):
    return _fold(a, b, lambda x, y: x * y)


def cosine(a, b):
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def chebyshev(a, b):
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def minkowski(a, b, p: float = 3.0):
    return F.pow(_fold(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p))), F.lit(1.0 / p))


def canberra(a, b):
    return _fold(a, b, lambda x, y: F.when(F.abs(x) + F.abs(y) > 0, F.abs(x - y) / (F.abs(x) + F.abs(y))).otherwise(0.0))


def braycurtis(a, b):
    low = _fold(a, b, lambda x, y: F.abs(x + y))
    return F.when(low > 0, l1(a, b) / low).otherwise(0.0)


def hamming(a, b):
    return _fold(a, b, lambda x, y: (x != y).cast("double")) / F.size(a)


METRICS = {"l2": squared_l2, "l1": l1, "cosine": cosine, "chebyshev": chebyshev, "minkowski": minkowski, "canberra": canberra, "braycurtis": braycurtis, "hamming": hamming}


def _salts(train: DataFrame) -> int:
    """Parts that the train rows are dealt to: one for 50,000 of them, 16 at least."""
    return max(16, train.count() // 50_000)


def query_pairs(queries: DataFrame, train: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every query (q, qv) with every train row (t, tv), by an equi-join on query blocks.

    Train rows are repeated once per block of queries and spread by a salt, so the join has blocks x salts keys and no side is broadcast by assumption."""
    n = max(1, math.ceil(queries.count() / block))
    salts = _salts(train)
    q = queries.withColumn("__b", F.pmod(F.xxhash64("q"), F.lit(n))).withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    t = train.withColumn("__s", F.pmod(F.xxhash64("t"), F.lit(salts)).cast("int")).withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return q.join(t, ["__b", "__s"]).drop("__b", "__s")


def _folded(q: np.ndarray, t: np.ndarray, *terms) -> list[np.ndarray]:
    """For each term the matrix of its sums over the dimensions, from the first to the last, as the columns above add them."""
    out = [np.zeros((len(q), len(t))) for _ in terms]
    columns = np.ascontiguousarray(t.T)
    for a in range(0, len(q), 8):  # a strip stays in the processor's cache
        for k, y in enumerate(columns):
            x = q[a : a + 8, k, None]
            for made, term in zip(out, terms):
                made[a : a + 8] += term(x, y)
    return out


def _product(x, y):
    return x * y


def _square(x, y):
    d = x - y
    return d * d


def _cube(x, y):
    d = np.abs(x - y)
    return d * d * d


def _difference(x, y):
    return np.abs(x - y)


def _sum(x, y):
    return np.abs(x + y)


def _ratio(x, y):
    size = np.abs(x) + np.abs(y)
    # NaN is no zero.
    return np.where(size == 0, 0.0, np.abs(x - y) / size)


def _cosine(q, t):
    length = [np.sqrt(sum((v[:, k] * v[:, k] for k in range(v.shape[1])), np.zeros(len(v)))) for v in (q, t)]
    return {"d": _folded(q, t, _product)[0] / (length[0][:, None] * length[1])}


def _minkowski(q, t):
    return {"d": np.power(_folded(q, t, _cube)[0], 1.0 / 3.0)}


def _canberra(q, t):
    return {"d": _folded(q, t, _ratio)[0]}


def _braycurtis(q, t):
    high, low = _folded(q, t, _difference, _sum)
    return {"d": np.where(low == 0, 0.0, high / low)}


def kernels(q, t):
    square, s = _folded(q, t, _square, _product)
    return {"rbf": np.exp(-0.5 * square), "linear": s, "poly": (s + 1) * (s + 1), "sig": np.tanh(0.1 * s)}


#: Metrics over whole blocks, with the values of the columns of the same name.
BLOCK_METRICS = {"braycurtis": _braycurtis, "canberra": _canberra, "cosine": _cosine, "minkowski": _minkowski}


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark's round: halves of the shortest decimal form go away from zero."""
    size = np.abs(x) * 10.0**digits
    whole = np.floor(size + 0.5)
    out = np.copysign(whole / 10.0**digits, x) + 0.0
    # The product is off by a rounding; so close to a half, the decimal form decides.
    for at in np.flatnonzero(np.isfinite(x) & ~(np.abs(size - np.floor(size) - 0.5) > 1e-7 + size * 1e-15)):
        v = float(x.flat[at])
        out.flat[at] = float(Decimal(repr(v)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) + 0.0 if abs(v) < 1e15 else v
    return out


def block_pairs(queries: DataFrame, train: DataFrame, made: Callable, digits: dict[str, int]) -> DataFrame:
    """q, t and the rounded values that made(query matrix, train matrix) gives, of every query (q, qv) with every train row (t, tv).

    Both sides are dealt to groups of bounded size, which meet as matrices. All vectors must have the same length and no nulls."""
    n, m = max(1, -(-queries.count() // GROUP_QUERIES)), max(1, -(-train.count() // GROUP_TRAIN))
    group = (F.col("__a") * m + F.col("__z")).alias("__g")
    q = queries.withColumn("__a", F.pmod(F.xxhash64("q"), F.lit(n))).withColumn("__z", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).select(group, "q", "qv")
    t = train.withColumn("__z", F.pmod(F.xxhash64("t"), F.lit(m))).withColumn("__a", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(group, "t", "tv")
    names = list(digits)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left["q"].combine_chunks(), right["t"].combine_chunks()
        got = {}
        if left.num_rows and right.num_rows:
            a, b = (v.combine_chunks().flatten().to_numpy().reshape(len(i), -1) for v, i in zip((left["qv"], right["tv"]), ids))
            with np.errstate(all="ignore"):
                got = made(a, b)
                got = {k: rounded(got[k], digits[k]).ravel() for k in names}
        columns = [ids[0].take(pa.array(np.repeat(np.arange(left.num_rows), right.num_rows))), ids[1].take(pa.array(np.tile(np.arange(right.num_rows), left.num_rows)))]
        return pa.table([*columns, *[pa.array(got.get(k, np.empty(0)), pa.float64()) for k in names]], names=["q", "t", *names])

    # A given number of partitions: by the size of their input, adaptive execution would gather all groups in a few tasks.
    parts = min(n * m, 2000)
    kinds = {"q": q.schema["q"].dataType, "t": t.schema["t"].dataType}
    schema = ", ".join([f"{k} {v.simpleString()}" for k, v in kinds.items()] + [f"{k} double" for k in names])
    return q.repartition(parts, "__g").groupBy("__g").cogroup(t.repartition(parts, "__g").groupBy("__g")).applyInArrow(meet, schema)


def all_pairs(queries: DataFrame, train: DataFrame, made: Callable, columns: dict[str, Column], digits: dict[str, int]) -> DataFrame:
    """block_pairs() of the vectors of the commonest length that hold no nulls; pairs with other vectors are joined and get their values from columns (of qv and tv)."""
    size = lambda v: F.when(F.forall(v, lambda x: x.isNotNull()), F.size(v))
    kinds = {r["n"]: r["count"] for r in train.groupBy(size("tv").alias("n")).count().orderBy(F.desc("count"), "n").limit(3).collect()}
    usual = max((n for n in kinds if n), key=kinds.get, default=None)
    if usual is None:
        return query_pairs(queries, train).select("q", "t", *[F.round(c, digits[k]).alias(k) for k, c in columns.items()])
    fits = lambda v: F.coalesce(size(v) == usual, F.lit(False))
    plain_q, plain_t = queries.filter(fits("qv")), train.filter(fits("tv"))
    out = block_pairs(plain_q, plain_t, made, digits)
    odd_q, odd_t = queries.filter(~fits("qv")), train.filter(~fits("tv"))
    rest = [(odd_q, train)] * (not odd_q.isEmpty()) + [(plain_q, odd_t)] * (len(kinds) > 1)
    for q, t in rest:
        out = out.unionByName(query_pairs(q, t).select("q", "t", *[F.round(c, digits[k]).alias(k) for k, c in columns.items()]))
    return out


def nearest(queries: DataFrame, train: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """q, t, distance, place of the k nearest train rows of each query, itself excluded; ties by id.

    The k best are kept per query and salt before they meet, so a query's candidates in one task are bounded by salts x k."""
    d = query_pairs(queries, train).filter(F.col("q") != F.col("t")).select("q", "t", METRICS[metric](F.col("qv"), F.col("tv")).alias("distance"))
    order = lambda *key: F.row_number().over(Window.partitionBy(*key).orderBy("distance", "t"))
    d = d.withColumn("__s", F.pmod(F.xxhash64("t"), F.lit(_salts(train))))
    d = d.withColumn("__p", order("q", "__s")).filter(F.col("__p") <= k).drop("__p", "__s")
    return d.withColumn("place", order("q")).filter(F.col("place") <= k)


def within_radius(queries: DataFrame, train: DataFrame, eps: float) -> DataFrame:
    """q, t of all pairs at distance at most eps (itself included)."""
    return query_pairs(queries, train).filter(squared_l2(F.col("qv"), F.col("tv")) <= eps * eps).select("q", "t")


def core_distance(queries: DataFrame, train: DataFrame, min_pts: int) -> DataFrame:
    """Distance to the min_pts-th nearest neighbour, itself excluded."""
    return nearest(queries, train, min_pts).filter(F.col("place") == min_pts).select("q", F.sqrt("distance").alias("core_distance"))
