"""Connected components of a graph given as edges, in logarithmically many rounds of joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.session import cut

#: Edges that one task joins.
_EDGES = 1 << 20


def forest(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """src, dst: fewer edges with the same components, for graphs with many more edges than nodes. Tasks of about _EDGES edges each link every node to the
    smallest one that the task's edges reach, so a task gives fewer edges than it has nodes. Null ends and self-loops link nothing."""
    e = cut(edges.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")).filter("src <> dst"))

    def run(batches):
        parts = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.concat_tables(parts)
        nodes, ends = np.unique(np.concatenate([t.column("src").to_numpy(), t.column("dst").to_numpy()]), return_inverse=True)
        a, b = ends[: t.num_rows], ends[t.num_rows :]
        low = np.arange(len(nodes))
        while True:
            x, y = low[a], low[b]
            open_ = x != y
            if not open_.any():
                break
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
            while (low != low[low]).any():
                low = low[low]
        more = np.flatnonzero(low != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[more]), pa.array(nodes[low[more]])], names=["src", "dst"])

    return e.repartition(1 + e.count() // _EDGES).mapInArrow(run, "src long, dst long")


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component: the smallest node that each node of edges reaches.

    Alternates large-star and small-star steps (every node hands its larger, then its smaller neighbours the smallest node it
    knows) until nothing changes. Minima are pre-aggregated map-side before they meet, edges never gather in one row, and
    each round is written to the shared checkpoint folder. Null ends and self-loops link nothing; no edges give no rows."""
    e = cut(edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u > v").distinct())

    def large_star(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def small_star(e: DataFrame) -> DataFrame:
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        down = e.join(low, "u")
        return down.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()

    def mark(e: DataFrame):
        r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    seen = mark(e)
    while seen[0]:
        e = cut(small_star(large_star(e)))
        now = mark(e)
        if now == seen:
            break
        seen = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
