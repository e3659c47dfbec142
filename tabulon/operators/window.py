"""Running operators along an explicit order within groups; rows of a group are sorted once, by Spark's window operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tabulon.session import cut

FIRST, NOW = Window.unboundedPreceding, Window.currentRow


def along(by: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def running(x: Column, w: WindowSpec) -> dict[str, Column]:
    upto, before = w.rowsBetween(FIRST, NOW), w.rowsBetween(FIRST, -1)
    return {
        "cumsum": F.sum(x).over(upto),
        "excl_sum": F.coalesce(F.sum(x).over(before), F.lit(0.0)),
        "cumprod": F.product(x).over(upto),
        "excl_prod": F.coalesce(F.product(x).over(before), F.lit(1.0)),
        "cummax": F.max(x).over(upto),
        "cummin": F.min(x).over(upto),
    }


def log_cumsum_exp(df: DataFrame, by: list[str], order: list[str], x: str, out: str = "logcumsumexp") -> DataFrame:
    """Running log-sum-exp, shifted by the running maximum of its own group so that nothing overflows."""
    w = along(by, order)
    whole = Window.partitionBy(*by)
    shifted = F.exp(F.col(x) - F.max(x).over(whole))
    return df.withColumn(out, F.log(F.sum(shifted).over(w.rowsBetween(FIRST, NOW))) + F.max(x).over(whole))


#: Rows of a group that are folded together.
BLOCK = 128


def _same(by: list[str]) -> Column:
    """Null-safe equality of the key columns, which on the right carry a trailing underscore."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in by], F.lit(True))


def recurrence(df: DataFrame, by: list[str], order: list[str], a: str, b: str, out: str = "h") -> DataFrame:
    """h_t = a_t * h_(t-1) + b_t with h_(-1) = 0 along each group. Returns by, order and h.

    Rows are numbered along their group and folded in blocks of BLOCK. A block maps what comes in to factor * h + rest, so the ends of the blocks are a recurrence of the
    same kind, BLOCK times shorter, which is solved likewise; time is linear in the rows, and no task holds more than a block."""
    k = F.row_number().over(along(by, order)) - 1
    rows = df.select(*by, *order, F.col(a).cast("double").alias("__a"), F.col(b).cast("double").alias("__b"), k.cast("long").alias("__k"))
    return _folded(rows, by, order).withColumnRenamed("__h", out)


def _folded(rows: DataFrame, by: list[str], more: list[str]) -> DataFrame:
    kept = F.struct("__k", *[c for c in more if c != "__k"], "__a", "__b")
    blocks = rows.groupBy(*by, F.floor(F.col("__k") / BLOCK).alias("__block")).agg(F.sort_array(F.collect_list(kept)).alias("__r"))
    step = lambda acc, x: F.struct((x["__a"] * acc["f"]).alias("f"), (x["__a"] * acc["h"] + x["__b"]).alias("h"))
    start = F.array(F.struct(F.lit(1.0).alias("f"), F.lit(0.0).alias("h")))
    run = F.aggregate("__r", start, lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))
    blocks = cut(blocks.withColumn("__f", F.slice(run, 2, F.size("__r"))))
    carried = blocks.withColumn("__in", F.lit(0.0))
    if blocks.filter("__block > 0").limit(1).count():
        last = F.element_at("__f", -1)
        ends = _folded(blocks.select(*by, last["f"].alias("__a"), last["h"].alias("__b"), F.col("__block").alias("__k")), by, ["__k"])
        ends = ends.select(*[F.col(c).alias(f"{c}_") for c in by], (F.col("__k") + 1).alias("__next"), F.col("__h").alias("__end"))
        met = blocks.join(ends, _same(by) & (F.col("__block") == F.col("__next")), "left")
        carried = met.withColumn("__in", F.coalesce("__end", F.lit(0.0)))
    each = carried.select(*by, "__in", F.explode(F.arrays_zip("__r", "__f")).alias("z"))
    return each.select(*by, *[F.col(f"z.__r.{c}").alias(c) for c in more], (F.col("z.__f.f") * F.col("__in") + F.col("z.__f.h")).alias("__h"))


def discounted(df: DataFrame, by: list[str], order: list[str], r: str, gamma: float, out: str = "g") -> DataFrame:
    """G_t = r_t + gamma * G_(t+1): the recurrence along the reversed order."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(o) for o in order])) - 1
    back = df.select(*by, *order, F.lit(float(gamma)).alias("__a"), F.col(r).cast("double").alias("__b"), place.cast("long").alias("__k"))
    return _folded(back, by, order).withColumnRenamed("__h", out)


def local_peaks(x: Column, w: WindowSpec) -> dict[str, Column]:
    """Strict local maxima and minima against both neighbours; ends are neither."""
    prev, nxt = F.lag(x).over(w), F.lead(x).over(w)
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return {"is_max": yes((x > prev) & (x > nxt)), "is_min": yes((x < prev) & (x < nxt))}


def runs(df: DataFrame, by: list[str], order: list[str], x: str) -> DataFrame:
    """(run, value, length) of adjacent equal values along each group."""
    w = along(by, order)
    start = F.coalesce((F.lag(x).over(w) != F.col(x)).cast("int"), F.lit(1))
    marked = df.withColumn("__s", start).withColumn("run", F.sum("__s").over(w.rowsBetween(FIRST, NOW)))
    return marked.groupBy(*by, "run").agg(F.first(x).alias("value"), F.count(F.lit(1)).alias("length"))


def td_targets(r: Column, v_next: Column, done: Column, gamma: float) -> Column:
    return r + gamma * v_next * (1.0 - done)


def gae(df: DataFrame, by: list[str], order: list[str], r: str, v: str, gamma: float, lam: float, out: str = "advantage") -> DataFrame:
    """A_t = delta_t + gamma * lam * A_(t+1), delta = r + gamma * V_(t+1) - V_t, the value after the end being 0."""
    nxt = F.coalesce(F.lead(v).over(along(by, order)), F.lit(0.0))
    delta = df.withColumn("__d", F.col(r) + gamma * nxt - F.col(v))
    return discounted(delta, by, order, "__d", gamma * lam, out)
