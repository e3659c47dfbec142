"""Convolution, pooling, padding and upsampling of grids in long form: one row per cell, with a key, its coordinates and a value.

Kernels are small: their taps are literals, so that a convolution is one explode and one pre-aggregated shuffle, on any number of grids. Grids are not gathered in
one row or task. Windows are valid ones (no padding; pad first) and kernels are not flipped."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.operators.shape import pad


@dataclass(frozen=True)
class Tap:
    """One weight of a kernel: at this offset, from an input channel to an output channel."""

    offset: tuple[int, ...]
    weight: float
    source: int = 0
    target: int = 0


def taps(kernel, source: int = 0, target: int = 0, dilation: int = 1) -> list[Tap]:
    """The taps of a nested list of weights of any number of dimensions; dilation spreads them."""
    if not isinstance(kernel, (list, tuple)):
        return [Tap((), float(kernel), source, target)]
    return [Tap((k * dilation, *t.offset), t.weight, source, target) for k, part in enumerate(kernel) for t in taps(part, source, target, dilation)]


def grouped_taps(kernels: list, groups: int, sources: int) -> list[Tap]:
    """Taps of a grouped convolution: kernels[target][source within its group]; with as many groups as sources it is depthwise."""
    per_source, per_target = sources // groups, len(kernels) // groups
    return [t for o, kernel in enumerate(kernels) for i, k in enumerate(kernel) for t in taps(k, (o // per_target) * per_source + i, o)]


def _literal(kernel: list[Tap]) -> Column:
    one = lambda t: F.struct(F.array(*[F.lit(int(d)) for d in t.offset]).alias("at"), F.lit(t.weight).alias("w"), F.lit(t.source).alias("source"), F.lit(t.target).alias("target"), F.lit(t.weight).alias("id"))
    return F.array(*[one(t) for t in kernel])


def _moved(df: DataFrame, space: list[str], kernel: list[Tap], channel: str | None, sign: int) -> DataFrame:
    """Every cell once for each tap of its channel, at the place that the tap takes it to."""
    numbered = F.transform(_literal(kernel), lambda t, k: F.struct(t["at"].alias("at"), t["w"].alias("w"), t["source"].alias("source"), t["target"].alias("target"), k.alias("tap")))
    own = numbered if channel is None else F.filter(numbered, lambda t: t["source"] == F.col(channel))
    wide = df.withColumn("__t", F.explode(own))
    return wide.withColumns({s: F.col(s) + sign * F.get(F.col("__t.at"), F.lit(i)) for i, s in enumerate(space)})


def _inside(space: list[str], sizes: list[int]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(s).between(0, n - 1) for s, n in zip(space, sizes)])


def _reach(kernel: list[Tap]) -> list[int]:
    return [1 + max(t.offset[i] for t in kernel) for i in range(len(kernel[0].offset))]


def conv(df: DataFrame, by: list[str], space: list[str], x: str, sizes: list[int], kernel: list[Tap], channel: str | None = None, stride: int = 1, bias: list[float] | None = None) -> DataFrame:
    """by, (channel), space, x: the valid cross-correlation in as many dimensions as space has. Missing cells count as zero; every window has a row."""
    out = [(n - r) // stride + 1 for n, r in zip(sizes, _reach(kernel))]
    moved = _moved(df, space, kernel, channel, -1)
    moved = moved.filter(reduce(lambda a, b: a & b, [F.col(s) % stride == 0 for s in space])).withColumns({s: (F.col(s) / stride).cast("int") for s in space}).filter(_inside(space, out))
    keys = [*by, *([F.col("__t.target").alias(channel)] if channel else []), *space]
    y = moved.groupBy(*keys).agg(F.sum(F.col(x) * F.col("__t.w")).alias(x))
    if bias:
        y = y.withColumn(x, F.col(x) + F.get(F.array(*[F.lit(float(b)) for b in bias]), F.col(channel) if channel else F.lit(0)))
    return y


def conv_transposed(df: DataFrame, by: list[str], space: list[str], x: str, kernel: list[Tap], channel: str | None = None, stride: int = 1) -> DataFrame:
    """The convolution's transpose: every cell adds its value times the kernel to the places from it on; also the gradient of conv() for its input (with the taps turned round)."""
    spread = df.withColumns({s: F.col(s) * stride for s in space})
    moved = _moved(spread, space, kernel, channel, 1)
    keys = [*by, *([F.col("__t.target").alias(channel)] if channel else []), *space]
    return moved.groupBy(*keys).agg(F.sum(F.col(x) * F.col("__t.w")).alias(x))


def turned(kernel: list[Tap]) -> list[Tap]:
    """Sources and targets exchanged, for the gradient of the input."""
    return [Tap(t.offset, t.weight, t.target, t.source) for t in kernel]


def conv_kernel_grad(df: DataFrame, grad: DataFrame, by: list[str], space: list[str], x: str, g: str, kernel: list[Tap], channel: str | None = None) -> DataFrame:
    """tap (its number in kernel), grad: the gradient of the kernel, summed over all grids."""
    moved = _moved(df, space, kernel, channel, -1)
    moved = moved.select(*by, *space, x, F.col("__t.tap").alias("tap"), *([F.col("__t.target").alias(channel)] if channel else []))
    return moved.join(grad, [*by, *([channel] if channel else []), *space]).groupBy("tap").agg(F.sum(F.col(x) * F.col(g)).alias("grad"))


def bias_grad(grad: DataFrame, channel: str, g: str) -> DataFrame:
    return grad.groupBy(channel).agg(F.sum(g).alias("grad"))


def morphology(df: DataFrame, by: list[str], space: list[str], x: str, sizes: list[int], kernel: list[Tap], erode: bool = False) -> DataFrame:
    """Grayscale dilation (largest of value plus weight) or erosion (smallest of value minus weight) over valid windows."""
    out = [n - r + 1 for n, r in zip(sizes, _reach(kernel))]
    moved = _moved(df, space, kernel, None, -1).filter(_inside(space, out))
    best = F.min(F.col(x) - F.col("__t.w")) if erode else F.max(F.col(x) + F.col("__t.w"))
    return moved.groupBy(*by, *space).agg(best.alias(x))


def _cells(space: list[str], size: int | list[int]) -> list[Column]:
    sizes = [size] * len(space) if isinstance(size, int) else size
    return [F.floor(F.col(s) / k).cast("int").alias(s) for s, k in zip(space, sizes)]


def pool(df: DataFrame, by: list[str], space: list[str], x: str, size: int | list[int], p: float | None = None) -> DataFrame:
    """by, space, avg, max (and lp, the p-norm) over adjacent blocks of the given size in each dimension."""
    more = [F.pow(F.sum(F.pow(F.abs(F.col(x)), F.lit(float(p)))), F.lit(1.0 / p)).alias("lp")] if p else []
    return df.groupBy(*by, *_cells(space, size)).agg(F.avg(x).alias("avg"), F.max(x).alias("max"), *more)


def pool_global(df: DataFrame, by: list[str], x: str, p: float = 2.0) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(x).alias("avg"), F.max(x).alias("max"), F.pow(F.sum(F.pow(F.abs(F.col(x)), F.lit(float(p)))), F.lit(1.0 / p)).alias("lp"))


def pool_adaptive(df: DataFrame, by: list[str], pos: str, x: str, n: int, bins: int) -> DataFrame:
    """by, pos (bin), avg, max: bin o of `bins` covers positions floor(o n / bins) up to ceil((o + 1) n / bins), so bins may share positions."""
    low, high = F.floor(F.col(pos) * bins / n), F.ceil((F.col(pos) + 1) * bins / n) - 1
    return df.withColumn("__o", F.explode(F.sequence(low.cast("int"), high.cast("int")))).groupBy(*by, F.col("__o").alias(pos)).agg(F.avg(x).alias("avg"), F.max(x).alias("max"))


def pool_grad(df: DataFrame, grad: DataFrame, by: list[str], space: list[str], x: str, g: str, size: int, kind: str = "max") -> DataFrame:
    """by, space, grad of each input cell: the block's gradient goes to its largest cell (the first of equals), or evenly to all cells."""
    own = [F.col(s).alias(f"__{s}") for s in space]
    block = df.select("*", *[F.floor(F.col(s) / size).cast("int").alias(f"__{s}") for s in space])
    coarse = grad.select(*by, *own, F.col(g).alias("__g"))
    keys = [*by, *[f"__{s}" for s in space]]
    if kind == "avg":
        n = block.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        return block.join(n.join(coarse, keys), keys).select(*by, *space, (F.col("__g") / F.col("__n")).alias("grad"))
    top = block.groupBy(*keys).agg(F.min(F.struct((-F.col(x)).alias("o"), *space)).alias("__top"))
    first = reduce(lambda a, b: a & b, [F.col(s) == F.col(f"__top.{s}") for s in space])
    return block.join(top.join(coarse, keys), keys).select(*by, *space, F.when(first, F.col("__g")).otherwise(0.0).alias("grad"))


def pad_grid(df: DataFrame, by: list[str], space: list[str], x: str, sizes: list[int], widths: list[tuple[int, int]], rule: str, fill: float = 0.0) -> DataFrame:
    """Pads one dimension after the other by `constant`, `reflect`, `replicate` or `circular`."""
    sizes = list(sizes)
    for i, s in enumerate(space):
        others = [o for o in space if o != s]
        df = pad(df, [*by, *others], s, x, sizes[i], *widths[i], rule, fill)
        sizes[i] += sum(widths[i])
    return df


def upsample_nearest(df: DataFrame, space: list[str], scales: list[int]) -> DataFrame:
    """Every cell becomes a block of equal cells."""
    for s, k in zip(space, scales):
        df = df.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn(s, F.col(s) * k + F.col("__k")).drop("__k")
    return df


def unfold(df: DataFrame, by: list[str], space: list[str], x: str, sizes: list[int], window: list[int]) -> DataFrame:
    """by, space (of the window), tap, x: all valid windows as rows (im2col)."""
    kernel = [Tap(t, 1.0) for t in _grid(window)]
    out = [n - w + 1 for n, w in zip(sizes, window)]
    return _moved(df, space, kernel, None, -1).filter(_inside(space, out)).select(*by, *space, F.col("__t.tap").alias("tap"), x)


def fold(df: DataFrame, by: list[str], space: list[str], x: str, window: list[int]) -> DataFrame:
    """by, space, x: the sum of all windows' cells at their places (col2im)."""
    at = F.array(*[F.array(*[F.lit(int(d)) for d in t]) for t in _grid(window)])
    placed = df.withColumn("__at", F.get(at, F.col("tap").cast("int"))).withColumns({s: F.col(s) + F.get("__at", F.lit(i)) for i, s in enumerate(space)})
    return placed.groupBy(*by, *space).agg(F.sum(x).alias(x))


def _grid(window: list[int]) -> list[tuple[int, ...]]:
    return [(k, *rest) for k in range(window[0]) for rest in (_grid(window[1:]) if len(window) > 1 else [()])]
