"""Statistical learners and graph steps as DataFrame operations."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.session import cut, scratch, stored

#: Edges that one task takes at most when a graph is contracted.
EDGES_PER_TASK = 200_000


def nb_counts(x: DataFrame, cls: str, feature: str) -> DataFrame:
    """Feature counts per class, pre-aggregated."""
    return x.groupBy(cls, feature).agg(F.count(F.lit(1)).alias("n"))


def nb_log_prob(counts: DataFrame, cls: str, feature: str, n_features: int, alpha: float = 1.0) -> DataFrame:
    """ln(count + alpha) - ln(total + alpha * features) of the features seen in a class."""
    totals = counts.groupBy(cls).agg(F.sum("n").alias("__t"))
    return counts.join(totals, cls).select(cls, feature, (F.ln(F.col("n") + alpha) - F.ln(F.col("__t") + alpha * n_features)).alias("logp"))


def multinomial_nb(tokens: DataFrame, doc: str, feature: str, logp: DataFrame, priors: DataFrame, unseen: DataFrame, cls: str) -> DataFrame:
    """doc, class, score: log prior plus the sum of log probabilities; a feature unseen in a class takes that class's floor.

    tokens(doc, feature, n); priors(class, prior); unseen(class, floor): one row for each class, few."""
    n = tokens.groupBy(doc).agg(F.sum("n").alias("__n"))
    hit = tokens.join(logp, feature).join(unseen, cls).groupBy(doc, cls).agg(F.sum(F.col("n") * (F.col("logp") - F.col("floor"))).alias("__s"))
    base = n.select(doc, "__n", F.explode(F.array(*[F.lit(r[0]) for r in priors.select(cls).collect()])).alias(cls)).join(priors, cls).join(unseen, cls)
    return base.join(hit, [doc, cls], "left").select(doc, cls, (F.col("prior") + F.col("__n") * F.col("floor") + F.coalesce("__s", F.lit(0.0))).alias("score"))


def bernoulli_nb(present: DataFrame, docs: DataFrame, doc: str, feature: str, logp: DataFrame, priors: DataFrame, cls: str) -> DataFrame:
    """doc, class, score: log prior, plus log p of the features a document has and log(1 - p) of those it has not.

    present(doc, feature): distinct; logp(class, feature, logp): all features of all classes; priors(class, prior). The absent ones are summed once a class, and
    a document corrects that sum by the features that it has."""
    none = logp.groupBy(cls).agg(F.sum(F.log1p(-F.exp("logp"))).alias("__none"))
    per = present.join(logp, feature).groupBy(doc, cls).agg(F.sum(F.col("logp") - F.log1p(-F.exp("logp"))).alias("__s"))
    classes = F.array(*[F.lit(r[0]) for r in priors.select(cls).collect()])
    base = docs.select(doc, F.explode(classes).alias(cls)).join(priors, cls).join(none, cls)
    return base.join(per, [doc, cls], "left").select(doc, cls, (F.col("prior") + F.col("__none") + F.coalesce("__s", F.lit(0.0))).alias("score"))


def gaussian_stats(x: DataFrame, cls: str, feature: str, value: str, smoothing: float = 1e-9) -> DataFrame:
    """class, feature, mean, var of a long table."""
    return x.groupBy(cls, feature).agg(F.avg(value).alias("mean"), (F.var_pop(value) + smoothing).alias("var"))


def gaussian_ll(x: DataFrame, row: str, feature: str, value: str, stats: DataFrame, priors: DataFrame, cls: str) -> DataFrame:
    """row, class, score: log prior - 0.5 * sum(ln var + (x - mean)^2 / var)."""
    d = F.col(value) - F.col("mean")
    s = x.select(row, feature, value).join(stats, feature).groupBy(row, cls).agg(F.sum(F.ln("var") + d * d / F.col("var")).alias("__s"))
    return s.join(priors, cls).select(row, cls, (F.col("prior") - 0.5 * F.col("__s")).alias("score"))


def itemset_support(items: DataFrame, basket: str, item: str, sets: DataFrame) -> DataFrame:
    """set, support: baskets that hold all items of sets(set, item), of sets of any size."""
    sizes = sets.groupBy("set").agg(F.count(F.lit(1)).alias("__k"))
    held = items.select(basket, item).distinct().join(sets.withColumnRenamed("item", item), item).groupBy(basket, "set").agg(F.count(F.lit(1)).alias("__n"))
    full = held.join(sizes, "set").filter("__n = __k").groupBy("set").agg(F.count(F.lit(1)).alias("support"))
    return sizes.join(full, "set", "left").select("set", F.coalesce("support", F.lit(0)).alias("support"))


def join_itemsets(sets: DataFrame) -> DataFrame:
    """items (sorted array, one longer): frequent sets of one size that agree in all but their last item, joined; no subset is pruned."""
    split = sets.select(F.slice("items", F.lit(1), F.size("items") - 1).alias("p"), F.element_at("items", -1).alias("a"))
    return split.join(split.select("p", F.col("a").alias("b")), "p").filter("a < b").select(F.concat("p", F.array("a", "b")).alias("items"))


def frequent_itemsets(items: DataFrame, basket: str, item: str, least: int, most_items: int) -> DataFrame:
    """items (sorted array), support of all sets of up to most_items items in at least `least` baskets, size after size.

    Sets grow inside the baskets: two frequent sets of a basket that agree in all but their last item are joined there. So only sets that some basket holds are counted;
    candidates joined from the frequent sets alone grow with the square of the items, however few of them ever meet."""
    often = stored(item_support(items, basket, item).filter(F.col("support") >= least), "itemsets")
    levels = [often.select(F.array(item).alias("items"), "support")]
    with scratch(items.sparkSession) as keep:
        held = stored(items.select(F.col(basket).alias("__b"), item).distinct().join(often.select(item), item, "left_semi").select("__b", F.col(item).alias("__1")), "itemset-baskets")
        for k in range(1, most_items):
            prefix, last, new = [f"__{i}" for i in range(1, k)], f"__{k}", f"__{k + 1}"
            made = held.join(held.select("__b", *prefix, F.col(last).alias(new)), ["__b", *prefix]).filter(F.col(last) < F.col(new))
            names = [*prefix, last, new]
            counted = made.groupBy(*names).agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= least)
            level = keep(stored(counted, "itemsets"))
            if level.isEmpty():
                break
            levels.append(level.select(F.array(*names).alias("items"), "support"))
            if k + 1 < most_items:
                held = stored(made.join(level.select(*names), names, "left_semi"), "itemset-baskets")
    return reduce(DataFrame.unionByName, levels)


def random_threshold(df: DataFrame, x: str, seed: int) -> Column:
    """A threshold drawn uniformly between the least and the largest value, by keyed hash."""
    from tabulon.operators.encode import uniform

    low, high = F.min(x), F.max(x)
    return df.agg((low + uniform(F.lit(x), seed=seed) * (high - low)).alias("t")).scalar()


def feature_subset(features: list[str], k: int, seed: int) -> list[str]:
    """k features drawn without replacement by keyed hash, in their given order."""
    import hashlib

    drawn = sorted(features, key=lambda f: hashlib.md5(f"{seed}:{f}".encode()).digest())[:k]
    return [f for f in features if f in drawn]


def item_support(items: DataFrame, basket: str, item: str) -> DataFrame:
    return items.select(basket, item).distinct().groupBy(item).agg(F.count(F.lit(1)).alias("support"))


def apriori_pairs(items: DataFrame, basket: str, item: str, least: int) -> DataFrame:
    """a, b, support of pairs in at least `least` baskets; only frequent items take part, so baskets shrink before they meet themselves."""
    often = item_support(items, basket, item).filter(F.col("support") >= least).select(item)
    kept = items.select(basket, item).distinct().join(often, item, "left_semi")
    left, right = kept.withColumnRenamed(item, "a"), kept.withColumnRenamed(item, "b")
    return left.join(right, basket).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= least)


def candidates(pairs: DataFrame) -> DataFrame:
    """a, b, c: pairs that share their first item, joined; no subset is pruned."""
    return pairs.select("a", "b").join(pairs.select("a", F.col("b").alias("c")), "a").filter("b < c")


def spmv(m: DataFrame, x: DataFrame) -> DataFrame:
    """(i, y) = M x; m(i, j, v), x(j, x)."""
    return m.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))


def gemm(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) = A B in coordinates; partial products are summed map-side."""
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("w"))
    return a.select("i", F.col("j").alias("k"), "v").join(right, "k").groupBy("i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def gram(m: DataFrame, lower: bool = True) -> DataFrame:
    g = gemm(m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), m)
    return g.filter("j <= i") if lower else g


def degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    d = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(d, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def neighbours(edges: DataFrame, features: DataFrame) -> DataFrame:
    """node, total, mean of the sources' features over the edges into each node; features(node, x)."""
    return edges.join(features.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("x").alias("total"), F.avg("x").alias("mean"))


def gcn_norm(features: DataFrame, degrees: DataFrame) -> DataFrame:
    return features.join(degrees, "node").select("node", F.when(F.col("degree") > 0, F.col("x") / F.sqrt("degree")).otherwise(F.col("x")).alias("x"))


def centroid_step(points: DataFrame, centroids: list[list[float]]) -> tuple[DataFrame, DataFrame]:
    """(assignment, new centroids): nearest centroid (a literal per centroid) and the mean of each cluster's coordinates."""
    from tabulon.operators.distance import squared_l2

    d = [squared_l2(F.col("v"), F.array(*[F.lit(float(x)) for x in c])) for c in centroids]
    best = F.least(*d)
    label = F.coalesce(*[F.when(x == best, F.lit(k)) for k, x in enumerate(d)])
    got = points.withColumn("cluster", label)
    long = got.select("cluster", F.posexplode("v").alias("dim", "x"))
    return got, long.groupBy("cluster", "dim").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))


def histograms(df: DataFrame, node: str, bins: list[str], grad: str, hess: str) -> DataFrame:
    """node, feature, bin, g, h, n: gradient sums for all features in one shuffle."""
    stacked = F.explode(F.array(*[F.struct(F.lit(b).alias("feature"), F.col(b).cast("int").alias("bin")) for b in bins])).alias("z")
    return df.select(node, grad, hess, stacked).groupBy(node, "z.feature", "z.bin").agg(F.sum(grad).alias("g"), F.sum(hess).alias("h"), F.count(F.lit(1)).alias("n"))


def best_split(hist: DataFrame, node: str, lam: float = 1.0, least_hess: float = 1e-3) -> DataFrame:
    """node, feature, bin, gain: the split `bin <= b goes left` with the largest gain; ties to the smaller feature name, then bin."""
    w = Window.partitionBy(node, "feature")
    run = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gl, hl, g, h = F.sum("g").over(run), F.sum("h").over(run), F.sum("g").over(w), F.sum("h").over(w)
    s = hist.select(node, "feature", "bin", gl.alias("gl"), hl.alias("hl"), g.alias("gt"), h.alias("ht"))
    gr, hr = F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl")
    gain = F.col("gl") * F.col("gl") / (F.col("hl") + lam) + gr * gr / (hr + lam) - F.col("gt") * F.col("gt") / (F.col("ht") + lam)
    ok = s.withColumn("gain", F.round(gain, 9)).filter((F.col("hl") >= least_hess) & (hr >= least_hess) & (F.col("gain") > 0))
    return ok.groupBy(node).agg(F.min(F.struct((-F.col("gain")).alias("o"), "feature", "bin", "gain")).alias("b")).select(node, "b.feature", "b.bin", "b.gain")


def leaf_values(df: DataFrame, node: str, grad: str, hess: str, lam: float = 1.0) -> DataFrame:
    return df.groupBy(node).agg((-F.sum(grad) / (F.sum(hess) + lam)).alias("value"))


def goss(df: DataFrame, grad: str, key: Column, top: float, other: float) -> DataFrame:
    """Adds weight: 1 for the share `top` of the largest |grad|, (1 - top) / other for a share `other` of the rest drawn by hash; others are dropped."""
    from tabulon.operators.ordering import quantiles

    cutoff = quantiles(df.select(F.abs(F.col(grad)).alias("g")), "g", [1.0 - top])[0]
    if cutoff is None:
        return df.withColumn("weight", F.lit(1.0))
    big = F.abs(F.col(grad)) >= cutoff
    marked = df.withColumn("weight", F.when(big, F.lit(1.0)).when(key < other, F.lit((1.0 - top) / other)))
    return marked.filter("weight is not null")


def _joined(n: int, a: Iterable[int], b: Iterable[int]) -> tuple[list[int], list[bool]]:
    """(the largest index that each of n indices reaches, whether an edge joined two parts), edges taken in their order."""
    top, joins = list(range(n)), []
    for x, y in zip(a, b):
        while top[x] != x:
            top[x] = x = top[top[x]]
        while top[y] != y:
            top[y] = y = top[top[y]]
        joins.append(x != y)
        if x < y:
            top[x] = y
        else:
            top[y] = x
    for x in range(n - 1, -1, -1):
        top[x] = top[top[x]]
    return top, joins


def _coded(a: pa.Array, b: pa.Array) -> tuple[pa.Array, list[int], list[int]]:
    """(the distinct ends in ascending order, both columns as places among them)."""
    both = pa.chunked_array([a, b]).combine_chunks()
    ends = both.unique()
    ends = ends.take(pa.compute.sort_indices(ends))
    at = pa.compute.index_in(both, ends).to_pylist()
    return ends, at[: len(a)], at[len(a) :]


def _whole(batches) -> pa.Table | None:
    """A task's batches as one table, None where it has none."""
    held = list(batches)
    return pa.Table.from_batches(held).combine_chunks() if held else None


def _task_components(batches):
    t = _whole(batches)
    if t is not None and t.num_rows:
        ends, a, b = _coded(*[t[c].combine_chunks() for c in ("src", "dst")])
        top, _ = _joined(len(ends), a, b)
        yield from pa.table({"node": ends, "component": ends.take(pa.array(top))}).to_batches()


def _task_forest(batches):
    t = _whole(batches)
    if t is not None and t.num_rows:
        t = t.take(pa.compute.sort_indices(t, [(c, "ascending") for c in ("w", "src", "dst")], null_placement="at_start"))
        ends, a, b = _coded(*[t[c].combine_chunks() for c in ("a", "b")])
        _, joins = _joined(len(ends), a, b)
        yield from t.select(["src", "dst", "w"]).filter(pa.array(joins)).to_batches()


def components(edges: DataFrame) -> DataFrame:
    """node, component: the largest node id that each node reaches.

    Edges are dealt by ranges and joined within their tasks first. What is left is the graph of the tasks' parts, linked where tasks share a node: it is joined in the same way, in one task
    once it fits there. Where ranges hardly shrink a graph, the largest label spreads along its edges, with pointer jumping."""
    with scratch(edges.sparkSession) as keep:
        whole = edges.select("src", "dst").filter("src is not null and dst is not null")
        e = stored(whole.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "graph-edges")
        return keep(stored(_contracted(e), "graph-components"))


def _contracted(e: DataFrame) -> DataFrame:
    """components() of distinct edges that are stored; their larger end is src."""
    kind, n = e.schema["src"].dataType.simpleString(), e.count()
    made = f"node {kind}, component {kind}"
    if n <= EDGES_PER_TASK:
        return e.coalesce(1).mapInArrow(_task_components, made)
    parts = e.repartitionByRange(-(-n // EDGES_PER_TASK), "src").mapInArrow(_task_components, made)
    parts = stored(parts.groupBy("node").agg(F.collect_set("component").alias("parts")).select("node", F.array_max("parts").alias("component"), "parts"), "graph-parts")
    links = parts.select(F.col("component").alias("src"), F.explode("parts").alias("dst")).filter("src != dst").distinct()
    links = stored(links, "graph-links")
    found = stored(_contracted(links) if links.count() <= n // 2 else _spread(links), "graph-found")
    up = found.select(F.col("node").alias("component"), F.col("component").alias("__top"))
    return parts.join(up, "component", "left").select("node", F.coalesce("__top", "component").alias("component"))


def _spread(edges: DataFrame) -> DataFrame:
    """components() by labels alone."""
    both = cut(edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label = cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("component", F.col("node")))
    while True:
        near = both.join(label.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.max("component").alias("m"))
        step = label.join(near, "node", "left").select("node", F.col("component").alias("old"), F.greatest("component", F.coalesce("m", F.col("component"))).alias("component"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("far"))
        new = cut(step.join(jump, "component").select("node", F.col("far").alias("component"), "old"))
        if new.filter("component != old").limit(1).count() == 0:
            return new.select("node", "component")
        label = new.select("node", "component")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """src, dst, w of a minimum spanning forest: every component takes its lightest outgoing edge (ties by ends) and is contracted, until what is left fits in one task."""
    chosen = []
    with scratch(edges.sparkSession) as keep:
        e = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w").filter("src != dst")
        e = stored(e.select("*", F.col("src").alias("a"), F.col("dst").alias("b")), "forest-edges")
        while (n := e.count()) > EDGES_PER_TASK:
            edge = F.struct("w", "src", "dst", "a", "b").alias("s")
            sides = e.select(F.col("a").alias("c"), edge).union(e.select("b", edge))
            best = keep(stored(sides.groupBy("c").agg(F.min("s").alias("s")).select("s.*").distinct(), "forest"))
            chosen.append(best.select("src", "dst", "w"))
            label = components(best.select(F.col("a").alias("src"), F.col("b").alias("dst")))
            for end in ("a", "b"):
                e = e.join(label.select(F.col("node").alias(end), F.col("component").alias("__c")), end).withColumn(end, F.col("__c")).drop("__c")
            e = stored(e.filter("a != b"), "forest-edges")
        if n or not chosen:
            kinds = {f.name: f.dataType.simpleString() for f in e.schema}
            chosen.append(keep(stored(e.coalesce(1).mapInArrow(_task_forest, ", ".join(f"{c} {kinds[c]}" for c in ("src", "dst", "w"))), "forest")))
        return reduce(DataFrame.unionByName, chosen)


def bootstrap(df: DataFrame, pos: str, n: int, rounds: int, seed: int = 7) -> DataFrame:
    """round, slot, pos of sampling with replacement by keyed hash; rows must carry positions 0 ... n-1."""
    from tabulon.operators.encode import uniform

    slot = F.col("id") % n
    at = F.floor(uniform(F.floor(F.col("id") / n).cast("long"), slot, seed=seed) * n)
    draws = df.sparkSession.range(rounds * n).select(F.floor(F.col("id") / n).cast("int").alias("round"), slot.alias("slot"), at.cast("long").alias(pos))
    return draws.join(df, pos)


def out_of_bag(df: DataFrame, pos: str, drawn: DataFrame, round_: int) -> DataFrame:
    return df.join(drawn.filter(F.col("round") == round_).select(pos).distinct(), pos, "left_anti")
