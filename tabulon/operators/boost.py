"""Gradient boosting on binned DataFrames: level-wise trees, leaf-wise trees with gradient sampling, and oblivious trees, for regression, two classes and many.

A round is a driver loop over levels (or leaves); each step is one pre-aggregated histogram shuffle (rows: nodes x features x bins) over all trees of the round. Node ids and
predictions are expressions of the binned columns, so rows are not written for a split; the frame is cut to the shared folder once per round.

Categorical columns enter as ordered target statistics along a random order of the rows: a row's value is made from the rows before it. For prediction they come from all training
rows, and an unseen value gives the prior. Features that are never both set may be bundled: they share one binned column, each with a range of bins of its own."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.operators import encode, ml
from tabulon.session import cut

OBJECTIVES = ("squared", "logistic", "multiclass")


def _routed(node: Column, splits: dict[int, tuple[str, int]]) -> Column:
    """The child that each row's node hands it to: 2 node + 1 for bin <= threshold, else 2 node + 2; nodes without a split stay."""
    out = node
    for n, (feature, at) in splits.items():
        out = F.when(node == n, F.when(F.col(feature) <= at, F.lit(2 * n + 1)).otherwise(F.lit(2 * n + 2))).otherwise(out)
    return out


def route_rows(df: DataFrame, node: str, splits: dict[int, tuple[str, int]]) -> DataFrame:
    return df.withColumn(node, _routed(F.col(node), splits))


@dataclass
class Tree:
    splits: dict[int, tuple[str, int]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def _descend(self, leaf) -> Column:
        def at(n: int) -> Column:
            if n not in self.splits:
                return F.lit(leaf(n))
            feature, t = self.splits[n]
            return F.when(F.col(feature) <= t, at(2 * n + 1)).otherwise(at(2 * n + 2))

        return at(0)

    def node(self) -> Column:
        """The node that a row ends in, as nested conditions."""
        return self._descend(lambda n: n)

    def leaf(self) -> Column:
        """That node's value."""
        return self._descend(lambda n: float(self.values.get(n, 0.0)))


def bundle_features(df: DataFrame, features: list[str], most_conflicts: int = 0) -> list[list[str]]:
    """Groups of features of which hardly ever two are set (not zero) in one row: greedily, by the conflicts counted in one pass over all pairs."""
    if len(features) < 2:
        return [[f] for f in features]
    on = {f: F.col(f"`{f}`") != 0 for f in features}
    pairs = [(a, b) for i, a in enumerate(features) for b in features[:i]]
    row = df.agg(*[F.count_if(on[f]).alias(f"s{i}") for i, f in enumerate(features)], *[F.count_if(on[a] & on[b]).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).first()
    clash = {frozenset(p): row[f"c{i}"] for i, p in enumerate(pairs)}
    out: list[list[str]] = []
    for _, f in sorted((-row[f"s{i}"], i) for i in range(len(features))):
        name = features[f]
        home = next((g for g in out if sum(clash[frozenset((name, o))] for o in g) <= most_conflicts), None)
        if home is None:
            out.append([name])
        else:
            home.append(name)
    return out


@dataclass
class Booster:
    """kind: 'level' (all nodes of a level), 'leaf' (best leaf first) or 'oblivious' (one split for a whole level).

    subsample and colsample draw rows (by hash of their features) and features anew for each round; goss keeps large gradients instead."""

    kind: str = "level"
    rounds: int = 30
    depth: int = 4
    leaves: int = 15
    rate: float = 0.3
    lam: float = 1.0
    bins: int = 32
    objective: str = "squared"
    goss: tuple[float, float] | None = None
    seed: int = 7
    subsample: float = 1.0
    colsample: float = 1.0
    bundling: bool = False
    smoothing: float = 1.0

    def __post_init__(self):
        if self.kind not in ("level", "leaf", "oblivious") or self.objective not in OBJECTIVES:
            raise ValueError("unknown kind or objective")
        if self.rounds < 1 or self.depth < 1 or self.leaves < 2 or not 0 < self.rate <= 1 or self.bins < 2 or self.lam < 0 or not 0 < self.subsample <= 1 or not 0 < self.colsample <= 1:
            raise ValueError("a parameter is out of range")

    def fit(self, df: DataFrame, features: list[str], target: str, categorical: list[str] = ()) -> "Booster":
        """features: numbers; categorical: those of them that are values to be told apart."""
        numeric = [f for f in features if f not in categorical]
        numbers = numeric if self.objective == "multiclass" else [*numeric, target]
        bad = " or ".join([*(f"`{c}` is null or isnan(`{c}`)" for c in numbers), f"`{target}` is null"])
        if not features or df.filter(bad).limit(1).count():
            raise ValueError("features and target must be finite")
        self.features, self.categorical, self.target = list(features), list(categorical), target
        self.classes = sorted(r[0] for r in df.select(target).distinct().limit(1001).collect()) if self.objective == "multiclass" else [1.0]
        if not 1 <= len(self.classes) <= 1000:
            raise ValueError("a multiclass target has 1 to 1000 classes")
        train = self._with_statistics(df) if self.categorical else df
        self.base = float(df.agg(F.avg(target)).first()[0]) if self.objective == "squared" else 0.0
        self.bundles = bundle_features(train, self.inputs) if self.bundling else [[f] for f in self.inputs]
        levels = [k / self.bins for k in range(1, self.bins)]
        row = train.agg(*[F.percentile_approx(F.col(f"`{c}`"), levels, 10_000).alias(f"q{i}") for i, c in enumerate(self.inputs)]).first()
        self.edges = {c: sorted(set(row[f"q{i}"])) for i, c in enumerate(self.inputs)}
        self.columns = [f"__b_{i}" for i in range(len(self.bundles))]
        self.trees: list[list[Tree]] = []
        start = F.array(*[F.lit(self.base) for _ in self.classes])
        data = cut(self._binned(train).select(*self.columns, F.col(f"`{target}`").alias("__y"), start.alias("__p"), F.xxhash64(*[F.col(f"`{f}`") for f in features], F.monotonically_increasing_id()).alias("__key")))
        for k in range(self.rounds):
            grown = self._round(data, k)
            self.trees.append(grown)
            data = cut(data.withColumn("__p", F.array(*[F.get("__p", F.lit(c)) + self.rate * t.leaf() for c, t in enumerate(grown)])))
        return self

    @property
    def inputs(self) -> list[str]:
        """The numeric columns that are binned: categorical ones by their statistics."""
        return [f"__ts_{f}" if f in self.categorical else f for f in self.features]

    def _with_statistics(self, df: DataFrame) -> DataFrame:
        """Training rows with ordered statistics along a random order; the whole statistics are kept for prediction."""
        y = F.col(f"`{self.target}`")
        y = F.array_position(F.array(*[F.lit(c) for c in self.classes]), y) if self.objective == "multiclass" else y
        rows = cut(df.withColumn("__target", y.cast("double")).withColumn("__id", F.monotonically_increasing_id()))
        rows = rows.withColumn("__order", encode.uniform(F.col("__id"), seed=self.seed))
        self.mean = float(rows.agg(F.avg("__target")).first()[0])
        self.statistics = {}
        for f in self.categorical:
            s = rows.groupBy(F.col(f"`{f}`").alias("__cat")).agg(((F.sum("__target") + self.mean * self.smoothing) / (F.count("__target") + self.smoothing)).alias("__whole"))
            self.statistics[f] = cut(s)
            rows = encode.ordered_target_stats(rows, f, "__target", ["__order", "__id"], self.mean, self.smoothing, f"__ts_{f}")
        return rows.drop("__target", "__id", "__order")

    def _round(self, data: DataFrame, k: int) -> list[Tree]:
        """One tree for each class, or one."""
        raw = F.col("__p")
        columns = sorted(ml.feature_subset(self.columns, max(1, round(self.colsample * len(self.columns))), self.seed + k))
        if self.subsample < 1:
            data = data.filter(encode.uniform(F.col("__key"), seed=self.seed + k) < self.subsample)
        out = []
        for c, label in enumerate(self.classes):
            if self.objective == "squared":
                g, h = F.get(raw, F.lit(0)) - F.col("__y"), F.lit(1.0)
            else:
                if self.objective == "logistic":
                    p, y = 1 / (1 + F.exp(-F.get(raw, F.lit(0)))), F.col("__y")
                else:
                    from tabulon.operators.neural import softmax

                    p, y = F.get(softmax(raw), F.lit(c)), (F.col("__y") == label).cast("double")
                g, h = p - y, F.greatest(p * (1 - p), F.lit(1e-3))
            work = data.select(*columns, "__key", g.cast("double").alias("__g"), h.alias("__h"))
            if self.goss:
                work = ml.goss(work, "__g", encode.uniform(F.col("__key"), seed=self.seed + 1000 + k), *self.goss).withColumns({"__g": F.col("__g") * F.col("weight"), "__h": F.col("__h") * F.col("weight")})
            out.append(self._grow(work, columns))
        return out

    def _binned(self, df: DataFrame) -> DataFrame:
        one = lambda c: F.size(F.filter(F.array(*[F.lit(float(e)) for e in self.edges[c]]).cast("array<double>"), lambda e: e <= F.col(f"`{c}`"))).cast("int")
        made = {}
        for name, group in zip(self.columns, self.bundles):
            if len(group) == 1:
                made[name] = one(group[0])
                continue
            # Bin 0 is "none set"; every feature's bins follow those of the features before it.
            value, at = F.lit(0), 1
            for f in group:
                value = F.when(F.col(f"`{f}`") != 0, at + one(f)).otherwise(value)
                at += len(self.edges[f]) + 1
            made[name] = value.cast("int")
        return df.withColumns(made)

    def _grow(self, work: DataFrame, columns: list[str]) -> Tree:
        tree = Tree()
        placed = lambda: work.withColumn("__n", tree.node())
        if self.kind == "leaf":
            open_, gains = {0}, {}
            while len(tree.splits) + 1 < self.leaves:
                fresh = [n for n in open_ if n not in gains]
                if fresh:
                    got = self._splits(placed().filter(F.col("__n").isin(*fresh)), columns)
                    gains.update({n: got.get(n) for n in fresh})
                best = max((n for n in open_ if gains[n]), key=lambda n: gains[n][2], default=None)
                if best is None:
                    break
                tree.splits[best] = gains[best][:2]
                open_ = (open_ - {best}) | {2 * best + 1, 2 * best + 2}
        else:
            for level in range(self.depth):
                nodes = range(2**level - 1, 2 ** (level + 1) - 1)
                if self.kind == "oblivious":
                    one = self._oblivious(placed(), columns)
                    found = {n: one for n in nodes} if one else {}
                else:
                    found = {n: s[:2] for n, s in self._splits(placed(), columns).items() if n in nodes}
                if not found:
                    break
                tree.splits.update(found)
        tree.values = {r["__n"]: r["value"] for r in ml.leaf_values(placed(), "__n", "__g", "__h", self.lam).collect()}
        return tree

    def _splits(self, work: DataFrame, columns: list[str]) -> dict:
        rows = ml.best_split(ml.histograms(work, "__n", columns, "__g", "__h"), "__n", self.lam).collect()
        return {r["__n"]: (r["feature"], r["bin"], r["gain"]) for r in rows}

    def _oblivious(self, work: DataFrame, columns: list[str]):
        """The split with the largest total gain over all nodes of the level."""
        from pyspark.sql import Window

        h = ml.histograms(work, "__n", columns, "__g", "__h")
        cells = h.select("__n", "feature").distinct().join(h.select("feature", "bin").distinct(), "feature")
        full = cells.join(h, ["__n", "feature", "bin"], "left").fillna(0.0, ["g", "h"])
        w = Window.partitionBy("__n", "feature")
        run = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        gl, hl, g, t = F.sum("g").over(run), F.sum("h").over(run), F.sum("g").over(w), F.sum("h").over(w)
        s = full.select("feature", "bin", (gl * gl / (hl + self.lam) + (g - gl) * (g - gl) / (t - hl + self.lam) - g * g / (t + self.lam)).alias("gain"))
        best = s.groupBy("feature", "bin").agg(F.round(F.sum("gain"), 9).alias("gain")).filter("gain > 0").orderBy(F.desc("gain"), "feature", "bin").limit(1).collect()
        return (best[0]["feature"], best[0]["bin"]) if best else None

    def _prepared(self, df: DataFrame) -> DataFrame:
        for f in self.categorical:
            s = self.statistics[f].withColumnRenamed("__whole", f"__ts_{f}")
            df = df.join(s, F.col(f"`{f}`").eqNullSafe(F.col("__cat")), "left").drop("__cat").withColumn(f"__ts_{f}", F.coalesce(f"__ts_{f}", F.lit(self.mean)))
        return self._binned(df)

    def _raw(self) -> list[Column]:
        totals = [F.lit(float(self.base)) for _ in self.classes]
        for grown in self.trees:
            totals = [t + self.rate * tree.leaf() for t, tree in zip(totals, grown)]
        return totals

    def _without(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.columns, *[f"__ts_{f}" for f in self.categorical])

    def predict_proba(self, df: DataFrame, out: str = "probabilities") -> DataFrame:
        """Adds the probabilities of all classes as an array, in the order of `classes` (0 and 1 for the logistic objective)."""
        if self.objective == "squared":
            raise ValueError("regression has no probabilities")
        if self.objective == "logistic":
            p = 1 / (1 + F.exp(-self._raw()[0]))
            made = F.array(1 - p, p)
        else:
            from tabulon.operators.neural import softmax

            made = softmax(F.array(*self._raw()))
        return self._without(self._prepared(df).withColumn(out, made))

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Adds the prediction: a value, the probability of class 1, or the likeliest class (the first of equals). One projection; a join for each categorical column."""
        if self.objective == "multiclass":
            from tabulon.operators.neural import bound

            best = bound(F.array(*self._raw()), lambda v: F.array_position(v, F.array_max(v)))
            labels = F.array(*[F.lit(c) for c in self.classes])
            return self._without(self._prepared(df).withColumn(out, F.element_at(labels, best.cast("int"))))
        total = self._raw()[0]
        return self._without(self._prepared(df).withColumn(out, total if self.objective == "squared" else 1 / (1 + F.exp(-total))))


def target_encoded(df: DataFrame, cat: str, target: str, order: list[str], prior: float, smoothing: float = 1.0, out: str | None = None) -> DataFrame:
    """Adds ordered target statistics of a categorical column, for training rows."""
    return encode.ordered_target_stats(df, cat, target, order, prior, smoothing, out or f"{cat}_ts")
