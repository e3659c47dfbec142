"""The lazy builder: Data describes, Model designs, Train runs.

    data = Data.load().set(df_or_path).target("y").exclude("id").split(0.8)
    model = Model().layer(16, "relu").layer(1).loss("mse").lr(0.05)
    run = Train().epochs(200).run(spark, model, data)
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.guards import strict_double
from tabulon.operators import encode, joins
from tabulon.plans import layers
from tabulon.session import cut
from tabulon.sources.tables import load

#: Tasks that add up gradients before the driver does.
FAN = 32
LOSSES = ("mse", "mae", "huber", "ce", "bce", "focal")


@dataclass
class Data:
    source: object = None
    tested: object = None
    y: str | None = None
    left_out: list[str] = field(default_factory=list)
    share: float | None = None
    #: How the groups of a folder or archive were joined.
    joined: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def load() -> "Data":
        return Data()

    def set(self, source) -> "Data":
        self.source = source
        return self

    def test(self, source) -> "Data":
        self.tested = source
        return self

    def target(self, name: str) -> "Data":
        self.y = name
        return self

    def exclude(self, *patterns: str) -> "Data":
        self.left_out += patterns
        return self

    def split(self, share: float) -> "Data":
        if not 0.0 <= share < 1.0:
            raise ValueError("the split must lie in [0, 1)")
        self.share = share
        return self

    def _read(self, spark: SparkSession, source) -> DataFrame:
        got = source if isinstance(source, DataFrame) else load(spark, source)
        if isinstance(got, dict):
            got, self.joined = joins.assemble(got, self.y)
        return got

    def frame(self, spark: SparkSession) -> DataFrame:
        """The source as one table; folders and archives of several groups are assembled."""
        if self.source is None:
            raise ValueError("no source is set")
        return self._read(spark, self.source)

    def prepared(self, spark: SparkSession) -> tuple[DataFrame, "Schema"]:
        """(f0, f1, ..., __y, __key, __train; how they were made). Kinds and vocabularies come from the source alone; the rows of a test source are encoded by them and never train."""
        df = self.frame(spark)
        names = {c: c for c in df.columns} | {c.rpartition(":")[2]: c for c in reversed(df.columns)}
        target = names.get(self.y, self.y) if self.y else df.columns[-1]
        if target not in df.columns:
            raise ValueError(f"no column {self.y}")
        df = encode.exclude(df, [p for p in self.left_out if p != target])
        schema = Schema.of(df, target)
        rows = df.withColumn("__test", F.lit(False))
        if self.tested is not None:
            rows = rows.unionByName(self._read(spark, self.tested).select(*[F.col(f"`{c}`").cast(t) for c, t in df.dtypes], F.lit(True).alias("__test")))
        x = encode.drop_bad_targets(schema.encoded(rows, ["__test"]), "__y")
        if self.share is not None:
            held = x.filter("__test").withColumn("in_train", F.lit(False))
            x = encode.exact_split(x.filter("not __test"), "__key", self.share).unionByName(held).withColumnRenamed("in_train", "__train")
        else:
            x = x.withColumn("__train", ~F.col("__test"))
        return x.drop("__test"), schema


@dataclass
class Schema:
    """How the columns of a table become numbers; saved with a model, so that new rows are encoded alike."""

    target: str
    classes: list
    columns: list[dict]  # name, kind, and values, width or vocabulary as the kind needs

    @staticmethod
    def of(df: DataFrame, target: str) -> "Schema":
        kinds = {r["column"]: r["kind"] for r in encode.kinds(encode.profile(df)).collect()}
        columns = []
        for c, kind in kinds.items():
            made = {"name": c, "kind": kind}
            if kind == "categorical":
                made["values"] = encode.vocabulary(df, c)
            elif kind == "text":
                length = df.agg(F.max(F.size(encode.tokens(F.col(f"`{c}`").cast("string"))))).first()[0] or 1
                made["width"] = int(min(max(length, 1), encode.MAX_TOKENS))
                made["vocabulary"] = [r["token"] for r in encode.token_vocabulary(df.withColumn(c, F.col(f"`{c}`").cast("string")), c).orderBy("id").collect()]
            if c != target and kind != "image":
                columns.append(made)
        classes = encode.vocabulary(df, target) if kinds[target] == "categorical" and dict(df.dtypes)[target] == "string" else []
        return Schema(target, classes, columns)

    @property
    def names(self) -> list[str]:
        out = []
        for c in self.columns:
            out += [f"{c['name']}={v}" for v in c["values"]] if c["kind"] == "categorical" else [f"{c['name']}#t{k}" for k in range(c["width"])] if c["kind"] == "text" else [c["name"]]
        return out

    def encoded(self, df: DataFrame, more: list[str]) -> DataFrame:
        """f0, f1, ... in the order of names, __y (null where df has no target), __key and the columns `more`."""
        number = lambda c: strict_double(F.col(f"`{c}`").cast("string"))
        df = df.withColumn("__key", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if c not in more]))
        cols = []
        for i, c in enumerate(self.columns):
            name = c["name"]
            if c["kind"] == "categorical":
                cols += encode.one_hot(F.col(f"`{name}`"), c["values"], name)
            elif c["kind"] == "temporal":
                cols.append(encode.days(df, name))
            elif c["kind"] == "text":
                vocab = df.sparkSession.createDataFrame([(t, k + 1) for k, t in enumerate(c["vocabulary"])], "token string, id int")
                df = encode.text_ids(df.withColumn("__text", F.col(f"`{name}`").cast("string")), "__text", f"__ids{i}", vocab, c["width"]).drop("__text")
                cols += [F.coalesce(F.get(f"__ids{i}", F.lit(k)), F.lit(0)).cast("double") for k in range(c["width"])]
            else:
                cols.append(number(name))
        if self.target not in df.columns:
            y = F.lit(None).cast("double")
        else:
            y = encode.ordinal(F.col(f"`{self.target}`"), self.classes) if self.classes else number(self.target)
        return df.select(*[c.alias(f"f{i}") for i, c in enumerate(cols)], y.alias("__y"), "__key", *more)


@dataclass
class Model:
    #: (size, activation) of a dense layer, (filters, activation, kernel) of a convolution.
    sizes: list[tuple] = field(default_factory=list)
    kind: str = "mse"
    rate: float = 0.01
    optimiser: str = "sgd"

    def layer(self, size: int, act: str = "linear") -> "Model":
        if size < 1 or act not in layers.ACTIVATIONS:
            raise ValueError("a layer needs a size and a known activation")
        self.sizes.append((size, act))
        return self

    def conv(self, filters: int, kernel: int, act: str = "linear") -> "Model":
        """A convolution along the features (in the order of the schema); its outputs are place after place."""
        if filters < 1 or kernel < 1 or act not in layers.ACTIVATIONS:
            raise ValueError("a convolution needs filters, a kernel and a known activation")
        self.sizes.append((filters, act, kernel))
        return self

    def loss(self, kind: str) -> "Model":
        if kind not in LOSSES:
            raise ValueError(f"unknown loss {kind}")
        self.kind = kind
        return self

    def lr(self, rate: float) -> "Model":
        self.rate = rate
        return self

    def optimizer(self, name: str) -> "Model":
        self.optimiser = name
        return self

    def problems(self, n_classes: int) -> list[str]:
        """What would fail before any job starts."""
        out = [] if self.sizes else ["the model has no layers"]
        if self.sizes and len(self.sizes[-1]) > 2:
            out.append("the last layer must be dense")
        last = self.sizes[-1][0] if self.sizes else 0
        if self.kind in ("bce", "focal") and (last != 1 or self.sizes[-1][1] != "sigmoid"):
            out.append(f"{self.kind} needs one sigmoid output")
        if self.kind == "ce" and last != max(n_classes, 2):
            out.append(f"ce needs {max(n_classes, 2)} outputs")
        if self.kind in ("mse", "mae", "huber") and last != 1:
            out.append(f"{self.kind} needs one output")
        return out


class Train:
    """Full-batch training: every partition sums its gradients, the driver adds the sums (their size is the model's) and takes the step."""

    def __init__(self):
        self.n, self.history, self.params, self.start, self.each, self.log_path, self.lines = 100, [], None, None, 1, None, []

    def epochs(self, n: int) -> "Train":
        self.n = n
        return self

    def log(self, path: str) -> "Train":
        """Losses are written to this file, a line for each logged epoch."""
        self.log_path = path
        return self

    def log_every(self, n: int) -> "Train":
        self.each = max(1, n)
        return self

    def resume(self, path: str) -> "Train":
        """Training goes on from a saved model, if its layers have the same shapes."""
        self.start = path
        return self

    def run(self, spark: SparkSession, model: Model, data: Data, seed: int = 1) -> "Train":
        x, self.schema = data.prepared(spark)
        if issues := model.problems(len(self.schema.classes)):
            raise ValueError("; ".join(issues))
        cols = [f"f{i}" for i in range(len(self.schema.names))]
        train = x.filter("__train")
        self.stats = self._statistics(train, cols)
        regress = model.kind in ("mse", "mae", "huber")
        s = train.agg(F.avg("__y").alias("m"), F.var_pop("__y").alias("v")).first()
        if s["m"] is None:
            raise ValueError("no row has a target to learn from")
        self.scale, self.kind = (s["m"], float(np.sqrt(s["v"] + 1e-8))) if regress else (0.0, 1.0), model.kind
        rows = cut(self._scaled(x, cols).select("x", ((F.col("__y") - self.scale[0]) / self.scale[1]).alias("y"), F.col("__y").alias("raw"), "__train"))
        self.params = self._initial(model, len(cols), seed)
        states = [({}, {}) for _ in self.params]
        fit, k = rows.filter("__train").select("x", "y"), model.sizes[-1][0]
        parts = 1 + (fit.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0)
        best = None
        for epoch in range(self.n):
            total, n, grads = self._gradients(fit, model.kind, k, parts)
            if not np.isfinite(total):
                break
            self.history.append(total / max(n, 1))
            if epoch % self.each == 0:
                self.lines.append(f"{epoch}\t{self.history[-1]:.9g}")
            if best is None or self.history[-1] < best[0]:
                best = (self.history[-1], [{**p, "w": p["w"].copy(), "b": p["b"].copy()} for p in self.params])
            for p, (gw, gb), (sw, sb) in zip(self.params, grads, states):
                p["w"] = layers.step(model.optimiser, p["w"], gw / max(n, 1), sw, model.rate)
                p["b"] = layers.step(model.optimiser, p["b"], gb / max(n, 1), sb, model.rate)
        if best is not None:
            self.params = best[1]
        if self.log_path:
            with open(self.log_path, "a") as f:
                f.writelines(line + "\n" for line in self.lines)
        self.rows = rows
        return self

    def _initial(self, model: Model, width: int, seed: int) -> list[dict]:
        rng, out = np.random.default_rng(seed), []
        for size, act, *kernel in model.sizes:
            rows = kernel[0] if kernel else width
            if rows > width:
                raise ValueError(f"a kernel of {rows} is wider than {width} features")
            out.append({"w": rng.normal(0, np.sqrt(2 / max(rows, 1)), (rows, size)), "b": np.zeros(size), "act": act, "kind": "conv" if kernel else "dense"})
            width = (width - rows + 1) * size if kernel else size
        if self.start:
            old = Train.load(self.start).params
            if [(p["w"].shape, p["act"], p["kind"]) for p in old] == [(p["w"].shape, p["act"], p["kind"]) for p in out]:
                out = old
        return out

    @staticmethod
    def _statistics(train: DataFrame, cols: list[str]) -> list[tuple[float, float]]:
        """(mean, deviation) of each feature's finite training values, in one pass."""
        finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        if not cols:
            return []
        s = train.agg(*[f(finite(F.col(c))).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("v", F.var_pop))]).first()
        return [(s[f"m_{c}"] or 0.0, float(np.sqrt((s[f"v_{c}"] or 0.0) + 1e-8))) for c in cols]

    def _scaled(self, x: DataFrame, cols: list[str]) -> DataFrame:
        """Adds x: the features, missing ones at the mean, over their deviations."""
        finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        return x.withColumn("x", F.array(*[(F.coalesce(finite(F.col(c)), F.lit(m)) - m) / d for c, (m, d) in zip(cols, self.stats)]).cast("array<double>"))

    def _gradients(self, fit: DataFrame, kind: str, k: int, n_parts: int):
        """(loss, rows, gradients) summed over all rows; beyond FAN partitions their sums are first added up in FAN tasks, so the driver gets a bounded number."""
        params = self.params

        def run(batches):
            total, n, sums = 0.0, 0, None
            for b in batches:
                y = b.column("y").to_numpy(zero_copy_only=False).astype(float)
                if not len(y):
                    continue
                x = np.array(b.column("x").to_pylist(), dtype=float).reshape(len(y), -1)
                t = np.eye(k)[y.astype(int)] if kind == "ce" else y[:, None]
                trace = layers.forward(params, x)
                value, g = layers.loss_grad(kind, trace[-1][1], t)
                grads = layers.backward(params, trace, g)
                total, n = total + value, n + len(y)
                sums = grads if sums is None else [(a + c, b_ + d) for (a, b_), (c, d) in zip(sums, grads)]
            if sums is not None:
                flat = np.concatenate([np.concatenate([a.ravel(), b_]) for a, b_ in sums])
                yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([n]), pa.array([flat.tobytes()], pa.binary())], names=["total", "n", "flat"])

        sums = fit.mapInArrow(run, "total double, n long, flat binary")
        if n_parts > FAN:

            def added(t):
                flat = sum(np.frombuffer(x.as_py()) for x in t.column("flat"))
                return pa.table({"total": [sum(t.column("total").to_pylist())], "n": [sum(t.column("n").to_pylist())], "flat": pa.array([flat.tobytes()], pa.binary())})

            sums = sums.withColumn("__f", (F.spark_partition_id() % FAN).cast("int")).groupBy("__f").applyInArrow(added, "total double, n long, flat binary")
        parts = sums.collect()
        flat = sum((np.frombuffer(r["flat"]) for r in parts), np.zeros(sum(p["w"].size + p["b"].size for p in params)))
        grads, at = [], 0
        for p in params:
            w, b = p["w"].size, p["b"].size
            grads.append((flat[at : at + w].reshape(p["w"].shape), flat[at + w : at + w + b]))
            at += w + b
        return sum(r["total"] for r in parts), sum(r["n"] for r in parts), grads

    def _applied(self, rows: DataFrame, more: str) -> DataFrame:
        """rows(x, more columns) with the prediction (class index for ce)."""
        params, kind, (m, d) = self.params, self.kind, self.scale

        def run(batches):
            for b in batches:
                x = np.array(b.column("x").to_pylist(), dtype=float).reshape(b.num_rows, -1)
                out = layers.forward(params, x)[-1][1]
                p = out.argmax(axis=1).astype(float) if kind == "ce" else out[:, 0] * d + m
                kept = [c for c in b.schema.names if c != "x"]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(p)], names=[*kept, "prediction"])

        return rows.mapInArrow(run, f"{more}, prediction double")

    def scored(self) -> DataFrame:
        """raw target, prediction (class index for ce), __train."""
        return self._applied(self.rows.select("x", "raw", "__train"), "raw double, __train boolean")

    def predict(self, df: DataFrame, key: str) -> DataFrame:
        """key, prediction for new rows, encoded by the schema that was trained with."""
        kind = dict(df.dtypes)[key]
        x = self.schema.encoded(df.withColumn("__id", F.col(f"`{key}`")), ["__id"])
        x = self._scaled(x, [f"f{i}" for i in range(len(self.schema.names))])
        return self._applied(x.select("x", "__id"), f"__id {kind}").withColumnRenamed("__id", key)

    def save(self, path: str) -> bool:
        """Writes the best parameters and what is needed to use them as JSON, unless the file holds a model with a smaller loss. Whether it was written."""
        best = min(self.history, default=None)
        if os.path.exists(path):
            with open(path) as f:
                old = json.load(f)["best"]
            if old is not None and (best is None or old < best):
                return False
        made = {"schema": vars(self.schema), "stats": self.stats, "scale": self.scale, "kind": self.kind, "best": best, "params": [{"w": p["w"].tolist(), "b": p["b"].tolist(), "act": p["act"], "kind": p["kind"]} for p in self.params]}
        with open(path, "w") as f:
            json.dump(made, f)
        return True

    @staticmethod
    def load(path: str) -> "Train":
        """A saved model, ready to predict."""
        with open(path) as f:
            made = json.load(f)
        out = Train()
        out.schema, out.stats, out.scale, out.kind = Schema(**made["schema"]), [tuple(s) for s in made["stats"]], tuple(made["scale"]), made["kind"]
        out.history = [] if made["best"] is None else [made["best"]]
        out.params = [{"w": np.array(p["w"], dtype=float).reshape(-1, len(p["b"])), "b": np.array(p["b"]), "act": p["act"], "kind": p["kind"]} for p in made["params"]]
        return out
