"""Toxicity by weak supervision.

Voters. Lexicons of four languages, lexicons mined from the training labels (whole words in four groups, word beginnings of four to six bytes), and patterns
(shouting, exclaiming, masked words, hits beside a second person, number and density of hits). A text's votes are a bit mask, so a corpus is summed up by the counts of its
distinct masks, at most 2 ** (number of voters), whatever its size.

Label model. Generative: class -> votes, where each voter depends on the class and on one other voter (the tree of largest conditional mutual information,
which holds the strongest correlations). Accuracies, correlations and the reliability of the given labels are estimated by expectation-maximisation over all training
documents, labelled or not. Its posterior is the target of the classifier.

Classifier. Logistic regression over the mined features and the votes, fitted on a bounded sample (FIT_ROWS, taken by hash: half of it labelled rows, half any training
rows) with a penalty towards fixed prior weights, so that with few or no labels the lexicons decide.

Mining counts every feature over all labelled training rows, pre-aggregated per batch; a feature is taken if its log-likelihood ratio is over LEAST_RATIO.
The driver holds those features, the counts of the distinct masks and the sample. Defined results: null and empty texts score by the intercept. Labels without a document, null labels and null ids teach nothing; of
several labels of one document the largest counts. Rows that repeat a doc_id are scored each. Empty tables give empty tables.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.session import stored

FIT_ROWS = 20_000
LEAST_RATIO, LEAST_DOCS = 22.0, 3

#: Insults by language.
LEXICONS = {
    "en": "idiot idiots moron morons stupid loser losers scum trash clown clowns pathetic disgusting worthless dumb imbecile filthy garbage jerk freak vermin ugly hate bastard".split(),
    "de": "idioten dumm dummkopf trottel versager abschaum müll ekelhaft wertlos erbärmlich arschloch dreck depp hässlich".split(),
    "fr": "idiote stupide crétin débile ordure minable dégoûtant nul pathétique imbécile connard racaille abruti".split(),
    "es": "idiotas estúpido imbécil basura escoria asqueroso inútil patético payaso cretino tonto perdedor".split(),
}
_SECOND = re.compile(r"\b(?:you|your|du|dich|tu|toi|vous|eres|usted|tú)\b")
_SHOUT = re.compile(r"\b[A-Z]{3,}\b")
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_MASKED = re.compile(r"\b[a-z]+[*@#$]{1,3}[a-z]+\b")
#: Punctuation beyond ASCII that separates words.
_SEPARATORS = re.compile("[\u00a0-\u00bf\u2000-\u206f\u3000-\u303f\uff00-\uff0f]")
_TABLE = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
#: Lengths, in bytes, of the word beginnings that are features.
PREFIXES = (4, 5, 6)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, as UTF-8."""
    text = (text or "").lower()
    if not text.isascii():
        text = _SEPARATORS.sub(" ", text)
    return text.encode().translate(_TABLE).split()


def features_of(words: list[bytes], starts: frozenset | None = None) -> tuple[set[bytes], ...]:
    """Distinct words, and distinct word beginnings of each length of PREFIXES (of longer words).

    With starts (four-byte beginnings), only words that begin so give beginnings: enough to look up features that all begin so."""
    distinct = set(words)
    some = distinct if starts is None else [w for w in distinct if w[:4] in starts]
    return distinct, *({w[:n] for w in some if len(w) > n} for n in PREFIXES)


def named(feats: tuple[set[bytes], ...]) -> list[bytes]:
    """The features in one list; a beginning is marked by its length."""
    return [*feats[0], *(b"%d:%b" % (n, w) for n, s in zip(PREFIXES, feats[1:]) for w in s)]


class Voters:
    """The labelling functions; mined: features that speak for toxicity."""

    def __init__(self, mined: list[bytes]):
        self.lexicons = [frozenset(w.encode() for w in v) for v in LEXICONS.values()]
        words = sorted(f for f in mined if not f[:1].isdigit())
        self.groups = [frozenset(words[k::4]) for k in range(4)]
        self.begins = [frozenset(f[2:] for f in mined if f.startswith(b"%d:" % n)) for n in PREFIXES]
        self.names = [*(f"lexicon_{k}" for k in LEXICONS), *(f"mined_{k}" for k in range(4)), *(f"begin_{n}" for n in PREFIXES), "twice", "thrice", "dense", "denser", "second_person", "shouting", "exclaiming", "masked"]

        self.starts = frozenset(f[:4] for s in self.begins for f in s)
        self.whole = frozenset().union(*self.lexicons, *self.groups)

    def votes(self, text: str | None, words: list[bytes], feats: tuple[set[bytes], ...]) -> int:
        """Bit k is set if voter k speaks for toxicity."""
        text = text or ""
        listed = feats[0] & self.whole
        bits = [bool(listed) and not listed.isdisjoint(s) for s in (*self.lexicons, *self.groups)]
        bits += [not f.isdisjoint(s) for f, s in zip(feats[1:], self.begins)]
        hits, n = 0, max(1, len(text))
        if any(bits):
            bad = listed | {w for w in feats[0] if w[:4] in self.starts and any(len(w) > k and w[:k] in s for k, s in zip(PREFIXES, self.begins))}
            hits = sum([w in bad for w in words])
        bits += [hits > 1, hits > 2, 250 * hits >= len(words) > 0, 100 * hits >= len(words) > 0]
        masked = any(c in text for c in "*@#$") and bool(_MASKED.search(text))
        # A shouted word has three capitals at least, so with few capitals there is nothing to count.
        capitals = len(text.encode().translate(None, _NOT_UPPER))
        shouting = 40 * capitals > n and 120 * len(_SHOUT.findall(text)) > n
        bits += [hits > 0 and bool(_SECOND.search(text.lower())), shouting, 60 * text.count("!") > n, masked]
        return sum(1 << i for i, b in enumerate(bits) if b)


def mine(labelled: DataFrame) -> list[tuple[bytes, float]]:
    """(feature, sign) of the features that tell the classes apart, by log-likelihood ratio over all of labelled(text, toxic)."""
    totals = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return []

    def count(batches):
        for b in batches:
            seen = (Counter(), Counter())
            for t, y in zip(b.column("text"), b.column("toxic").to_pylist()):
                seen[y].update(named(features_of(words_of(t.as_py()))))
            keys = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], names=["f", "a", "b"])

    per = labelled.select("text", "toxic").mapInArrow(count, "f binary, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    term = lambda k, n, e: F.when(k > 0, k * F.log(k / n / e)).otherwise(F.lit(0.0))
    p = (a + b) / float(n1 + n0)
    rest = lambda k, n: F.when(k < n, (n - k) * F.log((n - k) / n / (1 - p))).otherwise(F.lit(0.0))
    ratio = 2 * (term(a, float(n1), p) + term(b, float(n0), p) + F.when(p < 1, rest(a, float(n1)) + rest(b, float(n0))).otherwise(F.lit(0.0)))
    best = per.filter(a + b >= LEAST_DOCS).withColumn("g", ratio).filter(F.col("g") > LEAST_RATIO).orderBy(F.desc("g"), "f")
    return [(bytes(r["f"]), 1.0 if r["a"] / n1 > r["b"] / n0 else -1.0) for r in best.collect()]


class LabelModel:
    """Class -> votes, each vote also given its parent in a tree; fitted by EM on counts of vote masks."""

    def fit(self, masks: np.ndarray, free: np.ndarray, given: np.ndarray, m: int, rounds: int = 25) -> "LabelModel":
        """masks: distinct vote masks; free: documents of each without a label; given[:, y]: those labelled y."""
        votes = (masks[:, None] >> np.arange(m)) & 1
        rate = (given[:, 1].sum() + 1.0) / (given.sum() + 10.0)
        q = (given[:, 1] + 2 * rate) / (given.sum(1) + 2)
        strong = votes[:, : len(LEXICONS)].any(1)
        q = np.where((given.sum(1) == 0) & strong, 0.9, q)
        self.right = np.array([0.95, 0.95])  # P(label = y | class y)
        self.parent = self._tree(votes, free + given.sum(1), q)
        qg = np.repeat(q[:, None], 2, axis=1)
        for _ in range(rounds):
            w1 = free * q + (given * qg).sum(1)
            w0 = free * (1 - q) + (given * (1 - qg)).sum(1)
            self.prior = (w1.sum() + 1) / (w1.sum() + w0.sum() + 10)
            self.theta = np.empty((2, m, 2))
            for y, w in ((0, w0), (1, w1)):
                for j in range(m):
                    for v in (0, 1):
                        on = (votes[:, self.parent[j]] == v) if self.parent[j] >= 0 else np.ones(len(masks), bool)
                        self.theta[y, j, v] = ((w * on * votes[:, j]).sum() + 0.1) / ((w * on).sum() + (0.4 if y else 20.0))
            for y in (0, 1):
                own = qg if y else 1 - qg
                self.right[y] = np.clip(((given[:, y] * own[:, y]).sum() + 19) / ((given * own).sum() + 20), 0.8, 0.999)
            logit = self._logit(votes)
            q = 1 / (1 + np.exp(-logit))
            for lab in (0, 1):
                p1, p0 = (self.right[1], 1 - self.right[0]) if lab else (1 - self.right[1], self.right[0])
                qg[:, lab] = 1 / (1 + np.exp(-(logit + math.log(p1 / p0))))
        return self

    @staticmethod
    def _tree(votes: np.ndarray, n: np.ndarray, q: np.ndarray) -> list[int]:
        """Parents of the spanning tree with the largest mutual information given the class."""
        m = votes.shape[1]
        info = np.zeros((m, m))
        total = max(n.sum(), 1.0)
        for w in (n * q, n * (1 - q)):
            for i in range(m):
                for j in range(i):
                    t = np.array([[(w * (votes[:, i] == a) * (votes[:, j] == b)).sum() for b in (0, 1)] for a in (0, 1)]) + 1e-9
                    e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
                    info[i, j] += (t * np.log(t / e)).sum() / total
        info += info.T
        parent, inside = [-1] * m, {0}
        while len(inside) < m:
            i, j = max(((i, j) for i in inside for j in range(m) if j not in inside), key=lambda x: (info[x], -x[1]))
            parent[j] = i
            inside.add(j)
        return parent

    def _logit(self, votes: np.ndarray) -> np.ndarray:
        out = np.full(len(votes), math.log(self.prior / (1 - self.prior)))
        for j, p in enumerate(self.parent):
            v = votes[:, p] if p >= 0 else np.zeros(len(votes), int)
            a, b = self.theta[1, j][v], self.theta[0, j][v]
            out += np.where(votes[:, j] == 1, np.log(a / b), np.log((1 - a) / (1 - b)))
        return np.clip(out, -30, 30)

    def posterior(self, masks: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """P(toxic) from votes and label (-1: none)."""
        logit = self._logit((masks[:, None] >> np.arange(len(self.parent))) & 1)
        logit = logit + np.where(labels == 1, math.log(self.right[1] / (1 - self.right[0])), 0) + np.where(labels == 0, math.log((1 - self.right[1]) / self.right[0]), 0)
        return 1 / (1 + np.exp(-logit))


class Classifier:
    """Logistic regression on sparse presence features: the votes, then the mined features."""

    def __init__(self, voters: Voters, mined: list[tuple[bytes, float]]):
        self.voters, self.index = voters, {f: i + len(voters.names) for i, (f, _) in enumerate(mined)}
        self.words = {f: i for f, i in self.index.items() if not f[:1].isdigit()}
        self.begins = [{f[2:]: i for f, i in self.index.items() if f.startswith(b"%d:" % n)} for n in PREFIXES]
        self.starts = frozenset(f[:4] for s in self.begins for f in s)
        self.w = np.zeros(len(voters.names) + len(mined))
        self.w[: len(LEXICONS)] = 4.0  # prior weights
        self.b = -3.0

    def row(self, text: str | None) -> tuple[int, list[int]]:
        words = words_of(text)
        feats = features_of(words, self.starts)
        mask = self.voters.votes(text, words, feats)
        cols = [i for i in range(len(self.voters.names)) if mask >> i & 1]
        more = [t[f] for t, s in zip((self.words, *self.begins), feats) for f in s.intersection(t)]
        return mask, cols + sorted(more)

    def fit(self, rows: list[list[int]], target: np.ndarray, penalty: float = 0.5, steps: int = 400, rate: float = 0.1) -> "Classifier":
        """Adam on the full sample; the penalty draws the weights to their prior values."""
        if not rows:
            return self
        cols = np.array([c for r in rows for c in r], dtype=np.int64)
        who = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        prior = np.append(self.w, self.b)
        x = prior.copy()
        m1, m2 = np.zeros_like(x), np.zeros_like(x)
        pull = np.full(len(x), penalty)
        pull[-1] = 1.0
        for t in range(1, steps + 1):
            z = x[-1] + np.bincount(who, x[cols], len(rows))
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
            grad = np.append(np.bincount(cols, g[who], len(x) - 1), g.sum()) + pull * (x - prior)
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
            x -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        self.w, self.b = x[:-1], float(x[-1])
        return self

    def score(self, text: str | None) -> float:
        _, cols = self.row(text)
        z = self.b + float(self.w[cols].sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Classifier:
    """docs(doc_id, text): the training side only; labels(doc_id, toxic)."""
    docs = docs.select("doc_id", "text")
    given = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # Both sides are dealt by doc_id at every size: how much moves then follows the input.
    labelled = stored(docs.join(given.hint("merge"), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "toxic"), "toxic-labelled")
    mined = mine(labelled)
    voters = Voters([f for f, sign in mined if sign > 0])
    blank = Classifier(voters, mined)

    def sparse(batches):
        for b in batches:
            got = [blank.row(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([k for k, _ in got], pa.int64()), pa.array([c for _, c in got], pa.list_(pa.int32()))], names=["doc_id", "mask", "cols"])

    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    voted = stored(every.mapInArrow(sparse, "doc_id long, mask long, cols array<int>"), "toxic-votes")
    known = stored(voted.join(given.hint("merge"), "doc_id"), "toxic-known")
    free = voted.groupBy("mask").agg(F.count(F.lit(1)).alias("n")).select("mask", F.lit(-1).alias("y"), "n")
    counts = free.unionByName(known.groupBy("mask", F.col("toxic").alias("y")).agg(F.count(F.lit(1)).alias("n"))).collect()
    at = {k: i for i, k in enumerate(sorted({r["mask"] for r in counts}))}
    table = np.zeros((len(at), 3))
    for r in counts:
        table[at[r["mask"]], r["y"]] += r["n"]
    model = LabelModel().fit(np.array(list(at), dtype=np.int64), np.maximum(0, table[:, 2] - table[:, :2].sum(1)), table[:, :2], len(voters.names)) if at else None

    # The bounded sample: a quarter each of toxic rows, other labelled rows, rows with a vote and rows without one.
    order = [F.xxhash64("doc_id", F.lit("fit")), "doc_id", "mask", "cols"]
    first = lambda rows: rows.orderBy(*order).limit(max(1, fit_rows // 4)).select("mask", "toxic", "cols")
    unknown = voted.withColumn("toxic", F.lit(-1))
    parts = [known.filter("toxic = 1"), known.filter("toxic = 0"), unknown.filter("mask <> 0"), unknown.filter("mask = 0")]
    rows = pa.concat_tables([first(x).toArrow().cast(pa.schema([("mask", pa.int64()), ("toxic", pa.int32()), ("cols", pa.list_(pa.int32()))])) for x in parts])
    if model is not None and rows.num_rows:
        target = model.posterior(rows.column("mask").to_numpy(), rows.column("toxic").to_numpy())
        blank.fit(rows.column("cols").to_pylist(), target)
    blank.label_model = model
    return blank


def score_toxicity(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs(doc_id, held_out, text) -> doc_id, held_out, score, predicted."""

    def run(batches):
        for b in batches:
            s = [model.score(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", fold.alias("held_out"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = train_toxicity(docs.filter(~F.col("held_out")).select("doc_id", "text"), labels)
    return score_toxicity(docs, model)
