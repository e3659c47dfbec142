"""Language model scoring with a log-frequency Bloom filter.

Training counts n-grams of the whole training side. A count c is quantised to a level q = 1 + floor(log_BASE c); the filter
holds (n-gram, 1) ... (n-gram, q), so a level is read back by probing 1, 2, ... until one is missing: an n-gram in the filter is never
underestimated, and one that is absent passes the first probe with the filter's false positive rate only. Probabilities are
smoothed: P1(w) = (c(w) + 1) / (N + V + 1), and P(w | history) = (c(history w) + MU P(w | shorter)) / (c(history) + MU).

Scale. One plan at every size. Texts are tokenised once, into stored packs of about PACK characters (distinct word hashes and, per token, their
number); a document is known by its pack and place. N-grams are counted from the packs, combined per task, and shuffled once by filter shard; a shard holds
about SHARD_TOKENS n-gram occurrences and sizes itself by its own entries (BITS per entry), so what is gathered grows with the corpus. The whole filter grows
too and is therefore not broadcast. What is broadcast is bounded by proof: the levels, as probed in the filter, of all n-grams that make up 1 / TOP_GRAMS of all
occurrences or more, of which there are at most TOP_GRAMS (9 bytes each). All other distinct n-grams of a pack visit their shards, are probed there, and one byte a
piece travels back to the pack. The exact base score takes counts of the most frequent words from a broadcast of at most TOP_WORDS entries (16 bytes each) and joins the
rest, which are rare by construction.

Words are known by their 64-bit XXH64, n-grams by KEY_BITS bits within their shard. Defined results: null and empty texts are one end token. A null doc_id is taken as an empty
text for the fold. Repeated rows are scored (and learned) each; a null held_out is taken as false. With no training rows N = V = 0 and all tokens are unknown. An empty table gives an
empty table. Very long texts are read whole; memory is bounded by the batch.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.session import stored

ORDER = 2
BASE = 1.5
MU = 300.0
BITS, PROBES = 10, 5
TOP_WORDS, TOP_GRAMS = 1_000_000, 4_000_000
SHARD_TOKENS = 2_000_000
#: Characters of a pack, and counts that a task combines before it sends them on.
PACK, MERGE = 4 << 20, 2_000_000
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_END = np.uint64(0x9E3779B97F4A7C15)
_LEVELS = 100


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, xor-shift)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_hashes(texts: list[str | None], cache: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text closed by the end token, and the offset at which every text begins (plus the total)."""
    words: list[list[bytes]] = [(t or "").encode().translate(_TABLE).split() for t in texts]
    sizes = np.array([len(w) + 1 for w in words], dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.empty(at[-1], dtype=np.uint64)
    is_end = np.zeros(at[-1], dtype=bool)
    is_end[at[1:] - 1] = True
    flat[is_end] = _END
    flat[~is_end] = np.fromiter(map(cache.__getitem__, chain.from_iterable(words)), dtype=np.uint64, count=int(at[-1] - len(texts)))
    return flat, at


def ngram_hashes(flat: np.ndarray, at: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 ... order the hash of the n-gram that ends at each token; where the text is shorter, of what there is after its start mark."""
    first = np.zeros(len(flat), dtype=bool)
    first[at[:-1]] = True
    grams = [_mix(flat)]
    with np.errstate(over="ignore"):
        for n in range(2, order + 1):
            before = np.empty_like(flat)
            before[1:] = grams[-1][:-1]
            before[first] = np.uint64(n)  # the start of a text
            grams.append(_mix(before * np.uint64(0xD6E8FEB86659FD93) + flat + np.uint64(n)))
    return grams


def _slices(batch: pa.RecordBatch, column: str, limit: int):
    """(from, texts) with a bounded number of characters each; a longer text is a slice of its own."""
    start, size, texts = 0, 0, []
    for i, x in enumerate(batch.column(column)):
        texts.append(x.as_py())
        size += len(texts[-1] or "")
        if size > limit or i == batch.num_rows - 1:
            yield start, texts
            start, size, texts = i + 1, 0, []


def levels_of(counts: np.ndarray, base: float = BASE) -> np.ndarray:
    return np.minimum(_LEVELS, 1 + np.floor(np.log(counts) / math.log(base) + 1e-9)).astype(np.int64)


def level_values(base: float = BASE) -> np.ndarray:
    """The count that a level stands for: 0, then the middle of the whole numbers that have it."""
    out = [0.0]
    for q in range(1, _LEVELS + 1):
        low, high = math.ceil(base ** (q - 1) - 1e-9), max(math.ceil(base**q - 1e-9) - 1, math.ceil(base ** (q - 1) - 1e-9))
        out.append((low + high) / 2.0)
    return np.array(out)


#: An n-gram is known by its shard and so many bits of its hash, of which two n-grams of one shard of 2 ** 21 share all with a chance of 2 ** -19.
KEY_BITS = 40


def located(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The keys of n-grams: the shard above KEY_BITS bits of the hash."""
    return (((hashes >> np.uint64(20)) % np.uint64(shards)) << np.uint64(KEY_BITS)) | (hashes & np.uint64((1 << KEY_BITS) - 1))


def shard_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(KEY_BITS)).astype(np.int32)


def packed_keys(keys: np.ndarray) -> bytes:
    """The keys of one shard, without it: three low bytes each, then the steps (modulo 2 ** 16) of the two above them, which are small if the keys are in order."""
    import zlib

    raw = np.ascontiguousarray(keys, dtype="<u8").view(np.uint8).reshape(-1, 8)
    high = ((keys & np.uint64((1 << KEY_BITS) - 1)) >> np.uint64(24)).astype("<u2")
    return raw[:, :3].tobytes() + zlib.compress(np.diff(high, prepend=high.dtype.type(0)).view(np.uint8).reshape(-1, 2).T.tobytes(), 1) + len(keys).to_bytes(4, "little")


def unpacked_keys(raw: bytes, shard: int) -> np.ndarray:
    import zlib

    n = int.from_bytes(raw[-4:], "little")
    low = np.zeros((n, 8), dtype=np.uint8)
    low[:, :3] = np.frombuffer(raw, dtype=np.uint8, count=3 * n).reshape(-1, 3)
    steps = np.frombuffer(zlib.decompress(raw[3 * n : -4]), dtype=np.uint8).reshape(2, n)
    high = np.cumsum(steps[0] | (steps[1].astype(np.uint16) << np.uint16(8)), dtype=np.uint16)
    return low.view("<u8").reshape(-1) | (high.astype(np.uint64) << np.uint64(24)) | (np.uint64(shard) << np.uint64(KEY_BITS))


def _seeds(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and stride of the probes for (key, level)."""
    with np.errstate(over="ignore"):
        a = _mix(keys + np.uint64(0x632BE59BD9B4E019) * np.uint64(level))
        return a, _mix(a) | np.uint64(1)


def _bit(a: np.ndarray, b: np.ndarray, i: int, bits) -> np.ndarray:
    """The i-th bit position in a filter of so many bits (fewer than 2 ** 32)."""
    with np.errstate(over="ignore"):
        return (((a + np.uint64(i) * b) >> np.uint64(32)) * bits) >> np.uint64(32)


def build_shard(keys: np.ndarray, counts: np.ndarray, base: float = BASE) -> np.ndarray:
    """The filter of these n-grams as bytes."""
    q = levels_of(counts, base)
    bits = 64 * (int(q.sum()) * BITS // 64 + 1)
    filled = np.zeros(bits // 8, dtype=np.uint8)
    for level in range(1, int(q.max(initial=0)) + 1):
        a, b = _seeds(keys[q >= level], level)
        for i in range(PROBES):
            p = _bit(a, b, i, np.uint64(bits))
            np.bitwise_or.at(filled, (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
    return filled


class LogFrequencyFilter:
    """All shards one after another."""

    def __init__(self, filled: np.ndarray, sizes: np.ndarray):
        """sizes: bytes of each shard, 0 where it has no n-gram."""
        self.filled, self.shards = filled, len(sizes)
        self.at = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.uint64)
        self.bits = (8 * sizes).astype(np.uint64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key: level after level is probed until one is missing."""
        out = np.zeros(len(keys), dtype=np.int64)
        left = np.arange(len(keys))
        shard = shard_of(keys)
        at, bits = self.at[shard], self.bits[shard]
        left = left[bits > 0]
        for level in range(1, _LEVELS + 1):
            if not len(left):
                break
            a, b = _seeds(keys[left], level)
            for i in range(PROBES):
                p = _bit(a, b, i, bits[left])
                hit = (self.filled[at[left] + (p >> np.uint64(3))] >> (p & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
                left, a, b = left[hit], a[hit], b[hit]
            out[left] = level
        return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def pack_texts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, held_out, text) -> pack (its id), doc_ids, held (one per document), sizes (tokens of each), words (distinct hashes), tokens (number of each token's word)."""

    def run(batches):
        from pyspark import TaskContext

        cache, pack = _Hashes(), TaskContext.get().partitionId() << 32
        for b in batches:
            for at0, texts in _slices(b, "text", PACK):
                flat, at = token_hashes(texts, cache)
                words, tokens = np.unique(flat, return_inverse=True)
                part, sizes = b.slice(at0, len(texts)), np.diff(at)
                lists = [pa.array([part.column(c).to_pylist()], pa.list_(t)) for c, t in (("doc_id", pa.int64()), ("held_out", pa.bool_()))]
                yield pa.RecordBatch.from_arrays([pa.array([pack]), *lists, *(pa.array([x.tobytes()], pa.binary()) for x in (sizes, words, tokens.astype(np.uint16 if len(words) <= 1 << 16 else np.uint32)))], names=["pack", "doc_ids", "held", "sizes", "words", "tokens"])
                pack += 1

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("held_out", F.lit(False)).alias("held_out"), "text")
    return src.mapInArrow(run, "pack long, doc_ids array<long>, held array<boolean>, sizes binary, words binary, tokens binary")


class Pack:
    """One stored pack."""

    def __init__(self, row: dict):
        self.id, self.doc_ids, self.held = row["pack"], row["doc_ids"], np.array(row["held"], dtype=bool)
        self.sizes = np.frombuffer(row["sizes"], dtype=np.int64)
        self.words = np.frombuffer(row["words"], dtype=np.uint64)
        self.tokens = np.frombuffer(row["tokens"], dtype=np.uint16 if len(self.words) <= 1 << 16 else np.uint32)
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.who = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.learn = ~self.held[self.who]

    def grams(self, order: int, shards: int) -> np.ndarray:
        """One row of keys per order."""
        return located(np.stack(ngram_hashes(self.words[self.tokens], self.at, order)), shards)


def _packs(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield Pack(b.slice(i, 1).to_pylist()[0])


class _Merged:
    """Counts of hashes, combined whenever MERGE of them are held."""

    def __init__(self):
        self.h, self.n, self.held = [], [], 0

    def add(self, h: np.ndarray, n: np.ndarray):
        """Takes counts of distinct hashes; gives those to be sent on, if any."""
        self.h.append(h)
        self.n.append(n)
        self.held += len(h)
        if self.held > MERGE:
            h, n = self.take()
            if len(h) > MERGE // 2:
                return h, n
            self.h, self.n, self.held = [h], [n], len(h)
        return None

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        h, n = np.concatenate([np.empty(0, np.uint64), *self.h]), np.concatenate([np.empty(0, np.int64), *self.n])
        self.h, self.n, self.held = [], [], 0
        if not len(h):
            return h, n
        order = np.argsort(h)
        h, n = h[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return h[first], np.add.reduceat(n, first)


def word_counts(packs: DataFrame) -> DataFrame:
    """h, c: exact counts of the training side's tokens by hash."""

    def run(batches):
        merged = _Merged()
        row = lambda h, n: pa.RecordBatch.from_arrays([_signed(h), pa.array(n)], names=["h", "n"])
        for p in _packs(batches):
            n = np.bincount(p.tokens[p.learn], minlength=len(p.words)).astype(np.int64)
            if out := merged.add(p.words[n > 0], n[n > 0]):
                yield row(*out)
        yield row(*merged.take())

    return packs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("c"))


def filter_shards(packs: DataFrame, shards: int, heavy: float, order: int = ORDER) -> DataFrame:
    """shard, bits (bytes of the filter), n_grams, heavy_h and heavy_q (n-grams with a count of `heavy` or more and their levels): one row per shard."""

    def count(batches):
        import zlib

        merged = _Merged()

        def rows(keys, n):
            s = shard_of(keys)  # in order, as the keys are
            present, at = np.unique(s, return_index=True)
            parts = zip(np.split(keys, at[1:])[: len(present)], np.split(n.astype(np.uint32), at[1:])[: len(present)])
            # One row per shard, its n-grams packed, instead of a row per n-gram; most counts are small and take next to nothing.
            made = [(packed_keys(k), zlib.compress(c.tobytes(), 1)) for k, c in parts]
            return pa.RecordBatch.from_arrays([pa.array(present, pa.int32()), pa.array([k for k, _ in made], pa.binary()), pa.array([c for _, c in made], pa.binary())], names=["shard", "h", "n"])

        for p in _packs(batches):
            h, n = np.unique(p.grams(order, shards)[:, p.learn], return_counts=True)
            if out := merged.add(h, n):
                yield rows(*out)
        yield rows(*merged.take())

    def build(table):
        import zlib

        shard = table.column("shard")[0].as_py()
        merged = _Merged()
        merged.h = [unpacked_keys(x.as_py(), shard) for x in table.column("h")]
        merged.n = [np.frombuffer(zlib.decompress(x.as_py()), np.uint32).astype(np.int64) for x in table.column("n")]
        keys, counts = merged.take()
        filled = build_shard(keys, counts)
        most = keys[counts >= heavy]
        sizes = np.zeros(shards, dtype=np.int64)
        sizes[shard] = len(filled)
        levels = LogFrequencyFilter(filled, sizes).levels(most).astype(np.uint8)
        return pa.table({"shard": pa.array([shard], pa.int32()), "bits": pa.array([filled.tobytes()], pa.binary()), "n_grams": pa.array([len(keys)], pa.int64()), "heavy_h": pa.array([most.tobytes()], pa.binary()), "heavy_q": pa.array([levels.tobytes()], pa.binary())})

    rows = packs.mapInArrow(count, "shard int, h binary, n binary")
    return rows.groupBy("shard").applyInArrow(build, "shard int, bits binary, n_grams long, heavy_h binary, heavy_q binary")


def smoothed(flat_levels: list[np.ndarray], first: np.ndarray, n: int, v: int, texts: int, mu: float = MU) -> np.ndarray:
    """log10 P of every token from the levels of the n-grams that end at it."""
    values = level_values()
    counts = [values[x] for x in flat_levels]
    p = (counts[0] + 1.0) / (n + v + 1.0)
    for k in range(1, len(counts)):
        history = np.empty_like(p)
        history[1:] = counts[k - 1][:-1]
        history[first] = float(texts)
        p = (np.minimum(counts[k], history) + mu * p) / (history + mu)
    return np.log10(p)


def train(docs: DataFrame, order: int = ORDER, top_grams: int = TOP_GRAMS, shard_tokens: int = SHARD_TOKENS) -> dict:
    """docs(doc_id, held_out, text), of which those not held out are learnt. The model: packs of all texts, counts and the filter's shards (stored tables), n, v, texts."""
    packs = stored(pack_texts(docs), "lm-packs", compression="zstd")
    counts = stored(word_counts(packs), "lm-counts", tidy=True)
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.max(F.when(F.col("h") == int(_END.astype(np.int64)), F.col("c"))).alias("texts")).first()
    n = total["n"] or 0
    shards = max(8, math.ceil(order * n / shard_tokens))
    filled = stored(filter_shards(packs, shards, max(2.0, order * n / max(1, top_grams)), order), "lm-filter", tidy=True)
    return {"packs": packs, "counts": counts, "n": n, "v": total["v"], "texts": total["texts"] or 0, "shards": shards, "filter": filled, "order": order}


def _frequent(counts: DataFrame, most: int):
    """Sorted hashes and counts of the most frequent words, at most `most`, and the count from which all are in."""
    grade = F.floor(F.log(1.05, F.col("c").cast("double")) + 1e-9).cast("int")
    by = sorted(((r["g"], r["n"], r["c"]) for r in counts.groupBy(grade.alias("g")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).collect()), reverse=True)
    least, got = None, 0
    for _, k, c in by:
        if got + k > most:
            break
        least, got = c, got + k
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64), None
    t = counts.filter(F.col("c") >= least).toArrow()
    h = t.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], t.column("c").to_numpy()[order], least


def _heavy(model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and levels of the heavy n-grams; bounded by their threshold."""
    rows = model["filter"].select("heavy_h", "heavy_q").filter(F.length("heavy_q") > 0).toArrow()
    h = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(x.as_py(), np.uint64) for x in rows.column("heavy_h"))])
    q = np.concatenate([np.empty(0, np.uint8), *(np.frombuffer(x.as_py(), np.uint8) for x in rows.column("heavy_q"))])
    order = np.argsort(h)
    return h[order], q[order]


def _find(sorted_h: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether there) of each key."""
    if not len(sorted_h):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_h, keys), len(sorted_h) - 1)
    return at, sorted_h[at] == keys


def score(spark: SparkSession, model: dict, top_words: int = TOP_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document that train() was given."""
    n, v, texts, order, shards, packs = model["n"], model["v"], model["texts"], model["order"], model["shards"], model["packs"]
    top_h, top_c, least = _frequent(model["counts"], top_words)
    words, grams = spark.sparkContext.broadcast((top_h, top_c)), spark.sparkContext.broadcast(_heavy(model))
    denominator = float(n + v + 1)

    def asked(p: Pack):
        """(distinct n-grams, number of each token's, place and presence among the heavy ones, those that are asked, in order of their shards)."""
        u, which = np.unique(p.grams(order, shards), return_inverse=True)
        at, known = _find(grams.value[0], u)
        return u, which.reshape(order, -1), at, known, np.flatnonzero(~known)

    def asks(batches):
        for p in _packs(batches):
            u, _, _, _, open_ = asked(p)
            keys = u[open_]
            present, at = np.unique(shard_of(keys), return_index=True)
            rows = [packed_keys(k) for k in np.split(keys, at[1:])[: len(present)]]
            yield pa.RecordBatch.from_arrays([pa.array(present, pa.int32()), pa.array(np.full(len(present), p.id)), pa.array(rows, pa.binary())], names=["shard", "pack", "h"])

    def answer(left, right):
        """Probes the shard's filter for all its n-grams."""
        sizes = np.zeros(shards, dtype=np.int64)
        filled = np.frombuffer(right.column("bits")[0].as_py() if right.num_rows else b"", dtype=np.uint8)
        shard = left.column("shard")[0].as_py() if left.num_rows else 0
        sizes[shard] = len(filled)
        filt = LogFrequencyFilter(filled, sizes)
        levels = [filt.levels(unpacked_keys(x.as_py(), shard)).astype(np.uint8).tobytes() for x in left.column("h")]
        return pa.table({"pack": left.column("pack"), "shard": left.column("shard"), "q": pa.array(levels, pa.binary())})

    def finish(left, right):
        out = {k: [] for k in names}
        answers = {s: np.frombuffer(q, np.uint8) for s, q in zip(right.column("shard").to_pylist(), right.column("q").to_pylist())}
        for row in left.to_pylist():
            p = Pack(row)
            u, which, at, known, open_ = asked(p)
            levels = np.zeros(len(u), dtype=np.int64)
            levels[known] = grams.value[1][at[known]]
            if len(open_):
                levels[open_] = np.concatenate([answers[s] for s in sorted(answers)])
            first, k = np.zeros(len(p.tokens), dtype=bool), len(p.sizes)
            first[p.at[:-1]] = True
            scores = np.bincount(p.who, smoothed(list(levels[which]), first, n, v, texts), k)
            spot, top = _find(words.value[0], p.words)
            counts = words.value[1][spot] if len(words.value[1]) else np.zeros(len(spot))
            term = np.where(top, np.log10((counts + 1.0) / denominator), 0.0)
            # Words beyond the frequent ones, with their numbers in each document.
            rare = np.flatnonzero(~top[p.tokens])
            pairs, times = np.unique(p.who[rare] * len(p.words) + p.tokens[rare].astype(np.int64), return_counts=True)
            doc, word = np.divmod(pairs, len(p.words))
            ends = np.searchsorted(doc, np.arange(k + 1))
            out["pack"] += [p.id] * k
            out["pos"] += list(range(k))
            out["doc_id"] += p.doc_ids
            out["held_out"] += p.held.tolist()
            out["n_tokens"] += p.sizes.tolist()
            out["n_known"] += np.bincount(p.who, top[p.tokens], k).astype(np.int64).tolist()
            out["base_score"] += np.bincount(p.who, term[p.tokens], k).tolist()
            out["score"] += scores.tolist()
            signed = p.words.view(np.int64)
            out["rare"] += [[{"h": h, "m": m} for h, m in zip(signed[word[a:b]].tolist(), times[a:b].tolist())] for a, b in zip(ends, ends[1:])]
        return pa.table({k: pa.array(out[k], t) for k, t in names.items()})

    names = {"pack": pa.int64(), "pos": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64(), "rare": pa.list_(pa.struct([("h", pa.int64()), ("m", pa.int64())]))}
    schema = "pack long, pos long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<h: long, m: long>>"
    answers = packs.mapInArrow(asks, "shard int, pack long, h binary").groupBy("shard").cogroup(model["filter"].select("shard", "bits").groupBy("shard")).applyInArrow(answer, "pack long, shard int, q binary")
    answers = stored(answers, "lm-answers", compression="zstd", tidy=True)  # the questions, several times as large, are deleted before the packs travel
    scored = packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(finish, schema)
    scored = stored(scored, "lm-scored", compression="zstd", tidy=True)
    rare = scored.select("pack", "pos", F.explode("rare").alias("r")).select("pack", "pos", F.col("r.h").alias("h"), F.col("r.m").alias("m"))
    tail = model["counts"] if least is None else model["counts"].filter(F.col("c") < least)
    term = F.col("m") * F.log10((F.coalesce("c", F.lit(0)) + 1.0) / F.lit(denominator))
    more = rare.join(tail, "h", "left").groupBy("pack", "pos").agg(F.sum(term).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("m"))).alias("seen"))
    met = scored.join(more, ["pack", "pos"], "left")
    return met.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")


def op6_bloom_lm(spark, sf_dir: str) -> DataFrame:
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(7)) == 2
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", fold.alias("held_out"))
    return score(spark, train(docs))
