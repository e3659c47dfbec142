"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

The vocabulary is a byte-fallback BPE model, read on the driver; its pieces (bounded by the vocabulary) are broadcast. Encoding runs
the merge agenda: of all adjacent pairs that form a piece, the one with the best score, leftmost first, is merged, until none is
left. With dropout, each candidate merge that comes up is skipped with the rate's probability, and
stays skipped; without it the result is the model's own segmentation. Every occurrence of a unit draws for itself, by keyed hashes of seed, document
and place: the numbers of candidates between skips follow the geometric law. A text is cut in varied ways, and the same way on every rerun.

No piece joins a character to a space that follows it, or letters to other characters, so a text is cut there into units, each encoded by itself and remembered
in a table, by which of its candidates are skipped; beyond CACHE entries those used most often stay. Characters without a piece become byte pieces, and so does U+2581, which stands for the space inside
pieces; decoding therefore gives back every text exactly.

Defined results: null and empty texts have no pieces and decode to the empty text. Rows that repeat id and text are cut alike. A null id counts as an
empty key. Very long texts are one row like others. An empty table gives an empty table. Output columns replace those of the same name.
"""

from __future__ import annotations

import re
import sys
import types
from array import array
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
RATE, SEED = 0.1, 20_25
CACHE = 500_000
#: Characters of text that are cut together, and the longest unit that takes part in the joint agenda.
SLICE, LONGEST = 2 << 20, 24
#: Units whose agendas advance together, and bits of a slot in the table of pairs.
BLOCK, SLOTS = 4096, 20
SPACE = "▁"
#: Stands for a U+2581 of the text itself; no piece contains it, so it never merges.
LITERAL = "\0▁"
NEVER = float("-inf")
#: A unit of n characters has at most 3 * (n - 1) candidates; for units up to MASKED characters the skipped ones fit 63 bits.
MASKED = 22


def load_pieces(path: str = TOKENIZER) -> dict:
    """Piece -> (id, score) for normal pieces, the ids of the 256 bytes, and all pieces by id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
    is_byte = [sp.is_byte(i) for i in range(n)]
    ids = {p: i for i, p in enumerate(pieces) if not special[i] and not is_byte[i]}
    # Every way in which two pieces make a third, sorted by (left, right).
    pairs = sorted((ids[p[:k]] * n + ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
    return {
        "ids": ids,
        "pairs": (np.array([k for k, _ in pairs], dtype=np.int64), np.array([i for _, i in pairs], dtype=np.int32)),
        "scores": [sp.get_score(i) for i in range(n)],
        "bytes": [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)],
        "pieces": pieces,
        "special": special,
    }


class _Rows(dict):
    """Key -> row; a key that is looked up and not there gets the next row and is noted in fresh."""

    def __init__(self, *known):
        super().__init__(*known)
        self.fresh, self.end = [], 0

    def __missing__(self, key) -> int:
        row = self[key] = self.end + len(self.fresh)
        self.fresh.append(key)
        return row

    def find(self, keys, n: int, end: int) -> tuple[np.ndarray, list]:
        """(rows of n keys, those that are new, which have the rows from end on)."""
        self.fresh, self.end = [], end
        return np.fromiter(map(self.__getitem__, keys), dtype=np.int64, count=n), self.fresh


class Memo:
    """Remembers units without skips, and with them by the unit's row and the mask: row -> number of candidates, place in the pool of pieces, uses.

    When there are more than CACHE rows, those used most often stay, CACHE / 2 at most."""

    def __init__(self):
        self.whole, self.cut = _Rows(), _Rows()
        self.names: list[str | None] = []
        # Of each row: the number of candidates, the first and the number of its pieces, the uses, the length of its unit (0 with skips).
        self.came, self.start, self.size, self.uses, self.length = (np.empty(0, dtype=np.int64) for _ in range(5))
        self.pool = np.empty(0, dtype=np.int32)

    def add(self, names: list[str | None], pieces: np.ndarray, size: np.ndarray, came: np.ndarray) -> None:
        self.names += names
        start = len(self.pool) + np.cumsum(size) - size
        new = (came, start, size, np.zeros(len(size), dtype=np.int64), np.array([len(u or "") for u in names], dtype=np.int64))
        self.came, self.start, self.size, self.uses, self.length = map(np.concatenate, zip((self.came, self.start, self.size, self.uses, self.length), new))
        self.pool = np.concatenate([self.pool, pieces])

    def used(self, rows: np.ndarray) -> None:
        self.uses += np.bincount(rows, minlength=len(self.uses))

    def pieces(self, rows: np.ndarray) -> np.ndarray:
        """The pieces of these rows, one after another."""
        size = self.size[rows]
        return self.pool[np.repeat(self.start[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())]

    def turn(self) -> None:
        if len(self.names) <= CACHE:
            return
        rows = np.argsort(-self.uses, kind="stable")[: CACHE // 2]
        rows = np.sort(rows[self.uses[rows] > 1])
        to = np.full(len(self.names), -1, dtype=np.int64)
        to[rows] = np.arange(len(rows))
        new = to.tolist()
        whole = {u: new[i] for u, i in self.whole.items() if new[i] >= 0}
        cut = {k >> 32 << 32 | new[k & 0xFFFFFFFF]: new[i] for k, i in self.cut.items() if new[i] >= 0 and new[k & 0xFFFFFFFF] >= 0}
        pool, names = self.pieces(rows), [self.names[i] for i in rows.tolist()]
        came, size, uses = self.came[rows], self.size[rows], self.uses[rows] // 2
        self.__init__()
        self.whole, self.cut = _Rows(whole), _Rows(cut)
        self.add(names, pool, size, came)
        self.uses = uses


class Codec:
    """Encodes and decodes with the given pieces."""

    def __init__(self, vocab: dict, rate: float = RATE, seed: int = SEED):
        self.ids, self.byte_ids = vocab["ids"], vocab["bytes"]
        self.scores = [*vocab["scores"], NEVER]
        self.seed, self.rate = seed, rate
        # A 32-bit draw below the j-th bound stands for j candidates or more before the next skip.
        bounds, left = [], 1 - rate
        while rate > 0 and (left * (1 << 32) >= 1 or not bounds):
            bounds.append(int(left * (1 << 32)))
            left *= 1 - rate
        self.bounds = np.array(bounds[::-1], dtype=np.uint64)
        self.pair_keys, self.pair_ids = vocab["pairs"]
        # The pair that is looked for at each slot; slots of several are crowded, and those are searched.
        slot = self._slot(self.pair_keys)
        self.slots = np.zeros(1 << SLOTS, dtype=np.int32)
        self.slots[slot] = np.arange(len(slot))
        self.crowded = np.bincount(slot, minlength=1 << SLOTS) > 1
        self.score_array = np.array(self.scores, dtype=np.float32)  # [-1] is NEVER
        self.char_ids = np.full(0x110000, -1, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = i
        self.char_ids[ord(" ")] = self.char_ids[ord(SPACE)]
        self.char_ids[ord(SPACE)] = -1
        # Units end where no piece goes on: before a space, at a line end, and between letters and other characters.
        odd = "".join(sorted({c for p in self.ids for c in p if c.isalnum() and not c.isalpha() and not c.isdecimal()}))  # numerals such as superscripts are no letters
        for p in self.ids:
            bare = p.lstrip(SPACE)
            if len(p) > 1 and (SPACE in bare or "\n" in p or len({c.isalpha() for c in bare}) > 1):
                raise ValueError(f"the piece {p!r} spans a unit's end")
        self.units = re.compile(rf" *[^\W\d_{odd}]+| *(?:[^\w \n]|[\d_{odd}])+|\n| +")
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.out = [b"" if s else p.replace(SPACE, " ").encode() for p, s in zip(vocab["pieces"], vocab["special"])]
        for i, b in self.byte_of.items():
            self.out[i] = bytes([b])

    def merge(self, unit: str, skips=frozenset()) -> tuple[bytes, int]:
        """The ids of one unit's pieces, as 32-bit integers, and how many candidates came up; those whose number is in skips are skipped."""
        get, scores, step = self.ids.get, self.scores, 0
        if SPACE in unit:
            parts = [SPACE if c == " " else LITERAL if c == SPACE else c for c in unit]
            joined = [get(a + b, -1) for a, b in zip(parts, parts[1:])]
        else:
            marked = unit.replace(" ", SPACE)
            parts = list(marked)
            joined = [get(marked[i : i + 2], -1) for i in range(len(parts) - 1)]
        rank = [scores[x] for x in joined]  # scores[-1] is NEVER
        while rank:
            best = max(rank)
            if best == NEVER:
                break
            at = rank.index(best)  # the leftmost of equals
            step += 1
            if step - 1 in skips:
                rank[at] = NEVER
                continue
            here = parts[at] = parts[at] + parts[at + 1]
            del parts[at + 1], joined[at], rank[at]
            if at:
                x = joined[at - 1] = get(parts[at - 1] + here, -1)
                rank[at - 1] = scores[x]
            if at < len(rank):
                x = joined[at] = get(here + parts[at + 1], -1)
                rank[at] = scores[x]
        out = [get(p, -1) for p in parts]
        if -1 in out:
            out = []
            for p in parts:
                x = get(p, -1)
                out += [x] if x >= 0 else [self.byte_ids[b] for b in p.replace(LITERAL, SPACE).encode()]
        return array("i", out).tobytes(), step

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair of pieces makes, -1 for none."""
        key = a.astype(np.int64) * len(self.out) + b
        key[(a < 0) | (b < 0)] = -1
        slot = self._slot(key)
        at = self.slots[slot]
        out = np.where(self.pair_keys[at] == key, self.pair_ids[at], -1)
        crowd = np.flatnonzero(self.crowded[slot])
        if len(crowd):
            key = key[crowd]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            out[crowd] = np.where(self.pair_keys[at] == key, self.pair_ids[at], -1)
        return out

    def merge_many(self, units: list[tuple[str, int]]) -> list[tuple[bytes, int]]:
        """merge() of many (unit, mask of skipped candidates) at once."""
        flat, sizes, came = self._merge_all([u for u, _ in units], np.array([m for _, m in units], dtype=np.uint64))
        raw, ends = flat.tobytes(), np.cumsum(sizes) * 4
        return [(raw[e - 4 * n : e], c) for e, n, c in zip(ends.tolist(), sizes.tolist(), came.tolist())]

    def _merge_all(self, units: list[str], masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pieces of all units in turn, how many each has, how many candidates came up).

        Units over LONGEST characters, or with characters that have no piece, go one by one, the others in blocks of like length."""
        if not units:
            return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        length = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        chars = self.char_ids[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        first = np.cumsum(length) - length
        fit = (length >= 2) & (length <= LONGEST) & (np.minimum.reduceat(chars, first) >= 0)
        sizes, came = np.zeros(len(units), dtype=np.int64), np.zeros(len(units), dtype=np.int64)
        order, made = [], []
        for i in np.flatnonzero(~fit).tolist():
            mask = int(masks[i])
            raw, came[i] = self.merge(units[i], {k for k in range(mask.bit_length()) if mask >> k & 1})
            made.append(np.frombuffer(raw, dtype=np.int32))
            sizes[i] = len(made[-1])
            order.append([i])
        rows = np.flatnonzero(fit)
        rows = rows[np.argsort(length[rows], kind="stable")]
        for a in range(0, len(rows), BLOCK):
            r = rows[a : a + BLOCK]
            pieces, sizes[r], came[r] = self._agendas(chars, first[r], length[r], masks[r])
            made.append(pieces)
            order.append(r)
        # What was made in another order goes to its place.
        order = np.concatenate(order)
        n, end = sizes[order], np.cumsum(sizes) - sizes
        flat = np.empty(sizes.sum(), dtype=np.int32)
        flat[np.repeat(end[order] - (np.cumsum(n) - n), n) + np.arange(len(flat))] = np.concatenate(made)
        return flat, sizes, came

    def _agendas(self, chars: np.ndarray, first: np.ndarray, length: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """_merge_all() of units that lie in chars: all agendas advance by one candidate a round. Parts are linked places of a matrix whose outer columns never join."""
        n, width = len(first), int(length.max()) + 2
        cols = np.arange(1, width - 1)
        inside = cols <= length[:, None]
        part = np.full((n, width), -1, dtype=np.int32)
        part[:, 1:-1][inside] = chars[(first[:, None] + cols - 1)[inside]]
        joined = np.full((n, width), -1, dtype=np.int32)
        joined[:, 1:-1] = self._joined(part[:, 1:-1].ravel(), part[:, 2:].ravel()).reshape(n, -1)
        ranks = self.score_array[joined]
        part, joined, rank = part.ravel(), joined.ravel(), ranks.ravel()
        after, before = np.arange(1, n * width + 1), np.arange(-1, n * width - 1)
        alive = np.zeros((n, width), dtype=bool)
        alive[:, 1:-1] = inside
        gone = alive.ravel()
        came, act, some = np.zeros(n, dtype=np.int64), np.arange(n), bool(masks.any())
        while True:
            at = act * width + ranks[act].argmax(axis=1)
            go = rank[at] != NEVER
            act, at = act[go], at[go]
            if not len(act):
                break
            if some:
                skip = (masks[act] >> np.minimum(came[act], 63).astype(np.uint64)) & np.uint64(1) == 1
                rank[at[skip]] = NEVER
                at = at[~skip]
            came[act] += 1
            q, o = after[at], before[at]
            z = after[q]
            made = joined[at]
            part[at] = made
            rank[q] = NEVER
            gone[q] = False
            after[at], before[z] = z, at
            x = self._joined(np.concatenate([made, part[o]]), np.concatenate([part[z], made]))
            spot = np.concatenate([at, o])
            joined[spot], rank[spot] = x, self.score_array[x]
        return part[gone], alive.sum(axis=1), came

    def encode_many(self, texts: list[str | None], keys: list[str], memo: Memo) -> list[np.ndarray]:
        """Piece ids of each text; keys name the documents."""
        memo.turn()
        units_of = [self.units.findall(" " + t) if t else [] for t in texts]
        sizes = [len(u) for u in units_of]
        units = list(chain.from_iterable(units_of))
        row, fresh = memo.whole.find(units, len(units), len(memo.names))
        memo.add(fresh, *self._merge_all(fresh, np.zeros(len(fresh), dtype=np.uint64)))
        memo.used(row)
        if self.rate > 0 and units:
            states = self._states(keys, sizes, np.concatenate([np.arange(n) for n in sizes]))
            skip, states = self._gaps(states)
            at = np.flatnonzero(skip < memo.came[row])
            skip, states, whole = skip[at], states[at], row[at]
            short = memo.length[whole] <= MASKED
            for i, first, state in zip(at[~short].tolist(), skip[~short].tolist(), states[~short]):
                pieces, came = self.merge(units[i], self._skips(first, state, len(units[i])))
                pieces = np.frombuffer(pieces, dtype=np.int32)
                row[i] = len(memo.names)
                memo.add([None], pieces, np.array([len(pieces)]), np.array([came]))
            at, skip, states, whole = at[short], skip[short], states[short], whole[short]
            mask = np.zeros(len(at), dtype=np.uint64)
            # What comes up after a skip depends on it, so each round adds one skip to those that have another.
            while len(at):
                mask |= np.uint64(1) << skip.astype(np.uint64)
                row[at], fresh = memo.cut.find([m << 32 | i for m, i in zip(mask.tolist(), whole.tolist())], len(at), len(memo.names))
                of = [memo.names[k & 0xFFFFFFFF] for k in fresh]
                memo.add([None] * len(fresh), *self._merge_all(of, np.array([k >> 32 for k in fresh], dtype=np.uint64)))
                memo.used(row[at])
                gap, states = self._gaps(states)
                skip = skip + 1 + gap
                go = skip < memo.came[row[at]]
                at, skip, states, whole, mask = at[go], skip[go], states[go], whole[go], mask[go]
        ends = np.concatenate([[0], np.cumsum(memo.size[row])])[np.cumsum([0, *sizes])]
        return np.split(memo.pieces(row), ends[1:-1]) if texts else []

    def _gaps(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of candidates before the next skip, next states): one more draw of each state."""
        with np.errstate(over="ignore"):
            state = state + np.uint64(0x9E3779B97F4A7C15)
            h = (state ^ (state >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
        return len(self.bounds) - np.searchsorted(self.bounds, h >> np.uint64(32), "right"), state

    def _states(self, keys: list[str], sizes: list[int], places: np.ndarray) -> np.ndarray:
        """The state of the draws of each place of each document."""
        base = np.array([xxhash.xxh64_intdigest(k.encode(), self.seed) for k in keys], dtype=np.uint64)
        with np.errstate(over="ignore"):
            x = (places.astype(np.uint64) + np.repeat(base, sizes)) * np.uint64(0xD6E8FEB86659FD93)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD1B54A32D192ED03)
            return x ^ (x >> np.uint64(29))

    def _skips(self, first: int, state: np.uint64, size: int) -> set[int]:
        """The numbers of all skipped candidates of a unit of any length."""
        states, out, at = np.array([state], dtype=np.uint64), set(), first
        while at < 3 * (size - 1):
            out.add(at)
            gap, states = self._gaps(states)
            at += 1 + int(gap[0])
        return out

    def encode(self, text: str | None, key: str = "", memo: Memo | None = None) -> np.ndarray:
        """Piece ids of one text."""
        return self.encode_many([text], [key], Memo() if memo is None else memo)[0]

    def decode(self, ids) -> str:
        """The text that was encoded: pieces without the leading space that encoding puts first."""
        if len(ids) < 2:
            return b"".join(self.out[i] for i in ids).decode("utf-8", "replace")[1:]
        return b"".join(itemgetter(*ids)(self.out)).decode("utf-8", "replace")[1:]


def _memo(name: str) -> Memo:
    """A memo of the Python worker, shared by the tasks that it runs one after another."""
    state = sys.modules.setdefault("_tabulon_worker_state", types.ModuleType("_tabulon_worker_state"))
    return state.__dict__.setdefault(name, Memo())


def _encoder(codec: Codec, columns: list[str], name: str, check: bool):
    def run(batches):
        for b in batches:
            texts, keys = b.column("__text").to_pylist(), b.column("__key").to_pylist()
            ids, at, size = [], 0, 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size > SLICE or i == len(texts) - 1:
                    ids += codec.encode_many(texts[at : i + 1], keys[at : i + 1], _memo(name))
                    at, size = i + 1, 0
            ok = [codec.decode(x.tolist()) == (t or "") for x, t in zip(ids, texts)] if check else []
            sizes = np.array([len(x) for x in ids], dtype=np.int64)
            flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            out = [b.column(c) for c in columns] + [pa.array(sizes), pa.ListArray.from_arrays(offsets, flat)] + ([pa.array(ok, pa.bool_())] if check else [])
            yield pa.RecordBatch.from_arrays(out, names=[*columns, "n_tokens", "token_ids"] + ["lossless"] * check)

    return run


def encode_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = TOKENIZER, rate: float = RATE, seed: int = SEED, check: bool = False) -> DataFrame:
    """df without its text, with n_tokens and token_ids, and with check also lossless: whether decoding gave the text back."""
    vocab = load_pieces(model)
    Codec(vocab)  # refuses a vocabulary that it can't cut units for
    shared = df.sparkSession.sparkContext.broadcast(vocab)
    new = ["n_tokens", "token_ids", "lossless"]
    columns = [c for c in df.columns if c != text_col and c not in new]
    src = df.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text_col}`").alias("__text"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("__key"))
    from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructType

    schema = StructType([f for f in src.schema.fields if f.name in columns])
    schema = schema.add("n_tokens", LongType()).add("token_ids", ArrayType(IntegerType()))
    schema = schema.add("lossless", BooleanType()) if check else schema
    name = f"pieces:{model}:{rate}:{seed}"

    def run(batches):
        yield from _encoder(Codec(shared.value, rate, seed), columns, name, check)(batches)

    return src.mapInArrow(run, schema)


def decode_pieces(df: DataFrame, ids_col: str = "token_ids", out: str = "text", model: str = TOKENIZER) -> DataFrame:
    """df with the decoded text in column `out`; null ids give null."""
    shared = df.sparkSession.sparkContext.broadcast(load_pieces(model))
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def decoded(ids: pa.Array) -> pa.Array:
        codec = Codec(shared.value, 0.0)
        return pa.array([None if x is None else codec.decode(x) for x in ids.to_pylist()], pa.string())

    return df.withColumn(out, decoded(F.col(f"`{ids_col}`")))


def op1_piece_dropout(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_pieces(docs, check=True)
