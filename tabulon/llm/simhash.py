"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Each whole text becomes a 64-bit fingerprint over its word shingles. Two fingerprints at most 2 bits apart meet at some value at most 1 bit from either: every distinct
fingerprint emits itself and its 64 one-bit variants, rows are shuffled on the variant, and fingerprints that share one are
neighbours. At most 65 distinct fingerprints can share a variant, so no bucket grows with the data; linking each to
the next in its bucket keeps every connection, and each link is deduplicated and verified by its bit count. Copies of one fingerprint are
folded to their smallest doc_id before anything is emitted.

Defined results: null and empty texts and texts without words have fingerprint zero and link like any other. A text with fewer
words than a shingle is one shingle. Rows of a null doc_id get a fingerprint and the component of documents
with an id and the same fingerprint; a fingerprint that only null ids have links to nothing and its component is null. Repeated rows share fingerprint and component. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.graph import components, forest
from tabulon.llm.skew import join_groups
from tabulon.session import cut, stored

SHINGLE, SEED = 3, 42
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles whose bits are counted at once; bounds memory on very long texts.
_BLOCK = 1 << 16
#: Candidate pairs that are made at once, and rows of a bucket that are gathered at once.
_PAIRS, _CHUNK = 1 << 18, 1 << 18
#: Texts of a family that are compared with each other at once.
_FAMILY = 512


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint: bit b is set if over half of the shingles' XXH64 have it."""
    words = (text or "").encode().translate(_TABLE).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(words[i : i + shingle]), seed) for i in range(n)), dtype="<u8", count=n)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _BLOCK):
        bits = np.unpackbits(hashes[at : at + _BLOCK].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) per row of df."""
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return src.mapInArrow(run, "doc_id long, fp long")


def ball_links(classes: DataFrame) -> DataFrame:
    """src, dst: links between the ids of fingerprints at most 2 bits apart; classes(fp, id) holds distinct fingerprints."""
    from pyspark.sql import Window

    flips = [0] + [1 << k if k < 63 else -(1 << 63) for k in range(64)]
    variants = classes.select("fp", "id", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(x).cast("long")) for x in flips])).alias("variant"))
    order = Window.partitionBy("variant").orderBy("fp")
    met = variants.select("fp", "id", F.lag("fp").over(order).alias("fp0"), F.lag("id").over(order).alias("id0")).filter("fp0 is not null")
    close = met.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp0"))) <= 2)
    return close.select(F.least("id", "id0").alias("src"), F.greatest("id", "id0").alias("dst")).distinct()


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp, component_id per row of df."""
    docs = cut(fingerprints(df, id_col, text_col, shingle, seed))
    classes = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")))
    known = classes.filter("id is not null")
    found = components(ball_links(known))
    named = cut(known.join(found, F.col("id") == F.col("node"), "left").select("fp", F.coalesce("component", "id").alias("component_id"), "n"))
    return join_groups(docs, named, "fp", "n", docs.count()).select("doc_id", "fp", "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    out = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Similarity thresholds far beyond two bits: several short fingerprints, each searched by the same ball hashing.

#: Least words of 64 bits in a wide fingerprint, and the share of pairs at the threshold that the tables may miss.
WIDE, MISS = 8, 0.01
NEAR_SHINGLE, NEAR_SIMILARITY = 5, 0.8


def shingle_set(text: str | None, shingle: int = NEAR_SHINGLE, seed: int = SEED) -> np.ndarray:
    """The sorted, distinct hashes of a text's shingles; none for a text without words."""
    words = (text or "").encode().translate(_TABLE).split()
    n = max(1, len(words) - shingle + 1) if words else 0
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + shingle]), seed) for i in range(n)), dtype="<u8", count=n))


def wide_fingerprint(hashes: np.ndarray, width: int = WIDE) -> np.ndarray:
    """`width` fingerprints of one shingle set from differently mixed hashes of the same shingles."""
    n = len(hashes)
    counts = np.zeros((width, 64), dtype=np.int64)
    for at in range(0, n, _BLOCK):
        for k in range(width):
            with np.errstate(over="ignore"):
                x = (hashes[at : at + _BLOCK] + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
                x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                x ^= x >> np.uint64(29)
            counts[k] += np.unpackbits(x.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n, axis=1, bitorder="little").view("<u8").reshape(-1)


def differing_share(similarity: float) -> float:
    """Expected share of differing bits of two texts whose shingle sets have this Jaccard similarity."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def plan_tables(n: int, similarity: float, miss: float = MISS) -> tuple[int, int]:
    """(tables, bits): bits grow with the logarithm of the number of texts, so that unrelated texts rarely share a value;
    tables are as many as a pair at the threshold needs to be at most 2 bits apart in one of them."""
    p = differing_share(similarity)
    bits = int(np.clip(np.ceil(np.log2(max(n, 2))) + 5, 16, 40))
    near = sum(float(_choose(bits, k)) * p**k * (1 - p) ** (bits - k) for k in range(3))
    return int(np.ceil(np.log(miss) / np.log(1 - near))), bits


def plan_width(tables: int, bits: int) -> int:
    """Words of 64 bits that the tables need, WIDE at least."""
    return max(WIDE, -(-tables * bits // 64))


def _choose(n: int, k: int) -> int:
    from math import comb

    return comb(n, k)


def _buckets(batches, names: tuple[str, ...], most: int | None = None):
    """The columns of whole buckets (rows of equal x, which come together and may span batches), many at a time; longer ones than `most` in parts."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(c).to_numpy() for c in names]
        rows = rows if held is None else [np.concatenate(p) for p in zip(held, rows)]
        last = int(np.searchsorted(rows[0], rows[0][-1], "left"))
        if most and len(rows[0]) - last > most:
            last = len(rows[0])
        if last:
            yield [r[:last] for r in rows]
        held = [r[last:] for r in rows] if last < len(rows[0]) else None
    if held is not None:
        yield held


def _bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def _links(a: np.ndarray, b: np.ndarray, family: bool | None = None) -> pa.RecordBatch:
    more = [] if family is None else [pa.array(np.full(len(a), family))]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), *more], names=["a", "b", "family"][: 2 + len(more)])


def _hub(bits: np.ndarray) -> int:
    """The row of bits (as longs) nearest to the majority of all: of a text and its edited copies, the text."""
    rows = np.unpackbits(bits.view(np.uint8), bitorder="little").reshape(-1, 64)
    middle = np.packbits(2 * rows.sum(axis=0, dtype=np.int64) > len(rows), bitorder="little").view(np.int64)
    return int(_bits_apart(bits, middle).argmin())


def _gather(loose: int):
    """Links that gather large groups, a number in proportion to the rows: each text of a bucket to the next by its head, and to the bucket's hub.
    Rows come sorted by bucket, head and id."""

    def run(batches):
        for x, head, alt, ids in _buckets(batches, ("x", "head", "alt", "id"), _CHUNK):
            same = x[1:] == x[:-1]
            at = np.flatnonzero(same & (_bits_apart(head[1:], head[:-1]) <= loose))
            out = [(ids[at], ids[at + 1])]
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            sizes = np.diff(starts, append=len(x))
            for i, n in zip(starts[sizes > 3].tolist(), sizes[sizes > 3].tolist()):
                hub = i + _hub(alt[i : i + n])
                near = i + np.flatnonzero(_bits_apart(head[i : i + n], head[hub]) <= loose)
                near = near[near != hub]
                out.append((np.full(len(near), ids[hub]), ids[near]))
            a, b = (np.concatenate(c) for c in zip(*out))
            yield _links(a, b)

    return run


def _across(loose: int):
    """(a, b, family): pairs of the texts of one bucket that lie in different groups and whose heads allow a link. Rows come sorted by bucket, group and id; k tells
    which bit of a row's slice was turned (0: none), and a pair is named only in one of the buckets of a table in which it meets.

    A bucket names no more than three rows a text. Where it has more pairs than texts, the texts near its hub are not paired but join its family; so do the others that
    have a pair with one of them, where such pairs outnumber the texts near the hub. That is done again with the others while they have too many. Of a family only the rows that
    connect it are named (hub, text, true), at most one a text."""

    flip = np.concatenate([[0], 1 << np.arange(40)]).astype(np.int64)

    def pairs(rows, which, ends, limit=None):
        """Passing pairs of each row of `which` with the rows from its group's end on up to `ends`; None if there are more than limit."""
        x, _, _, head, v, stop_g = rows
        c = ends[which] - stop_g[which]
        which, c = which[c > 0], c[c > 0]
        total, at, found, n = np.cumsum(c), 0, [], 0
        while at < len(which):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _PAIRS, "right")))
            w, k = which[at:stop], c[at:stop]
            left = np.repeat(w, k)
            right = np.arange(len(left)) + np.repeat(stop_g[w] - (np.cumsum(k) - k), k)
            ok = _bits_apart(head[left], head[right]) <= loose
            left, right = left[ok], right[ok]
            low = v[left] ^ v[right]
            low &= -low
            ok = np.minimum(v[left] ^ low, v[right] ^ low) == x[left] & ((1 << 40) - 1)
            found.append((left[ok], right[ok]))
            n += len(found[-1][0])
            if limit is not None and n > limit:
                return None
            at = stop
        return found

    def run(batches):
        for x, g, ids, head, k in _buckets(batches, ("x", "g", "id", "head", "k")):
            n, v = len(x), (x & ((1 << 40) - 1)) ^ flip[k]
            new = x[1:] != x[:-1]
            ends = lambda cut: np.repeat(e := np.append(np.flatnonzero(cut) + 1, n), np.diff(e, prepend=0))
            stop_g, stop = ends(new | (g[1:] != g[:-1])), ends(new)
            starts = np.flatnonzero(np.concatenate([[True], new]))
            sizes = np.diff(starts, append=n)
            large = np.add.reduceat(stop - stop_g, starts) > sizes
            for left, right in pairs((x, g, ids, head, v, stop_g), np.flatnonzero(~np.repeat(large, sizes)), stop):
                yield _links(ids[left], ids[right], False)
            for i, size in zip(starts[large].tolist(), sizes[large].tolist()):
                rest, label = np.arange(i, i + size), np.arange(size)
                while True:
                    part = tuple(c[rest] for c in (x, g, ids, head, v))
                    end = np.full(len(rest), len(rest))
                    stops = np.searchsorted(part[1], part[1], "right")
                    found = pairs((*part, stops), np.arange(len(rest)), end, len(rest))
                    if found is not None:
                        for left, right in found:
                            yield _links(part[2][left], part[2][right], False)
                        break
                    hub = _hub(part[3])
                    near = _bits_apart(part[3], part[3][hub]) <= loose
                    # The texts near the hub against the others.
                    away, own = np.flatnonzero(~near), np.flatnonzero(near)
                    step, met, between, n = max(1, _PAIRS // max(1, len(away))), np.zeros(len(away), dtype=bool), [], 0
                    for at in range(0, len(own) if len(away) else 0, step):
                        mine = own[at : at + step]
                        ok = (_bits_apart(part[3][mine][:, None], part[3][away][None, :]) <= loose) & (part[1][mine][:, None] != part[1][away][None, :])
                        met |= ok.any(axis=0)
                        n += int(ok.sum())
                        if n <= len(own):
                            l, r = np.nonzero(ok)
                            between.append((mine[l], away[r]))
                    if n <= len(own):
                        for a, b in between:
                            yield _links(part[2][a], part[2][b], False)
                    else:
                        own = np.concatenate([own, away[met]])
                    # One row for each part of the family that the hub is not connected to yet.
                    to = label[rest[hub] - i]
                    parts, first = np.unique(label[rest[own] - i], return_index=True)
                    more = own[first[parts != to]]
                    yield _links(np.full(len(more), part[2][hub]), part[2][more], True)
                    label[np.isin(label, parts)] = to
                    rest = rest[~near]

    return run


def _exact(similarity: float):
    """src, dst: the links between texts of different groups in two blocks of a family (or in one), by the exact similarity of their shingle sets."""

    def run(key, table):
        ids, g, sizes, block = (table.column(c).to_numpy() for c in ("id", "g", "n", "block"))
        low, high = key[1].as_py(), key[2].as_py()
        sets = table.column("s").combine_chunks()
        flat, which = sets.flatten().to_numpy(), np.repeat(np.arange(len(ids)), np.diff(sets.offsets.to_numpy()))
        _, at, counts = np.unique(flat, return_inverse=True, return_counts=True)
        often = np.flatnonzero(counts > 1)
        place = np.full(len(counts), -1)
        place[often] = np.arange(len(often))
        at, which = place[at][place[at] >= 0], which[place[at] >= 0]
        shared = np.zeros((len(ids), len(ids)), dtype=np.float32)
        for c in range(0, len(often), 4096):
            own = (at >= c) & (at < c + 4096)
            m = np.zeros((len(ids), min(4096, len(often) - c)), dtype=np.float32)
            m[which[own], at[own] - c] = 1
            shared += m @ m.T
        alike = shared >= similarity * (sizes[:, None] + sizes[None, :] - shared)
        alike &= (g[:, None] != g[None, :]) & (ids[:, None] < ids[None, :])
        if low != high:
            alike &= block[:, None] != block[None, :]
        a, b = np.nonzero(alike)
        return pa.table({"src": pa.array(ids[a]), "dst": pa.array(ids[b])})

    return run


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = NEAR_SHINGLE, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """doc_id, component_id for every document with words. Documents are linked whose sets of `shingle` words have a Jaccard similarity of at
    least `similarity`: the fingerprints name the candidates, the sets decide. The component is the smallest id reached.

    Rows of one doc_id are one document, of which the text with the smallest component counts; null ids and texts without words are linked to nothing."""
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    tables, bits = plan_tables(src.count(), similarity)
    width = plan_width(tables, bits)

    def run(batches):
        for b in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in b.column("text")]
            same = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
            wide = [wide_fingerprint(x, width).tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(same, pa.binary()), pa.array(wide, pa.binary())], names=["doc_id", "same", "wide"])

    docs = cut(src.mapInArrow(run, "doc_id long, same binary, wide binary").filter("same is not null"))
    classes = cut(docs.groupBy("same", "wide").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")))

    def slices(batches):
        weights = 1 << np.arange(bits, dtype=np.int64)
        words = [0, *(1 + t % (width - 1) for t in range(tables))]
        for b in batches:
            raw = np.frombuffer(b"".join(b.column("wide").to_pylist()), dtype=np.uint8).reshape(-1, 8 * width)
            flat = np.unpackbits(raw, axis=1, bitorder="little")[:, : tables * bits].reshape(-1, tables, bits).astype(np.int64)
            values = (flat * weights).sum(axis=2)
            picked = raw.view("<i8")[:, words]
            lists = [pa.array(m.tolist(), pa.list_(pa.int64())) for m in (values, picked[:, 1:])]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.ascontiguousarray(picked[:, 0])), *lists], names=["id", "head", "v", "alt"])

    parts = classes.mapInArrow(slices, "id long, head long, v array<bigint>, alt array<bigint>")
    parts = parts.select("id", "head", F.posexplode(F.arrays_zip("v", "alt")).alias("t", "z")).select("id", "head", F.col("z.v").alias("v"), "t", F.col("z.alt").alias("alt"))
    # Bits may differ in 4.5 standard deviations more than at the threshold, in one word and then in the whole fingerprint.
    share = differing_share(similarity)
    most = lambda n: int(n * share + 4.5 * (n * share * (1 - share)) ** 0.5)
    loose = most(64)
    wide = classes.select("id", "wide")
    word = lambda c, k: F.conv(F.hex(F.substring(c, 8 * k + 1, 8)), 16, -10).cast("long")
    apart = sum((F.bit_count(word("wa", k).bitwiseXOR(word("wb", k))) for k in range(width)), F.lit(0))

    def sets(batches):
        for b in batches:
            got = [shingle_set(t.as_py(), shingle).view(np.int64) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, pa.list_(pa.int64()))], names=["id", "s"])

    def linked(pairs: DataFrame) -> DataFrame:
        both = pairs.distinct().join(wide.select(F.col("id").alias("a"), F.col("wide").alias("wa")), "a").join(wide.select(F.col("id").alias("b"), F.col("wide").alias("wb")), "b")
        near = cut(both.filter(apart <= most(64 * width)).select("a", "b").distinct())
        used = near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        texts = stored(src.join(used, "doc_id", "left_semi").mapInArrow(sets, "id long, s array<bigint>"), "near-sets")
        both = near.join(texts.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(texts.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        alike = shared / (F.size("sa") + F.size("sb") - shared) >= similarity
        return both.filter(alike).select(F.col("a").alias("src"), F.col("b").alias("dst"))

    def family_links(families: DataFrame, groups: DataFrame) -> DataFrame:
        """Links inside families of texts that are much alike, block by block. A text of which more shingles than the threshold lets differ are in no other text of
        any family has none."""
        texts = stored(src.join(families.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").mapInArrow(sets, "id long, s array<bigint>"), "near-families")
        once = texts.select("id", F.explode("s").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("id")).filter("k = 1").groupBy("id").agg(F.count(F.lit(1)).alias("own"))
        able = texts.withColumn("n", F.size("s").cast("long")).join(once, "id", "left").filter(F.col("n") - F.coalesce("own", F.lit(0)) >= similarity * F.col("n")).drop("own")
        able = able.join(families.select(F.col("node").alias("id"), F.col("component").alias("family")), "id").join(groups.select(F.col("node").alias("id"), F.col("component").alias("c")), "id", "left")
        able = able.select("id", "family", F.coalesce("c", "id").alias("g"), "n", "s")
        blocks = able.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / float(_FAMILY)).cast("int").alias("blocks"))
        placed = able.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        placed = placed.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        return placed.select("family", "low", "high", "id", "g", "n", "block", "s").groupBy("family", "low", "high").applyInArrow(_exact(similarity), "src long, dst long")

    # Texts with an equal slice are linked to few others, which gathers large groups; then every bucket of slices at most 2 bits apart pairs its
    # texts of different groups, so nothing is left out and no group is paired with itself.
    bucket = lambda v: (F.col("t").cast("long") * F.lit(1 << 40) + v).alias("x")
    met = parts.select(bucket(F.col("v")), "head", "alt", "id").repartition("x").sortWithinPartitions("x", "head", "id")
    groups = cut(components(linked(met.mapInArrow(_gather(loose), "a long, b long"))))
    flips = F.array(*[F.lit(0).cast("long")], *[F.lit(1 << k).cast("long") for k in range(bits)])
    grouped = parts.join(groups, F.col("id") == F.col("node"), "left").withColumn("g", F.coalesce("component", "id"))

    keyed = grouped.select("t", "g", "id", "head", F.posexplode(F.transform(flips, lambda x: F.col("v").bitwiseXOR(x))).alias("k", "y"))
    keyed = keyed.select(bucket(F.col("y")), "g", "id", "head", F.col("k").cast("tinyint").alias("k")).repartition("x").sortWithinPartitions("x", "g", "id")
    met = cut(keyed.mapInArrow(_across(loose), "a long, b long, family boolean").distinct())
    links = groups.filter("node <> component").select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(linked(met.filter("not family").select("a", "b")))
    crowds = met.filter("family and a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    if not crowds.isEmpty():
        links = links.unionByName(stored(family_links(components(forest(crowds)), groups), "near-family-links"))
    found = components(links)
    named = cut(classes.join(found, F.col("id") == F.col("node"), "left").select("same", F.coalesce("component", "id").alias("component_id"), "n"))
    return join_groups(docs.select("doc_id", "same"), named, "same", "n", docs.count()).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def drop_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """df without the documents that are linked to one with a smaller id; of each group one document stays."""
    found = near_duplicates(df, id_col, text_col, **settings)
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__gone"))
    return df.join(gone, F.col(f"`{id_col}`") == F.col("__gone"), "left_anti")
