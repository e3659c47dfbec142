"""Secret scans with a recursive decoding worklist.

A text is scanned for three kinds of secrets. Then every encoded layer in it is unwrapped and scanned in turn: percent escapes and
Unicode escapes (\\uXXXX, \\UXXXXXXXX, \\u{X}, \\xXX, &#N;) are replaced in place, base64 runs (also URL-safe, also in lines) are decoded, and
decoded bytes with the magic of gzip, zlib, bzip2, xz or zstd are decompressed. Each new layer goes on the worklist until no layer gives a new one; a layer that was seen before for the same place is
not taken again, so cycles (an archive of itself) end. Every layer carries, for each of its characters, the span of the original text it came from, and a
match in it is reported as that span: of plain base64 the characters that carry it, of a compressed layer the whole run.

Defined results: null and empty texts have no spans. Layers are whole: all members and frames of an archive are read. A decompressed layer is streamed and scanned in
windows of about WINDOW characters, which end where no match and no encoded run goes on; n_cut, the number of layers not read to their end, is 0. Repeated rows give equal rows. The scan is row by row: nothing is shuffled or kept.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a decompressed layer that are scanned at once, and bytes that are decompressed at once.
WINDOW, STEP = 1 << 20, 1 << 20

#: The kinds, in order, with their patterns and least lengths.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = {"assign": 0, "access": 1, "hex": 2}
_WORDS = ("passw", "secret", "token", "apikey", "api_key")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_BASE64 = re.compile(r"(?:[A-Za-z0-9+/_-]{48,}\r?\n)+[A-Za-z0-9+/_-]*={0,2}|[A-Za-z0-9+/_-]{16,}={0,2}")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
#: Places that no match and no encoded run reaches across.
_BREAK = re.compile(r"""(?<=[^\s:="']) (?=[A-Za-z0-9])|(?<![A-Za-z0-9+/_\r-])\n|[^ -~\r\n]""")
_URL_SAFE = str.maketrans("-_", "+/")


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """The base matches of one layer, per kind leftmost and without overlap."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


class Layer:
    """A text with, per character, the span of the original that it stands for; no arrays for the original itself."""

    __slots__ = ("text", "starts", "ends")

    def __init__(self, text: str, starts=None, ends=None):
        self.text, self.starts, self.ends = text, starts, ends

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        return int(self.starts[start]), int(self.ends[end - 1])

    def arrays(self):
        if self.starts is None:
            n = len(self.text)
            return np.arange(n, dtype=np.int64), np.arange(1, n + 1, dtype=np.int64)
        return self.starts, self.ends


def _replaced(layer: Layer, pieces) -> Layer:
    """A layer in which each (start, end, chars, widths) of pieces is replaced by chars, of which each stands for so many characters."""
    starts, ends = layer.arrays()
    text, s, e, at = [], [], [], 0
    for a, b, chars, widths in pieces:
        text += [layer.text[at:a], chars]
        stop = a + np.cumsum(widths)
        s += [starts[at:a], starts[stop - widths]]
        e += [ends[at:a], ends[stop - 1]]
        at = b
    return Layer("".join([*text, layer.text[at:]]), np.concatenate([*s, starts[at:]]), np.concatenate([*e, ends[at:]]))


def _percent(layer: Layer) -> Layer | None:
    pieces = []
    for m in _PERCENT.finditer(layer.text):
        raw = binascii.unhexlify(m[0].replace("%", ""))
        try:
            chars = raw.decode()
        except UnicodeDecodeError:
            chars = raw.decode("latin-1")
            widths = np.full(len(chars), 3)
        else:
            widths = np.array([3 * len(c.encode()) for c in chars])
        pieces.append((m.start(), m.end(), chars, widths))
    return _replaced(layer, pieces) if pieces else None


def _unicode(layer: Layer) -> Layer | None:
    pieces = []
    for m in _ESCAPE.finditer(layer.text):
        point = int(m[6]) if m[6] else int(next(g for g in m.groups()[:5] if g), 16)
        if point <= 0x10FFFF and not 0xD800 <= point <= 0xDFFF:
            pieces.append((m.start(), m.end(), chr(point), np.array([m.end() - m.start()])))
    return _replaced(layer, pieces) if pieces else None


_ERRORS = (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError)  # damaged data


class _Source:
    """The chunks of an iterator as a file."""

    def __init__(self, chunks):
        self.chunks, self.left = iter(chunks), b""

    def read(self, size: int = -1) -> bytes:
        if not self.left:
            self.left = next(self.chunks, b"")
        size = len(self.left) if size < 0 else size
        out, self.left = self.left[:size], self.left[size:]
        return out


def _opener(head: bytes):
    """Makes a decompressor for data with this beginning; None without a known magic."""
    if head[:2] == b"\x1f\x8b":
        return lambda: zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 2 and (head[0] * 256 + head[1]) % 31 == 0:
        return zlib.decompressobj
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor
    if head[:6] == b"\xfd7zXZ\x00":
        return lambda: lzma.LZMADecompressor(memlimit=256 << 20)
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return zstandard.ZstdDecompressor
    return None


def _unpacked(chunks, new):
    """Decompressed chunks of all members, up to the end or the first damage."""
    try:
        d = new()
        if isinstance(d, zstandard.ZstdDecompressor):
            with d.stream_reader(_Source(chunks), read_across_frames=True) as r:
                while out := r.read(STEP):
                    yield out
            return
        for chunk in chunks:
            while chunk:
                if d.eof:
                    d = new()
                while True:
                    out = d.decompress(chunk, STEP)
                    if out:
                        yield out
                    if d.eof:
                        chunk = d.unused_data
                        break
                    chunk = getattr(d, "unconsumed_tail", b"")
                    if not chunk and len(out) < STEP:
                        break
    except _ERRORS:
        pass


def _windows(chunks):
    """The text of the chunks in windows that end at breaks; a run without a break stays whole."""
    decoder, text, looked = codecs.getincrementaldecoder("utf-8")("replace"), [], 0
    for chunk in chunks:
        text.append(decoder.decode(chunk))
        looked += len(text[-1])
        if looked >= WINDOW:
            last = text[-1]
            at = max((m.end() for m in _BREAK.finditer(last, max(1, len(last) - (1 << 16)))), default=0) or max((m.end() for m in _BREAK.finditer(last, 1)), default=0)
            if 0 < at < len(last):
                yield "".join([*text[:-1], last[:at]])
                text, looked = [last[at:]], len(last) - at
    text.append(decoder.decode(b"", True))
    if any(text):
        yield "".join(text)


def _legible(raw: bytes) -> str | None:
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return text if text and (text.isprintable() or len(_CONTROL.findall(text)) <= 0.3 * len(text)) else None


def _decoded(run: str):
    """(the windows of the text that a base64 run holds, whether it was compressed, any number of times); None if it holds none."""
    body = run.replace("\r", "").replace("\n", "").rstrip("=").translate(_URL_SAFE)
    body = body[: len(body) - (len(body) % 4 == 1)]
    try:
        raw = base64.b64decode(body + "=" * (-len(body) % 4))
    except ValueError:
        return None
    head, rest, depth, seen = raw, iter(()), 0, set()
    while (new := _opener(head)) and head not in seen and next(_unpacked([head], new), None):
        seen.add(head)
        rest, head, depth = _unpacked(chain([head], rest), new), b"", depth + 1
        for chunk in rest:
            head += chunk
            if len(head) >= STEP:
                seen.clear()  # too long for an archive of itself
                break
    if depth:  # compressed text need not be printable throughout
        return _windows(chain([head], rest)), True
    text = _legible(raw)
    return None if text is None else ([text], False)


def _places(run: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where in a base64 run each character of its plain text begins and ends: byte k lies in the sextets from 8 k // 6 to (8 k + 7) // 6."""
    used = np.flatnonzero(~np.isin(np.frombuffer(run.encode("utf-32-le"), dtype=np.uint32), (10, 13)))
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    after = np.cumsum(1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000))
    before = np.concatenate([[0], after[:-1]])
    return used[before * 8 // 6], used[(after * 8 - 1) // 6] + 1


def _base64(layer: Layer):
    """A layer for each window of each run that decodes; if a run does not, it is tried without a short last line, then in parts between separators."""
    for m in _BASE64.finditer(layer.text):
        tries = [(m.start(), m.end())]
        while tries:
            a, b = tries.pop()
            found = _decoded(layer.text[a:b])
            if found is not None:
                texts, compressed = found
                s, e = layer.span(a, b)
                for text in texts:
                    if compressed:
                        yield Layer(text, np.full(len(text), s), np.full(len(text), e))
                        continue
                    first, last = _places(layer.text[a:b], text)
                    plain = layer.starts is None
                    yield Layer(text, a + first if plain else layer.starts[a + first], a + last if plain else layer.ends[a + last - 1])
            elif (a, b) == m.span():
                if re.search("[/_+-]", m[0]):
                    tries += [(a + p.start(), a + p.end()) for p in re.finditer(r"[A-Za-z0-9]{16,}={0,2}", m[0]) if p.span() != (0, len(m[0]))]
                if (end := m[0].rfind("\n")) >= 0:
                    tries.append((a, a + end))


def scan(text: str | None) -> tuple[list, list, int]:
    """(base spans, all spans, number of cut layers); spans are (start, rank of kind, end, kind), sorted."""
    first = Layer(text or "")
    base = sorted({(s, KINDS[k], e, k) for k, s, e in find_spans(first.text)})
    every, work, seen = set(base), [iter([first])], set()
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if layer is not first:
            if not layer.text:
                continue
            key = (hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), int(layer.starts[0]), int(layer.ends[-1]))
            if key in seen:
                continue
            seen.add(key)
            for k, s, e in find_spans(layer.text):
                a, b = layer.span(s, e)
                every.add((a, KINDS[k], b, k))
        work.append(_inner(layer))
    return base, sorted(every), 0


def _inner(layer: Layer):
    """The layers that one layer holds."""
    if "%" in layer.text and (x := _percent(layer)):
        yield x
    if ("\\" in layer.text or "&#" in layer.text) and (x := _unicode(layer)):
        yield x
    yield from _base64(layer)


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, base and spans (arrays of struct(kind, start, end)), n_cut."""

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        shape = lambda xs: [{"kind": k, "start": s, "end": e} for s, _, e, k in xs]
        for b in batches:
            base, every, cuts = [], [], []
            for t in b.column("text"):
                x, y, n = scan(t.as_py())
                base.append(shape(x))
                every.append(shape(y))
                cuts.append(n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(base, kind), pa.array(every, kind), pa.array(cuts, pa.int64())], names=["doc_id", "base", "spans", "n_cut"])

    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"doc_id long, base {span}, spans {span}, n_cut long")


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    line = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[n(k) for k in KINDS], F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"), "n_cut")
