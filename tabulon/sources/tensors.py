"""Tensor files (JSON header, then little-endian data), the indented checkpoint text, and images."""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators.encode import IMAGE_EXTENSIONS

#: Element types of tensor files.
TYPES = {"BOOL": "u1", "U8": "u1", "I8": "i1", "I16": "<i2", "U16": "<u2", "F16": "<f2", "BF16": "<u2", "I32": "<i4", "U32": "<u4", "F32": "<f4", "I64": "<i8", "U64": "<u8", "F64": "<f8"}
IMAGES = "{" + ",".join(IMAGE_EXTENSIONS) + "}"


def parse_header(raw: bytes) -> tuple[dict, int]:
    """name -> {dtype, shape, data_offsets}, and where the data begins. Raises ValueError on a damaged file."""
    if len(raw) < 8:
        raise ValueError("too short for a header")
    n = struct.unpack("<Q", raw[:8])[0]
    if 8 + n > len(raw):
        raise ValueError("the header is longer than the file")
    head = {k: v for k, v in json.loads(raw[8 : 8 + n]).items() if k != "__metadata__"}
    for name, t in head.items():
        a, b = t["data_offsets"]
        size = np.dtype(TYPES[t["dtype"]]).itemsize * int(np.prod(t["shape"], dtype=np.int64))
        if not 0 <= a <= b <= len(raw) - 8 - n or b - a != size:
            raise ValueError(f"offsets of {name} do not fit")
    return head, 8 + n


def tensors(raw: bytes) -> dict[str, np.ndarray]:
    """All tensors as doubles."""
    head, at = parse_header(raw)
    out = {}
    for name, t in head.items():
        a, b = t["data_offsets"]
        x = np.frombuffer(raw[at + a : at + b], dtype=TYPES[t["dtype"]])
        if t["dtype"] == "BF16":
            x = (x.astype(np.uint32) << 16).view(np.float32)
        out[name] = x.astype(np.float64).reshape(t["shape"])
    return out


def dump_tensors(arrays: dict[str, np.ndarray]) -> bytes:
    """Doubles to a tensor file."""
    head, body, at = {}, [], 0
    for name, x in arrays.items():
        raw = np.ascontiguousarray(x, dtype="<f8").tobytes()
        head[name] = {"dtype": "F64", "shape": list(np.shape(x)), "data_offsets": [at, at + len(raw)]}
        body.append(raw)
        at += len(raw)
    j = json.dumps(head).encode()
    return struct.pack("<Q", len(j)) + j + b"".join(body)


def read_tensors(spark: SparkSession, path: str) -> DataFrame:
    """One row per leading index; a vector is a column, a matrix the columns name:0, name:1, ... All leading sizes must agree. Files are parsed on executors."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    first = files.limit(1).first()
    if first is None:
        raise ValueError(f"no tensor file at {path}")
    head, _ = parse_header(bytes(first["content"]))
    leads = {t["shape"][0] if t["shape"] else 1 for t in head.values()}
    if len(leads) != 1:
        raise ValueError("leading sizes differ")
    names = [n if len(t["shape"]) < 2 else f"{n}:{k}" for n, t in head.items() for k in range(int(np.prod(t["shape"][1:])) if len(t["shape"]) > 1 else 1)]

    def run(batches):
        for b in batches:
            for raw in b.column("content"):
                cols = [c for x in tensors(raw.as_py()).values() for c in x.reshape(x.shape[0] if x.ndim else 1, -1).T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=names)

    return files.select("content").mapInArrow(run, ", ".join(f"`{n}` double" for n in names))


def resized(data: bytes, height: int, width: int, channels: int, to: tuple[int, int]) -> np.ndarray:
    """Pixels of an image (rows of BGR or grey bytes) as numbers in [0, 1], red first, at another size by the nearest pixel."""
    x = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)[:, :, ::-1]
    i = np.minimum((np.arange(to[0]) + 0.5) * height / to[0], height - 1).astype(int)
    j = np.minimum((np.arange(to[1]) + 0.5) * width / to[1], width - 1).astype(int)
    return x[i][:, j].astype(np.float64) / 255.0


def read_images(spark: SparkSession, folder: str, labelled: bool = False, size: tuple[int, int] | None = None) -> DataFrame:
    """path, stem, width, height, channels, pixels (numbers in [0, 1], null if the file can't be read), and with labelled the parent folder (a number if all are).

    All images get one size (rows, columns): the given one, or that of the first by path."""
    img = spark.read.format("image").option("dropInvalid", "false").option("pathGlobFilter", f"*.{IMAGES}").option("recursiveFileLookup", "true").load(folder).select("image.*")
    if size is None:
        first = img.filter("height > 0").select("origin", "height", "width").orderBy("origin").first()
        size = (first["height"], first["width"]) if first else (1, 1)

    def run(batches):
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("data", "height", "width", "nChannels")))
            pixels = [resized(d, h, w, n, size).ravel().tolist() if h > 0 else None for d, h, w, n in rows]
            yield pa.RecordBatch.from_arrays([b.column("origin"), b.column("nChannels"), pa.array(pixels, pa.list_(pa.float64()))], names=["path", "channels", "pixels"])

    out = img.select("origin", "height", "width", "nChannels", "data").mapInArrow(run, "path string, channels int, pixels array<double>")
    stem = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
    out = out.select("path", stem.alias("stem"), F.lit(size[1]).alias("width"), F.lit(size[0]).alias("height"), "channels", "pixels")
    if not labelled:
        return out
    out = out.withColumn("label", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    numbers = out.agg(F.bool_and(F.col("label").try_cast("double").isNotNull())).first()[0]
    return out.withColumn("label", F.col("label").cast("double")) if numbers else out


@dataclass
class Node:
    """A tree of named values: indentation nests, the first '=' separates name and value."""

    name: str
    value: str = ""
    children: list["Node"] = field(default_factory=list)

    @staticmethod
    def parse(text: str) -> "Node":
        root = Node("")
        path = [(-1, root)]
        for line in text.splitlines():
            if not line.strip():
                continue
            depth = len(line) - len(line.lstrip(" \t"))
            name, _, value = line.strip().partition("=")
            node = Node(name.strip(), value.strip())
            while path[-1][0] >= depth:
                path.pop()
            path[-1][1].children.append(node)
            path.append((depth, node))
        return root

    def get(self, dotted: str) -> "Node | None":
        node = self
        for part in dotted.split("."):
            node = next((c for c in node.children if c.name == part), None)
            if node is None:
                return None
        return node

    def number(self, dotted: str) -> float | None:
        node = self.get(dotted)
        try:
            return None if node is None else float(node.value)
        except ValueError:
            return None

    def dump(self, depth: int = -1) -> str:
        own = "" if depth < 0 else "\t" * depth + self.name + (f" = {self.value}" if self.value else "") + "\n"
        return own + "".join(c.dump(depth + 1) for c in self.children)
