"""Text tables: delimited files, attribute-relation files, folders and archives of them. All cells are strings until they are typed."""

from __future__ import annotations

import csv
import io
import itertools
import os
import re
import zipfile
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.guards import NUMBER, strict_double

#: Cells that the loader blanks.
BLANKED = ("NA", "NaN", "nan")


#: Bytes of a file that are read at first to find its first record.
HEAD = 1 << 16
KINDS = {".csv": ",", ".data": ",", ".txt": ",", ".tsv": "\t"}


def first_records(spark: SparkSession, paths: list[str], sep: str = ",") -> dict[str, list[str] | None]:
    """The cells of each file's first record, None for an empty file; only the beginnings are read, through Spark's own file systems."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = {}
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        length, size = fs.getFileStatus(p).getLen(), HEAD
        while True:
            stream = fs.open(p)
            try:
                raw = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, min(size, length))))
            finally:
                stream.close()
            records = list(itertools.islice((r for r in csv.reader(io.StringIO(raw.decode("utf-8", "replace"), newline=""), delimiter=sep) if r), 2))
            # A second record proves that the first one is whole.
            if len(records) > 1 or size >= length:
                break
            size *= 8
        out[path] = records[0] if records else None
    return out


def header_of(cells: list[str]) -> tuple[list[str], bool]:
    """(column names, whether the first record names them): it is data if every cell is a number."""
    number = re.compile(NUMBER)
    headless = all(number.match(c.strip()) for c in cells)
    return ([f"col_{i}" for i in range(len(cells))] if headless else cells), not headless


def _cleaned(cell):
    return F.when(F.coalesce(cell, F.lit("")).isin(*BLANKED), "").otherwise(F.coalesce(cell, F.lit("")))


def files_of(spark: SparkSession, path: str) -> list[str]:
    """The file itself, or the data files of a folder of parts."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.getFileStatus(p).isDirectory():
        return [path]
    found = [s.getPath() for s in fs.listStatus(p) if s.isFile()]
    return sorted(f.toString() for f in found if not f.getName().startswith(("_", ".")))


def read_csv(spark: SparkSession, path: str | list[str], sep: str = ",", multiline: bool = True) -> DataFrame:
    """A delimited file, a folder of parts, or files with one header, as strings.

    Quoted cells may hold separators, doubled quotes and line breaks. A first record in which every cell is a number is data; columns are then col_0, col_1, ... Rows
    are cut or padded with "" to the width of the first. NA, NaN and nan become "". Files without any record have no columns. Without multiline, files are
    split over tasks, and a quoted cell ends with its line."""
    paths = [f for p in ([path] if isinstance(path, str) else path) for f in files_of(spark, p)]
    # Parts without a record, which Spark writes for empty partitions, say nothing of the columns.
    first = next((c for p in paths if (c := first_records(spark, [p], sep)[p])), None)
    if first is None:
        return spark.createDataFrame([], "`_empty` string").drop("_empty")
    names, header = header_of(first)
    schema = ", ".join(f"`c{i}` string" for i in range(len(names)))
    raw = spark.read.csv(paths, schema=schema, header=header, sep=sep, quote='"', escape='"', mode="PERMISSIVE", multiLine=multiline, enforceSchema=True, nullValue="\0")
    return raw.select(*[_cleaned(F.col(f"c{i}")).alias(n) for i, n in enumerate(names)], *([F.col("_metadata.file_path").alias("_file")] if not isinstance(path, str) else []))


def parse_arff_header(lines) -> tuple[list[tuple[str, list[str] | None]], int]:
    """(name, categories or None for numeric) of each attribute, and the number of lines up to and including @data."""
    attrs, n = [], 0
    for n, line in enumerate(lines, 1):
        s = line.strip()
        if not s or s.startswith("%"):
            continue
        low = s.lower()
        if low.startswith("@data"):
            break
        m = re.match(r"@attribute\s+('(?:[^']*)'|\S+)\s+(.*)$", s, re.I)
        if m:
            name, kind = m[1].strip("'"), m[2].strip()
            attrs.append((name, split_quoted(kind[1:-1]) if kind.startswith("{") and kind.endswith("}") else None))
    return attrs, n


def split_quoted(line: str) -> list[str]:
    """Fields between commas; single quotes toggle quoting; fields are trimmed."""
    out, now, inside = [], [], False
    for ch in line:
        if ch == "'":
            inside = not inside
        elif ch == "," and not inside:
            out.append("".join(now).strip())
            now = []
        else:
            now.append(ch)
    return [*out, "".join(now).strip()]


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """Rows after @data; numeric attributes as doubles (anything else NULL), categories as strings with their values in the column's metadata."""
    numbered = spark.read.text(path, wholetext=False)
    head = []
    for r in numbered.toLocalIterator():
        head.append(r[0])
        if r[0].strip().lower().startswith("@data"):
            break
    attrs, _ = parse_arff_header(head)
    body = numbered.filter(~F.trim("value").rlike("^(%|@|$)"))
    cells = F.transform(F.split("value", r",(?=(?:[^']*'[^']*')*[^']*$)"), lambda c: F.replace(F.trim(c), F.lit("'"), F.lit("")))
    rows = body.select(cells.alias("c"))
    cols = []
    for i, (name, values) in enumerate(attrs):
        cell = F.get("c", F.lit(i))
        cols.append(strict_double(cell).alias(name) if values is None else cell.alias(name, metadata={"kind": "categorical", "values": values}))
    return rows.select(*cols)


def group_of(name: str, hashes: set[str] = frozenset()) -> tuple[str, str]:
    """(group, hash) of a file name: HASH__group.ext; a stem that is a known hash belongs to the group of its extension; else both are the stem."""
    base, ext = os.path.splitext(os.path.basename(name))
    if "__" in base:
        key, _, group = base.partition("__")
        return group, key
    if base in hashes:
        return ext.lstrip("."), base
    return base, base


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the files below a folder, by Spark's own file system."""
    return sorted(r[0] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path").collect())


def _group_column(file, hashes: set[str]):
    """The hash of group_of() as an expression of a file's path."""
    base = F.regexp_extract(file, r"([^/]*)$", 1)
    stem = F.regexp_replace(base, r"(.)\.[^.]*$", "$1")
    return F.when(stem.contains("__"), F.substring_index(stem, "__", 1)).otherwise(stem)


def _united(frames: list[DataFrame]) -> DataFrame:
    one = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return one.fillna("", [c for c, t in one.dtypes if t == "string"])


def read_folder(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """group -> table with a _hash column. Files of one group and header are one scan; different headers are united by column name, absent cells are ""."""
    files = [f for f in list_files(spark, folder) if f.lower().endswith((*KINDS, ".arff"))]
    hashes = {os.path.basename(f).partition("__")[0] for f in files if "__" in os.path.basename(f)}
    alike: dict[tuple, list[str]] = {}
    groups: dict[str, list[DataFrame]] = {}
    for sep in set(KINDS.values()):
        some = [f for f in files if KINDS.get(os.path.splitext(f.lower())[1]) == sep]
        for f, cells in first_records(spark, some, sep).items():
            if cells:
                names, header = header_of(cells)
                alike.setdefault((group_of(f, hashes)[0], sep, tuple(names), header), []).append(f)
    for (group, sep, _, _), paths in alike.items():
        df = read_csv(spark, paths, sep)
        groups.setdefault(group, []).append(df.withColumn("_hash", _group_column(F.col("_file"), hashes)).drop("_file"))
    for f in files:
        if f.lower().endswith(".arff"):
            group, key = group_of(f, hashes)
            groups.setdefault(group, []).append(read_arff(spark, f).withColumn("_hash", F.lit(key)))
    return {g: _united(frames) for g, frames in groups.items()}


def _zip_records(raw: bytes):
    """(member, separator, records) of the delimited members of an archive; nothing is unpacked to disk."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for m in z.namelist():
            if os.path.isabs(m) or ".." in m.replace("\\", "/").split("/"):
                raise ValueError(f"unsafe path in archive: {m}")
            sep = KINDS.get(os.path.splitext(m.lower())[1])
            if sep:
                with z.open(m) as f:
                    yield m, sep, (r for r in csv.reader(io.TextIOWrapper(f, "utf-8", "replace", newline=""), delimiter=sep) if r)


def read_zip(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """group -> table with a _hash column, of the delimited files in an archive (or in several, by a pattern). Members are parsed where the archive is read, a task for each."""
    archives = spark.read.format("binaryFile").load(path).select("content")

    def heads(batches):
        for b in batches:
            for raw in b.column("content"):
                got = [(m, next(rows, None)) for m, _, rows in _zip_records(raw.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in got], pa.string()), pa.array([c for _, c in got], pa.list_(pa.string()))], names=["member", "cells"])

    found = [(r["member"], r["cells"]) for r in archives.mapInArrow(heads, "member string, cells array<string>").collect() if r["cells"]]
    hashes = {os.path.basename(m).partition("__")[0] for m, _ in found if "__" in os.path.basename(m)}
    alike: dict[tuple, set[str]] = {}
    for m, cells in found:
        names, header = header_of(cells)
        alike.setdefault((group_of(m, hashes)[0], tuple(names), header), set()).add(m)
    groups: dict[str, list[DataFrame]] = {}
    for (group, names, header), members in alike.items():

        def rows(batches, names=names, header=header, members=members):
            for b in batches:
                for raw in b.column("content"):
                    for m, _, records in _zip_records(raw.as_py()):
                        if m not in members:
                            continue
                        records = itertools.islice(records, int(header), None)
                        while part := list(itertools.islice(records, 10_000)):
                            cells = [(r + [""] * len(names))[: len(names)] for r in part]
                            columns = [pa.array(["" if x in BLANKED else x for x in c], pa.string()) for c in zip(*cells)]
                            yield pa.RecordBatch.from_arrays([*columns, pa.array([group_of(m, hashes)[1]] * len(part))], names=[*(f"c{i}" for i in range(len(names))), "_hash"])

        schema = ", ".join(f"c{i} string" for i in range(len(names))) + ", _hash string"
        df = archives.mapInArrow(rows, schema)
        groups.setdefault(group, []).append(df.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], "_hash"))
    return {g: _united(frames) for g, frames in groups.items()}


def load(spark: SparkSession, path: str):
    """By extension: a table, or for archives and folders a table per group."""
    low = path.lower()
    kind = os.path.splitext(low)[1]
    if kind == ".arff":
        return read_arff(spark, path)
    if kind == ".zip":
        return read_zip(spark, path)
    if kind in KINDS:
        return read_csv(spark, path, KINDS[kind])
    if kind == ".parquet":
        return spark.read.parquet(path)
    if kind in (".sqlite", ".db"):
        raise ValueError("SQLite files are not read; use a JDBC source")
    return read_folder(spark, path)


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Sink: a folder of Parquet or CSV parts."""
    w = df.write.mode("overwrite")
    w.parquet(path) if kind == "parquet" else w.option("header", "true").csv(path)
