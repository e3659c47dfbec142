"""The five stages against brute force."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tabulon.llm import mixing, quality
from tests.llm.test_ops import SCHEMA, lower


@pytest.fixture(scope="module")
def kept(spark, sf):
    """What each stage returns, by name, and documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {"documents": docs.collect()}
    columns = docs.columns
    for k, (name, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
        out[name] = docs.collect()
        docs = spark.createDataFrame(out[name], docs.schema)
    return out


def test_stages(spark, sf, kept):
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash_near_dedup", "source_mix", "piece_encoding"]
    marked = quality.op10_quality_rules(spark, sf).filter("kept").select("doc_id").collect()
    assert {r["doc_id"] for r in kept["quality_rules"]} == {r[0] for r in marked}
    best = {}
    for r in kept["quality_rules"]:
        best[lower(r["text"])] = max(best.get(lower(r["text"]), -1), r["doc_id"])
    assert {r["doc_id"] for r in kept["exact_dedup"]} == set(best.values())
    shingles = {}
    for r in kept["exact_dedup"]:
        w = lower(r["text"]).split()
        shingles[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    left = {r["doc_id"] for r in kept["simhash_near_dedup"]}
    alike = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    assert all(max(alike(i, j) for j in shingles if j != i) >= 0.8 for i in set(shingles) - left)
    ids = sorted(left)
    assert not [(a, b) for k, a in enumerate(ids) for b in ids[:k] if alike(a, b) >= 0.8]
    near = spark.createDataFrame(kept["simhash_near_dedup"], spark.read.parquet(f"{sf}/documents.parquet").schema)
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(near).collect() if r["size"]}
    got = collections.Counter(r["doc_id"] for r in kept["source_mix"])
    assert got == {i: n for i, n in want.items() if n}
    assert collections.Counter(r["doc_id"] for r in kept["piece_encoding"]) == got


def test_run(spark, sf, kept):
    rows = pipeline.run(spark, sf).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in rows) == sorted((r["doc_id"], r["n_tokens"]) for r in kept["piece_encoding"])


def test_odd_and_empty_tables(spark, sf):
    """Nulls, empty texts and repeated texts, with extra columns: what each stage leaves of them."""
    data = [(k, t, None, None, None, "x", 1, 2) for k, t in enumerate([None, "", "the and " + "word " * 3] * 2)] + [(None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(data, SCHEMA)
    left = {name: sorted((r["doc_id"] for r in stage(spark, docs, sf).collect()), key=str) for name, stage in pipeline.STAGES}
    assert left["quality_rules"] == []  # under 50 words
    assert left["exact_dedup"] == [4, 5]  # of equal texts the largest id, null being empty
    assert left["simhash_near_dedup"] == [0, 1, 2, 3, 4, None]  # of linked texts the smallest id; texts without words are linked to nothing
    assert left["source_mix"] == [2, 5]  # one source, every word of it
    assert left["piece_encoding"] == [0, 1, 2, 3, 4, 5, None]
    assert all(stage(spark, docs.limit(0), sf).count() == 0 for _, stage in pipeline.STAGES)
    columns = [stage(spark, docs, sf).columns for _, stage in pipeline.STAGES[:-1]]
    assert all(c == docs.columns for c in columns)


def test_scratch_deletes_all_but_what_is_kept(spark):
    import os

    from tabulon.session import cut, scratch, stored

    folder = lambda df: df.inputFiles()[0].rpartition("/")[0].removeprefix("file:")
    with scratch(spark) as outer:
        with scratch(spark) as keep:
            gone = stored(spark.range(5), "t")
            cut(gone)
            out = keep(stored(gone.filter("id > 1"), "t"))
        assert not os.path.exists(folder(gone)) and out.count() == 3
        outer(out)
    assert out.count() == 3
    with scratch(spark):
        last = stored(out, "t")
    assert not os.path.exists(folder(last))
