import pytest

from tabulon import catalog
from tests.oracle import connect, oracle_rows, rows_of


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, sf, con, name):
    got = rows_of(catalog.QUERIES[name](spark, sf))
    if name in catalog.ORACLES:
        assert got == oracle_rows(con, catalog.ORACLES[name])
    else:
        assert got[1]


def test_eigenvalues_take_all_dimensions(spark, sf):
    import numpy as np

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("label", "embedding").collect()
    got = catalog.QUERIES["linalg_eigenvalues_by_label"](spark, sf).collect()
    for label in {r["label"] for r in rows}:
        x = np.array([r["embedding"] for r in rows if r["label"] == label], dtype=float)
        want = np.linalg.eigvalsh(x.T @ x / len(x))
        assert np.allclose([r["v"] for r in sorted(got, key=lambda r: r["j"]) if r["label"] == label], want, atol=2e-6)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
