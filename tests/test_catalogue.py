"""Each registered query against its SQL, run by DuckDB on the same tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries that SQL can't express, and the tests that hold their operators against brute force or a known answer.
TESTED = {
    "communities_cpm": "test_graph.py::test_two_triangles",
    "communities_louvain": "test_graph.py::test_two_triangles",
    "communities_lpa": "test_graph.py::test_two_triangles",
    "spectral_vectors": "test_operators.py::test_spectral_embedding_by_its_products",
    "shortest_composable_path": "test_graph.py::test_derivations_against_brute_force",
}
NAMES = [(m.__name__.rsplit(".", 1)[1], n) for m in entry.MODULES for n in m.QUERIES]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("module,name", NAMES)
def test_query(spark, sf_dir, duck, module, name):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert name in TESTED, f"{name} has neither SQL nor a test of its own"
        return
    found = duck.sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[k]) for k in at) for r in found.fetchall()), key=str)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
