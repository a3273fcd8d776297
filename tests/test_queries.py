"""Every query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from eventloom import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    link = duckdb.connect()
    for t in TABLES:
        link.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return link


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    return repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, oracle, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    if name not in queries.ORACLE_SQL:
        assert got
        return
    found = oracle.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(_plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_entry_survives_without_the_optional_operators(monkeypatch):
    import importlib
    import sys

    for gone in ("corpus_pipeline", "eventloom.llm", "eventloom.llm.queries"):
        monkeypatch.setitem(sys.modules, gone, None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(queries.QUERIES)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
