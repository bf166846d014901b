"""Every query with SQL gives DuckDB's rows; the others run with a stable schema."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from calltide import registry

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return v


def rows(t):
    names = sorted(t.schema.names)
    return names, sorted((tuple(map(plain, r)) for r in zip(*[t.column(n).to_pylist() for n in names], strict=True)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toArrow(), duck.sql(SQL[name]).to_arrow_table()
    assert rows(got) == rows(want)
    kinds = lambda t: {f.name: str(f.type).replace("large_", "") for f in t.schema}
    assert kinds(got) == kinds(want)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry_loads_without_the_training_subpackage(monkeypatch):
    import importlib
    import importlib.util

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n in ("calltide.llm", "corpus_pipeline") else real(n, *a))
    import __spark_entry__ as entry

    entry = importlib.reload(entry)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(SQL)
    monkeypatch.undo()
    importlib.reload(entry)
