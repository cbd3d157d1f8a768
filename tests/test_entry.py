"""Every registered query of the engine against its SQL, and the entry points."""

import datetime
import importlib
import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from jobs.queries import ORACLE_SQL as JOBS_SQL
from jobs.queries import QUERIES as JOBS
from quillmine.plans.queries import ORACLE_SQL, QUERIES

EMPTY = {"bm25_syntax_error"}


def norm(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return [norm(v) for v in value]
    return value.isoformat() if isinstance(value, (datetime.date, datetime.datetime)) else value


@pytest.fixture(scope="module")
def duck(small):
    db = duckdb.connect()
    for f in os.listdir(small):
        db.execute(f"create view {f.removesuffix('.parquet')} as select * from '{small}/{f}'")
    return db


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_is_its_sql(name, spark, small, duck):
    df = QUERIES[name](spark, small)
    names = sorted(df.columns)
    got = sorted(([norm(r[c]) for c in names] for r in df.collect()), key=str)
    want = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == names
    rows = sorted(([norm(r[columns.index(c)]) for c in names] for r in want.fetchall()), key=str)
    assert got == rows
    assert bool(rows) != (name in EMPTY) or name == "knn_site_postfilter"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(name, spark, small):
    assert QUERIES[name](spark, small).count() > 0


def test_entry_points(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns == ["chunk_id", "bm25"]


def test_entry_without_what_the_training_data_needs(monkeypatch):
    for name in ("quillmine.llm", "quillmine.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    assert set(importlib.reload(entry).queries()) == set(QUERIES) | set(JOBS) and set(entry.oracle_sql()) == set(ORACLE_SQL) | set(JOBS_SQL)
    monkeypatch.undo()
    importlib.reload(entry)
