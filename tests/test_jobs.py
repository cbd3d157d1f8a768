"""The jobs over growing input, run again, and against their SQL. No training-data operators here."""

import os
import subprocess
import sys

import duckdb
import pytest

from jobs import index_refresh, site_audit
from jobs.queries import ORACLE_SQL, QUERIES
from quillmine.operators import fts
from quillmine.operators.index import TextIndex
from quillmine.operators.term_index import TermIndex


@pytest.fixture(scope="module")
def duck(small):
    db = duckdb.connect()
    for f in os.listdir(small):
        db.execute(f"create view {f.removesuffix('.parquet')} as select * from '{small}/{f}'")
    return db


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_is_its_sql(name, spark, small, duck):
    settings = lambda: {k: spark.conf.get(k) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.streaming.schemaInference")}
    before = settings()
    df = QUERIES[name](spark, small)
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    rows = sorted((tuple(r) for r in want.fetchall()), key=str)
    assert rows and sorted((tuple(r) for r in df.select(*names).collect()), key=str) == rows
    assert before == settings()


def add(spark, folder, rows, mode="append"):
    spark.createDataFrame(rows, "doc_id long, text string, other string").coalesce(1).write.mode(mode).parquet(folder)


def test_index_takes_only_what_is_new(spark, tmp_path):
    documents, output, checkpoint = (str(tmp_path / n) for n in ("documents", "output", "checkpoint"))
    refresh = lambda: index_refresh.run(spark, documents, output, checkpoint, files_per_batch=1)
    add(spark, documents, [(1, "Alpha beta, alpha", "x"), (2, None, None), (None, "lost", "x"), (3, "", "x")])
    assert refresh() == {"batches": 1, "documents_read": 4, "documents_added": 3, "merges": 0}
    first = sorted(map(tuple, index_refresh.output_of(spark, output).collect()))
    assert first == [(1, "alpha", 2, 3, 1, 2), (1, "beta", 1, 3, 1, 1)]
    assert refresh()["batches"] == 0 and sorted(map(tuple, index_refresh.output_of(spark, output).collect())) == first
    add(spark, documents, [(4, "beta gamma", "x"), (4, "beta gamma", "x"), (1, "Alpha beta, alpha", "x")])  # one is new
    assert refresh() == {"batches": 1, "documents_read": 3, "documents_added": 1, "merges": 0}
    rows = sorted(map(tuple, index_refresh.output_of(spark, output).collect()))
    assert rows == [(1, "alpha", 2, 3, 1, 2), (1, "beta", 1, 3, 2, 2), (4, "beta", 1, 2, 2, 2), (4, "gamma", 1, 2, 1, 1)]
    for i in range(5):
        add(spark, documents, [(10 + i, f"beta word{i}", "x")])
    assert refresh() == {"batches": 5, "documents_read": 5, "documents_added": 5, "merges": 1}
    texts = {1: "alpha beta alpha", 2: None, 3: "", 4: "beta gamma", **{10 + i: f"beta word{i}" for i in range(5)}}
    whole = TextIndex.build(spark.createDataFrame(list(texts.items()), "chunk_id long, text string"))
    index = TermIndex(spark, f"{output}/index")
    for query in ("beta", "beta AND word3", "alph*", '"beta gamma"', "alpha OR gamma"):
        got, want = ({r["chunk_id"]: round(r["bm25"], 9) for r in fts.match(x, query).collect()} for x in (index, whole))
        assert got == want and got


def test_index_batch_that_runs_again(spark, tmp_path):
    """A batch that failed after it had written its delta: the next run's replaces it."""
    documents, output, checkpoint = (str(tmp_path / n) for n in ("documents", "output", "checkpoint"))
    add(spark, documents, [(1, "alpha beta", "x")])
    half = TermIndex(spark, f"{output}/index")
    half.append(spark.createDataFrame([(1, "alpha beta"), (9, "not there")], "chunk_id long, text string"), 0)
    index_refresh.run(spark, documents, output, checkpoint)
    assert sorted(map(tuple, index_refresh.output_of(spark, output).collect())) == [(1, "alpha", 1, 2, 1, 1), (1, "beta", 1, 2, 1, 1)]


def test_audit_counts(spark, tmp_path):
    pages, output = str(tmp_path / "pages"), str(tmp_path / "output")
    link = lambda *hrefs: "<title>T</title>" + "".join(f'<a href="{h}">x</a>' for h in hrefs)
    rows = [
        (1, "https://A.org/docs/", link("/docs/b", "c?utm_source=q#top", "/gone", "https://b.org/x", "mailto:x@y", "#top", "//b.org/none")), (2, "https://a.org/docs/b", link("/docs/")),
        (3, "https://a.org/docs/c", link("/gone", "/gone")), (4, "https://b.org/x", link("/docs/")), (5, "https://b.org/y", link("/docs/")), (6, "no url", "x"), (None, "https://a.org/", "x"), (7, "https://c.org/", None),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(pages)
    for _ in range(2):
        done = site_audit.run(spark, pages, output, parts=3)
        assert done == {"rows_read": 8, "pages": 6, "frontier": 3, "sites": 3, "left_out": 2}
        got = {r["page_id"]: r for r in site_audit.output_of(spark, output).collect()}
        assert {i: (r["links"], r["inside"], r["missing"], r["referrers"], r["duplicate_of"]) for i, r in got.items()} == {
            1: (5, 3, 1, 1, None), 2: (1, 1, 0, 1, None), 3: (1, 1, 1, 1, None), 4: (1, 1, 1, 1, 2), 5: (1, 1, 1, 0, 2), 7: (0, 0, 0, 0, None),
        }
        assert (got[1]["address"], got[1]["host"], got[1]["title"], got[7]["title"]) == ("https://a.org/docs/", "a.org", "T", None)
        assert (got[4]["site_pages"], got[4]["site_duplicates"], got[4]["site_missing"], got[4]["site_unreferred"], got[4]["site_frontier"]) == (2, 2, 2, 1, 2)
        frontier = {(r["host"], r["address"]): (r["referrers"], r["first_referrer"]) for r in spark.read.schema(site_audit.FRONTIER).parquet(f"{output}/frontier").collect()}
        assert frontier == {("a.org", "https://a.org/gone"): (2, 1), ("b.org", "https://b.org/docs/"): (2, 4), ("b.org", "https://b.org/none"): (1, 1)}


def test_audit_of_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    assert site_audit.run(spark, str(tmp_path / "pages"), str(tmp_path / "output"))["pages"] == 0
    assert site_audit.output_of(spark, str(tmp_path / "output")).count() == 0


def test_command_line(spark, tmp_path):
    """A job as it is started, with a configuration file and an argument that counts more."""
    spark.createDataFrame([(1, "https://a.org/", "<title>T</title>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    (tmp_path / "own.json").write_text('{"pages": "nowhere", "parts": 2}')
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run(
        [sys.executable, f"{root}/jobs/site_audit.py", "--config", str(tmp_path / "own.json"), "--pages", str(tmp_path / "pages"), "--output", str(tmp_path / "out")],
        env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell"}, cwd=tmp_path, capture_output=True, text=True, timeout=300,
    )
    assert out.returncode == 0, out.stderr[-2000:]
    assert "wrote 1 pages" in out.stderr and spark.read.parquet(str(tmp_path / "out/pages")).count() == 1


def test_audit_resolves_links_once(spark, tmp_path, monkeypatch):
    """What pages, referrers and frontier are made of is written down, not made of the pages' text for each."""
    kept, cut = [], site_audit.cut
    monkeypatch.setattr(site_audit, "cut", lambda df: kept.append(df.columns) or cut(df))
    spark.createDataFrame([(1, "https://a.org/", '<a href="/b">x</a>')], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    assert site_audit.run(spark, str(tmp_path / "pages"), str(tmp_path / "output"))["frontier"] == 1
    assert [sorted(c) for c in kept] == [["host", "inside", "page_id", "target", "there"]]
