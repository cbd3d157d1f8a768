"""The index that lies by term: deltas, merges, files that a search opens, and bounded top-k."""

import random

import pytest

from quillmine.operators import fts, ranking
from quillmine.operators.index import TextIndex
from quillmine.operators.term_index import FAN_IN, TermIndex


def some_chunks(n, seed=1, start=0):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    return [(start + i, " ".join(draw.choices(words, [1 / (j + 1) for j in range(40)], k=draw.randrange(1, 60))) + (" rare" if i % 37 == 0 else "")) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, text string")


def scores(df):
    return {r["chunk_id"]: round(r["bm25"], 9) for r in df.collect()}


def files(df):
    return len(df.inputFiles())


def test_fifty_deltas(spark, tmp_path):
    """Deltas are merged as they come in; a search's files follow its terms, not the deltas."""
    index = TermIndex(spark, str(tmp_path / "index"), buckets=4)
    rows = some_chunks(100)
    for number in range(50):
        index.append(frame(spark, rows[2 * number : 2 * number + 2]), number)
        index.merge()
    spans = index.spans()
    assert spans == [(0, 15), (16, 31), (32, 47), (48, 48), (49, 49)] and sorted(i for a, b in spans for i in range(a, b + 1)) == list(range(50))
    whole = TextIndex.build(frame(spark, rows))
    for query in ("w1", "w3 AND w5", "rare OR w9", '"w1 w2"', "w3*", "w1 NOT w2"):
        assert scores(fts.match(index, query)) == scores(fts.match(whole, query))
    one, every = index._of("postings", "chunk_id long, term string, bucket int", ["rare"]), index.postings
    assert files(one) <= 2 * len(spans) and files(every) > files(one)
    assert index.vacuum() > 0 and index.all_spans() == spans == TermIndex(spark, index.folder, 4).spans()
    assert scores(fts.match(index, "w1")) == scores(fts.match(whole, "w1"))


def test_a_delta_again_and_a_merge_that_broke_off(spark, tmp_path):
    index = TermIndex(spark, str(tmp_path / "index"), buckets=3)
    for number in range(FAN_IN):
        index.append(frame(spark, [(number, "same words here")]), number)
    index.append(frame(spark, [(2, "other words")]), 2)
    assert scores(fts.match(index, "same")).keys() == {0, 1, 3}
    # postings of the merged span, but no stats: it doesn't count
    frame(spark, [(0, "x")]).write.parquet(index._path("postings", (0, FAN_IN - 1)))
    assert index.merge() == 1 and scores(fts.match(index, "words")).keys() == {0, 1, 2, 3}
    assert index.spans() == [(0, FAN_IN - 1)]


def test_no_chunks(spark, tmp_path):
    index = TermIndex(spark, str(tmp_path / "none"))
    assert index.spans() == [] and scores(fts.match(index, "a")) == {} and index.best(["a"], 5)[0].count() == 0 and index.merge() == 0
    index.append(frame(spark, []), 0)
    assert scores(fts.match(index, "a")) == {} and index.best(["a"], 5)[0].count() == 0


@pytest.mark.parametrize(("terms", "every"), [(["rare", "w0"], False), (["w0", "w1", "w2"], False), (["w0", "rare"], True), (["w3"], False), (["rare", "absent"], False), (["rare", "absent"], True), (["w5", "w5", "w7"], True)])
def test_best_is_match(spark, tmp_path_factory, terms, every):
    folder = tmp_path_factory.getbasetemp() / "best"
    index = TermIndex(spark, str(folder), buckets=4, width=8)
    rows = some_chunks(600, seed=2, start=-300)  # ids of either sign
    if not folder.exists():
        index.append(frame(spark, rows[:400]), 0)
        index.append(frame(spark, rows[400:]), 1)
    got, scanned = index.best(terms, 10, every)
    want = ranking.bm25_top(fts.match(TextIndex.build(frame(spark, rows)), (" AND " if every else " OR ").join(dict.fromkeys(terms))), 10)
    assert [(r["chunk_id"], round(r["bm25"], 9)) for r in got.collect()] == [(r["chunk_id"], round(r["bm25"], 9)) for r in want.collect()]
    assert scanned.postings <= scanned.of_postings


def test_best_reads_few_blocks(spark, tmp_path):
    """A rare term beside one that every chunk has: less than a tenth of the postings."""
    rows = [(i, "common " * (1 + i % 5) + ("rare " if i < 60 else "") + "word " * (i % 7)) for i in range(4000)]
    index = TermIndex(spark, str(tmp_path / "index"), buckets=4, width=16)
    index.append(frame(spark, rows), 0)
    got, scanned = index.best(["rare", "common"], 50)
    want = ranking.bm25_top(fts.match(TextIndex.build(frame(spark, rows)), "rare OR common"), 50)
    assert scores(got) == scores(want) and scanned.postings < scanned.of_postings / 10


def test_postings_move_once(spark, tmp_path):
    """What blocks can score lies with their first posting: no second table, whose making moved all postings again."""
    rows = [(i, "common " * (1 + i % 3) + "word", "Common Head" if i % 2 else None) for i in range(64)]
    index = TermIndex(spark, str(tmp_path / "index"), buckets=2, width=16)
    index.append(spark.createDataFrame(rows, "chunk_id long, text string, heading_path string"), 0)
    assert not (tmp_path / "index/blocks").exists()
    bounds = index._of("postings", "term string, block long, n long, max_tf long, min_length long, bucket int", ["common"]).where("n is not null")
    assert sorted((r["block"], r["n"], r["max_tf"], r["min_length"]) for r in bounds.collect()) == [(b, 16, 4, 2) for b in range(4)]
    assert {r["length"] for r in index.rows.where("chunk_id = 1").collect()} == {5}
