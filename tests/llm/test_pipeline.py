import collections
import zlib

import corpus_pipeline
import numpy as np
from quillmine.llm import language_id, mixing
from quillmine.llm.queries import ORACLE_SQL, QUERIES

from .test_dedup import components_brute, lines_brute, simhash_brute
from .test_operators import WORD, ids_brute


def test_names():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{i}" for i in range(1, 13)] and set(ORACLE_SQL) <= set(QUERIES)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == names or name == corpus_pipeline.STAGES[-1][0]
        seen[name] = docs
    before = spark.read.parquet(f"{small}/documents.parquet")
    assert seen["language"].count() > 0.95 * before.count() and seen["lines"].count() == seen["language"].count()
    assert seen["near_duplicates"].count() < seen["lines"].count()
    copies = collections.Counter(r["doc_id"] for r in seen["mixture"].select("doc_id").collect())
    assert max(copies.values()) <= 2
    packed = {(r["doc_id"], r["start"]) for r in docs.collect()}
    assert {d for d, _ in packed} == set(copies)


def test_stages_against_brute_force(spark, small, tmp_path):
    """Each stage's rows against what its rule gives, in plain Python, for the rows it got."""
    seen = [spark.read.parquet(f"{small}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen[-1], small).write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    start, language, lines, near, mixed, packed = ([r.asDict() for r in x.collect()] for x in seen)
    told = {r["doc_id"]: r for r in language_id.identify(seen[0]).collect()}
    assert {r["doc_id"] for r in language} == {i for i, r in told.items() if r["lang_pred"] != "und" and r["score"] >= language_id.LEAST_SCORE}
    texts = {i: t for i, t, *_ in lines_brute([(r["doc_id"], r["text"], r["source"]) for r in language], 10)}
    assert {r["doc_id"]: r["text"] for r in lines} == texts and all(r["n_chars"] == len(r["text"]) for r in lines)
    component = components_brute({i: simhash_brute(t) for i, t in texts.items()})
    assert {r["doc_id"] for r in near} == set(component.values()) and {r["doc_id"]: r["text"] for r in near}.items() <= texts.items()
    words, own = collections.Counter(), collections.Counter()
    for r in near:
        words[r["source"]] += len(WORD.findall(r["text"]))
        own[r["doc_id"]] = len(WORD.findall(r["text"]))
    order = sorted(words)
    targets = dict(zip(order, mixing.fill_targets([words[s] for s in order])))
    drawn, of_doc = collections.Counter(), collections.Counter()
    for r in mixed:
        drawn[r["source"]] += len(WORD.findall(r["text"]))
        of_doc[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert set(WORD.findall(r["text"])) <= set(WORD.findall(texts[r["doc_id"]]))
    assert all(abs(drawn[s] - t) <= 1 for s, t in targets.items()) and all(n <= 2 * own[i] for i, n in of_doc.items())
    want = collections.Counter()
    for r in mixed:
        ids = ids_brute(r["text"])
        for at in range(0, len(ids), 2048):
            part = ids[at : at + 2048]
            want[r["doc_id"], at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    assert collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in packed) == want
    windows = collections.defaultdict(list)
    for r in packed:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in windows.values():
        ends = np.cumsum([n for _, n in sorted(held)])
        assert ends[-1] <= 2048 and [o for o, _ in sorted(held)] == [0, *ends[:-1]]


PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")


def test_run_agrees_with_its_stages(spark, small, tmp_path):
    got = corpus_pipeline.run(spark, small)
    assert got.columns == [*PIECE, "sequence_id", "offset"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    pieces = lambda df: collections.Counter(tuple(r) for r in df.select(*PIECE).collect())
    assert pieces(got) == pieces(docs) and got.count() > 0


def test_stages_take_odd_tables(spark, odd, none):
    for start in (odd.select("doc_id", "text", "lang", "source", "n_chars"), none):
        docs, ids = start, {r["doc_id"] for r in start.collect()}
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
            left = {r["doc_id"] for r in docs.select("doc_id").collect()}
            assert left <= ids and not left & {1, 2, 3}, name  # null, empty and blank texts go first
            ids = left
