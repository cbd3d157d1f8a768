"""The query language against SQLite's own full-text index."""

import random
import sqlite3

import pytest

from quillmine.operators import fts
from quillmine.operators.index import TextIndex, unicode61

WORDS = "a b c d ab abc café Über naïve x_y ñandú Йод".split()
TERMS = ["a", "b", "c", "d", "ab", "abc", "cafe", "über", "naive", "x_y", "nandu", "йод", '"a b"', '"b c d"', "a*", "ab*", "^a", "a + b", "zzz", '""', '"é"']
FIXED = [
    "a", "next.js", "c++", "what's new", "(a OR b) c", "AND", "foo-bar", "a NOT b c", "a OR b c", '""', "*", "NEAR(a b c, 3)", "NEAR(a b, 0)", "NEAR(^a b)",
    "text:a heading_path:b", 'a AND "" ', 'a ""', '"a b" *', "text : a", "{text}: a", "-text:a", "text:(a OR b)", "a NOT b OR c", "a AND b NOT c", "title:a", "a b a", "nearly(a b)",
]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    rows = [
        (i, " ".join(rng.choice(WORDS) + rng.choice(["", ",", ".", " -"]) for _ in range(rng.randint(0, 14))), " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 4))))
        for i in range(1, 41)
    ]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(text, heading_path, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("insert into f(rowid, text, heading_path) values (?, ?, ?)", rows)
    built = TextIndex.build(spark.createDataFrame(rows, "chunk_id long, text string, heading_path string"), "unicode61")
    return db, TextIndex(built.postings.cache(), built.lengths.cache(), "unicode61")


def _random(rng, depth=0):
    r = rng.random()
    if depth > 2 or r < 0.3:
        return rng.choice(TERMS)
    if r < 0.45:
        return f"{rng.choice(TERMS)} {rng.choice(TERMS)}"
    if r < 0.75:
        return f"{_random(rng, depth + 1)} {rng.choice(['AND', 'OR', 'NOT'])} {_random(rng, depth + 1)}"
    if r < 0.82:
        return f"({_random(rng, depth + 1)})"
    if r < 0.9:
        return f"NEAR({rng.choice(TERMS)} {rng.choice(TERMS)}{rng.choice(['', ', 2', ', 0', ', 5'])})"
    return rng.choice(["text:", "heading_path:", "{text heading_path}:", "-text:"]) + rng.choice([rng.choice(TERMS), f"({_random(rng, depth + 1)})"])


def _same(corpus, text):
    db, index = corpus
    try:
        want = dict(db.execute("select rowid, bm25(f) from f where f match ?", (text,)).fetchall())
    except sqlite3.Error:
        with pytest.raises(fts.QuerySyntaxError):
            fts.parse(text, "unicode61")
        assert fts.match(index, text).count() == 0
        return
    got = {r["chunk_id"]: r["bm25"] for r in fts.match(index, text, strict=True).collect()}
    assert set(got) == set(want), text
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want), text


def test_fixed_queries(corpus):
    for text in FIXED:
        _same(corpus, text)


def test_random_queries(corpus):
    rng = random.Random(5)
    for _ in range(25):
        _same(corpus, _random(rng))


def test_unicode61_folds_as_the_index_does():
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(t, tokenize='unicode61 remove_diacritics 2')")
    db.execute("create virtual table v using fts5vocab(f, instance)")
    texts = ["CAFÉ au lait", "snake_case next.js", "Ünïcödé İstanbul", "ß ½ ① x² ﬁne ø ł", "ά й ガ 한국", "й éa", "日本語テスト", "a b", "", "don't"]
    for i, t in enumerate(texts):
        db.execute("insert into f(rowid, t) values (?, ?)", (i + 1, t))
    for i, t in enumerate(texts):
        want = [r[0] for r in db.execute("select term from v where doc = ? order by offset", (i + 1,))]
        assert unicode61(t) == want, t


def test_written_index_answers_the_same(corpus, spark, tmp_path):
    _, index = corpus
    index.write(str(tmp_path))
    again = TextIndex.read(spark, str(tmp_path), "unicode61")
    key = lambda f: sorted(map(tuple, f.collect()))
    assert key(fts.match(index, "a OR abc")) == key(fts.match(again, "a OR abc"))
