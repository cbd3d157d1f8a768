import datetime
import http.server
import json
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from quillmine.operators import ranking, store
from quillmine.operators.index import TextIndex
from quillmine.plans import crawl, search, site
from quillmine.schema import CHUNKS, META, PAGES, SITES, VECTORS, checked
from quillmine.sources.embeddings import embedded, http_embedder, in_batches, probe
from quillmine.sources.fetch import Response, fetch, fetch_pages, http_source, table_source
from quillmine.streaming import ingest

T0 = datetime.datetime(2024, 1, 1)
BASE = "https://h.org/docs/"


def page(title, links=(), body="Some words that are long enough to count, with commas, as content of a page."):
    anchors = "".join(f'<a href="{x}">{x}</a>' for x in links)
    return f"<html><head><title>{title}</title></head><body><nav>{anchors}</nav><main><h1>{title}</h1><p>{body}</p></main></body></html>"


GRAPH = {
    BASE: page("root", ["a", "b/", "/elsewhere", "a#top"]),
    BASE + "a/": page("a", ["c/", "private/x"]),
    BASE + "b/": page("b", ["./", "missing"]),
    BASE + "a/c/": page("c", ["../../d/"]),
    BASE + "d/": page("d"),
    BASE + "a/private/x/": page("x"),
}


@pytest.fixture
def source(spark):
    return table_source(spark.createDataFrame(list(GRAPH.items()), "url string, html string"))


def test_crawl_follows_levels(spark, source):
    found = crawl.crawl(spark, source, crawl.CrawlOptions(BASE, exclude=["**/private/**"]))
    depth = {r["url"]: r["depth"] for r in found.pages.collect()}
    assert depth == {BASE: 0, BASE + "a/": 1, BASE + "b/": 1, BASE + "a/c/": 2, BASE + "d/": 3}
    # /elsewhere is out of scope, private excluded, missing is a 404
    assert found.skipped == 3 and found.attempts == 6 and found.warnings == []


def test_crawl_limits(spark, source):
    some = crawl.crawl(spark, source, crawl.CrawlOptions(BASE, max_pages=2))
    assert {r["url"] for r in some.pages.collect()} == {BASE, BASE + "a/"}
    flat = crawl.crawl(spark, source, crawl.CrawlOptions(BASE, max_depth=0))
    assert flat.pages.count() == 1
    seeded = crawl.crawl(spark, source, crawl.CrawlOptions(BASE, seeds=["https://other.org/", BASE + "d", BASE + "d/#x"], max_depth=0))
    assert {r["url"] for r in seeded.pages.collect()} == {BASE, BASE + "d/"}
    robots = crawl.parse_robots("User-agent: *\nDisallow: /docs/b")
    assert BASE + "b/" not in {r["url"] for r in crawl.crawl(spark, source, crawl.CrawlOptions(BASE, robots=robots)).pages.collect()}


def test_crawl_warnings(spark, source):
    shell = table_source(spark.createDataFrame([(BASE, page("shell"))], "url string, html string"))
    assert crawl.crawl(spark, shell, crawl.CrawlOptions(BASE)).warnings == [crawl.SHELL]
    none = crawl.crawl(spark, source, crawl.CrawlOptions("https://nowhere.org/"))
    assert none.warnings == [crawl.NO_PAGES.format(n=1)]


def test_a_level_takes_as_many_tasks_as_its_pages_need(spark):
    """Whatever the number of partitions of the table that they are stored in."""
    stored = spark.createDataFrame(list(GRAPH.items()), "url string, html string").repartition(40)
    parts = []

    def cut(df):
        out = crawl.written(df)
        parts.extend([out.rdd.getNumPartitions()] if "page" in df.columns else [])
        return out

    with_many = lambda urls: table_source(stored)(urls).repartition(40)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would merge the parts after a join, not those before it
    try:
        assert crawl.crawl(spark, with_many, crawl.CrawlOptions(BASE, max_depth=1), cut).pages.count() == 3
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert parts and set(parts) == {1}


def test_reachable_takes_the_least_depth(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (2, 0), (2, 3), (9, 8)], "src long, dst long")
    got = {r["url"]: r["depth"] for r in crawl.reachable(edges, spark.createDataFrame([(0,)], "url long"), 5).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 2}


def pages_of(spark, rows):
    return spark.createDataFrame([(i, 1, u, t, None, None, "", m, 0, T0, 0) for i, u, t, m in rows], PAGES).withColumn("content_hash", F.sha2("markdown", 256))


def test_upsert(spark):
    stored = pages_of(spark, [(1, "same", "old", "x"), (2, "changed", "old", "y"), (3, "gone", "old", "z")])
    new = spark.createDataFrame([(1, u, "new", None, None, m, T0 + datetime.timedelta(days=d), 7) for u, m, d in [("same", "x", 1), ("changed", "Y", 1), ("fresh", "f", 1), ("fresh", "older", 0)]],
                                "site_id long, url string, title string, etag string, last_modified string, markdown string, fetched_at timestamp, depth int")
    classified = store.classify(stored, store.fetched_pages(new))
    assert {r["url"]: r["state"] for r in classified.collect()} == {"same": "unchanged", "changed": "updated", "fresh": "inserted"}
    out = {r["url"]: r for r in store.upsert_pages(stored, classified).collect()}
    assert set(out) == {"same", "changed", "gone", "fresh"}
    assert out["same"]["title"] == "old" and out["same"]["depth"] == 0 and out["same"]["fetched_at"] > T0
    assert out["changed"]["title"] == "new" and out["changed"]["page_id"] == 2 and out["changed"]["markdown_size"] == 1
    assert out["fresh"]["markdown"] == "f" and out["gone"]["markdown"] == "z"
    counts = store.change_counts(classified, 3).first()
    assert tuple(counts) == (1, 1, 1, 3)


def test_cascade_and_vectors(spark):
    tables = {
        "sites": spark.createDataFrame([(1, "a", "a", None, None, T0, T0, None), (2, "b", "b", None, None, T0, T0, None)], SITES),
        "pages": pages_of(spark, [(1, "u", None, "m"), (2, "v", None, "m")]).withColumn("site_id", F.col("page_id")),
        "chunks": spark.createDataFrame([(10, 1, 0, "", "x", 1), (20, 2, 0, "", "y", 1)], CHUNKS),
        "vectors": spark.createDataFrame([(10, [1.0]), (20, [2.0])], VECTORS),
    }
    out = store.without_site(tables, 1)
    assert [r["site_id"] for r in out["sites"].collect()] == [2] and [r["chunk_id"] for r in out["vectors"].collect()] == [20]
    counts = {r["site_id"]: (r["page_count"], r["chunk_count"]) for r in store.site_counts(out["sites"], out["pages"], out["chunks"]).collect()}
    assert counts == {2: (1, 1)}
    new = store.store_vectors(tables["vectors"], spark.createDataFrame([(10, [3.0]), (30, [])], VECTORS), tables["chunks"])
    assert {r["chunk_id"]: list(r["embedding"]) for r in new.collect()} == {10: [3.0], 20: [2.0]}
    meta = spark.createDataFrame([], META)
    _, meta, fresh = store.ensure_dimension(tables["vectors"], meta, 4)
    assert fresh and store.ensure_dimension(tables["vectors"], meta, 4)[2] is False
    for bad in (0, -1, 1.5, True):
        with pytest.raises(ValueError):
            store.ensure_dimension(tables["vectors"], meta, bad)


def test_owning_site_is_the_first_that_covers(spark):
    sites = spark.createDataFrame([(2, "https://h.org/docs/"), (1, "https://h.org/"), (3, "https://x.org/")], "site_id long, base_url string")
    urls = spark.createDataFrame([("https://h.org/docs/a",), ("https://x.org/y",), ("https://z.org/",)], "url string")
    assert {r["url"]: r["site_id"] for r in store.owning_site(urls, sites).collect()} == {"https://h.org/docs/a": 1, "https://x.org/y": 3, "https://z.org/": None}


def test_diversify_is_the_two_pass_walk(spark):
    rng = random.Random(3)
    for _ in range(4):
        n, k, cap = rng.randint(0, 14), rng.randint(1, 8), rng.randint(0, 3)
        hits = [(i + 1, rng.choice("abc")) for i in range(n)]
        counts, taken, rest = {}, [], []
        for rank, p in hits:
            if cap <= 0 or (counts.get(p, 0) < cap and len(taken) < k):
                counts[p] = counts.get(p, 0) + 1
                taken.append(rank)
            else:
                rest.append(rank)
        want = (taken + rest)[:k]
        got = ranking.diversify(spark.createDataFrame(hits, "rank int, page_url string"), k, cap).orderBy("position").collect()
        assert [r["rank"] for r in got] == want


def test_fusion(spark):
    a = spark.createDataFrame([(10, 1), (11, 2)], "chunk_id long, bm25_rank int")
    b = spark.createDataFrame([(11, 1), (12, 2)], "chunk_id long, vector_rank int")
    got = [(r["chunk_id"], r["source"]) for r in ranking.reciprocal_rank_fusion(a, b, 10).orderBy("rank").collect()]
    assert got == [(11, "both"), (10, "bm25"), (12, "vector")]


def test_knn(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 2), (3, [1.0], 1), (4, [0.9, 0.0], 2)], "chunk_id long, embedding array<float>, site_id long")
    assert [r["chunk_id"] for r in ranking.knn(v, [1.0, 0.0], 2).collect()] == [1, 4]
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "query_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in ranking.knn_batch(v, q, 2).collect()}
    assert got == {(7, 1): 1, (7, 2): 4, (8, 1): 2, (8, 2): 4}
    near = v.where("size(embedding) = 2").select("chunk_id", "site_id", ranking.l2(F.col("embedding"), F.array(F.lit(1.0), F.lit(0.0))).alias("distance"))
    assert [r["chunk_id"] for r in ranking.knn_sites(near, 2, 1).collect()] == []
    assert [r["chunk_id"] for r in ranking.knn_sites(near, 2, 1, prefilter=True).collect()] == [4]


def test_knn_batch_keeps_the_least_ids_of_equal_vectors_and_splits_queries(spark):
    rng = random.Random(3)
    ids = list(range(300))
    rng.shuffle(ids)
    table = [(i, [0.1, 0.2, 0.3] if i % 3 else [0.3, 0.1, 0.2]) for i in ids]
    v = spark.createDataFrame(table, "chunk_id long, embedding array<float>").coalesce(1)
    q = spark.createDataFrame([(n, [0.1, 0.2, 0.3 + n]) for n in range(7)], "query_id long, embedding array<float>")
    whole = sorted(map(tuple, ranking.knn_batch(v, q, 5).select("query_id", "rank", "chunk_id").collect()))
    assert [x[2] for x in whole if x[0] == 0] == [1, 2, 4, 5, 7]
    assert sorted(map(tuple, ranking.knn_batch(v, q, 5, max_queries=3).select("query_id", "rank", "chunk_id").collect())) == whole


CHUNK_ROWS = [(1, 1, 0, "Guide > Routing", "How routing works with paths", 5), (2, 1, 1, "Guide > Rendering", "How rendering works", 4), (3, 2, 0, "Deploy", "routing to servers\n\n```sh\nrun it\n```", 5)]


def corpus(spark, embed=True):
    chunks = spark.createDataFrame(CHUNK_ROWS, CHUNKS)
    pages = pages_of(spark, [(1, "https://h.org/a", "A", "m"), (2, "https://h.org/b", None, "m")]).withColumn("site_id", F.col("page_id"))
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8]), (99, [1.0, 0.0])], VECTORS)
    return search.Corpus(chunks, pages, TextIndex.build(chunks), vectors if embed else None, (lambda q: [1.0, 0.0]) if embed else None)


def test_search_modes(spark):
    hits, mode = search.search(corpus(spark), "routing", "bm25")
    rows = hits.collect()
    assert mode == "bm25" and {r["chunk_id"] for r in rows} == {1, 3} and rows[0]["score"] == 1 and "<<routing>>" in rows[0]["snippet"].lower()
    hits, mode = search.search(corpus(spark), "routing", "vector")
    assert mode == "vector" and [r["chunk_id"] for r in hits.collect()][0] == 1 and hits.count() == 3
    hits, mode = search.search(corpus(spark), "routing")
    rows = hits.collect()
    assert mode == "hybrid" and rows[0]["chunk_id"] == 1 and rows[0]["source"] == "both"
    assert search.search(corpus(spark, False), "routing")[1] == "bm25"
    assert [r["chunk_id"] for r in search.search(corpus(spark), "routing", "bm25", site_id=2)[0].collect()] == [3]
    for blank in ("", "  ", "next.js"):
        assert search.search(corpus(spark), blank, "bm25")[0].count() == 0
    with pytest.raises(ValueError):
        search.search(corpus(spark, False), "x", "vector")
    for bad in ({"top_k": 0}, {"top_k": 51}, {"max_per_page": 0}, {"mode": "x"}):
        with pytest.raises(ValueError):
            search.search(corpus(spark), "x", **bad)


def test_render(spark):
    text = search.render(*search.search(corpus(spark), "servers", "bm25"))
    assert text.startswith("mode=bm25\n\n### 1. Deploy\nSource: https://h.org/b\nScore: 1.000 (bm25)") and "```sh\nrun it\n```" in text
    assert search.render(*search.search(corpus(spark), "zzz", "bm25")) == "No results."


def test_checked():
    assert checked("top_k", None) == 10 and checked("max_chars", 100) == 100
    for name, bad in (("top_k", True), ("max_depth", 21), ("max_pages", "5")):
        with pytest.raises(ValueError):
            checked(name, bad)


def test_embedding(spark):
    calls = []

    def embed(texts):
        calls.append(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    assert in_batches(embed, ["a"] * 5, 2) == [[1.0, 1.0]] * 5 and sorted(calls) == [1, 2, 2]  # batches run side by side
    assert probe(embed) == (2, None) and probe(None)[0] is None and probe(lambda t: 1 / 0)[1].startswith("ZeroDivision")
    assert in_batches(lambda ts: [[float(t)] for t in ts], [str(i) for i in range(100)], 3, 4) == [[float(i)] for i in range(100)]
    got = spark.createDataFrame([("abc",), (None,)], "t string").select(embedded(F.col("t"), lambda ts: [[float(len(t))] for t in ts]).alias("e")).collect()
    assert [(list(r["e"]["vector"]), r["e"]["error"]) for r in got] == [([3.0], None), ([0.0], None)]
    got = spark.createDataFrame([("abc",)], "t string").select(embedded(F.col("t"), lambda ts: 1 / 0).alias("e")).collect()
    assert got[0]["e"]["vector"] is None and got[0]["e"]["error"].startswith("ZeroDivisionError")


def test_fetch_pages(spark):
    urls = spark.createDataFrame([("https://a.b/1",), ("https://a.b/2",)], "url string")

    def get(url, **_):
        if url.endswith("2"):
            raise OSError("down")
        return Response(200, {"etag": "e"}, "body", url)

    got = {r["url"]: r for r in fetch_pages(urls, get, per_second=1000, retries=0).collect()}
    assert got["https://a.b/1"]["body"] == "body" and got["https://a.b/1"]["headers"] == {"etag": "e"} and got["https://a.b/2"]["error"] == "OSError: down"


def test_requests_at_once_are_bounded(spark, tmp_path):
    """Two to an origin, as many origins' as a task has room for, at the origin's rate."""
    log = tmp_path / "log"

    def get(url, **_):
        with log.open("a") as f:
            f.write(f"{url} {time.monotonic()} start\n")
        time.sleep(0.2)
        with log.open("a") as f:
            f.write(f"{url} {time.monotonic()} end\n")
        return Response(200, {}, "x", url)

    urls = spark.createDataFrame([(f"https://{h}.org/{i}", 20.0 if h == "a" else 1000.0) for h in "ab" for i in range(6)], "url string, per_second double")
    assert fetch_pages(urls, get, partitions=1, at_once=3).where("status = 200").count() == 12
    now, most = {"a": 0, "b": 0}, {"a": 0, "b": 0}
    starts = []
    for line in sorted(log.read_text().splitlines(), key=lambda x: float(x.split()[1])):
        url, at, what = line.split()
        host = url[8]
        now[host] += 1 if what == "start" else -1
        most[host] = max(most[host], now[host])
        starts += [float(at)] if host == "a" and what == "start" else []
    assert most["a"] <= 2 and most["b"] == 2 and all(b - a > 0.04 for a, b in zip(starts, starts[1:]))


def test_library(spark, source, tmp_path):
    lib = site.Library(spark, str(tmp_path / "lib"), source, embed=lambda ts: [[float(len(t)), 1.0] for t in ts], now=lambda: T0)
    report = lib.add_site(BASE, exclude=["**/private/**"])
    assert (report.pages_added, report.pages_updated, report.pages_unchanged) == (5, 0, 0)
    again = lib.refresh_site(report.site_id)
    assert (again.pages_added, again.pages_unchanged) == (0, 5)
    listed = lib.list_sites().collect()
    assert len(listed) == 1 and listed[0]["page_count"] == 5 and listed[0]["name"] == "h.org/docs"
    status = lib.index_status(report.site_id)
    assert status["status"] == "idle" and status["chunk_count"] >= 5 and status["error"] is None and status["warnings"] == []
    assert site.status_line(status).startswith(f"[{report.site_id}] h.org/docs: idle; pages 5") and site.report_line(report).endswith(": 5 new, 0 changed, 0 as before, 3 left out")
    assert site.site_lines(lib.list_sites()) == f"[{report.site_id}] h.org/docs <{BASE}> pages 5, crawled 2024-01-01T00:00:00.000"
    assert lib.hint(report.site_id) is None
    doc = lib.get_doc(BASE + "a/", max_chars=100)
    assert doc["source"] == "cache" and doc["title"] == "a"
    fresh = lib.get_doc(BASE + "a/private/x/", persist=True)
    assert fresh["source"] == "fetched" and fresh["persisted"] and lib.get_doc(BASE + "a/private/x/")["source"] == "cache"
    with pytest.raises(LookupError):
        lib.get_doc("https://h.org/none")
    hits, mode = lib.search("words AND content")
    assert mode == "hybrid" and hits.count() > 0
    counted = search.hit_pages(hits).first()
    assert counted["hits"] == hits.count() and counted["pages"] == len({r["page_url"] for r in hits.collect()})
    with pytest.raises(LookupError):
        lib.search("words", site_id=7)
    assert lib.refresh_site(report.site_id, "full").pages_added == 5
    assert lib.store.vacuum() > 0
    assert lib.remove_site(report.site_id)["pages"] == 5 and lib.list_sites().count() == 0
    with pytest.raises(LookupError):
        lib.site(report.site_id)


def test_a_change_reads_and_writes_its_own_buckets(spark, source, tmp_path):
    log = tmp_path / "texts"

    def embed(texts):
        with log.open("a") as f:
            f.writelines(json.dumps(t) + "\n" for t in texts)
        return [[1.0, 2.0] for _ in texts]

    seen = lambda: [t for t in map(json.loads, log.read_text().splitlines()) if t != "probe"]
    lib = site.Library(spark, str(tmp_path / "lib"), source, embed=embed, now=lambda: T0)
    first = lib.add_site(BASE)
    chunks = lib.store.tables()["chunks"]
    assert sorted(seen()) == sorted(r["text"] for r in chunks.collect())  # each text once
    assert first.chunks_embedded == chunks.count() == lib.store.tables()["vectors"].count()
    before = lib.store.places()
    row = lib.store.tables()["pages"].where(F.col("url") == BASE + "b/").first()
    fresh = spark.createDataFrame([(first.site_id, row["url"], "b", "# b\n\nquite another zebra text", T0, 1)], "site_id long, url string, title string, markdown string, fetched_at timestamp, depth int")
    changed, buckets, counts = lib.ingest(fresh)
    lib.store.commit(changed, buckets)
    after = lib.store.places()
    moved = {k for k in before.keys() | after.keys() if before.get(k) != after.get(k)}
    assert counts["pages_updated"] == 1 and {b for _, b in moved} == {row["page_id"] & 4095} and {t for t, _ in moved} == {"pages", "chunks", "vectors", "postings", "lengths"}
    assert len(seen()) == len(set(seen())) == chunks.count() + 1
    # what is stored is what an index built anew would hold
    kept, built = lib.index(), TextIndex.build(lib.store.tables()["chunks"])
    key = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert key(kept.postings) == key(built.postings) and key(kept.lengths) == key(built.lengths)
    hits, _ = lib.search("zebra", mode="bm25")
    assert [r["page_url"] for r in hits.collect()] == [BASE + "b/"]
    plan = ranking.bm25_top(search.fts.match(lib.index(), "zebra"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,zebra)" in plan and "regexp_extract_all" not in plan
    assert lib.store.tables()["chunks"].join(lib.store.tables()["vectors"], "chunk_id").count() == lib.store.tables()["vectors"].count()


def test_writers_that_meet(spark, tmp_path):
    one, two = (store.Collection(spark, str(tmp_path / "c")) for _ in range(2))
    row = lambda i, h: spark.createDataFrame([(i, 1, f"u{i}", None, None, None, h, "m", 1, T0, 0)], PAGES)
    one.commit({"pages": row(5, "a").union(row(6, "a"))})
    write = one._write

    def meanwhile(name, df):
        out = write(name, df)
        two.commit({"pages": row(6, "b")}, {"pages": [6]})  # before one's listing is made
        one._write = write
        return out

    one._write = meanwhile
    one.commit({"pages": row(5, "c")}, {"pages": [5]})
    assert {r["page_id"]: r["content_hash"] for r in two.tables()["pages"].collect()} == {5: "c", 6: "b"}
    one._write = lambda name, df: (write(name, df), two.commit({"pages": row(5, "d")}, {"pages": [5]}))[0]
    with pytest.raises(store.Conflict):
        one.commit({"pages": row(5, "e")}, {"pages": [5]})
    assert {r["page_id"]: r["content_hash"] for r in one.tables([5])["pages"].collect()} == {5: "d"}
    with pytest.raises(ValueError):
        two.commit({"pages": row(7, "x")}, {"pages": [5]})
    two.commit({"pages": row(5, "x").limit(0)}, {"pages": [5]})
    assert [r["page_id"] for r in two.tables()["pages"].collect()] == [6]


def test_migration(spark, tmp_path):
    folder = str(tmp_path / "c")
    held = {
        "sites": spark.createDataFrame([(1, "https://h.org/", "h", None, None, T0, T0, None)], SITES), "pages": pages_of(spark, [(1, "https://h.org/a", "A", "m")]),
        "chunks": spark.createDataFrame([(10, 1, 0, "", "some words", 3)], CHUNKS), "vectors": spark.createDataFrame([(10, [1.0])], VECTORS),
    }
    for name, df in held.items():
        df.write.parquet(f"{folder}/data/{name}-0")
    listing = spark.createDataFrame([(n, f"{folder}/data/{n}-0", 1) for n in held], "table string, place string, version int")
    listing.coalesce(1).write.json(f"{folder}/snapshot-0000000000")
    c = store.Collection(spark, folder)
    with pytest.raises(RuntimeError):
        c.tables()
    assert c.migrate() == 1 and c.migrate() == 2
    t = c.tables()
    page, chunk = t["pages"].first(), t["chunks"].first()
    assert page["url"] == "https://h.org/a" and chunk["page_id"] == page["page_id"] != 1 and chunk["chunk_id"] & 4095 == page["page_id"] & 4095
    assert t["vectors"].first()["chunk_id"] == chunk["chunk_id"] and {r["term"] for r in t["postings"].collect()} == {"some", "words"} and t["sites"].count() == 1


SITE = {
    "/robots.txt": (200, {}, "User-agent: *\nDisallow: /docs/private\nCrawl-delay: 0.01\nSitemap: {base}/extra.xml"),
    "/extra.xml": (200, {}, "<urlset><url><loc>{base}/docs/lonely/</loc></url><url><loc>{base}/docs/private/x/</loc></url></urlset>"),
    "/docs/": (200, {"ETag": "e1", "Last-Modified": "Mon, 01 Jan 2024 00:00:00 GMT"}, page("root", ["a/", "torn/", "short/", "odd/", "private/y/"])),
    "/docs/a/": (200, {}, page("a")), "/docs/lonely/": (200, {}, page("lonely")), "/docs/private/y/": (200, {}, page("y")), "/docs/private/x/": (200, {}, page("x")),
    "/docs/torn/": (200, {"Content-Encoding": "gzip"}, "this is no gzip"), "/docs/short/": (200, {"Content-Length": "9999"}, "cut off"), "/docs/odd/": None,
}


@pytest.fixture
def server():
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((self.path, {k.lower(): v for k, v in self.headers.items()}))
            answer = SITE.get(self.path, (404, {}, "none"))
            if answer is None:  # no HTTP at all
                self.wfile.write(b"\x00\x01 nonsense\r\n\r\n")
                return
            status, headers, body = answer
            body = body.replace("{base}", base).encode()
            if self.headers.get("If-None-Match") == headers.get("ETag", "-"):
                status, body = 304, b""
            self.send_response(status)
            for k, v in ({"Content-Length": str(len(body))} | headers).items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body)

        def do_POST(self):
            asked.append((self.path, {k.lower(): v for k, v in self.headers.items()}))
            data = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if any("lonely" in t for t in data["input"]):
                self.send_error(500)
                return
            body = json.dumps({"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(data["input"])))]}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    run = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    base = f"http://127.0.0.1:{run.server_port}"
    threading.Thread(target=run.serve_forever, daemon=True).start()
    yield base, asked
    run.shutdown()


def test_a_site_over_the_network(spark, server, tmp_path):
    """Rules, sitemaps, damaged answers, a failing embedder and conditional requests, over a real socket."""
    base, asked = server
    lib = site.Library(spark, str(tmp_path / "lib"), http_source(per_second=50, retries=1, base=0.01), http_embedder(f"{base}/v1/", "m", "secret-token"), model="m")
    report = lib.add_site(f"{base}/docs/")
    paths = [p for p, _ in asked]
    found = {r["url"].removeprefix(base) for r in lib.store.tables()["pages"].collect()}
    assert found == {"/docs/", "/docs/a/", "/docs/lonely/"} and report.pages_added == 3 and "/docs/private/x/" not in paths and "/docs/private/y/" not in paths  # root, a and what only a sitemap names
    assert paths.count("/docs/torn/") == paths.count("/docs/short/") == paths.count("/docs/odd/") == 2  # tried again, then left out
    assert len(report.warnings) == 1 and "no vector" in report.warnings[0] and lib.store.tables()["vectors"].count() == report.chunks_embedded
    assert lib.site(report.site_id)["robots_txt"].startswith("User-agent") and ("/v1/embeddings" in paths)
    assert next(h["authorization"] for p, h in asked if p == "/v1/embeddings") == "Bearer secret-token"
    row = lib.store.tables()["pages"].where(F.col("url") == f"{base}/docs/").first()
    assert row["etag"] == "e1" and row["last_modified"].startswith("Mon")
    assert lib.refresh_page(f"{base}/docs/") == "unchanged" and asked[-1][1]["if-none-match"] == "e1"
    assert {r["key"]: r["value"] for r in lib.store.tables()["meta"].collect()} == {"dim": "2", "model": "m"}
    with pytest.raises(PermissionError):
        lib.get_doc(f"{base}/docs/private/y/")
    # another embedder's vectors take the place of the old ones
    wider = site.Library(spark, str(tmp_path / "lib"), http_source(per_second=50, retries=0), lambda ts: [[1.0, 2.0, 3.0] for _ in ts], model="n")
    assert wider.embedder()[1] is None and wider.store.tables()["vectors"].count() == 0
    assert {r["key"]: r["value"] for r in wider.store.tables()["meta"].collect()} == {"dim": "3", "model": "n"}
    dead = site.Library(spark, str(tmp_path / "lib"), http_source(), lambda ts: 1 / 0)
    assert dead.embedder()[0] is None and dead.search("words")[1] == "bm25"


def test_background_crawls_fold(spark, source, tmp_path):
    gate = threading.Event()

    def slow(urls):
        gate.wait(60)
        return source(urls)

    lib = site.Library(spark, str(tmp_path / "lib"), slow, now=lambda: T0)
    report = lib.add_site(BASE, wait=False)
    assert report.status == "indexing" and lib.add_site(BASE, wait=False) is report and lib.index_status(report.site_id)["status"] == "indexing"
    assert "being crawled" in lib.hint(report.site_id) and "indexing" in site.site_lines(lib.list_sites())
    gate.set()
    assert lib.add_site(BASE) is report and report.status == "idle" and report.pages_added == 6
    lib.source = lambda urls: 1 / 0
    with pytest.raises(ZeroDivisionError):
        lib.refresh_site(report.site_id)
    status = lib.index_status(report.site_id)
    assert status["status"] == "failed" and "division" in status["error"]
    assert site.report_line(lib.last[report.site_id].report).endswith("the crawl failed (division by zero)")


def test_pages_are_remembered(spark, source, tmp_path):
    clock = [T0]
    calls = []
    lib = site.Library(spark, str(tmp_path / "lib"), lambda urls: calls.append(1) or source(urls), now=lambda: clock[0])
    assert lib.get_doc(BASE)["source"] == "fetched" and lib.get_doc(BASE)["source"] == "memory-cache" and len(calls) == 2  # rules and page
    clock[0] += datetime.timedelta(minutes=31)
    assert lib.get_doc(BASE)["source"] == "fetched" and len(calls) == 3  # the rules are known
    with pytest.raises(LookupError):
        lib.get_doc(BASE + "a/", persist=True)
    assert site.site_lines(lib.list_sites()) == "The collection has no sites."


def test_waits_are_bounded():
    waits = []
    answers = iter([Response(429, {"retry-after": "86400"}), Response(200, {}, "x")])
    assert fetch("u", lambda url: next(answers), sleep=waits.append).status == 200 and waits == [120.0]


def test_streaming(spark, tmp_path):
    lib = site.Library(spark, str(tmp_path / "lib"), source=None, now=lambda: T0)
    rows = [(1, u, 200, b, T0, 0) for u, b in GRAPH.items()] + [(1, BASE + "bad", 500, "x", T0, 0)]
    spark.createDataFrame(rows, ingest.LANDING).write.parquet(str(tmp_path / "in"))
    stream = ingest.landing_pages(spark, str(tmp_path / "in"))
    query = ingest.ingest_stream(lib, stream, str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert query.exception() is None and lib.store.tables()["pages"].count() == len(GRAPH)
    spark.createDataFrame([(1, BASE, 200, page("root", body="Another text that is long enough, with commas, to be content here."), T0, 0)], ingest.LANDING).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.ingest_stream(lib, stream, str(tmp_path / "cp")).awaitTermination(120)
    pages = lib.store.tables()["pages"]
    assert pages.count() == len(GRAPH) and "Another text" in pages.where(F.col("url") == BASE).first()["markdown"]
    assert ingest.arrivals(spark.read.schema(ingest.LANDING).parquet(str(tmp_path / "in"))).agg(F.sum("pages"), F.sum("failures")).first() == (len(GRAPH) + 1, 1)


def test_regressions(spark):
    from quillmine.operators.compare import regressions

    old = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 0.0), ("gone", 1.0)], "name string, mean double")
    new = spark.createDataFrame([("a", 1.1), ("b", 1.3), ("b", 1.5), ("c", 1.0)], "name string, mean double")
    assert {r["name"]: r["failed"] for r in regressions(old, new).collect()} == {"a": False, "b": True, "c": False}


def test_a_paragraph_at_the_top_is_all_that_is_indexed(spark, tmp_path):
    """Chunks that a page keeps keep their ids, postings and vectors, wherever they stand now."""
    log = tmp_path / "texts"

    def embed(texts):
        with log.open("a") as f:
            f.writelines(json.dumps(t) + "\n" for t in texts)
        return [[float(len(t)), 2.0] for t in texts]

    seen = lambda: [t for t in map(json.loads, log.read_text().splitlines()) if t != "probe"] if log.exists() else []
    lib = site.Library(spark, str(tmp_path / "lib"), None, embed=embed, now=lambda: T0)
    parts = [f"## Part {i}\n\n" + f"words{i} of a part of its own. " * 5 for i in range(4)] + ["## Twice\n\nthe same"] * 2

    def came(*sections):
        rows = [(1, "https://h.org/a", "A", "# A\n\n" + "\n\n".join(sections), T0, 0)]
        changed, buckets, counts = lib.ingest(spark.createDataFrame(rows, "site_id long, url string, title string, markdown string, fetched_at timestamp, depth int"))
        lib.store.commit(changed, buckets)
        t = lib.store.tables()
        built = TextIndex.build(t["chunks"])
        key = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
        assert key(lib.index().postings) == key(built.postings) and key(lib.index().lengths) == key(built.lengths)
        assert {r["chunk_id"] for r in t["vectors"].collect()} == {r["chunk_id"] for r in t["chunks"].collect()}
        return counts["chunks_embedded"], {r["chunk_id"]: r["ord"] for r in t["chunks"].collect()}

    first, ids = came(*parts)
    assert first == len(ids) == len(seen())
    n, after = came("## New\n\nquite another paragraph", *parts)
    assert n == 1 and len(seen()) == first + 1 and ids.keys() < after.keys() and all(after[i] == ids[i] + 1 for i in ids if ids[i] > 0)
    n, last = came(*parts[1:-1])  # the first part and one of the two equal ones are gone
    assert n == 0 and len(last) == len(ids) - 2 and last.keys() < ids.keys()


def test_a_crawl_is_seen_level_by_level(spark, source, tmp_path):
    """What a level has brought is there while the next one is fetched, and stays if that fails."""
    seen = []

    def watched(urls):
        if lib is not None and "h.org/robots" not in str(urls.first()["url"]) and "sitemap" not in str(urls.first()["url"]):
            seen.append(lib.store.tables()["pages"].count())
            if len(seen) == 3:
                raise RuntimeError("no network")
        return source(urls)

    lib = None
    lib = site.Library(spark, str(tmp_path / "lib"), watched, now=lambda: T0)
    with pytest.raises(RuntimeError, match="no network"):
        lib.add_site(BASE)
    first, second, third = seen
    kept = lib.store.tables()["pages"]
    assert first == 0 < second < third == kept.count() and {r["depth"] for r in kept.collect()} == {0, 1}
    lib.source = source
    again = lib.refresh_site(kept.first()["site_id"])
    assert again.pages_unchanged == third and again.pages_added > 0
