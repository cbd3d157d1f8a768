"""The registered queries of the retrieval engine, each with SQL that gives the same rows.

The tables of the driver stand for a collection: ``documents`` are chunks (``source`` is the page,
``lang`` the site), ``embeddings`` their vectors, ``pages`` raw responses, ``benchmark`` queries.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking, html, snippets, text, urls
from ..operators import compare, fts, index, prefixes, ranking, store
from ..operators.cells import CellIndex
from ..operators.index import TextIndex
from ..operators.term_index import TermIndex
from ..sources import sitemap as sitemaps
from ..sources.fetch import table_source
from ..sources.shared import shared_folder
from . import crawl as crawling
from .search import hit_pages, rendered, search_batch
from .site import listed_sites, parsed_options, status_of

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
TOKEN = index.TOKEN
BASE = "https://site1.example.org/docs/"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("page_url"), F.col("lang").alias("site"))


def text_index(spark: SparkSession, sf: str) -> TextIndex:
    return TextIndex.build(docs(spark, sf).select("chunk_id", "text"))


def headed_index(spark: SparkSession, sf: str) -> TextIndex:
    return TextIndex.build(docs(spark, sf).withColumn("heading_path", F.col("page_url")))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def query_vector(spark: SparkSession, sf: str) -> list[float]:
    return table(spark, sf, "embeddings").where("vec_id = 0").first()["embedding"]


# ---- keyword search

TOKENS = f"toks AS (SELECT doc_id AS chunk_id, source, lang, regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}') AS t FROM documents)"


def bm25_sql(counts: list[str], where: str, tail: str = "ORDER BY sc.bm25, sc.chunk_id LIMIT 50", site: str = "true", length: str = "len(t)", columns: str = "sc.chunk_id, round(sc.bm25, 6) AS bm25", tokens: str = TOKENS, more: str = "") -> str:
    """BM25 over lists of tokens: ``counts`` gives each phrase's occurrences in a row."""
    tfs = ", ".join(f"({c})::BIGINT AS tf{i}" for i, c in enumerate(counts))
    ns = ", ".join(f"count(*) FILTER (tf{i} > 0) AS n{i}" for i in range(len(counts)))
    idfs = ", ".join(f"CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{i} + 0.5) / (n{i} + 0.5)) END AS idf{i}" for i in range(len(counts)))
    score = " + ".join(f"CASE WHEN tf{i} > 0 THEN idf{i} * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a)) ELSE 0 END" for i in range(len(counts)))
    return f"""
        WITH {tokens}, tf AS (SELECT chunk_id, source, lang, {length} AS l, {tfs} FROM toks),
        st AS (SELECT count(*) AS n, avg(l) AS a, {ns} FROM tf), idf AS (SELECT a, {idfs} FROM st),
        sc AS (SELECT chunk_id, source, lang, -({score}) AS bm25 FROM tf, idf WHERE ({where}) AND {site}){more}
        SELECT {columns} FROM sc {tail}
    """


def tf(term: str, tokens: str = "t") -> str:
    return f"len(list_filter({tokens}, lambda x: x = '{term}'))"


def top(spark: SparkSession, sf: str, text_: str, k: int = 50, index_=text_index) -> DataFrame:
    hits = ranking.bm25_top(fts.match(index_(spark, sf), text_, strict=True), k)
    return hits.select("chunk_id", r6("bm25").alias("bm25"))


def _keyword(name: str, text_: str, counts: list[str], where: str, **more):
    query(name, bm25_sql(counts, where, **more))(lambda spark, sf: top(spark, sf, text_))


PHRASE = "len(list_filter(range(1, len(t)), lambda i: t[i] = 'in' AND t[i + 1] = 'the'))"
INITIAL = "(len(t) > 0 AND t[1] = 'the')"
_keyword("bm25_single_term", "tion", [tf("tion")], "tf0 > 0")
_keyword("bm25_two_term_and", "tion thre", [tf("tion"), tf("thre")], "tf0 > 0 AND tf1 > 0")
_keyword("bm25_idf_floor", "the", [tf("the")], "tf0 > 0")
_keyword("bm25_or", "tion OR schtz", [tf("tion"), tf("schtz")], "tf0 > 0 OR tf1 > 0")
_keyword("bm25_not", "tion NOT thre", [tf("tion")], f"tf0 > 0 AND chunk_id NOT IN (SELECT chunk_id FROM toks WHERE {tf('thre')} > 0)")
_keyword("bm25_prefix", "thre*", ["len(list_filter(t, lambda x: starts_with(x, 'thre')))"], "tf0 > 0")
_keyword("bm25_phrase", '"in the"', [PHRASE], "tf0 > 0")
_keyword("bm25_initial", "^the", [INITIAL + "::INT"], "tf0 > 0")
_keyword("bm25_parentheses", "(tion OR ble) AND thre", [tf("tion"), tf("ble"), tf("thre")], "(tf0 > 0 OR tf1 > 0) AND tf2 > 0")


@query("bm25_near", f"""
    WITH {TOKENS}, p AS (SELECT chunk_id, list_filter(range(1, len(t) + 1), lambda i: t[i] = 'tion') AS a, list_filter(range(1, len(t) + 1), lambda i: t[i] = 'thre') AS b FROM toks)
    SELECT chunk_id FROM p WHERE len(list_filter(a, lambda x: len(list_filter(b, lambda y: abs(x - y) <= 6)) > 0)) > 0
""")  # fmt: skip
def bm25_near(spark, sf):
    return fts.match(text_index(spark, sf), "NEAR(tion thre, 5)").select("chunk_id")


@query("bm25_site_filter", bm25_sql([tf("tion")], "tf0 > 0", site="lang = 'fr'"))
def bm25_site_filter(spark, sf):
    scored = fts.match(text_index(spark, sf), "tion").join(docs(spark, sf).where("site = 'fr'").select("chunk_id"), "chunk_id")
    return ranking.bm25_top(scored, 50).select("chunk_id", r6("bm25").alias("bm25"))


PER_SITE = bm25_sql([tf("tion")], "tf0 > 0", tail="QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sc.bm25, sc.chunk_id) <= 5", columns="sc.lang AS site, row_number() OVER (PARTITION BY lang ORDER BY sc.bm25, sc.chunk_id)::INT AS rank, sc.chunk_id, round(sc.bm25, 6) AS bm25")


@query("bm25_top_k_per_site", PER_SITE)
def bm25_top_k_per_site(spark, sf):
    scored = fts.match(text_index(spark, sf), "tion").join(docs(spark, sf).select("chunk_id", "site"), "chunk_id")
    return ranking.ranked(scored, "bm25", "chunk_id", per=("site",)).where("rank <= 5").select("site", "rank", "chunk_id", r6("bm25").alias("bm25"))


HEADED = TOKENS.replace(" AS t FROM", f" AS t, regexp_extract_all(lower(coalesce(source, '')), '{TOKEN}') AS h FROM")


@query("bm25_two_columns", bm25_sql([f"{tf('src3')} + {tf('src3', 'h')}"], "tf0 > 0", length="len(t) + len(h)", tokens=HEADED))
def bm25_two_columns(spark, sf):
    return top(spark, sf, "src3", index_=headed_index)


@query("bm25_column_filter", bm25_sql([tf("tion"), tf("src3", "h")], "tf0 > 0 AND tf1 > 0", length="len(t) + len(h)", tokens=HEADED))
def bm25_column_filter(spark, sf):
    return top(spark, sf, "text:tion heading_path:src3", index_=headed_index)


@query("bm25_syntax_error", "SELECT doc_id AS chunk_id, 0.0::DOUBLE AS bm25 FROM documents WHERE false")
def bm25_syntax_error(spark, sf):
    return fts.match(text_index(spark, sf), "next.js")


@query("bm25_batch", f"""
    WITH {TOKENS}, q AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}')) AS ts FROM benchmark),
    qt AS (SELECT query_id, len(ts) AS wanted, unnest(ts) AS term FROM q), post AS (SELECT chunk_id, unnest(t) AS term FROM toks),
    tf AS (SELECT chunk_id, term, count(*) AS tf FROM post SEMI JOIN qt USING (term) GROUP BY ALL),
    df AS (SELECT term, count(*) AS n FROM tf GROUP BY term), st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM toks),
    sc AS (SELECT query_id, chunk_id, -sum(CASE WHEN ln((st.n - df.n + 0.5) / (df.n + 0.5)) <= 0 THEN 1e-6 ELSE ln((st.n - df.n + 0.5) / (df.n + 0.5)) END
             * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(t) / a))) AS bm25
           FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN toks USING (chunk_id), st GROUP BY query_id, chunk_id HAVING count(*) = any_value(wanted))
    SELECT query_id, chunk_id, round(bm25, 6) AS bm25 FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(sc.bm25, 9), chunk_id) <= 10
""")  # fmt: skip
def bm25_batch(spark, sf):
    terms = index.native_tokens(F.col("text"))
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), terms.alias("terms"))
    hits = search_batch(text_index(spark, sf), queries, 10, (F.round("bm25", 9), "chunk_id"))
    return hits.select("query_id", "chunk_id", r6("bm25").alias("bm25"))


def _by_term(spark, sf) -> TermIndex:
    """A stored index of the documents, come in as four deltas and merged."""
    index_, chunks = TermIndex(spark, f"{shared_folder(spark)}/by-term-{uuid.uuid4().hex}"), docs(spark, sf).select("chunk_id", "text")
    for number in range(4):
        index_.append(chunks.where(F.pmod("chunk_id", F.lit(4)) == number), number)
    index_.merge()
    return index_


@query("bm25_by_term_and", ORACLE_SQL["bm25_two_term_and"])
def bm25_by_term_and(spark, sf):
    """The best chunks with both terms, from an index that lies by term, by blocks' bounds."""
    return _by_term(spark, sf).best(["tion", "thre"], 50, every=True)[0].select("chunk_id", r6("bm25").alias("bm25"))


@query("bm25_by_term_or", ORACLE_SQL["bm25_or"])
def bm25_by_term_or(spark, sf):
    return _by_term(spark, sf).best(["tion", "schtz"], 50)[0].select("chunk_id", r6("bm25").alias("bm25"))


# ---- index

@query("tokenise_postings", f"""
    WITH {TOKENS}, p AS (SELECT chunk_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM toks)
    SELECT chunk_id, term, count(*) AS tf, min(pos)::INT AS first_pos, max(pos)::INT AS last_pos FROM p GROUP BY chunk_id, term
""")  # fmt: skip
def tokenise_postings(spark, sf):
    p = text_index(spark, sf).postings
    return p.select("chunk_id", "term", F.size("positions").cast("long").alias("tf"), F.array_min("positions").alias("first_pos"), F.array_max("positions").alias("last_pos"))


@query("corpus_stats", f"WITH {TOKENS} SELECT count(*) AS n_rows, sum(len(t))::BIGINT AS total_tokens, round(avg(len(t)), 6) AS avg_tokens FROM toks")
def corpus_stats(spark, sf):
    return index.corpus_stats(text_index(spark, sf).lengths).withColumn("avg_tokens", r6("avg_tokens"))


@query("term_df", f"WITH {TOKENS}, p AS (SELECT chunk_id, unnest(t) AS term FROM toks) SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS cf FROM p GROUP BY term")
def term_df(spark, sf):
    return index.term_frequencies(text_index(spark, sf).postings, columns=1)


# ---- vectors

DISTANCE = "list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[])"
Q0 = "q AS (SELECT embedding FROM embeddings WHERE vec_id = 0)"
NEAR = f"WITH {Q0}, near AS (SELECT v.vec_id AS chunk_id, label, {DISTANCE} AS d FROM embeddings v, q ORDER BY d, chunk_id LIMIT 50)"


@query("knn_l2", f"{NEAR} SELECT chunk_id, round(d, 6) AS distance FROM near")
def knn_l2(spark, sf):
    return ranking.knn(vectors(spark, sf), query_vector(spark, sf), 50).withColumn("distance", r6("distance"))


def _measured(spark, sf):
    held = F.array(*(F.lit(x) for x in query_vector(spark, sf)))
    return vectors(spark, sf).select("chunk_id", F.col("label").alias("site_id"), ranking.l2(F.col("embedding"), held).alias("distance"))


@query("knn_site_postfilter", f"{NEAR} SELECT chunk_id, label AS site_id, round(d, 6) AS distance FROM near WHERE label = 3")
def knn_site_postfilter(spark, sf):
    return ranking.knn_sites(_measured(spark, sf), 3, 50).withColumn("distance", r6("distance"))


@query("knn_prefilter", f"WITH {Q0} SELECT v.vec_id AS chunk_id, label AS site_id, round({DISTANCE}, 6) AS distance FROM embeddings v, q WHERE label = 3 ORDER BY {DISTANCE}, v.vec_id LIMIT 20")
def knn_prefilter(spark, sf):
    return ranking.knn_sites(_measured(spark, sf), 3, 20, prefilter=True).withColumn("distance", r6("distance"))


KNN_BATCH = f"""
    SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round({DISTANCE}, 6) AS distance FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0
    QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {DISTANCE}, v.vec_id) <= 10
"""


def _asked(v: DataFrame) -> DataFrame:
    return v.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")


@query("knn_batch", KNN_BATCH)
def knn_batch(spark, sf):
    v = vectors(spark, sf)
    return ranking.knn_batch(v, _asked(v), 10).select("query_id", "chunk_id", r6("distance").alias("distance"))


@query("knn_cells", KNN_BATCH)
def knn_cells(spark, sf):
    """The same from vectors that are stored by cell."""
    v = vectors(spark, sf)
    dimension = v.select(F.size("embedding").alias("n")).where("n > 0").groupBy("n").count().orderBy(F.desc("count"), "n").first()["n"]
    index = CellIndex.write(v, f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}", dimension)
    return index.nearest(_asked(v), 10)[0].select("query_id", "chunk_id", r6("distance").alias("distance"))


@query("vector_score", f"WITH {Q0} SELECT vec_id AS chunk_id, round(1 - least(1.0, 0.5 * {DISTANCE}), 6) AS score FROM embeddings v, q")
def vector_score(spark, sf):
    return _measured(spark, sf).select("chunk_id", r6(ranking.vector_score(F.col("distance") * 0.5)).alias("score"))


# ---- fusion

FUSED = bm25_sql([tf("tion"), tf("thre")], "tf0 > 0 AND tf1 > 0", columns="*", tail="", more=f""",
    kw AS (SELECT chunk_id, row_number() OVER (ORDER BY bm25, chunk_id)::INT AS bm25_rank FROM sc QUALIFY bm25_rank <= 50),
    {Q0}, vd AS (SELECT v.vec_id AS chunk_id, {DISTANCE} AS d FROM embeddings v JOIN documents ON doc_id = vec_id, q),
    ve AS (SELECT chunk_id, row_number() OVER (ORDER BY d, chunk_id)::INT AS vector_rank FROM vd QUALIFY vector_rank <= 50),
    fu AS (SELECT chunk_id, bm25_rank, vector_rank, coalesce(1.0::DOUBLE / (60 + bm25_rank), 0) + coalesce(1.0::DOUBLE / (60 + vector_rank), 0) AS raw FROM kw FULL JOIN ve USING (chunk_id)),
    ra AS (SELECT *, row_number() OVER (ORDER BY raw DESC, bm25_rank ASC NULLS LAST, vector_rank ASC NULLS LAST)::INT AS rank, raw / max(raw) OVER () AS score,
             CASE WHEN bm25_rank IS NULL THEN 'vector' WHEN vector_rank IS NULL THEN 'bm25' ELSE 'both' END AS source_ FROM fu)""").replace("SELECT * FROM sc", "")  # fmt: skip


def _fused(spark, sf, k=50):
    keyword = ranking.ranked(ranking.bm25_top(fts.match(text_index(spark, sf), "tion thre"), 50), "bm25", "chunk_id", name="bm25_rank")
    stored = vectors(spark, sf).join(docs(spark, sf).select("chunk_id"), "chunk_id", "left_semi")
    near = ranking.ranked(ranking.knn(stored, query_vector(spark, sf), 50), "distance", "chunk_id", name="vector_rank")
    return ranking.reciprocal_rank_fusion(keyword, near, k)


@query("rrf_hybrid", f"{FUSED} SELECT chunk_id, rank, round(score, 6) AS score, source_ AS source FROM ra WHERE rank <= 50")
def rrf_hybrid(spark, sf):
    return _fused(spark, sf).select("chunk_id", "rank", r6("score").alias("score"), "source")


@query("rrf_source_label", f"{FUSED} SELECT source_ AS source, count(*) AS n, min(rank) AS best FROM ra GROUP BY source_")
def rrf_source_label(spark, sf):
    return _fused(spark, sf, 100).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("best"))


@query("hybrid_diversified", f"""{FUSED}, ow AS (SELECT ra.*, d.source AS page_url, row_number() OVER (PARTITION BY d.source ORDER BY rank) AS own FROM ra JOIN documents d ON d.doc_id = chunk_id WHERE rank <= 50),
    po AS (SELECT *, row_number() OVER (ORDER BY (own > 2)::INT, rank)::INT AS position FROM ow)
    SELECT position, chunk_id, page_url, round(score, 6) AS score, source_ AS source FROM po WHERE position <= 10
""")  # fmt: skip
def hybrid_diversified(spark, sf):
    hits = _fused(spark, sf).join(docs(spark, sf).select("chunk_id", "page_url"), "chunk_id")
    return ranking.diversify(hits, 10).select("position", "chunk_id", "page_url", r6("score").alias("score"), "source")


@query("diversify_by_page", """
    WITH r AS (SELECT doc_id AS chunk_id, source AS page_url, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 200),
    o AS (SELECT *, row_number() OVER (PARTITION BY page_url ORDER BY rank) AS own FROM r)
    SELECT row_number() OVER (ORDER BY (own > 2)::INT, rank)::INT AS position, chunk_id, page_url FROM o QUALIFY position <= 60
""")  # fmt: skip
def diversify_by_page(spark, sf):
    best = table(spark, sf, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(200)
    hits = ranking.ranked(best.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("page_url"), "n_chars"), F.desc("n_chars"), "chunk_id")
    return ranking.diversify(hits, 60).select("position", "chunk_id", "page_url")


@query("score_normalise", bm25_sql([tf("tion")], "tf0 > 0", columns="sc.chunk_id, round(sc.bm25 / min(sc.bm25) OVER (), 6) AS score", tail=""))
def score_normalise(spark, sf):
    return ranking.normalised(fts.match(text_index(spark, sf), "tion")).select("chunk_id", r6("score").alias("score"))


# ---- scalar text functions

@query("token_count", r"SELECT doc_id, ceil(greatest(strlen(text) / 4.0, length(regexp_replace(text, '[^\x{3000}-\x{9FFF}\x{A000}-\x{A4CF}\x{F900}-\x{FAFF}\x{20000}-\x{2FFFF}]', '', 'g'))))::BIGINT AS token_count FROM documents")
def token_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.token_count(F.col("text")).alias("token_count"))


@query("utf8_size", "SELECT doc_id, strlen(text)::BIGINT AS size FROM documents")
def utf8_size(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.utf8_size(F.col("text")).alias("size"))


@query("content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"))


W = text.WHITE
FLAT = rf"regexp_replace(regexp_replace(%s, '{W}+', ' ', 'g'), '^{W}+|{W}+$', '', 'g')"


@query("text_length", f"SELECT page_id, length({FLAT % chr(39).join(['regexp_replace(html, ', '<[^>]+>', ', ', ' ', ', ', 'g', ')'])})::BIGINT AS n FROM pages")
def text_length(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.text_length(F.col("html")).alias("n"))


@query("count_tables", r"SELECT page_id, len(regexp_extract_all(replace(html, '<ul', '<TABLE x'), '(?i)<table[\s>]'))::BIGINT AS n FROM pages")
def count_tables(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.count_tables(F.replace(F.col("html"), F.lit("<ul"), F.lit("<TABLE x"))).alias("n"))


@query("orphan_rows", r"SELECT page_id, regexp_replace(replace(replace(html, '<li', '<tr'), '</li>', '</tr>'), '((?:<tr\b.*?</tr>\s*)+)', '<table><tbody>\1</tbody></table>', 'gis') AS html FROM pages")
def orphan_rows(spark, sf):
    rows = F.replace(F.replace(F.col("html"), F.lit("<li"), F.lit("<tr")), F.lit("</li>"), F.lit("</tr>"))
    return table(spark, sf, "pages").select("page_id", text.rewrap_orphan_rows(rows).alias("html"))


@query("describe_clip", f"SELECT doc_id, CASE WHEN length({FLAT % 'text'}) > 400 THEN substring({FLAT % 'text'}, 1, 400) || '...' ELSE {FLAT % 'text'} END AS description FROM documents")
def describe_clip(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.clip_description(F.col("text")).alias("description"))


@query("snippet_fallback", "SELECT doc_id, substring(text, 1, 200) AS snippet FROM documents")
def snippet_fallback(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.snippet_fallback(F.col("text")).alias("snippet"))


@query("table_cells", rf"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    c AS (SELECT doc_id, i, list_transform(string_split(regexp_replace(regexp_replace('|' || line || '|', '^\|', ''), '\|\s*$', ''), '|'), lambda x: regexp_replace(x, '^{W}+|{W}+$', '', 'g')) AS cells FROM l)
    SELECT doc_id, i::INT AS line, len(cells) AS n, cells[1] AS first_cell, cells[-1] AS last_cell FROM c
""")  # fmt: skip
def table_cells(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    cells = lines.select("doc_id", (F.col("at") + 1).alias("line"), text.split_cells(F.concat(F.lit("|"), F.col("line"), F.lit("|"))).alias("c"))
    return cells.select("doc_id", "line", F.size("c").cast("long").alias("n"), F.element_at("c", 1).alias("first_cell"), F.element_at("c", -1).alias("last_cell"))


@query("truncate_doc", "SELECT doc_id, substring(text, 1, 1000) AS text, length(text) > 1000 AS truncated FROM documents")
def truncate_doc(spark, sf):
    head, more = text.truncated(F.col("text"), 1000)
    return table(spark, sf, "documents").select("doc_id", head.alias("text"), more.alias("truncated"))


# ---- URLs

PARTS = r"'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$'"
DROP = ", ".join(f"'{t}'" for t in urls.TRACKERS)
URLS = rf"""u AS (SELECT page_id, url, lower(regexp_extract(url, {PARTS}, 1)) AS scheme, lower(regexp_extract(url, {PARTS}, 2)) AS host,
    CASE WHEN regexp_extract(url, {PARTS}, 3) = '' THEN '/' ELSE regexp_extract(url, {PARTS}, 3) END AS path,
    list_filter(string_split(regexp_replace(regexp_extract(url, {PARTS}, 4), '^\?', ''), '&'), lambda p: p <> '' AND NOT list_contains([{DROP}], string_split(p, '=')[1])) AS params FROM pages),
    n AS (SELECT page_id, url, scheme, host, regexp_replace(path, '/index\.html?$', '/') AS path, list_sort(list_transform(params, lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END)) AS params FROM u)"""
QUERY_TAIL = "CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END"


@query("url_normalize", f"WITH {URLS} SELECT page_id, scheme || '://' || host || path || {QUERY_TAIL} AS url FROM n")
def url_normalize(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.native_normalized(F.col("url")).alias("url"))


SLASHED = r"CASE WHEN path = '/' OR ends_with(path, '/') OR regexp_matches(path, '/[^/]*\.[A-Za-z0-9]{1,6}$') THEN path ELSE path || '/' END"


@query("url_normalize_base", f"WITH {URLS} SELECT page_id, scheme || '://' || host || {SLASHED} || {QUERY_TAIL} AS url FROM n")
def url_normalize_base(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.native_normalized(F.col("url"), BASE).alias("url"))


FIRST = "f AS (SELECT scheme AS s0, host AS h0, path AS p0 FROM n ORDER BY page_id LIMIT 1)"


def _first_url(spark, sf) -> Column:
    return F.lit(table(spark, sf, "pages").orderBy("page_id").first()["url"])


@query("url_same_origin", f"WITH {URLS}, {FIRST} SELECT page_id, scheme = s0 AND host = h0 AS same FROM n, f")
def url_same_origin(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.native_same_origin(F.col("url"), _first_url(spark, sf)).alias("same"))


@query("url_under_base", f"WITH {URLS} SELECT page_id, path, starts_with(rtrim(path, '/') || '/', '/' || string_split(path, '/')[2] || '/') AND path <> '/' AS under_first, starts_with(rtrim(path, '/') || '/', '/docs/') AS under_docs FROM u")
def url_under_base(spark, sf):
    u = F.col("url")
    first = F.concat(urls.origin_of(u), F.lit("/"), F.split(urls.path_of(u), "/")[1], F.lit("/"))
    under = urls.native_under_base(u, first) & (urls.path_of(u) != "/")
    return table(spark, sf, "pages").select("page_id", urls.path_of(u).alias("path"), under.alias("under_first"), urls.native_under_base(u, F.concat(urls.origin_of(u), F.lit("/docs"))).alias("under_docs"))


@query("url_glob_filter", rf"WITH {URLS} SELECT page_id, path FROM u WHERE regexp_matches(path, '^/[^/.][^/]*(/[^/.][^/]*)*/?$') AND NOT regexp_matches(path, '\.html$')")
def url_glob_filter(spark, sf):
    path = urls.path_of(F.col("url"))
    keep = urls.native_match_patterns(path, ["/**", "!/**/*.html", "!/*.html", "!/"])
    return table(spark, sf, "pages").where(keep & ~path.rlike("//")).select("page_id", path.alias("path"))


@query("derive_name", f"WITH {URLS} SELECT page_id, host || regexp_replace(path, '/$', '') AS name FROM u")
def derive_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.derive_name(F.col("url")).alias("name"))


TIONSH = "https://blog.tionsh.example.net/"


@query("url_dedupe", f"""
    WITH {URLS} SELECT scheme || '://' || host || {SLASHED} || {QUERY_TAIL} AS url, min(page_id) AS first_page, bool_or(scheme = 'https' AND host = 'blog.tionsh.example.net') AS accepted
    FROM n GROUP BY 1
""")  # fmt: skip
def url_dedupe(spark, sf):
    raw = table(spark, sf, "pages").select(F.col("page_id").alias("parent"), F.lit(0).cast("long").alias("at"), F.col("url").alias("raw"))
    return crawling.fresh_urls(raw, crawling.CrawlOptions(TIONSH)).select("url", F.col("found.parent").alias("first_page"), "accepted")


@query("owning_site", f"WITH {URLS}, s AS (SELECT min(page_id) AS site_id, scheme, host FROM u GROUP BY ALL) SELECT u.url, s.site_id FROM u JOIN s USING (scheme, host)")
def owning_site(spark, sf):
    pages = table(spark, sf, "pages")
    sites = pages.groupBy(F.concat(urls.origin_of(F.col("url")), F.lit("/")).alias("base_url")).agg(F.min("page_id").alias("site_id"))
    return store.owning_site(pages.select("url"), sites)


@query("owning_site_nested", f"""
    WITH {URLS}, d AS (SELECT *, string_split(path, '/')[2] AS dir FROM u), s AS (SELECT scheme, host, '/' AS base, 1000000 + min(page_id) AS site_id FROM d GROUP BY scheme, host
        UNION ALL SELECT scheme, host, '/' || dir || '/', min(page_id) FROM d WHERE dir <> '' GROUP BY scheme, host, dir)
    SELECT d.url, min(s.site_id) AS site_id FROM d JOIN s ON s.scheme = d.scheme AND s.host = d.host AND starts_with(CASE WHEN ends_with(path, '/') THEN path ELSE path || '/' END, base) GROUP BY d.page_id, d.url
""")  # fmt: skip
def owning_site_nested(spark, sf):
    """Sites within sites: a host's root, and each of its first directories with smaller ids."""
    pages = table(spark, sf, "pages")
    u = F.col("url")
    root, first = F.concat(urls.origin_of(u), F.lit("/")), F.split(urls.path_of(u), "/")[1]
    nested = pages.where(first != "").groupBy(F.concat(root, first, F.lit("/")).alias("base_url")).agg(F.min("page_id").alias("site_id"))
    roots = pages.groupBy(root.alias("base_url")).agg((F.min("page_id") + 1_000_000).alias("site_id"))
    return store.owning_site(pages.select("url"), roots.unionByName(nested))


DIRECTORY = "CASE WHEN host LIKE '%.org' THEN 'es' WHEN host LIKE '%.com' THEN 'de' ELSE 'en' END"


@query("robots_allowed", rf"""
    WITH {URLS}, d AS (SELECT *, {DIRECTORY} AS dir, path || regexp_extract(url, '^[^?#]*(\?[^#]+)', 1) AS whole FROM u)
    SELECT page_id, CASE WHEN ends_with(whole, '.html') THEN false WHEN starts_with(whole, '/' || dir || '/1') THEN true ELSE NOT starts_with(whole, '/' || dir || '/') END AS allowed FROM d
""")  # fmt: skip
def robots_allowed(spark, sf):
    """Every page's URL by the rules of its own host, which keep robots from a directory and from files."""
    pages = table(spark, sf, "pages")
    host = urls.host_of(F.col("url"))
    directory = F.when(host.endswith(".org"), "es").when(host.endswith(".com"), "de").otherwise("en")
    text_ = F.format_string("User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /%s/\nAllow: /%s/1\nDisallow: /*.html$\n", directory, directory)
    robots = pages.select(urls.origin_of(F.col("url")).alias("origin"), text_.alias("text")).distinct()
    return prefixes.allowed(pages.select("page_id", "url"), robots, "quillmine/1.0").select("page_id", "allowed")


@query("sitemap_urls", f"WITH {URLS} SELECT host AS site, url FROM u GROUP BY host, url")
def sitemap_urls(spark, sf):
    """Every host's pages from its sitemaps: an index at the root names one for English pages, one for others, itself, and one that is missing."""
    pages = table(spark, sf, "pages").select(urls.host_of(F.col("url")).alias("site"), "url").distinct()
    place = F.concat(F.lit("https://"), "site", F.lit("/sitemap"))
    loc = lambda u: F.concat(F.lit("<loc>"), F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit("</loc>"))
    part = F.when(F.col("url").contains("/en/"), "-en.xml").otherwise("-rest.xml")
    sets = pages.groupBy(F.concat(place, part).alias("url")).agg(F.array_join(F.collect_list(F.concat(F.lit("<url>"), loc(F.col("url")), F.lit("</url>"))), "").alias("inner"))
    sets = sets.select("url", F.concat(F.lit("<urlset>"), "inner", F.lit("</urlset>")).alias("html"))
    named = [F.concat(F.lit("<sitemap>"), loc(F.concat(place, F.lit(x))), F.lit("</sitemap>")) for x in ("-en.xml", ".xml", "-none.xml", "-rest.xml")]
    sites = pages.select("site").distinct()
    roots = sites.select("site", F.concat(place, F.lit(".xml")).alias("url"), F.lit(0).alias("ord"))
    stored = sets.unionByName(sites.select(F.concat(place, F.lit(".xml")).alias("url"), F.concat(F.lit("<sitemapindex>"), *named, F.lit("</sitemapindex>")).alias("html")))
    return sitemaps.sitemap_urls(roots, table_source(stored))


# ---- HTML

LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']+)["'']"""


@query("html_links", f"SELECT page_id, unnest(regexp_extract_all(html, '{LINK}', 1)) AS href FROM pages")
def html_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(text.html_links(F.col("html"))).alias("href"))


@query("html_title", rf"SELECT page_id, regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1), '<[^>]+>', '', 'g'), '^{W}+|{W}+$', '', 'g') AS title FROM pages")
def html_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.html_title(F.col("html")).alias("title"))


@query("link_edges_in_scope", f"""
    WITH {URLS}, l AS (SELECT page_id, unnest(regexp_extract_all(html, '{LINK}', 1)) AS href FROM pages)
    SELECT l.page_id, count(*) AS links, count(*) FILTER (scheme = 'https' AND host = 'blog.tionsh.example.net' AND starts_with(href, '/')) AS followed FROM l JOIN u USING (page_id) GROUP BY l.page_id
""")  # fmt: skip
def link_edges_in_scope(spark, sf):
    links = table(spark, sf, "pages").select("page_id", F.explode(html.links_of(F.col("html"), F.col("url"))).alias("link"))
    judged = links.select("page_id", crawling.judged(F.col("link"), crawling.CrawlOptions(TIONSH)).alias("j"))
    return judged.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.count_if("j.accepted").alias("followed"))


@query("extract_article")
def extract_article(spark, sf):
    found = table(spark, sf, "pages").select("page_id", html.extracted(F.col("url"), F.col("html")).alias("x"))
    return found.where("x.content_html is not null").select("page_id", "x.url", "x.title", "x.content_html")


@query("html_to_markdown")
def html_to_markdown(spark, sf):
    return table(spark, sf, "pages").select("page_id", html.page_markdown(F.col("url"), F.col("html")).alias("p")).select("page_id", "p.title", "p.markdown")


@query("html_links_parsed", f"""
    WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '{LINK}', 1)) AS href, generate_subscripts(regexp_extract_all(html, '{LINK}', 1), 1) - 1 AS ord FROM pages)
    SELECT page_id, ord::INT AS ord, regexp_extract(url, '^https?://[^/]+')
        || array_to_string(list_transform(string_split(replace(href, '&amp;', '&'), ''), lambda c: CASE WHEN unicode(c) < 128 THEN c ELSE url_encode(c) END), '') AS link FROM l
""")  # fmt: skip
def html_links_parsed(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.posexplode(html.links_of(F.col("html"), F.col("url"))).alias("ord", "link"))


def _composed(spark, sf, end: Column | None = None) -> DataFrame:
    """Documents as Markdown: a heading, the lines as paragraphs under a second one, a code block, and an end."""
    body = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    md = F.concat(F.lit("# "), F.col("lang"), F.lit("\n\n## "), F.col("source"), F.lit("\n\n"), body, F.lit("\n\n```sh\nrun "), F.col("source"), F.lit("\n```\n"), *([end] if end is not None else []))
    return table(spark, sf, "documents").select("doc_id", md.alias("markdown"))


@query("chunk_markdown")
def chunk_markdown(spark, sf):
    return chunking.explode_chunks(_composed(spark, sf))


ENDS = r"'^\s+|\s+$'"
LINES = "l AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"


@query("chunk_sections", rf"""
    WITH {LINES}, s AS (SELECT doc_id, 0 AS ord, lang AS heading_path, '# ' || lang AS text FROM documents
        UNION ALL SELECT doc_id, i AS ord, lang || ' > s' || i AS heading_path, regexp_replace('## s' || i || chr(10) || chr(10) || line, {ENDS}, '', 'g') AS text FROM l)
    SELECT doc_id, ord::INT AS ord, heading_path, text,
        ceil(greatest(strlen(text) / 4.0, length(regexp_replace(text, '[^\x{{3000}}-\x{{9FFF}}\x{{A000}}-\x{{A4CF}}\x{{F900}}-\x{{FAFF}}\x{{20000}}-\x{{2FFFF}}]', '', 'g'))))::INT AS token_count FROM s
""")  # fmt: skip
def chunk_sections(spark, sf):
    """Each line of a document as a section of its own under the document's heading."""
    sections = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("## s"), (i + 1).cast("string"), F.lit("\n\n"), x))
    md = F.concat(F.lit("# "), F.col("lang"), F.lit("\n\n"), F.array_join(sections, "\n\n"))
    return chunking.explode_chunks(table(spark, sf, "documents").select("doc_id", md.alias("markdown")), labels=False)


PROSE = rf"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, {ENDS}, '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, '^#{{1,6}}\s+'))"
FIRST_PROSE = rf"coalesce(regexp_replace(({PROSE})[1], '\s+', ' ', 'g'), 'end')"


@query("snippet_parts", rf"""
    SELECT doc_id, CASE WHEN length({FIRST_PROSE}) > 400 THEN substring({FIRST_PROSE}, 1, 400) || '...' ELSE {FIRST_PROSE} END AS description, 'sh' AS language, 'run ' || source AS code,
        1::BIGINT AS blocks, 1::BIGINT AS tables, 'lang,size' AS headers, lang || ',' || length(text) || ',,x' AS cells FROM documents
""")  # fmt: skip
def snippet_parts(spark, sf):
    """Documents with headings before, and a code block, a table of ragged rows and a paragraph after their lines."""
    row = F.concat(F.lit("\n\n| lang | size |\n| :-- | --: |\n| "), F.col("lang"), F.lit(" | "), F.length("text").cast("string"), F.lit(" |\nno row\n|  | x |\n\nend\n"))
    parts = _composed(spark, sf, row).select("doc_id", snippets.parts_of(F.col("markdown")).alias("p"))
    block, found = F.element_at("p.code_blocks", -1), F.col("p.tables")[0]
    return parts.select(
        "doc_id", "p.description", block["language"].alias("language"), block["code"].alias("code"), F.size("p.code_blocks").cast("long").alias("blocks"),
        F.size("p.tables").cast("long").alias("tables"), F.array_join(found["headers"], ",").alias("headers"), F.array_join(F.flatten(found["rows"]), ",").alias("cells"),
    )


@query("fts_snippet")
def fts_snippet(spark, sf):
    hits = ranking.bm25_top(fts.match(text_index(spark, sf), "tion thre"), 50).join(docs(spark, sf), "chunk_id")
    return hits.select("chunk_id", snippets.snippet_of(F.col("text"), fts.parse("tion thre").leaves()).alias("snippet"))


@query("render_hits", """
    WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS position, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS heading, CASE WHEN doc_id % 2 = 0 THEN source END AS title, * FROM documents)
    SELECT doc_id, '### ' || position || '. ' || CASE WHEN heading <> '' THEN heading WHEN title IS NOT NULL THEN title ELSE '(untitled)' END || chr(10) || 'Source: ' || source || chr(10)
        || 'Score: 0.' || lpad((doc_id % 1000)::VARCHAR, 3, '0') || ' (' || lang || ')' || CASE WHEN text = '' THEN '' ELSE chr(10) || chr(10) || text END
        || chr(10) || chr(10) || '```' || CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'sh' END || chr(10) || source || chr(10) || '```' || chr(10) || chr(10) || '```' || chr(10) || lang || chr(10) || '```'
        || chr(10) || chr(10) || '| a | b |' || chr(10) || '| --- | --- |'
        || array_to_string(list_transform(range(1, least(doc_id % 25, 20) + 1), lambda i: chr(10) || '| ' || i || ' | ' || lang || ' |'), '')
        || CASE WHEN doc_id % 25 > 20 THEN chr(10) || '| _… ' || (doc_id % 25 - 20) || ' more rows_ |' ELSE '' END AS text FROM h
""")  # fmt: skip
def render_hits(spark, sf):
    """Documents as hits: three code blocks (two are shown) and a table of up to 24 rows (20 are)."""
    block = lambda language, code: F.struct(language.alias("language"), code.alias("code"))
    lang, source = F.col("lang"), F.col("source")
    rows = F.transform(F.sequence(F.lit(1), F.lit(25)), lambda i: F.array(i.cast("string"), F.col("lang")))
    rows = F.slice(rows, 1, (F.col("doc_id") % 25).cast("int"))
    blocks = F.array(block(F.when(F.col("doc_id") % 5 != 0, "sh"), source), block(F.lit(None).cast("string"), lang), block(F.lit("x"), lang))
    hits = ranking.positions(table(spark, sf, "documents"), "doc_id").select(
        "doc_id", "position", F.when(F.col("doc_id") % 3 == 0, "").otherwise(lang).alias("heading_path"), F.when(F.col("doc_id") % 2 == 0, source).alias("page_title"), source.alias("page_url"),
        F.col("text").alias("description"), blocks.alias("code_blocks"), F.array(F.struct(F.array(F.lit("a"), F.lit("b")).alias("headers"), rows.alias("rows"))).alias("tables"),
        ((F.col("doc_id") % 1000) / 1000).alias("score"), lang.alias("source"),
    )
    # the position says which document it is
    return rendered(hits).join(hits.select("position", "doc_id"), "position").select("doc_id", "text")


# ---- crawling and storing

LINKED = "https://h.example/docs/"


def linked_site(spark, sf, links: bool = True) -> DataFrame:
    """``url, html``: a site whose page i links to the pages 2i + 1 and 2i + 2, page 0 at its root."""
    href = lambda i: F.when(i == 0, LINKED).otherwise(F.concat(F.lit(LINKED + "p"), i.cast("string"), F.lit("/")))
    i = F.col("page_id")
    anchors = F.concat(F.lit('<a href="/docs/p'), (i * 2 + 1).cast("string"), F.lit('#top">next</a><a href="'), href(i * 2 + 2), F.lit('">more</a>')) if links else F.lit("")
    body = F.lit("<main><h1>Page</h1><p>Some words that are long enough, with commas, to count as the content of a page.</p></main>")
    return table(spark, sf, "pages").select(href(i).alias("url"), F.concat(F.lit("<html><body><nav>"), anchors, F.lit("</nav>"), body, F.lit("</body></html>")).alias("html"))


EDGES = "e AS (SELECT page_id AS src, page_id * 2 + 1 AS dst FROM pages UNION SELECT page_id, page_id * 2 + 2 FROM pages)"
REACHED = f"{EDGES}, r AS (SELECT 0::BIGINT AS i, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.i JOIN pages p ON p.page_id = e.dst WHERE r.depth < 5)"


@query("crawl_bfs_depth", f"WITH RECURSIVE {REACHED} SELECT CASE WHEN i = 0 THEN '{LINKED}' ELSE '{LINKED}p' || i || '/' END AS url, min(depth)::INT AS depth FROM r GROUP BY i")
def crawl_bfs_depth(spark, sf):
    found = crawling.crawl(spark, table_source(linked_site(spark, sf)), crawling.CrawlOptions(LINKED, max_depth=5, max_pages=20_000))
    return found.pages.select("url", "depth")


@query("reachable_depth", f"""
    WITH RECURSIVE {EDGES}, r AS (SELECT 0::BIGINT AS url, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.url WHERE r.depth < 5)
    SELECT url, min(depth)::INT AS depth FROM r GROUP BY url
""")  # fmt: skip
def reachable_depth(spark, sf):
    from ..sources.shared import cut

    pages = table(spark, sf, "pages").select(F.col("page_id").alias("src"))
    edges = pages.select("src", F.explode(F.array(F.col("src") * 2 + 1, F.col("src") * 2 + 2)).alias("dst"))
    return crawling.reachable(edges, spark.range(1).select(F.col("id").alias("url")), 5, cut)


@query("crawl_warnings", f"""
    WITH RECURSIVE {REACHED} SELECT 'linked' AS site, count(DISTINCT i) AS pages, 0 AS warnings, '' AS warning FROM r
    UNION ALL SELECT 'shell', count(*), 1, '{crawling.SHELL}' FROM pages WHERE page_id = 0
    UNION ALL SELECT 'nowhere', 0, 1, '{crawling.NO_PAGES.format(n=1).replace("'", "''")}'
""")  # fmt: skip
def crawl_warnings(spark, sf):
    """What three crawls say: of a site whose pages link to others, of one whose pages don't, of one that isn't there."""
    runs = [("linked", LINKED, True), ("shell", LINKED, False), ("nowhere", "https://nowhere.example/", True)]
    rows = []
    for name, base, links in runs:
        found = crawling.crawl(spark, table_source(linked_site(spark, sf, links)), crawling.CrawlOptions(base, max_depth=5, max_pages=20_000))
        rows.append((name, found.pages.count(), len(found.warnings), "; ".join(found.warnings)))
    return spark.createDataFrame(rows, "site string, pages long, warnings int, warning string")


OLD = "o AS (SELECT doc_id AS page_id, lang, 'u' || doc_id AS url, sha256(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 5 <> 0)"


def _stored(spark, sf) -> DataFrame:
    """A stored state: a fifth of the documents is missing, a third of the rest differs."""
    md = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    rows = table(spark, sf, "documents").where("doc_id % 5 <> 0").select(
        F.col("doc_id").alias("page_id"), F.lit(1).cast("long").alias("site_id"), F.concat(F.lit("u"), F.col("doc_id")).alias("url"), F.col("lang").alias("title"),
        F.lit("old").alias("etag"), F.lit(None).cast("string").alias("last_modified"), md.alias("markdown"), F.timestamp_seconds(F.lit(0)).alias("fetched_at"), F.lit(1).alias("depth"),
    )
    return rows.withColumn("content_hash", text.content_hash(F.col("markdown"))).withColumn("markdown_size", text.utf8_size(F.col("markdown")))


def _classified(spark, sf) -> tuple[DataFrame, DataFrame]:
    stored = _stored(spark, sf)
    rows = table(spark, sf, "documents").select(
        F.lit(1).cast("long").alias("site_id"), F.concat(F.lit("u"), F.col("doc_id")).alias("url"), F.col("source").alias("title"), F.lit("new").alias("etag"),
        F.lit(None).cast("string").alias("last_modified"), F.col("text").alias("markdown"), F.timestamp_seconds(F.lit(60)).alias("fetched_at"), F.lit(0).alias("depth"),
    )
    return stored, store.classify(stored, store.fetched_pages(rows))


@query("upsert_states", f"WITH {OLD} SELECT 'u' || d.doc_id AS url, CASE WHEN o.url IS NULL THEN 'inserted' WHEN o.h = sha256(d.text) THEN 'unchanged' ELSE 'updated' END AS state FROM documents d LEFT JOIN o ON o.url = 'u' || d.doc_id")
def upsert_states(spark, sf):
    return _classified(spark, sf)[1].select("url", "state")


@query("touch_vs_update", f"""
    WITH {OLD} SELECT 'u' || d.doc_id AS url, CASE WHEN o.url IS NOT NULL AND o.h = sha256(d.text) THEN d.lang ELSE d.source END AS title, 'new' AS etag,
        sha256(d.text) AS content_hash, CASE WHEN o.url IS NOT NULL AND o.h = sha256(d.text) THEN 1 ELSE 0 END::INT AS depth FROM documents d LEFT JOIN o ON o.url = 'u' || d.doc_id
""")  # fmt: skip
def touch_vs_update(spark, sf):
    return store.upsert_pages(*_classified(spark, sf)).select("url", "title", "etag", "content_hash", "depth")


@query("crawl_counters", f"""
    WITH {OLD}, s AS (SELECT CASE WHEN o.url IS NULL THEN 'i' WHEN o.h = sha256(d.text) THEN 'n' ELSE 'u' END AS s FROM documents d LEFT JOIN o ON o.url = 'u' || d.doc_id)
    SELECT count(*) FILTER (s = 'i') AS pages_added, count(*) FILTER (s = 'u') AS pages_updated, count(*) FILTER (s = 'n') AS pages_unchanged, 0::BIGINT AS pages_skipped FROM s
""")  # fmt: skip
def crawl_counters(spark, sf):
    return store.change_counts(_classified(spark, sf)[1])


CHUNKS = "c AS (SELECT doc_id AS page_id, lang AS site, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents)"


def _chunks(spark, sf) -> DataFrame:
    lines = F.posexplode(F.split("text", "\n")).alias("ord", "text")
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), F.col("lang").alias("heading_path"), lines)
    return rows.select(store.stable_id("page_id", "ord").alias("chunk_id"), "page_id", "ord", "heading_path", "text", F.length("text").alias("token_count"))


@query("replace_chunks", f"WITH {CHUNKS} SELECT page_id, count(*) AS n, sum(CASE WHEN page_id % 4 = 0 THEN length('new ' || text) ELSE length(text) END)::BIGINT AS chars FROM c WHERE page_id % 4 <> 0 OR ord = 0 GROUP BY page_id")
def replace_chunks(spark, sf):
    chunks = _chunks(spark, sf)
    changed = table(spark, sf, "documents").where("doc_id % 4 = 0").select(F.col("doc_id").alias("page_id"))
    new = chunks.where("page_id % 4 = 0 and ord = 0").withColumn("text", F.concat(F.lit("new "), "text"))
    out = store.replace_chunks(chunks, changed, new)
    return out.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("chunk_reuse", """
    WITH l AS (SELECT doc_id AS page_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents),
    o AS (SELECT page_id, line, count(*) AS n FROM l GROUP BY ALL),
    w AS (SELECT page_id, line, count(*) AS m FROM (SELECT page_id, line FROM l WHERE NOT (page_id % 3 = 1 AND ord = 1) UNION ALL SELECT doc_id, 'A paragraph that is new.' FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL) GROUP BY ALL)
    SELECT page_id, sum(coalesce(n, 0))::BIGINT AS stored, sum(least(coalesce(n, 0), coalesce(m, 0)))::BIGINT AS kept, sum(greatest(coalesce(m, 0) - coalesce(n, 0), 0))::BIGINT AS fresh FROM o FULL JOIN w USING (page_id, line) GROUP BY page_id
""")  # fmt: skip
def chunk_reuse(spark, sf):
    """Documents' lines as chunks: a third of the documents gets a line at its top, a third loses its first; what is indexed anew."""
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("ord", "text"), F.lit("").alias("heading_path"))
    top = table(spark, sf, "documents").where("doc_id % 3 = 0 and text is not null").select(F.col("doc_id").alias("page_id"), F.lit(-1).alias("ord"), F.lit("A paragraph that is new.").alias("text"), F.lit("").alias("heading_path"))
    stored, new = store.with_chunk_ids(lines), store.with_chunk_ids(lines.where("page_id % 3 <> 1 or ord > 0").unionByName(top))
    gone, fresh = store.matched_chunks(stored, new)
    count = lambda df, ids, name: df.join(ids, "chunk_id", "left_semi").groupBy("page_id").agg(F.count(F.lit(1)).alias(name))
    held = stored.groupBy("page_id").agg(F.count(F.lit(1)).alias("stored")).join(count(stored, gone, "gone"), "page_id", "left").join(count(new, fresh, "fresh"), "page_id", "full")
    return held.fillna(0, ["stored", "gone", "fresh"]).select("page_id", "stored", (F.col("stored") - F.col("gone")).alias("kept"), "fresh")


@query("delete_missing", "SELECT doc_id AS page_id FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 2 = 0")
def delete_missing(spark, sf):
    stored = _stored(spark, sf)
    return store.keep_listed(stored, 1, stored.where("page_id % 2 = 0").select("url")).select("page_id")


@query("cascade_delete", f"WITH {CHUNKS} SELECT site, count(DISTINCT page_id) AS pages, count(*) AS chunks, count(DISTINCT v.vec_id) AS vectors FROM c LEFT JOIN embeddings v ON v.vec_id = c.page_id AND ord = 0 WHERE site <> 'fr' GROUP BY site")
def cascade_delete(spark, sf):
    chunks = _chunks(spark, sf)
    pages = table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), F.col("lang").alias("site"), F.xxhash64("lang").alias("site_id"))
    first = chunks.where("ord = 0").select("chunk_id", "page_id")
    held = vectors(spark, sf).withColumnRenamed("chunk_id", "page_id").join(first, "page_id").select("chunk_id", "embedding")
    sites = pages.select("site_id").distinct()
    gone = pages.where("site = 'fr'").select("site_id").limit(1).first()
    out = store.without_site({"sites": sites, "pages": pages, "chunks": chunks, "vectors": held}, gone["site_id"] if gone else 0)
    counted = out["chunks"].join(out["vectors"].select("chunk_id", F.lit(1).alias("v")), "chunk_id", "left").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))
    return out["pages"].join(counted, "page_id").groupBy("site").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("chunks"), F.coalesce(F.sum("v"), F.lit(0)).alias("vectors"))


@query("site_page_counts", f"WITH {CHUNKS} SELECT site, count(DISTINCT page_id) AS page_count, count(*) AS chunk_count FROM c GROUP BY site")
def site_page_counts(spark, sf):
    pages = table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), F.col("lang").alias("site_id"))
    counted = store.site_counts(pages.select("site_id").distinct(), pages, _chunks(spark, sf))
    return counted.select(F.col("site_id").alias("site"), "page_count", "chunk_count")


@query("page_chunk_counts", f"WITH {CHUNKS} SELECT d.doc_id AS page_id, count(c.text) AS chunk_count FROM documents d LEFT JOIN c ON c.page_id = d.doc_id AND c.ord > 0 GROUP BY d.doc_id")
def page_chunk_counts(spark, sf):
    pages = table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), F.lit("").alias("url"))
    return store.page_chunk_counts(pages, _chunks(spark, sf).where("ord > 0")).drop("url")


@query("heading_frequency", "SELECT lang || ' > ' || source AS heading_path, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, heading_path LIMIT 20")
def heading_frequency(spark, sf):
    heads = table(spark, sf, "documents").select(F.concat("lang", F.lit(" > "), "source").alias("heading_path"))
    return store.heading_frequency(heads)


@query("largest_page", "SELECT doc_id AS page_id, strlen(text)::BIGINT AS markdown_size FROM documents ORDER BY markdown_size DESC, page_id LIMIT 1")
def largest_page(spark, sf):
    sized = table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), text.utf8_size(F.col("text")).alias("markdown_size"))
    return store.largest_page(sized)


@query("kv_latest", "SELECT event_type AS key, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY event_type")
def kv_latest(spark, sf):
    return store.latest_values(table(spark, sf, "events"), "event_type", "value", F.desc("ts"), F.desc("event_id"))


@query("put_meta", """
    WITH m AS (SELECT event_type AS key, count(*)::VARCHAR AS value FROM events GROUP BY event_type)
    SELECT key, value FROM m WHERE key NOT IN ('click', 'dim') UNION ALL VALUES ('click', 'new'), ('dim', '64')
""")  # fmt: skip
def put_meta(spark, sf):
    held = table(spark, sf, "events").groupBy(F.col("event_type").alias("key")).agg(F.count(F.lit(1)).cast("string").alias("value"))
    return store.put_meta(store.put_meta(held, {"click": "old"}), {"click": "new", "dim": "64"})


def _sites(spark, sf) -> DataFrame:
    """A site for each language, with the id of its first document."""
    found = table(spark, sf, "documents").groupBy("lang").agg(F.min("doc_id").alias("site_id"))
    return found.select("site_id", F.col("lang").alias("name"), F.concat(F.lit("https://"), "lang", F.lit(".example/")).alias("base_url"), F.lit(0).alias("created_at"), F.lit(None).cast("int").alias("last_crawled_at"))


def _site_tables(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    sites = _sites(spark, sf)
    pages = table(spark, sf, "documents").join(sites.select("site_id", F.col("name").alias("lang")), "lang").select("site_id", F.col("doc_id").alias("page_id"))
    return sites, pages, _chunks(spark, sf)


SITE_COUNTS = f"{CHUNKS}, s AS (SELECT lang AS name, min(doc_id) AS site_id, count(*) AS page_count FROM documents GROUP BY lang), k AS (SELECT site AS name, count(*) AS chunk_count FROM c GROUP BY site)"


@query("list_sites", f"WITH {SITE_COUNTS} SELECT site_id, name, 'https://' || name || '.example/' AS base_url, page_count, site_id = 1 AS indexing FROM s")
def list_sites(spark, sf):
    return listed_sites(*_site_tables(spark, sf), running=[1]).select("site_id", "name", "base_url", "page_count", "indexing")


@query("index_status", f"""
    WITH {SITE_COUNTS} SELECT site_id, name, page_count, chunk_count, CASE WHEN site_id = 1 THEN 'indexing' WHEN site_id IN (2, 5) THEN 'failed' ELSE 'idle' END AS status,
        CASE WHEN site_id IN (1, 2, 5) THEN 'down' END AS error FROM s JOIN k USING (name)
""")  # fmt: skip
def index_status(spark, sf):
    found = status_of(*_site_tables(spark, sf), running=[1], errors={1: "down", 2: "down", 5: "down"})
    return found.select("site_id", "name", "page_count", "chunk_count", "status", "error")


@query("hit_pages", bm25_sql([tf("tion")], "tf0 > 0", tail=")", columns="*", more=", h AS (SELECT source FROM sc ORDER BY bm25, chunk_id LIMIT 50), z AS (").replace("SELECT * FROM sc )", "SELECT 1) SELECT count(*) AS hits, count(DISTINCT source) AS pages FROM h"))
def hits_on_pages(spark, sf):
    return hit_pages(ranking.bm25_top(fts.match(text_index(spark, sf), "tion"), 50).join(docs(spark, sf), "chunk_id"))


@query("iso_times", "SELECT event_id, strftime(to_timestamp(event_id * 1234567 / 1000.0) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.') || lpad((event_id * 1234567 % 1000)::VARCHAR, 3, '0') || 'Z' AS iso FROM events")
def iso_times(spark, sf):
    return table(spark, sf, "events").select("event_id", text.iso_time(F.col("event_id") * 1_234_567).alias("iso"))


@query("mean_regressions", """
    WITH a AS (SELECT event_type AS name, min(value) AS before FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS name, min(value) AS after FROM events WHERE event_id % 2 = 1 GROUP BY 1)
    SELECT name, before, after, CASE WHEN before > 0 THEN round(after / before, 6) END AS ratio, coalesce(before > 0 AND after / before > 1.2, false) AS failed FROM a JOIN b USING (name)
""")  # fmt: skip
def mean_regressions(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("name"), F.col("value").alias("mean"), (F.col("event_id") % 2).alias("half"))
    return compare.regressions(rows.where("half = 0"), rows.where("half = 1")).withColumn("ratio", r6("ratio"))


@query("crawl_options_json", "SELECT event_id, CASE WHEN json_valid(j) THEN (j->>'maxDepth')::INT END AS max_depth, CASE WHEN json_valid(j) THEN j->>'$.includePatterns[0]' END AS include FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '{broken' ELSE '{\"maxDepth\":' || event_id % 9 || ',\"includePatterns\":[\"/' || event_type || '/**\"]}' END AS j FROM events)")
def crawl_options_json(spark, sf):
    good = F.concat(F.lit('{"maxDepth":'), (F.col("event_id") % 9).cast("string"), F.lit(',"includePatterns":["/'), F.col("event_type"), F.lit('/**"]}'))
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, "{broken").otherwise(good).alias("j")).select("event_id", parsed_options(F.col("j")).alias("o"))
    return rows.select("event_id", F.col("o.maxDepth").alias("max_depth"), F.get("o.includePatterns", F.lit(0)).alias("include"))
