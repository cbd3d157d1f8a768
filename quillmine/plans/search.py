"""Search over a collection: keyword, vector and hybrid, from a query to rendered hits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.snippets import parts_of, snippet_of
from ..operators import fts, ranking
from ..operators.index import TextIndex
from ..operators.ranking import MAX_PER_PAGE, bm25_top, diversify, fetch_size, ranked, with_chunks
from ..schema import MODES, checked, one_of
from ..sources.shared import cut

RENDERED_ROWS, RENDERED_BLOCKS, RENDERED_TABLES = 20, 2, 1


@dataclass
class Corpus:
    """What a search reads: tables, the text index, and vectors with their embedder if there are any."""

    chunks: DataFrame
    pages: DataFrame
    index: TextIndex
    vectors: DataFrame | None = None
    embed_query: Callable[[str], list[float]] | None = None


def resolve_mode(mode: str, has_vectors: bool, has_embedder: bool) -> str:
    """The mode that runs: auto is hybrid where vectors and an embedder are there; hybrid falls
    back to keywords; vector search without an embedder is an error."""
    one_of("mode", mode, MODES)
    if mode == "auto":
        return "hybrid" if has_vectors and has_embedder else "bm25"
    if mode == "vector" and not has_embedder:
        raise ValueError("vector search needs embed_query")
    return "bm25" if mode == "hybrid" and not has_embedder else mode


def _bm25_hits(corpus: Corpus, query: str, k: int, site_id: int | None, strict: bool) -> DataFrame:
    scored = fts.match(corpus.index, query, strict) if query.strip() else fts.match(corpus.index, fts.Node("and"))
    where = corpus.chunks.select("chunk_id", "page_id").join(corpus.pages.select("page_id", "site_id"), "page_id")
    return ranked(bm25_top(scored.join(where, "chunk_id"), k, site_id), "bm25", "chunk_id", name="bm25_rank")


def _vector_hits(corpus: Corpus, query: str, k: int, site_id: int | None, prefilter: bool) -> DataFrame:
    vectors = corpus.vectors.join(corpus.chunks.select("chunk_id"), "chunk_id", "left_semi")  # stale vectors take no slots
    where = corpus.chunks.select("chunk_id", "page_id").join(corpus.pages.select("page_id", "site_id"), "page_id")
    if prefilter and site_id is not None:
        vectors = vectors.join(where.where(F.col("site_id") == site_id).select("chunk_id"), "chunk_id", "left_semi")
    near = ranking.knn(vectors, corpus.embed_query(query), k).join(where, "chunk_id")
    if site_id is not None:
        near = near.where(F.col("site_id") == site_id)
    return ranked(near, "distance", "chunk_id", name="vector_rank")


def search(corpus: Corpus, query: str, mode: str = "auto", top_k: int | None = None, site_id: int | None = None, max_per_page: int | None = None, prefilter: bool = False, strict: bool = False) -> tuple[DataFrame, str]:
    """Hits in order, and the mode that ran: ``position, chunk_id, page_url, page_title,
    heading_path, snippet, description, code_blocks, tables, score, source``.

    Candidates are over-fetched, fused or normalised, spread over pages, and only then joined with
    their texts and given to the Markdown and snippet functions: at most ``top_k`` rows.
    A site filter comes before the keyword cut and, unless ``prefilter``, after the vector cut.
    """
    top_k = checked("top_k", top_k)
    max_per_page = MAX_PER_PAGE if max_per_page is None else checked("max_per_page", max_per_page)
    mode = resolve_mode(mode, corpus.vectors is not None, corpus.embed_query is not None)
    k = fetch_size(top_k)
    keyword = _bm25_hits(corpus, query, k, site_id, strict) if mode != "vector" else None
    vector = _vector_hits(corpus, query, k, site_id, prefilter) if mode != "bm25" and corpus.vectors is not None else None
    if mode == "bm25":
        hits = keyword.select("chunk_id", F.col("bm25_rank").alias("rank"), ranking.normalised_bm25(F.col("bm25")).alias("score"), F.lit("bm25").alias("source"))
    elif mode == "vector":
        if vector is None:
            vector = corpus.chunks.select("chunk_id", F.lit(0.0).alias("distance"), F.lit(0).alias("vector_rank")).where("false")
        hits = vector.select("chunk_id", F.col("vector_rank").alias("rank"), ranking.vector_score(F.col("distance")).alias("score"), F.lit("vector").alias("source"))
    else:
        hits = ranking.reciprocal_rank_fusion(keyword, vector, k) if vector is not None else ranking.reciprocal_rank_fusion(keyword, keyword.withColumnRenamed("bm25_rank", "vector_rank").where("false"), k)
    place = corpus.chunks.select("chunk_id", "page_id").join(corpus.pages.select("page_id", F.col("url").alias("page_url")), "page_id").drop("page_id")
    hits = diversify(hits.join(place, "chunk_id"), top_k, max_per_page).drop("page_url", "rank")
    hits = with_chunks(hits, corpus.chunks, corpus.pages)
    return _dressed(hits, corpus, query).orderBy("position"), mode


def _dressed(hits: DataFrame, corpus: Corpus, query: str) -> DataFrame:
    try:
        phrases = fts.parse(query, corpus.index.tokenizer).leaves()
    except fts.QuerySyntaxError:
        phrases = []
    marked = snippet_of(F.col("text"), phrases, corpus.index.tokenizer == "unicode61")
    snippet = F.when(F.col("source") == "vector", F.substring("text", 1, ranking.SNIPPET_LENGTH)).otherwise(marked)
    return hits.withColumn("__parts", parts_of(F.col("text"))).select(
        "position", "chunk_id", "page_url", "page_title", "heading_path", snippet.alias("snippet"), "__parts.*", "score", "source"
    )


def site_guard(sites: DataFrame, pages: DataFrame, site_id: int, indexing: bool = False) -> str | None:
    """None if the site has pages, a hint if it has none; raises LookupError if there is no site."""
    site = sites.where(F.col("site_id") == site_id).select("name").first()
    if site is None:
        raise LookupError(f"there is no site {site_id}")
    if not pages.where(F.col("site_id") == site_id).isEmpty():
        return None
    return f"{site['name']} ({site_id}) holds no pages " + ("so far; it is being crawled, try again later" if indexing else "to search; crawl it first")


def hit_pages(hits: DataFrame) -> DataFrame:
    """One row: how many hits there are, and on how many distinct pages."""
    return hits.agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("page_url").alias("pages"))


def rendered(hits: DataFrame) -> DataFrame:
    """``position, text``: each hit as Markdown, two code blocks and twenty rows of a table at most."""

    def row(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def block(c: Column) -> Column:
        return F.concat(F.lit("\n\n```"), F.coalesce(c["language"], F.lit("")), F.lit("\n"), c["code"], F.lit("\n```"))

    def table(t: Column) -> Column:
        rest = F.size(t["rows"]) - RENDERED_ROWS
        more = F.when(rest > 0, F.concat(F.lit("\n| _… "), rest.cast("string"), F.lit(" more rows_ |"))).otherwise("")
        rows = F.array_join(F.transform(F.slice(t["rows"], 1, RENDERED_ROWS), lambda r: F.concat(F.lit("\n"), row(r))), "")
        return F.concat(F.lit("\n\n"), row(t["headers"]), F.lit("\n"), row(F.transform(t["headers"], lambda h: F.lit("---"))), rows, more)

    heading = F.coalesce(F.when(F.col("heading_path") != "", F.col("heading_path")), F.when(F.col("page_title") != "", F.col("page_title")), F.lit("(untitled)"))
    head = F.concat(
        F.lit("### "), F.col("position").cast("string"), F.lit(". "), heading,
        F.lit("\nSource: "), F.col("page_url"), F.lit("\nScore: "), F.format_string("%.3f", F.col("score")), F.lit(" ("), F.col("source"), F.lit(")"),
    )
    prose = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit("\n\n"), F.col("description"))).otherwise("")
    blocks = F.array_join(F.transform(F.slice("code_blocks", 1, RENDERED_BLOCKS), block), "")
    tables = F.array_join(F.transform(F.slice("tables", 1, RENDERED_TABLES), table), "")
    return hits.select("position", F.concat(head, prose, blocks, tables).alias("text"))


def render(hits: DataFrame, mode: str) -> str:
    """All hits (``top_k`` at most) as one text."""
    texts = [r["text"] for r in rendered(hits).orderBy("position").collect()]
    return f"mode={mode}\n\n" + "\n\n---\n\n".join(texts) if texts else "No results."


def search_batch(index: TextIndex, queries: DataFrame, top_k: int, order: tuple[Column | str, ...] = ("bm25", "chunk_id")) -> DataFrame:
    """Keyword search for many queries at once: ``query_id, chunk_id, bm25, rank`` (by ``order``).

    ``queries(query_id, terms)``: each wants all of its distinct terms (any column). One plan for
    all of them. A query's rarest term gives its candidates; its other terms' postings are only
    joined where there is a candidate, so a term that most chunks have costs what the rarest ones
    beside it let through. Then one aggregation by query and chunk, the best ``top_k`` of each.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    wanted = queries.select("query_id", F.size(F.array_distinct("terms")).alias("wanted"))
    per_row = cut(index.counts(terms.select("term").distinct()))  # read three times
    stats = index.lengths.agg(F.count(F.lit(1)).alias("rows"), F.avg("length").alias("avgdl"))
    df = per_row.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    idf = F.log((F.col("rows") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weights = df.crossJoin(F.broadcast(stats)).withColumn("idf", F.when(idf <= 0, F.lit(fts.IDF_FLOOR)).otherwise(idf))
    ordered = ranked(terms.join(weights, "term"), "n", "term", per=("query_id",))
    rarest = ordered.where("rank = 1").join(per_row, "term")
    # of a candidate: all of its query's terms that its chunk has
    others = rarest.select("query_id", "chunk_id").join(ordered.where("rank > 1"), "query_id").join(per_row, ["term", "chunk_id"])
    columns = ("query_id", "chunk_id", "idf", "tf", "avgdl")
    met = rarest.select(*columns).unionByName(others.select(*columns)).join(index.lengths, "chunk_id")
    length = fts.K1 * (1 - fts.B + fts.B * F.col("length") / F.col("avgdl"))
    scored = met.select("query_id", "chunk_id", (F.col("idf") * F.col("tf") * (fts.K1 + 1) / (F.col("tf") + length)).alias("part"))
    hits = scored.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"), F.count(F.lit(1)).alias("n"))
    hits = hits.join(wanted, "query_id").where("n = wanted").select("query_id", "chunk_id", (-F.col("score")).alias("bm25"))
    return ranked(hits, *order, per=("query_id",)).where(F.col("rank") <= top_k)
