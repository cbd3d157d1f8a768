"""Candidate generation, fusion, normalisation and diversification of ranked hits."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import cut

RRF_K = 60
FETCH_MULTIPLIER, FETCH_LEAST = 3, 50
MAX_PER_PAGE = 2
SNIPPET_LENGTH = 200
#: Numbers in a block of a matrix product of queries and vectors.
CELLS = 4_000_000
#: Bytes of query vectors that go to a task at a time.
QUERY_BYTES = 64 << 20


def fetch_size(top_k: int) -> int:
    """Candidates fetched so that the per-page cap still leaves enough."""
    return max(top_k * FETCH_MULTIPLIER, FETCH_LEAST)


def with_chunks(hits: DataFrame, chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Hits with their chunk's text and page; hits of chunks that are gone drop out."""
    page = pages.select("page_id", "site_id", F.col("url").alias("page_url"), F.col("title").alias("page_title"))
    return hits.join(chunks.select("chunk_id", "page_id", "heading_path", "text"), "chunk_id").join(page, "page_id")


def bm25_top(scored: DataFrame, top_k: int, site_id: int | None = None) -> DataFrame:
    """Best ``top_k`` of scored hits: the site filter comes before the cut, ties go by chunk_id."""
    if site_id is not None:
        scored = scored.where(F.col("site_id") == site_id)
    return scored.orderBy("bm25", "chunk_id").limit(top_k)


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays, accumulated in double precision."""
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2)))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def knn(vectors: DataFrame, query: list[float], top_k: int) -> DataFrame:
    """``chunk_id, distance`` of the exact nearest vectors of ``vectors(chunk_id, embedding)``;
    vectors of another dimension are no neighbours."""
    held = F.array(*(F.lit(float(np.float32(x))) for x in query))
    near = vectors.where(F.size("embedding") == len(query)).select("chunk_id", l2(F.col("embedding"), held).alias("distance"))
    return near.orderBy("distance", "chunk_id").limit(top_k)


def knn_sites(near: DataFrame, site_id: int | None, top_k: int, prefilter: bool = False) -> DataFrame:
    """A site's part of the nearest: of the ``top_k`` nearest by default (so there may be fewer),
    the ``top_k`` nearest of the site with ``prefilter``. ``near`` has ``distance, site_id``."""
    if prefilter and site_id is not None:
        near = near.where(F.col("site_id") == site_id)
    near = near.orderBy("distance", "chunk_id").limit(top_k)
    return near if prefilter or site_id is None else near.where(F.col("site_id") == site_id)


def _nearest_rows(matrix: np.ndarray, block: np.ndarray, chunk: np.ndarray, top_k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ids of each query's ``top_k`` in a block of vectors, in the order of distance, id."""
    # |q - v|^2 = |q|^2 + |v|^2 - 2 qv picks candidates, which are then measured directly: all that
    # the error of this sum leaves within the k-th, for equal distances go by id
    own, other = (matrix**2).sum(1), (block**2).sum(1)
    square = own[:, None] + other - 2 * matrix @ block.T
    k = min(len(chunk), top_k)
    error = 4 * (matrix.shape[1] + 4) * np.finfo(np.float64).eps * (own + other.max())
    within = square <= (np.partition(square, k - 1, axis=1)[:, k - 1] + 2 * error)[:, None]
    best_d, best_i = np.empty((len(matrix), k)), np.empty((len(matrix), k), np.int64)
    for n, near in enumerate(within):
        some = np.flatnonzero(near)
        exact = np.sqrt(((matrix[n] - block[some]) ** 2).sum(1))
        order = np.lexsort((chunk[some], exact))[:k]
        best_d[n], best_i[n] = exact[order], chunk[some][order]
    return best_d, best_i


def knn_batch(vectors: DataFrame, queries: DataFrame, top_k: int, max_queries: int = 100_000) -> DataFrame:
    """``query_id, chunk_id, distance, rank`` for many queries (``query_id, embedding``) at once.

    The queries come to the driver in order and go to every task, ``max_queries`` or ``QUERY_BYTES`` at a time, each time
    with a pass over the vectors; each task keeps its ``top_k`` for each query by block matrix
    products, so what is shuffled is bounded by tasks x queries x k. The driver holds the queries.
    """
    schema = "query_id long, chunk_id long, distance double"
    rows, found = queries.orderBy("query_id").toLocalIterator(), []
    if first := next(rows, None):
        max_queries = max(1, min(max_queries, QUERY_BYTES // (8 * max(1, len(first["embedding"])))))
        rows = itertools.chain([first], rows)
    while part := list(itertools.islice(rows, max_queries)):
        found.append(_nearest(vectors, np.array([r["query_id"] for r in part]), np.array([r["embedding"] for r in part], np.float64), top_k, schema))
    if not found:
        return vectors.sparkSession.createDataFrame([], schema + ", rank int")
    near = functools.reduce(DataFrame.union, found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= top_k)


def _nearest(vectors: DataFrame, ids: np.ndarray, matrix: np.ndarray, top_k: int, schema: str) -> DataFrame:
    """Each task's ``top_k`` for each of the queries."""

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best_d, best_i = np.empty((len(ids), 0)), np.empty((len(ids), 0), np.int64)
        for batch in batches:
            batch = batch[[len(v) == matrix.shape[1] for v in batch["embedding"]]]
            if not len(batch):
                continue
            block, chunk = np.array(batch["embedding"].tolist(), np.float64), batch["chunk_id"].to_numpy()
            step = max(1, CELLS // len(block))
            parts = [_nearest_rows(matrix[n : n + step], block, chunk, top_k) for n in range(0, len(ids), step)]
            best_d = np.concatenate([best_d, np.concatenate([d for d, _ in parts])], axis=1)
            best_i = np.concatenate([best_i, np.concatenate([i for _, i in parts])], axis=1)
            order = np.lexsort((best_i, best_d), axis=1)[:, :top_k]
            best_d, best_i = np.take_along_axis(best_d, order, 1), np.take_along_axis(best_i, order, 1)
        n = best_d.shape[1]
        yield pd.DataFrame({"query_id": np.repeat(ids, n), "chunk_id": best_i.ravel(), "distance": best_d.ravel()})

    return vectors.select(F.col("chunk_id").cast("long").alias("chunk_id"), "embedding").where("embedding is not null").mapInPandas(nearest, schema)


def ranked(hits: DataFrame, *order: Column | str, name: str = "rank", per: tuple[str, ...] = ()) -> DataFrame:
    """1-based list position of hits that a top-k has bounded (within ``per``, if given)."""
    return hits.withColumn(name, F.row_number().over(Window.partitionBy(*per).orderBy(*order)))


def positions(hits: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """``hits`` with their 1-based place in the order of all, for any number of them: sorted over many tasks, then
    numbered within each, behind the rows of the tasks before it."""
    made = cut(hits.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = {r["part"]: r["n"] for r in made.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a task
    starts = list(itertools.accumulate((sizes[p] for p in sorted(sizes)), initial=0))
    before = hits.sparkSession.createDataFrame(list(zip(sorted(sizes), starts)), "__part long, __before long")
    made = made.withColumn("__part", part).join(F.broadcast(before), "__part")
    return made.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).drop("__at", "__part", "__before")


def vector_score(distance: Column) -> Column:
    return F.lit(1.0) - F.least(F.lit(1.0), distance)


def normalised_bm25(score: Column, per: tuple[str, ...] = ()) -> Column:
    """Share of the best (first) hit's score; 0 where that is 0."""
    best = F.max(F.abs(score)).over(Window.partitionBy(*per))
    return F.when(best > 0, F.abs(score) / best).otherwise(0.0)


def normalised(hits: DataFrame, score: str = "bm25") -> DataFrame:
    """``hits`` with ``score`` as :func:`normalised_bm25` gives it, for any number of them: the best score is found by one aggregation."""
    best = hits.agg(F.max(F.abs(score)).alias("__best"))
    share = F.when(F.col("__best") > 0, F.abs(score) / F.col("__best")).otherwise(0.0)
    return hits.crossJoin(F.broadcast(best)).withColumn("score", share).drop("__best")  # a single row


def reciprocal_rank_fusion(bm25: DataFrame, vector: DataFrame, top_k: int, k: int = RRF_K, per: tuple[str, ...] = ()) -> DataFrame:
    """Fuse ``bm25(chunk_id, bm25_rank)`` and ``vector(chunk_id, vector_rank)``:
    ``chunk_id, bm25_rank, vector_rank, score, source, rank``.

    A full outer join; a hit's score is the sum of 1 / (k + rank) over its lists, divided by the
    best hit's. Ties keep the keyword list's order, then the vector list's.
    """
    both = bm25.select(*per, "chunk_id", "bm25_rank").join(vector.select(*per, "chunk_id", "vector_rank"), [*per, "chunk_id"], "full_outer")

    def term(rank: str) -> Column:
        return F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(rank)), F.lit(0.0))

    both = both.withColumn("raw", term("bm25_rank") + term("vector_rank"))
    order = [F.desc("raw"), F.asc_nulls_last("bm25_rank"), F.asc_nulls_last("vector_rank")]
    source = F.when(F.col("bm25_rank").isNull(), "vector").when(F.col("vector_rank").isNull(), "bm25").otherwise("both")
    both = ranked(both, *order, per=per).withColumn("score", F.col("raw") / F.max("raw").over(Window.partitionBy(*per)))
    return both.where(F.col("rank") <= top_k).select(*per, "chunk_id", "bm25_rank", "vector_rank", "score", source.alias("source"), "rank")


def diversify(hits: DataFrame, top_k: int, max_per_page: int = MAX_PER_PAGE, page: str = "page_url", per: tuple[str, ...] = ()) -> DataFrame:
    """At most ``max_per_page`` hits of a page while others remain, then the leftovers in rank
    order: adds ``position``. The accepted come first, so positions need not follow scores."""
    if max_per_page <= 0:
        order = [F.col("rank")]
    else:
        own = F.row_number().over(Window.partitionBy(*per, page).orderBy("rank"))
        hits = hits.withColumn("__own", own)
        order = [(F.col("__own") > max_per_page).cast("int"), F.col("rank")]
    return ranked(hits, *order, name="position", per=per).drop("__own").where(F.col("position") <= top_k)
