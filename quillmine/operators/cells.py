"""Exact nearest vectors by cells.

Vectors are dealt to the nearest of some centres, which a sample has given, and a cell keeps the
least and greatest distance of its vectors to its centre. By the triangle inequality no vector of a cell is
nearer to a query than the query's distance to the centre less the greatest, or the least less that
distance. A query is measured in its nearest cells first; then only the cells are read whose bound reaches
the distance of the ``top_k``-th found there. What centres a sample gives changes the work, not the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import cut
from .ranking import _nearest_rows

#: Vectors that centres are found on (the first in a hashed order), centres at most, and rounds of finding them.
SAMPLE, MOST_CELLS, ROUNDS = 50_000, 4096, 10
#: Vectors, and queries, of a cell that meet in one task, on average.
PART_ROWS, PART_QUERIES = 4096, 4096
#: Relative slack of bounds for the rounding of distances.
SLACK = 1e-9

FOUND = "query_id long, chunk_id long, distance double"


@dataclass
class Work:
    """Distances that a search measures (with repeats of a vector for each query) and all that there are."""

    measured: int
    of: int


def centres_of(vectors: DataFrame, dimension: int, cells: int, sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Centres of k-means on a bounded sample of ``vectors(chunk_id, embedding)``, in one order and partition."""
    some = vectors.orderBy(F.xxhash64("chunk_id", F.lit(seed)), "chunk_id").limit(sample).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    some = cut(some.coalesce(1))
    n = some.count()
    if n == 0:
        return np.zeros((1, dimension))
    return np.array(KMeans(k=max(2, min(cells, n)), maxIter=ROUNDS, seed=seed).fit(some).clusterCenters()) if n > 1 else np.zeros((1, dimension))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T))


class CellIndex:
    """Vectors by cell: ``vectors(chunk_id, embedding, cell, away)``, and ``cells(cell, n, least, most)``."""

    def __init__(self, vectors: DataFrame, cells: DataFrame, centres: np.ndarray):
        self.vectors, self.cells, self.centres = vectors, cells, centres

    @staticmethod
    def dealt(vectors: DataFrame, dimension: int, cells: int = 64, sample: int = SAMPLE) -> tuple[DataFrame, np.ndarray]:
        """``chunk_id, embedding, cell, away`` of the vectors of ``dimension``; others are no neighbours of any."""
        if cells > MOST_CELLS:
            raise ValueError(f"more than {MOST_CELLS} cells")
        held = vectors.where(F.size("embedding") == dimension).select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        held = held.where("chunk_id is not null")
        centres = centres_of(held, dimension, cells, sample)
        shared = vectors.sparkSession.sparkContext.broadcast(centres)

        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                matrix = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
                cell = _distances(matrix, shared.value).argmin(1)
                away = np.sqrt(((matrix - shared.value[cell]) ** 2).sum(1))  # measured directly: bounds rest on it
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(away)], names=["chunk_id", "embedding", "cell", "away"])

        return held.mapInArrow(assigned, "chunk_id long, embedding array<double>, cell int, away double"), centres

    @classmethod
    def _of(cls, vectors: DataFrame, centres: np.ndarray) -> CellIndex:
        cells = vectors.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("least"), F.max("away").alias("most"))
        return cls(vectors, cut(cells), centres)

    @classmethod
    def write(cls, vectors: DataFrame, folder: str, dimension: int, cells: int = 64, sample: int = SAMPLE) -> CellIndex:
        """Write the vectors to ``folder`` by cell, and the centres beside them."""
        spark = vectors.sparkSession
        rows, centres = cls.dealt(vectors, dimension, cells, sample)
        spread = F.pmod(F.xxhash64("chunk_id"), F.lit(8))  # a hot cell over several tasks
        rows.repartition("cell", spread).write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/vectors")
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centres")
        return cls.read(spark, folder)

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> CellIndex:
        centres = np.array([r["centre"] for r in spark.read.parquet(f"{folder}/centres").orderBy("cell").collect()])
        rows = spark.read.schema("chunk_id long, embedding array<double>, cell int, away double").parquet(f"{folder}/vectors")
        return cls._of(rows, centres)

    # ---- search

    def _bounds(self, queries: DataFrame) -> DataFrame:
        """``query_id, cell, n, bound, nth``: for each query the cells' least possible distances, and their order by distance to the centre.

        A query has a row for each cell (``MOST_CELLS`` at most).
        """
        cells = sorted((r["cell"], r["n"], r["least"], r["most"]) for r in self.cells.collect())
        at, n, least, most = (np.array(x) for x in zip(*cells)) if cells else (np.zeros(0, int),) * 4
        shared = queries.sparkSession.sparkContext.broadcast((self.centres[at], at, n, least, most))

        def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, at, n, least, most = shared.value
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    away = _distances(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1), centres)
                    scale = SLACK * (1 + away + most)
                    bound = np.maximum(0, np.maximum(away - most, least - away) - scale)
                    # the square root of a difference is off by more where both are alike: such a cell has no bound
                    bound[away < 1e-4 * (1 + most)] = 0
                    nth = away.argsort(1, kind="stable").argsort(1)
                    names = ["query_id", "cell", "n", "bound", "nth"]
                    columns = [np.repeat(part.column(0).to_numpy(zero_copy_only=False), len(at)), np.tile(at, part.num_rows), np.tile(n, part.num_rows), bound.ravel(), nth.ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int32()))], names=names)

        return queries.mapInArrow(bounds, "query_id long, cell int, n long, bound double, nth int")

    def _measured(self, wanted: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
        """``FOUND``: each query's ``top_k`` in each part of each of its cells ``wanted(query_id, cell)``.

        Parts of a cell's vectors meet parts of its queries, each of a bounded number of rows on average.
        """
        asked = {r["cell"]: r["n"] for r in wanted.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        held = {r["cell"]: r["n"] for r in self.cells.collect()}
        parts = [(c, -(-held[c] // PART_ROWS), -(-n // PART_QUERIES)) for c, n in asked.items()]
        table = F.broadcast(wanted.sparkSession.createDataFrame(parts, "cell int, rows long, asking long"))
        mine = wanted.join(table, "cell").join(queries, "query_id").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("part"), F.pmod(F.xxhash64("query_id"), F.col("asking")).alias("turn"), "query_id", "embedding")
        theirs = self.vectors.join(table, "cell").select("cell", F.pmod(F.xxhash64("chunk_id"), F.col("rows")).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("asking") - 1)).alias("turn"), "chunk_id", "embedding")

        def nearest(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(v):
                return pd.DataFrame({"query_id": [], "chunk_id": [], "distance": []}).astype({"query_id": "int64", "chunk_id": "int64", "distance": "float64"})
            block, chunk, out = np.array(v["embedding"].tolist(), np.float64), v["chunk_id"].to_numpy(), []
            for lo in range(0, len(q), 512):
                some = q.iloc[lo : lo + 512]
                d, i = _nearest_rows(np.array(some["embedding"].tolist(), np.float64), block, chunk, top_k)
                out.append(pd.DataFrame({"query_id": np.repeat(some["query_id"].to_numpy(), d.shape[1]), "chunk_id": i.ravel(), "distance": d.ravel()}))
            return pd.concat(out)

        keys = ("cell", "part", "turn")
        return mine.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInPandas(nearest, FOUND)

    def nearest(self, queries: DataFrame, top_k: int) -> tuple[DataFrame, Work]:
        """``query_id, chunk_id, distance, rank`` of ``queries(query_id, embedding)``, and the work that it takes.

        The same rows as a full comparison, ties by chunk_id. Queries of another dimension find nothing.
        """
        dimension = self.centres.shape[1]
        queries = cut(queries.where(F.size("embedding") == dimension).select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")))
        bounds = cut(self._bounds(queries))
        before = F.sum("n").over(Window.partitionBy("query_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1))
        order = cut(bounds.withColumn("before", F.coalesce(before, F.lit(0))))
        first = order.where(F.col("before") < top_k)  # the nearest cells that hold enough together
        near = cut(self._measured(first.select("query_id", "cell"), queries, top_k))
        top = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id"))).where(F.col("rank") <= top_k)
        reach = top(near).groupBy("query_id").agg(F.max("distance").alias("reach"), F.count(F.lit(1)).alias("n"))
        reach = reach.select("query_id", F.when(F.col("n") == top_k, F.col("reach")).alias("reach"))
        rest = cut(order.where(F.col("before") >= top_k).join(reach, "query_id").where(F.col("reach").isNull() | (F.col("bound") <= F.col("reach") * (1 + SLACK))))
        every = near.unionByName(self._measured(rest.select("query_id", "cell"), queries, top_k))
        work = [x.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for x in (first, rest, bounds)]
        return top(every), Work(work[0] + work[1], work[2])
