"""Exact nearest vectors by cells against full comparison."""

import numpy as np
import pytest

from quillmine.operators import ranking
from quillmine.operators.cells import CellIndex


def frame(spark, matrix, start=0):
    return spark.createDataFrame([(start + i, [float(x) for x in v]) for i, v in enumerate(matrix)], "chunk_id long, embedding array<float>")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["distance"], 9)) for r in df.collect())


def test_nearest_is_a_full_comparison(spark, tmp_path):
    draw = np.random.default_rng(1)
    matrix = np.concatenate([draw.normal(c, 0.2, (60, 8)) for c in draw.normal(0, 3, (12, 8))] + [np.ones((200, 8)), np.zeros((3, 8))]).astype(np.float32)  # a group of copies
    vectors = frame(spark, matrix).unionByName(spark.createDataFrame([(5000, [1.0, 2.0]), (5001, None), (5002, [])], "chunk_id long, embedding array<float>"))
    queries = vectors.where("chunk_id % 20 = 0 and size(embedding) = 8").selectExpr("chunk_id as query_id", "embedding")
    index = CellIndex.write(vectors, str(tmp_path / "cells"), 8, cells=16)
    got, work = index.nearest(queries, 10)
    assert rows(got) == rows(ranking.knn_batch(vectors, queries, 10))
    assert work.measured < 0.5 * work.of and work.of == queries.count() * len(matrix)
    again, _ = CellIndex.read(spark, str(tmp_path / "cells")).nearest(queries, 10)
    assert rows(again) == rows(got)


@pytest.mark.parametrize(("n", "k"), [(0, 3), (1, 3), (2, 5), (5, 5)])
def test_few_vectors(spark, tmp_path, n, k):
    vectors = frame(spark, np.eye(6)[:n])
    queries = frame(spark, np.full((2, 6), 0.5)).withColumnRenamed("chunk_id", "query_id")
    got, _ = CellIndex.write(vectors, str(tmp_path / "cells"), 6).nearest(queries, k)
    assert rows(got) == rows(ranking.knn_batch(vectors, queries, k))


def test_queries_of_another_dimension(spark, tmp_path):
    index = CellIndex.write(frame(spark, np.eye(6)), str(tmp_path / "cells"), 6)
    queries = spark.createDataFrame([(1, [1.0]), (2, None)], "query_id long, embedding array<float>")
    assert index.nearest(queries, 3)[0].count() == 0
