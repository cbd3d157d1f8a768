"""Postings in slices: what a Python worker holds doesn't grow with the batches that it gets."""

import random

import pyarrow as pa
import pytest

from quillmine.operators import index


def batch(sizes, seed=5):
    draw = random.Random(seed)
    tokens = [None if n is None else [f"t{draw.randrange(9)}" for _ in range(n)] for n in sizes]
    return tokens, pa.RecordBatch.from_arrays([pa.array(range(len(sizes)), pa.int64()), pa.array([0] * len(sizes), pa.int32()), pa.array(tokens, pa.list_(pa.string())), pa.array([n or 0 for n in sizes], pa.int64())], names=["chunk_id", "col", "tokens", "length"])


@pytest.mark.parametrize("by_term", [False, True])
def test_postings_by_slices(by_term):
    sizes = [3, 0, None, 40, 7, 7, 7, 1, 0, 90, 2, 0]
    tokens, rows = batch(sizes)
    parts = list(index._grouped(iter([rows]), 20, by_term))
    assert len(parts) > 4 and all(sum(map(len, p.column(3).to_pylist())) <= 20 or len(set(p.column(0).to_pylist())) == 1 for p in parts)
    got = sorted((r["chunk_id"], r["term"], r["positions"], r["length"]) for p in parts for r in p.to_pylist())
    assert got == sorted((i, t, [j for j, x in enumerate(ts) if x == t], sizes[i]) for i, ts in enumerate(tokens) if ts for t in set(ts))


def test_a_batch_is_not_held_at_once():
    """A batch of 2,000 chunks with a million tokens and more comes in several parts."""
    _, rows = batch([700] * 2000)
    parts = [sum(map(len, p.column(3).to_pylist())) for p in index._grouped(iter([rows]))]
    assert sum(parts) == 1_400_000 and max(parts) <= 1 << 19
