"""Embeddings from a pluggable function or an HTTP endpoint."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BATCH, TIMEOUT, PROBE_TIMEOUT, WORKERS = 16, 60.0, 5.0, 4
EMBEDDED = "struct<vector:array<float>,error:string>"
Embedder = Callable[[list[str]], list[list[float]]]


def http_embedder(base_url: str, model: str, token: str | None = None, timeout: float = TIMEOUT) -> Embedder:
    """``POST {model, input}`` to the endpoint's ``/embeddings``; results by index, else by place."""

    def embed(texts: list[str]) -> list[list[float]]:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
        body = json.dumps({"model": model, "input": texts}).encode()
        request = urllib.request.Request(base_url.removesuffix("/") + "/embeddings", body, headers)
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            found = json.loads(answer.read())["data"]
        out: list[list[float]] = [[] for _ in texts]
        for place, x in enumerate(found):
            out[x.get("index", place)] = x["embedding"]
        return out

    return embed


def in_batches(embed: Embedder, texts: list[str], size: int = BATCH, workers: int = WORKERS) -> list[list[float]]:
    """Vectors in the texts' order; requests of ``size`` texts, ``workers`` at a time."""
    parts = [texts[i : i + size] for i in range(0, len(texts), size)]
    if len(parts) < 2:
        return [v for part in parts for v in embed(part)]
    with ThreadPoolExecutor(min(workers, len(parts))) as pool:
        return [v for part in pool.map(embed, parts) for v in part]


def embedded(text: Column, embed: Embedder, size: int = BATCH, workers: int = WORKERS) -> Column:
    """``struct(vector, error)`` of a text column. A request that fails gives its texts no vector and
    the error instead: pages are indexed without vectors rather than not at all."""

    def safe(texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
        try:
            vectors = embed(texts)
            return [(list(vectors[i]) if i < len(vectors) else None, None) for i in range(len(texts))]
        except Exception as e:  # noqa: BLE001  whatever an embedder raises
            return [(None, f"{type(e).__name__}: {e}")] * len(texts)

    def batch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(in_batches(safe, texts.fillna("").tolist(), size, workers), columns=["vector", "error"])

    return F.pandas_udf(batch, EMBEDDED)(text)


def probe(embed: Embedder | None) -> tuple[int | None, str | None]:
    """``(dimension, None)`` if the embedder answers, else ``(None, reason)``."""
    if embed is None:
        return None, "no embedder"
    try:
        vector = embed(["probe"])[0]
    except Exception as e:  # noqa: BLE001  any failure makes vectors unavailable, and is reported
        return None, f"{type(e).__name__}: {e}"
    return (len(vector), None) if vector else (None, "empty vector")
