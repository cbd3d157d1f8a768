"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: Every operator splits words at these characters and no others.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python worker holds as objects at a time; a longer text goes alone.
SLICE = 1 << 20
#: Edges that a file of a round of components holds, and files at least (unless there are fewer partitions).
EDGES, LEAST_PARTS = 250_000, 8
#: Bytes of an Arrow batch between Spark and its Python workers.
ARROW_BATCH = "4m"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only a local master gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="quillmine-checkpoint-"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder, cutting its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have the cluster give back what the rounds so far have left: the broadcasts, shuffles and checkpoints that nothing
    refers to any more, which Spark frees once the driver's collector finds them gone, and the heap and buffers that the
    executors hold until they collect, which the need of the Python workers beside a JVM doesn't make them do.

    A collection for each core or so; a matter of room, not of results.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    n = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def bound_batches(spark: SparkSession, size: str = ARROW_BATCH) -> None:
    """Let Spark hand Python workers Arrow batches of some ``size`` bytes instead of its default of 64 MB (or 10,000
    rows), so that neither side holds more. A setting of the session, which stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) != size:
        spark.conf.set(name, size)


def named(column: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts are some ``size`` bytes together, a longer text with those before it."""
    if len(texts):
        sums = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        ends = [*(np.flatnonzero(np.diff(sums // size)) + 1).tolist(), len(texts)]
        yield from zip([0, *ends[:-1]], ends)


def map_texts(df: DataFrame, id_col: str, text_col: str, schema: str, start: Callable[[], Callable[[int | None, object], Iterable[tuple]]], as_type: str = "string") -> DataFrame:
    """Rows of ``schema`` for each ``(id, text)`` of ``df``: ``start()`` gives, once in a task, the function that makes
    them. A worker holds one slice of texts and its rows as objects, whatever the size of Spark's Arrow batches."""
    bound_batches(df.sparkSession)
    held = to_arrow_schema(StructType.fromDDL(schema))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of = start()
        for batch in batches:
            docs, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts):
                rows = [r for d, t in zip(docs.slice(a, b - a).to_pylist(), texts.slice(a, b - a).to_pylist()) for r in rows_of(d, t)]
                columns = zip(*rows) if rows else [()] * len(held)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, held)], schema=held)

    return df.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast(as_type).alias("text")).mapInArrow(mapped, schema)


def bounded_sample(rows: DataFrame, most: int, seed: int, most_labels: int) -> DataFrame:
    """Up to ``most`` rows of ``rows(id, label)`` for each label: the first in a hashed order.

    Labels are counted first. A label with many rows is thinned out by its hash, to four times the
    bound on average, so what one label's ranking sees doesn't grow with the table. (That fewer
    than ``most`` of so many stay is out of the question unless ids repeat.) The driver holds a row
    for each label; more than ``most_labels`` are an error.
    """
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).limit(most_labels + 1).collect()
    if len(counts) > most_labels:
        raise ValueError(f"more than {most_labels} labels")
    top = (1 << 63) - 1
    bounds = [(r["label"], top if r["n"] <= 4 * most else int(4 * most / r["n"] * 2 * top) - top) for r in counts]
    table = rows.sparkSession.createDataFrame(bounds, f"__label {rows.schema['label'].dataType.simpleString()}, __bound long")
    order = F.xxhash64("id", F.lit(seed))
    some = rows.join(F.broadcast(table), F.col("label") == F.col("__label")).where(order <= F.col("__bound"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(order, "id"))
    return some.withColumn("__n", rank).where(F.col("__n") <= most).select("id", "label")


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.xxhash64("a", "b") % 1_000_000_007), F.lit(0)).alias("s"),
    ).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every vertex of ``edges(a long, b long)``: ``id``, ``component``.

    Alternating large-star and small-star rounds until the edge set stands still. A round keeps
    at most as many edges as it had, a hub's edges are only joined (adaptive execution splits a
    hot key) or reduced by a map-side combined minimum, and every round is checkpointed, in files of
    ``EDGES`` rows or so where there are fewer edges than partitions are meant for.
    Self loops and repeated edges are allowed; vertices without edges don't appear.
    """
    edges = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = _fingerprint(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(low, "a")
        small = joined.select("a", F.col("low").alias("b")).union(
            joined.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        )
        edges = cut(small.distinct().coalesce(max(LEAST_PARTS, -(-seen[0] // EDGES))))
        now = _fingerprint(edges)
        if now == seen:
            break
        seen = now
    return edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component").union(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
