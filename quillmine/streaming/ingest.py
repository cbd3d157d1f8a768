"""Continuous ingestion: fetched pages that land as files are indexed in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.html import page_markdown
from ..operators.store import latest
from ..plans.site import Library

LANDING = "site_id long, url string, status int, body string, fetched_at timestamp, depth int"


def landing_pages(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """A stream of responses written as Parquet to ``folder``."""
    return spark.readStream.schema(LANDING).option("maxFilesPerTrigger", max_files).parquet(folder)


def ingest_stream(library: Library, responses: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Index a stream of responses. A batch is an upsert by URL and hash, so that one that runs
    again after a failure changes nothing; readers see whole batches, and a batch rewrites the buckets
    that its pages lie in."""

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.where((F.col("status") == 200) & (F.col("body") != ""))
        rows = latest(rows, ["site_id", "url"], F.desc("fetched_at"), F.desc(F.xxhash64("body")))
        pages = rows.select("site_id", "url", page_markdown(F.col("url"), F.col("body")).alias("page"), "fetched_at", "depth")
        pages = pages.where("page.markdown is not null").select("site_id", "url", "page.title", "page.markdown", "fetched_at", "depth")
        changed, buckets, _ = library.ingest(pages)  # all sites of the batch at once: one commit
        library.store.commit(changed, buckets)

    writer = responses.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def arrivals(responses: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Pages and failures per site and window of event time; later rows than ``late`` are left out."""
    ok = (F.col("status") == 200).cast("long")
    return (
        responses.withWatermark("fetched_at", late)
        .groupBy(F.window("fetched_at", window), "site_id")
        .agg(F.sum(ok).alias("pages"), F.sum(1 - ok).alias("failures"))
    )
