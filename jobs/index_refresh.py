"""Keep a stored keyword index up to date: take the document files that are new, index them, merge small deltas.

A file stream with a checkpoint gives each new file once (``availableNow``: all there are, then it ends). A micro-batch is a
delta of the index, numbered like the batch: a batch that runs again after a failure replaces its own delta. Documents
whose id is indexed already are left out. The table of terms, partitioned like the index, is written anew when something came in.

    spark-submit jobs/index_refresh.py --documents PATH --output PATH --checkpoint PATH
"""

from __future__ import annotations

import os
import sys
import uuid

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command, log
from quillmine.operators.index import TOKEN
from quillmine.operators.term_index import BUCKETS, TermIndex
from quillmine.sources.shared import shared_folder


def run(
    spark: SparkSession, documents: str, output: str, checkpoint: str, id_column: str = "doc_id", text_column: str = "text", files_per_batch: int = 100, buckets: int = BUCKETS
) -> dict:
    """Index what is new in ``documents`` (a folder, file or pattern) into ``output``; counts of documents, batches and merges.

    A null text is an empty one; rows without an id are read and left out; of several new texts of an id the least counts.
    """
    index = TermIndex(spark, f"{output}/index", buckets)
    done = {"batches": 0, "documents_read": 0, "documents_added": 0}

    def batch(rows: DataFrame, number: int) -> None:
        chunks = rows.select(F.col(id_column).alias("chunk_id"), F.col(text_column).alias("text"))
        index.append(index.fresh(chunks, number), number)
        read, added = rows.count(), spark.read.parquet(f"{output}/index/lengths/lo={number}/hi={number}").count()
        done["batches"] += 1
        done["documents_read"] += read
        done["documents_added"] += added
        log.info("batch %d: read %d rows of %s, added %d documents", number, read, documents, added)

    rows = spark.readStream.schema(f"`{id_column}` long, `{text_column}` string").option("maxFilesPerTrigger", files_per_batch).parquet(_either(documents))
    rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    done["merges"] = index.merge()
    if done["batches"]:
        found = index.rows.groupBy("term").agg(F.sum("n").alias("df"), F.sum(F.size("positions")).alias("cf"))  # a chunk is in one span
        found = found.withColumn("bucket", F.pmod(F.crc32(F.encode("term", "utf-8")), F.lit(buckets)).cast("int"))
        found.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{output}/terms")
        log.info("wrote %s/index and %s/terms", output, output)
    else:
        log.info("nothing new in %s", documents)
    return done


def _either(path: str) -> str:
    """A folder's or a single file's path as a pattern: a file stream takes a plain path for a folder's alone."""
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def output_of(spark: SparkSession, output: str, buckets: int = BUCKETS) -> DataFrame:
    """What the job has written: ``chunk_id, term, tf, length`` of the index and the term's ``df, cf``."""
    index = TermIndex(spark, f"{output}/index", buckets)
    terms = spark.read.schema("term string, df long, cf long").parquet(f"{output}/terms").select("term", "df", "cf")
    found = index.rows.select("chunk_id", "term", F.size("positions").cast("long").alias("tf"), "length")
    return found.join(terms, "term").select("chunk_id", "term", "tf", "length", "df", "cf")


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job over the whole of ``documents``, twice into one new folder; the second run finds nothing new."""
    folder = f"{shared_folder(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        run(spark, f"{sf_dir}/documents.parquet", f"{folder}/output", f"{folder}/checkpoint")
    return output_of(spark, f"{folder}/output")


ORACLE_SQL = f"""
    WITH d AS (SELECT doc_id AS chunk_id, regexp_extract_all(lower(coalesce(min(text), '')), '{TOKEN}') AS t FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
    p AS (SELECT chunk_id, unnest(t) AS term FROM d), f AS (SELECT chunk_id, term, count(*) AS tf FROM p GROUP BY chunk_id, term),
    v AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM f GROUP BY term)
    SELECT chunk_id, term, tf, len(t)::BIGINT AS length, df, cf FROM f JOIN v USING (term) JOIN d USING (chunk_id)
"""

if __name__ == "__main__":
    command("index_refresh", run, os.path.join(os.path.dirname(os.path.abspath(__file__)), "index_refresh.json"))
