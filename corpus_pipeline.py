"""From raw documents to packed training sequences: five stages, each a written table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.llm.common import documents, shared_folder
from quillmine.llm.language_id import keep_identified
from quillmine.llm.line_dedup import line_dedup
from quillmine.llm.mixing import mixed_documents
from quillmine.llm.packing import pack_documents
from quillmine.llm.simhash import keep_one


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a determinable language."""
    return keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take boilerplate lines out of the texts; every document stays, with its length up to date (if there is such a column)."""
    out = line_dedup(docs, counts=False)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw the sources to their target weights, in the mix's order: a document comes once for each pass that takes it."""
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what was drawn into windows: a row for each piece."""
    return pack_documents(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packed", packed)]

#: A recurrent network, XXH64 fingerprints and a tokenizer are beyond SQL.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again.
    A stage's table goes when the next one's is complete; the last one's is the result.

    Null, empty and blank texts have no language and go in the first stage; null sources are a
    source of their own. Rows without an id pass until the mixture, which can't tell them apart and
    leaves them out; rows that repeat an id count as one document from the near duplicates on (the
    one that stays is any of them there). Extra columns are kept until the last stage, whose rows
    are pieces; an empty table gives no rows.
    """
    folder, docs, before = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}", documents(spark, sf_dir), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _delete(spark, before)
        before = f"{folder}/{name}"
    return docs
