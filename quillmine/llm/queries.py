"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import language_id, line_dedup, phrases, pii, quality, substring_dedup, url_filter
from .common import documents
from .exact_dedup import exact_dedup
from .mixing import mix
from .packing import pack_documents
from .secrets import scan
from .simhash import simhash_dedup

#: Key of the registered query alone, so that its results can be compared; the operator has no default.
PII_KEY = b"registered query op8"


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir))


def op2_simhash(spark, sf_dir):
    return simhash_dedup(documents(spark, sf_dir))


def op3_language_id(spark, sf_dir):
    return language_id.identify(documents(spark, sf_dir))


def op4_packing(spark, sf_dir):
    return pack_documents(documents(spark, sf_dir))


def op5_quality(spark, sf_dir):
    docs = documents(spark, sf_dir)
    spread = quality.spread_lines(docs)
    return quality.quality(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), spread), spread)


def op6_mixing(spark, sf_dir):
    return mix(documents(spark, sf_dir))


def op7_line_dedup(spark, sf_dir):
    return line_dedup.line_dedup(documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_removed")


def op8_pii(spark, sf_dir):
    return pii.pseudonymise_documents(documents(spark, sf_dir), PII_KEY)


def op9_substring_dedup(spark, sf_dir):
    return substring_dedup.repeated_passages(documents(spark, sf_dir))


def op10_secrets(spark, sf_dir):
    return scan(documents(spark, sf_dir))


def op11_url_filter(spark, sf_dir):
    return url_filter.judged(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).drop("url")


def op12_phrases(spark, sf_dir):
    return phrases.collocations(documents(spark, sf_dir))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_simhash": op2_simhash,
    "op3_language_id": op3_language_id,
    "op4_packing": op4_packing,
    "op5_quality": op5_quality,
    "op6_mixing": op6_mixing,
    "op7_line_dedup": op7_line_dedup,
    "op8_pii": op8_pii,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_secrets": op10_secrets,
    "op11_url_filter": op11_url_filter,
    "op12_phrases": op12_phrases,
}

ORACLE_SQL = {
    "op7_line_dedup": line_dedup.ORACLE_SQL,
    "op12_phrases": phrases.ORACLE_SQL,
    "op1_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM n JOIN g USING (t)
    """,
}
