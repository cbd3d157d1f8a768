"""Removal of lines that spread over many sites."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, named, slices, unused

#: A line is boilerplate from this many distinct sites.
SITES = 10
#: Near-duplicate documents count as one: of the documents with a line, at least this share, and at least ``SITES``, must
#: have distinct companies.
DISTINCT_SHARE = 0.5
#: Sketches hold 2^LG_K registers; estimates off a threshold by less than MARGIN times it are
#: counted exactly. The relative standard error is about 1.04 / sqrt(2^LG_K) = 3.3 %.
LG_K = 10
MARGIN = 0.3
#: Boilerplate lines up to this many go to every task as 16-byte hashes; more are joined.
BROADCAST_LINES = 200_000
#: Parts that the rows of a line are dealt over where they are joined to more lines than that.
SALTS = 32


def bare(line: Column) -> Column:
    """A line without the white space at its ends."""
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def line_key(line: Column) -> Column:
    """128-bit hash of a line without the white space at its ends; null if it has no word."""
    return F.when(bare(line) != "", F.unhex(F.md5(bare(line))))


def occurrences(df: DataFrame, site_col: str = "source", text_col: str = "text") -> DataFrame:
    """``key, site, company``: a row for each distinct line with a word of each document.

    A line's company stands for the rest of its document: a MinHash sample of the other lines,
    weighted by their lengths, so that two documents that carry the line have the same company with
    the probability of their weighted Jaccard similarity without it. Copies of a document share
    their companies, and near copies mostly do, however many sites carry them; a boilerplate line
    stands in ever other company. The only line of its document has a null company.
    """
    # a line as its hash in hexadecimal digits, followed by its length
    marked = F.transform(F.split(F.col(text_col), "\n"), lambda x: bare(x))
    marked = F.transform(F.filter(marked, lambda x: x != ""), lambda x: F.concat(F.md5(x), F.length(x).cast("string")))
    rows = df.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(site_col).cast("string"), F.lit("\0null")).alias("site"), F.array_distinct(marked).alias("lines"))

    def sample(lines: Column) -> Column:
        draw = lambda x: (F.conv(F.substring(x, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
        return F.array_min(F.transform(lines, lambda x: F.struct((-F.ln(draw(x)) / F.substring(x, 33, 10).cast("double")).alias("at"), x.alias("line"))))["line"]

    rows = rows.withColumn("first", sample(F.col("lines")))
    rows = rows.withColumn("second", sample(F.filter("lines", lambda x: x != F.col("first"))))
    rows = rows.select("site", F.xxhash64("first").alias("a"), F.when(F.col("second").isNotNull(), F.xxhash64("second")).alias("b"), "first", F.explode("lines").alias("line"))
    return rows.select(F.unhex(F.substring("line", 1, 32)).alias("key"), "site", F.when(F.col("line") == F.col("first"), F.col("b")).otherwise(F.col("a")).alias("company"))


def _of_lines(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The ``rows`` of the lines ``keys``. While these are few the rows stay where they lie; else a common
    line's rows are dealt over several tasks, by their companies."""
    if keys.count() <= BROADCAST_LINES:
        return rows.join(F.broadcast(keys), "key", "left_semi")
    dealt = rows.withColumn("salt", F.coalesce(F.pmod("company", F.lit(SALTS)), F.lit(0)))
    return dealt.join(keys.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["key", "salt"], "left_semi").drop("salt")


def boilerplate(rows: DataFrame, sites: int = SITES, share: float = DISTINCT_SHARE, margin: float = MARGIN) -> DataFrame:
    """``key`` of the lines on ``sites`` distinct sites or more whose documents aren't mostly copies
    of one another, from ``occurrences`` (written down before it is read twice).

    Each line hash gets two HyperLogLog sketches, of sites and of companies, merged by aggregation.
    A line whose estimate lies clearly below a threshold is out, one whose estimates lie clearly
    above both is in, and the lines between get exact distinct counts. Lines with too few documents
    or one site (nearly all) are told apart by a count and the least and greatest site: no sketch.
    """
    several = rows.groupBy("key").agg(F.min("site").alias("lo"), F.max("site").alias("hi"), F.count(F.lit(1)).alias("n"))
    several = cut(several.where((F.col("n") >= sites) & ((F.lit(sites) <= 1) | (F.col("lo") < F.col("hi")))).select("key", "n"))
    spread = _of_lines(rows, several.select("key"))
    estimates = spread.groupBy("key").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"),
        F.hll_sketch_estimate(F.hll_sketch_agg("company", F.lit(LG_K))).alias("companies"),
    )
    least = F.greatest(F.lit(sites), F.ceil(F.col("n") * share))
    estimates = estimates.join(several, "key").select("key", "sites", "companies", least.alias("least"))
    estimates = cut(estimates.where((F.col("sites") >= sites * (1 - margin)) & (F.col("companies") >= F.col("least") * (1 - margin))))
    unsure = (F.col("sites") <= sites * (1 + margin)) | (F.col("companies") <= F.col("least") * (1 + margin))
    near = estimates.where(unsure).select("key", "least")
    # a common line's distinct values are counted map-side: its few sites are all that moves
    close = _of_lines(rows, near.select("key"))
    counted = [close.select("key", c).where(F.col(c).isNotNull()).distinct().groupBy("key").agg(F.count(F.lit(1)).alias(c)) for c in ("site", "company")]
    exact = near.join(counted[0], "key").join(counted[1], "key").where((F.col("site") >= sites) & (F.col("company") >= F.col("least")))
    return estimates.where(~unsure).select("key").union(exact.select("key"))


def _bare_key(line: str) -> bytes | None:
    bare = line.strip(" \t\n\v\f\r")
    return hashlib.md5(bare.encode("utf-8", "surrogatepass")).digest() if bare else None


def line_dedup(
    df: DataFrame, site_col: str = "source", text_col: str = "text", sites: int = SITES, share: float = DISTINCT_SHARE, counts: bool = True, broadcast_lines: int = BROADCAST_LINES
) -> DataFrame:
    """``df`` without the boilerplate lines in ``text_col``, and ``n_lines``, ``n_removed`` (long)
    if ``counts``.

    A line is boilerplate if it stands on ``sites`` distinct sites or more and its documents are not
    mostly near copies of one another (``share``, see :func:`occurrences`): taking out the lines of
    a copied document is the work of document deduplication. A null text stays null and has no
    lines; a text whose lines all go becomes empty, its row stays. Lines without a word are never
    removed, nor is a line that is the only one of all its documents. A null site is a site of its
    own; repeated rows count as documents. Columns of the input that are called like the two new
    ones are replaced (with ``counts``); all others are kept. An empty table gives no rows.

    Lines are hashed once, to narrow rows; texts are not shuffled while the boilerplate's hashes
    fit the stated bound. Beyond it they are joined to the lines.
    """
    bound_batches(df.sparkSession)
    keys = cut(boilerplate(cut(occurrences(df, site_col, text_col)), sites, share))
    new = ("n_lines", "n_removed") if counts else ()
    kept = [c for c in df.columns if c not in new]
    if keys.count() <= broadcast_lines:
        known = frozenset(bytes(r["key"]) for r in keys.collect())
        shared = df.sparkSession.sparkContext.broadcast(known)

        def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            gone = shared.value
            for batch in batches:
                for a, b in slices(batch):
                    texts, sizes, removed = [], [], []
                    for text in batch.slice(a, b - a).to_pylist():
                        lines = text.split("\n") if text is not None else []
                        stay = [x for x in lines if _bare_key(x) not in gone] if gone else lines
                        texts.append("\n".join(stay) if text is not None else None)
                        sizes.append(len(lines))
                        removed.append(len(lines) - len(stay))
                    yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64())], names=["text", "n_lines", "n_removed"])

        at = unused(df, "cleaned")
        out = df.withColumn(at, F.arrow_udf(clean, "text string, n_lines long, n_removed long")(F.col(f"`{text_col}`").cast("string")))
        return out.select(*(F.col(at)["text"].alias(c) if c == text_col else named(c) for c in kept), *(F.col(at)[c].alias(c) for c in new))
    # rows are told apart by a number that is written down before it is used twice
    row, at, line, gone_at, lines_at = (unused(df, x) for x in ("row", "at", "line", "gone", "lines"))
    rows = cut(df.withColumn(row, F.monotonically_increasing_id()))
    lines = rows.select(row, F.posexplode(F.split(F.col(f"`{text_col}`"), "\n")).alias(at, line))
    gone = lines.select(row, at, line_key(F.col(line)).alias("key")).join(keys, "key", "left_semi")
    gone = gone.groupBy(row).agg(F.collect_set(at).alias(gone_at))
    out = rows.join(gone, row, "left").withColumn(lines_at, F.split(F.col(f"`{text_col}`"), "\n"))
    out = out.withColumn(gone_at, F.coalesce(gone_at, F.array().cast("array<int>")))
    text = F.array_join(F.filter(lines_at, lambda x, i: ~F.array_contains(gone_at, i)), "\n")
    made = {"n_lines": F.coalesce(F.size(lines_at), F.lit(0)).cast("long"), "n_removed": F.size(gone_at).cast("long")}
    return out.select(*(text.alias(c) if c == text_col else named(c) for c in kept), *(made[c].alias(c) for c in new))


#: The same rows by exact distinct counts.
ORACLE_SQL = rf"""
    WITH l AS (SELECT doc_id, coalesce(source, chr(1) || 'null') AS site, i, line,
                   regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare
               FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                         generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
    m AS (SELECT doc_id, any_value(site) AS site, bare, -ln((('0x' || substr(md5(bare), 1, 12))::UBIGINT + 0.5) / 281474976710656) / length(bare) AS drawn
          FROM l WHERE bare <> '' GROUP BY doc_id, bare),
    c AS (SELECT doc_id, list(bare ORDER BY drawn)[1:2] AS least FROM m GROUP BY doc_id),
    b AS (SELECT bare FROM (SELECT bare, site, CASE WHEN bare = least[1] THEN least[2] ELSE least[1] END AS company FROM m JOIN c USING (doc_id))
          GROUP BY bare HAVING count(DISTINCT site) >= {SITES} AND count(DISTINCT company) >= greatest({SITES}, ceil({DISTINCT_SHARE} * count(*)))),
    r AS (SELECT doc_id, count(*) AS n_lines, count(b.bare) AS n_removed,
              coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE b.bare IS NULL), '') AS text
          FROM l LEFT JOIN b ON l.bare = b.bare GROUP BY doc_id)
    SELECT doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE r.text END AS text,
        coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
    FROM documents d LEFT JOIN r USING (doc_id)
"""
