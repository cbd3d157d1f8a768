"""A stored keyword index that lies by term: deltas are appended, merged in tiers, and read by the bucket of a term.

Plain Parquet under one folder, a *span* being one delta or several that were merged:

- ``postings/lo=./hi=.``: ``chunk_id, col, term, positions, length, block``, partitioned by ``bucket`` and sorted by term and chunk;
  the first row of a term's block has ``n, max_tf, min_length`` too, what its postings there can score at most; null in the others
- ``lengths/lo=./hi=.``: ``chunk_id, length``
- ``stats/lo=./hi=.``: ``rows, tokens, bounded``, one file that is written last: a span without it doesn't count

A span that lies within a wider one is superseded by it. Chunks are never changed in place: a
chunk's id belongs to one text.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import cut
from .fts import IDF_FLOOR, K1, B
from .index import COLUMNS, lengths, postings

#: Parts that terms are dealt over by their hash; a search reads its terms' alone.
BUCKETS = 32
#: Ids in a block, as a chunk's id divided by it. Ids that are hashes want a width of 2^64 / chunks * 128 or so.
WIDTH = 128
#: Neighbouring spans of a tier that are merged into one of the next.
FAN_IN = 4
#: Blocks that are scored first, for a bound that the others have to reach.
FIRST_BLOCKS = 64
#: Blocks up to this many are part of the scan's filter; more are joined.
LITERAL_BLOCKS = 2000
#: Tasks that a bucket's rows are dealt over by their blocks, for one term may have most of them; small ones are put together again.
SPREAD = 8
#: Slack for sums of doubles that are compared.
SLACK = 1e-9

_POSTINGS = "chunk_id long, col int, term string, positions array<int>, length long, block long, n long, max_tf long, min_length long, bucket int"
_BLOCKS = "term string, block long, n long, max_tf long, min_length long, bucket int"
_LENGTHS = "chunk_id long, length long"


def bucket_of_term(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


@dataclass
class Scanned:
    """What a bounded search has read: postings of ``read`` blocks of all that its terms have."""

    postings: int
    of_postings: int
    blocks: int
    of_blocks: int


class TermIndex:
    """An index in ``folder``; ``buckets`` and ``width`` must be those that it was begun with.

    It answers what :class:`~quillmine.operators.index.TextIndex` answers, so the query language runs on it unchanged.
    """

    chunks = None

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, width: int = WIDTH, tokenizer: str = "native"):
        self.spark, self.folder, self.buckets, self.width, self.tokenizer = spark, folder, buckets, width, tokenizer
        self._spans: list[tuple[int, int]] | None = None

    # ---- spans

    def _path(self, table: str, span: tuple[int, int]) -> str:
        return f"{self.folder}/{table}/lo={span[0]}/hi={span[1]}"

    def all_spans(self) -> list[tuple[int, int]]:
        """Every complete span, superseded ones included: a row of ``stats`` each."""
        try:
            found = self.spark.read.schema("rows long, tokens long, bounded boolean, lo long, hi long").parquet(f"{self.folder}/stats")
        except AnalysisException:  # nothing has been written yet
            return []
        every = found.select("lo", "hi", "bounded").distinct().collect()
        if not all(r["bounded"] for r in every):
            raise ValueError(f"{self.folder} was written by an earlier version, whose blocks lay apart: index its chunks anew")
        return sorted((r["lo"], r["hi"]) for r in every)

    def spans(self) -> list[tuple[int, int]]:
        """The spans that count, in order."""
        if self._spans is None:
            every = self.all_spans()
            self._spans = [s for s in every if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in every)]
        return self._spans

    def _read(self, table: str, schema: str, buckets: Sequence[int] | None = None, spans: list[tuple[int, int]] | None = None) -> DataFrame:
        """A table of the spans, of some buckets alone: their folders are named, no other is listed."""
        spans = self.spans() if spans is None else spans
        if not spans:
            return self.spark.createDataFrame([], schema)
        parts = []
        for span in spans:
            path = self._path(table, span)
            part = self.spark.read.schema(schema).option("basePath", path)
            parts.append((part.parquet(*self._present(path, buckets)) if buckets is not None else part.parquet(path)))
        return functools.reduce(DataFrame.union, parts)

    def _present(self, path: str, buckets: Sequence[int]) -> list[str]:
        return [f"{path}/bucket={b}" for b in sorted(set(buckets))]

    # ---- changes

    def fresh(self, chunks: DataFrame, number: int) -> DataFrame:
        """``chunks`` whose ids no delta but ``number`` has, each once; of several texts of an id the least, no null ids.

        Ids alone are counted and joined; texts move only where an id repeats.
        """
        others = [s for s in self.spans() if s != (number, number)]
        known = self._read("lengths", _LENGTHS, spans=others).select("chunk_id")
        new = chunks.where("chunk_id is not null").join(known, "chunk_id", "left_anti")
        again = cut(new.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("chunk_id"))
        least = new.join(again, "chunk_id", "left_semi").groupBy("chunk_id").agg(*(F.min(c).alias(c) for c in chunks.columns if c != "chunk_id"))
        return new.join(again, "chunk_id", "left_anti").select(*chunks.columns).unionByName(least)

    def append(self, chunks: DataFrame, number: int) -> None:
        """Add ``chunks(chunk_id, text[, heading_path])``, which no other delta has, as delta ``number``; the same number
        again replaces it."""
        self._spans = None
        self._write(postings(chunks, self.tokenizer, sized=True), lengths(chunks, self.tokenizer), (number, number), "heading_path" in chunks.columns)

    def _write(self, rows: DataFrame, sized: DataFrame, span: tuple[int, int], headed: bool) -> None:
        """``rows`` move once, in few columns, and what blocks can score is found where they arrive."""
        rows = rows.select("chunk_id", "term", F.concat(F.array("col", F.col("length").cast("int")), "positions").alias("packed"))
        # every bucket gets a folder, so that a reader can name it unseen: rows without a term, whose id is the bucket's
        empty = self.spark.range(self.buckets).select(F.col("id").alias("chunk_id"), *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns[1:]))
        bucket = F.coalesce(F.pmod(F.crc32(F.encode("term", "utf-8")), F.lit(self.buckets)), F.col("chunk_id")).cast("int")
        block = F.call_function("div", "chunk_id", F.lit(self.width).cast("long"))
        spread = F.pmod(block, F.lit(SPREAD)).cast("int")
        rows = rows.unionByName(empty).repartition(bucket.alias("bucket"), spread.alias("spread"))
        rows = rows.withColumns({"block": block, "bucket": bucket, "spread": spread, "col": F.col("packed")[0], "length": F.col("packed")[1].cast("long"), "positions": F.slice("packed", 3, F.greatest(F.size("packed") - 2, F.lit(0)))})
        held = ("bucket", "term", "block", "spread")
        # one window over rows that lie in order already; two columns' greatest frequencies add up to a bound
        rows, block_of_term = rows.sortWithinPartitions(*held, "chunk_id", "col"), Window.partitionBy(*held)
        most = [F.max(F.when(F.col("col") == i, F.size("positions")).otherwise(0)) for i in range(len(COLUMNS) if headed else 1)]
        head = (F.min(F.struct("chunk_id", "col")).over(block_of_term) == F.struct("chunk_id", "col")) & F.col("term").isNotNull()
        bounds = {"n": F.size(F.collect_set("chunk_id").over(block_of_term)) if headed else F.count(F.lit(1)).over(block_of_term), "max_tf": sum(m.over(block_of_term) for m in most), "min_length": F.min("length").over(block_of_term)}
        rows = rows.withColumns({"head": head, **bounds}).withColumns({c: F.when(F.col("head"), F.col(c).cast("long")) for c in bounds})
        rows = rows.select(*(x.split()[0] for x in _POSTINGS.split(", ")))
        rows.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 4 << 20).partitionBy("bucket").parquet(self._path("postings", span))
        sized.write.mode("overwrite").parquet(self._path("lengths", span))
        stats = self.spark.read.schema(_LENGTHS).parquet(self._path("lengths", span)).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"))
        stats.withColumn("bounded", F.lit(True)).coalesce(1).write.mode("overwrite").parquet(self._path("stats", span))
        self._spans = None

    def merge(self, fan_in: int = FAN_IN) -> int:
        """Merge ``fan_in`` neighbouring spans of a tier into one, as often as there are so many; how many were made.

        The spans that went in stay until they are vacuumed, and a merge that broke off changes nothing.
        """
        made = 0
        while True:
            spans, group = self.spans(), []
            for span in spans:
                tier = lambda s: _tier(s, fan_in)
                group = [*group, span] if group and tier(group[-1]) == tier(span) and group[-1][1] + 1 == span[0] else [span]
                if len(group) == fan_in:
                    break
            else:
                return made
            whole = (group[0][0], group[-1][1])
            rows = self._read("postings", _POSTINGS, spans=group).where("term is not null")
            self._write(rows, self._read("lengths", _LENGTHS, spans=group), whole, not rows.where("col > 0").isEmpty())
            made += 1

    def vacuum(self) -> int:
        """Delete the folders of superseded spans, which no new reader opens; how many there were."""
        gone = sorted(set(self.all_spans()) - set(self.spans()))
        for span in gone:
            for table in ("stats", "lengths", "postings"):
                path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(table, span))
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return len(gone)

    # ---- what the query language reads

    @property
    def lengths(self) -> DataFrame:
        return self._read("lengths", _LENGTHS)

    @property
    def rows(self) -> DataFrame:
        """The postings with ``length`` and, for each term, ``n`` that add up to the number of its chunks."""
        return self._read("postings", _POSTINGS).where("term is not null").select("chunk_id", "col", "term", "positions", "length", "n")

    @property
    def postings(self) -> DataFrame:
        return self.rows.select("chunk_id", "col", "term", "positions")

    def _of(self, table: str, schema: str, terms: Sequence[str]) -> DataFrame:
        held = self._read(table, schema, [bucket_of_term(t, self.buckets) for t in terms])
        return held.where(F.col("term").isin(list(terms)))

    def of_terms(self, wanted: Column, terms: Sequence[str] | None = None) -> DataFrame:
        """The postings whose ``term`` is wanted; if these are known ``terms``, their buckets alone are opened."""
        held = self._read("postings", _POSTINGS, None if terms is None else [bucket_of_term(t, self.buckets) for t in terms])
        return held.where(wanted).select("chunk_id", "col", "term", "positions")

    def counts(self, terms: DataFrame) -> DataFrame:
        """``term, chunk_id, tf`` of ``terms(term)``, over all columns."""
        return self.postings.join(terms, "term", "left_semi").groupBy("term", "chunk_id").agg(F.sum(F.size("positions")).alias("tf"))

    # ---- bounded top-k

    def best(self, terms: Sequence[str], top_k: int, every: bool = False) -> tuple[DataFrame, Scanned]:
        """``chunk_id, bm25`` of the ``top_k`` best chunks with any (``every``: all) of the terms, and what was read.

        A block of chunks can score at most what its greatest frequency and least length give, summed over the
        terms. The blocks with the highest bounds are scored first; of the others only those are read whose
        bound reaches the score of the ``top_k``-th found there. Rows and scores are those of a full search.
        """
        terms = list(dict.fromkeys(terms))
        if not terms:
            return self.spark.createDataFrame([], "chunk_id long, bm25 double"), Scanned(0, 0, 0, 0)
        bounds = self._of("postings", _BLOCKS, terms).where("n is not null")
        n = {r["term"]: r["n"] for r in bounds.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        known = [t for t in terms if t in n]
        nothing = self.spark.createDataFrame([], "chunk_id long, bm25 double"), Scanned(0, sum(n.values()), 0, 0)
        if not known or every and len(known) < len(terms):
            return nothing
        spans = self.spans()
        stats = functools.reduce(DataFrame.union, [self.spark.read.schema("rows long, tokens long").parquet(self._path("stats", s)) for s in spans])
        rows, tokens = stats.agg(F.sum("rows"), F.sum("tokens")).first()
        average = tokens / rows
        plain = {t: F.log(F.lit((rows - n[t] + 0.5) / (n[t] + 0.5))) for t in known}
        idf = {t: F.when(x <= 0, F.lit(IDF_FLOOR)).otherwise(x) for t, x in plain.items()}

        def score(tf: Column, length: Column, weight: Column) -> Column:
            return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(average)))

        weight = functools.reduce(lambda w, t: w.when(F.col("term") == t, idf[t]), known[1:], F.when(F.col("term") == known[0], idf[known[0]]))
        # a block of several spans has several bounds for a term: the greatest holds
        most = bounds.withColumn("most", score(F.col("max_tf"), F.col("min_length"), weight)).groupBy("term", "block").agg(F.max("most").alias("most"), F.sum("n").alias("n"))
        blocks = most.groupBy("block").agg(F.sum("most").alias("most"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("terms"))
        if every:
            blocks = blocks.where(F.col("terms") == len(known))
        blocks = cut(blocks)

        def found(chosen: DataFrame) -> DataFrame:
            some = [r["block"] for r in chosen.select("block").limit(LITERAL_BLOCKS + 1).collect()]
            held = self._of("postings", _POSTINGS, known)
            held = held.where(F.col("block").isin(some)) if len(some) <= LITERAL_BLOCKS else held.join(chosen.select("block"), "block", "left_semi")
            tfs = [F.sum(F.when(F.col("term") == t, F.size("positions"))).alias(f"tf{i}") for i, t in enumerate(known)]
            per = held.groupBy("chunk_id").agg(F.min("length").alias("length"), *tfs)
            if every:
                per = per.where(functools.reduce(Column.__and__, [F.col(f"tf{i}").isNotNull() for i in range(len(known))]))
            total = F.lit(0.0)
            for i, t in enumerate(known):
                total += F.coalesce(score(F.col(f"tf{i}"), F.col("length"), idf[t]), F.lit(0.0))
            return per.select("chunk_id", (-total).alias("bm25")).orderBy("bm25", "chunk_id").limit(top_k)

        first = found(blocks.orderBy(F.desc("most"), "block").limit(FIRST_BLOCKS)).agg(F.max("bm25").alias("worst"), F.count(F.lit(1)).alias("n")).first()
        chosen = blocks.where(F.col("most") >= -first["worst"] - SLACK) if first["n"] == top_k else blocks
        read = chosen.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        return found(chosen), Scanned(read[0], sum(n.values()), read[1], blocks.count())


def _tier(span: tuple[int, int], fan_in: int) -> int:
    size, tier = span[1] - span[0] + 1, 0
    while size >= fan_in:
        size, tier = size // fan_in, tier + 1
    return tier
