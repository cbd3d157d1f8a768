"""The text index: tokens, postings and corpus statistics as DataFrames.

A chunk table has ``chunk_id, text, heading_path``. A collection stores postings and lengths beside
its chunks, and derives them anew for changed pages alone.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("text", "heading_path")
#: Letters, numbers and private use characters; everything else separates tokens.
TOKEN = r"[\p{L}\p{N}\p{Co}]+"
POSTINGS_SCHEMA = "chunk_id long, col int, term string, positions array<int>"
#: Tokens that a Python worker sorts at a time; a chunk with more goes alone.
SLICE = 1 << 19


def native_tokens(text: Column) -> Column:
    """Lower-cased tokens, diacritics kept. Runs in the JVM."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


@lru_cache(maxsize=1 << 16)
def _fold(char: str) -> str:
    """A token character in lower case, without a diacritic if it is Latin; "" if it is a bare
    diacritic, which stands within tokens; " " if it separates tokens."""
    code = ord(char)
    if 0x300 <= code <= 0x331:
        return ""
    kind = unicodedata.category(char)
    if kind[0] not in "LN" and kind != "Co":
        return " "
    low = char.lower()[0]
    if code >= 0xC0 and "LATIN" in unicodedata.name(low, ""):
        base = unicodedata.normalize("NFD", low)[0]
        return base if base.isalpha() else low
    return low


_ASCII = str.maketrans({chr(i): chr(i).lower() if chr(i).isalnum() else " " for i in range(128)})


def unicode61(text: str | None) -> list[str]:
    """Tokens as full-text indexes commonly cut them: folded, Latin diacritics removed, others kept."""
    if not text:
        return []
    if text.isascii():
        return text.translate(_ASCII).split()
    return "".join(map(_fold, text)).split()


def _unicode61_batch(texts: pd.Series) -> pd.Series:
    return texts.map(unicode61)


def folded_tokens(text: Column) -> Column:
    """:func:`unicode61` over Arrow batches."""
    return F.pandas_udf(_unicode61_batch, "array<string>")(text)


TOKENIZERS = {"native": native_tokens, "unicode61": folded_tokens}


def query_tokens(text: str, tokenizer: str) -> list[str]:
    """The same tokens for a query's text, on the driver."""
    if tokenizer == "unicode61":
        return unicode61(text)
    out, run = [], []
    for c in [*text.lower(), " "]:
        kind = unicodedata.category(c)
        if kind[0] in "LN" or kind == "Co":
            run.append(c)
        elif run:
            out.append("".join(run))
            run = []
    return out


def tokenise(chunks: DataFrame, tokenizer: str = "native", sized: bool = False) -> DataFrame:
    """``chunk_id, col, tokens``: a row for each chunk and indexed column; ``sized``: and the chunk's ``length``."""
    cut = TOKENIZERS[tokenizer]
    columns = [F.struct(F.lit(i).alias("col"), cut(F.col(c)).alias("tokens")) for i, c in enumerate(COLUMNS) if c in chunks.columns]
    rows, more = chunks.select("chunk_id", F.array(*columns).alias("all")), []
    if sized:
        more = ["length"]
        rows = rows.withColumn("length", F.aggregate("all", F.lit(0).cast("long"), lambda n, x: n + F.size(x["tokens"])))
    return rows.select("chunk_id", *more, F.explode("all").alias("x")).select("chunk_id", "x.col", "x.tokens", *more)


def _slices(tokens: pa.ListArray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that have ``most`` tokens together, or a single row with more."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), side="right")))
        yield at, end
        at = end


def _grouped(batches: Iterator[pa.RecordBatch], most: int = SLICE, by_term: bool = False) -> Iterator[pa.RecordBatch]:
    """``chunk_id, col, term, positions[, length]`` from rows of ``chunk_id, col, tokens[, length]``, a slice of a batch at
    a time: tokens as numbers of a dictionary, sorted by row and number (``by_term``: number and row), cut where either
    changes. What a worker holds beside a batch doesn't grow with it."""
    for batch in batches:
        for begin, end in _slices(batch.column(2), most):
            ids, cols, tokens, *more = batch.slice(begin, end - begin).columns
            coded = pc.dictionary_encode(tokens.flatten())
            sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            number = code * len(sizes) + row if by_term else row * max(1, len(coded.dictionary)) + code
            order = np.argsort(number, kind="stable")
            begins = np.flatnonzero(np.diff(number[order], prepend=-1))
            first = pa.array(order[begins])
            positions = pa.ListArray.from_arrays(pa.array(np.append(begins, len(order)).astype(np.int32)), pa.array(place[order].astype(np.int32)))
            rows = pa.array(row[order[begins]])
            terms = coded.dictionary.take(coded.indices.take(first))
            names = ["chunk_id", "col", "term", "positions", *["length"][: len(more)]]
            yield pa.RecordBatch.from_arrays([ids.take(rows), cols.take(rows), terms, positions, *(x.take(rows) for x in more)], names=names)


def postings(chunks: DataFrame, tokenizer: str = "native", sized: bool = False) -> DataFrame:
    """``chunk_id, col, term, positions`` with ascending 0-based positions; ``sized``: and the chunk's ``length``, the
    rows by term as far as they are sorted together, so that they move in fewer bytes.

    All tokens of a chunk lie in one row, so they are grouped where they lie, in Arrow batches:
    nothing is shuffled and no row is looked at by itself.
    """
    rows = tokenise(chunks, tokenizer, sized).withColumn("chunk_id", F.col("chunk_id").cast("long"))
    return rows.mapInArrow(partial(_grouped, by_term=sized), POSTINGS_SCHEMA + (", length long" if sized else ""))


def lengths(chunks: DataFrame, tokenizer: str = "native") -> DataFrame:
    """``chunk_id, length``: tokens over all columns. One projection, no shuffle."""
    cut = TOKENIZERS[tokenizer]
    total = sum((F.size(cut(F.col(c))) for c in COLUMNS if c in chunks.columns), F.lit(0))
    return chunks.select("chunk_id", total.cast("long").alias("length"))


def corpus_stats(lengths_: DataFrame) -> DataFrame:
    """One row: ``n_rows, total_tokens, avg_tokens``."""
    return lengths_.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("total_tokens"),
        F.avg("length").alias("avg_tokens"),
    )


def term_frequencies(postings_: DataFrame, columns: int = len(COLUMNS)) -> DataFrame:
    """``term, df, cf``: rows with the term, and its occurrences. With one indexed column a posting
    is a row; with more a row counts once."""
    if columns == 1:
        return postings_.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.size("positions")).alias("cf"))
    per_row = postings_.groupBy("term", "chunk_id").agg(F.sum(F.size("positions")).alias("tf"))
    return per_row.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


class TextIndex:
    """Postings, lengths and tokenizer of one chunk table; written and read as Parquet.

    Written postings are sorted by term within files that are dealt by a hash of the term, so that the
    term filter of a query prunes files' row groups by their statistics. An index that isn't written
    makes the postings of a query's terms alone from the chunks.
    """

    def __init__(self, postings_: DataFrame, lengths_: DataFrame, tokenizer: str = "native", chunks: DataFrame | None = None):
        self.postings, self.lengths, self.tokenizer, self.chunks = postings_, lengths_, tokenizer, chunks

    @classmethod
    def build(cls, chunks: DataFrame, tokenizer: str = "native") -> TextIndex:
        return cls(postings(chunks, tokenizer), lengths(chunks, tokenizer), tokenizer, chunks)

    def write(self, folder: str) -> None:
        self.postings.repartition("term").sortWithinPartitions("term", "chunk_id").write.mode("overwrite").parquet(f"{folder}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{folder}/lengths")

    @classmethod
    def read(cls, spark, folder: str, tokenizer: str = "native") -> TextIndex:
        return cls(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/lengths"), tokenizer)

    def _tokens(self) -> DataFrame:
        return tokenise(self.chunks, self.tokenizer).select("chunk_id", "col", F.posexplode("tokens").alias("pos", "term"))

    def of_terms(self, wanted: Column, terms: list[str] | None = None) -> DataFrame:
        """The postings whose ``term`` is wanted, all of ``terms`` if they are known one by one."""
        if self.chunks is None:
            return self.postings.where(wanted)
        return self._tokens().where(wanted).groupBy("chunk_id", "col", "term").agg(F.sort_array(F.collect_list("pos")).alias("positions"))

    def counts(self, terms: DataFrame) -> DataFrame:
        """``term, chunk_id, tf`` of ``terms(term)``, over all columns."""
        if self.chunks is None:
            return self.postings.join(terms, "term", "left_semi").groupBy("term", "chunk_id").agg(F.sum(F.size("positions")).alias("tf"))
        return self._tokens().join(terms, "term", "left_semi").groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("tf"))
