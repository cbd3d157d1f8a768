"""Phrase collocations by hierarchical pair naming.

Frequent words get numbers. Two numbers of frequent (k-1)-word phrases that begin one word apart are
a pair, and a frequent pair is a k-word phrase that gets a number of its own: all positions where
it stands are renamed, and the next level pairs these. A phrase's two parts, without its last and
without its first word, are thus known by number, and whatever is asked of the phrases inside it
(the parts of a cut, what a longer phrase covers) follows these links, never the texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, cut, named, shared_folder, slices

#: Words of a phrase at most, occurrences of a candidate at least, phrases of a language in the report.
LONGEST, LEAST, REPORTED = 4, 30, 2000
#: A phrase is covered if a longer candidate around it has this share of its occurrences (percent).
COVERED = 80
SCALE = 2_000_000
UNKNOWN = "und"
#: Names up to this many go to every task (16 bytes a pair); more are joined to the positions.
BROADCAST_NAMES = 1_000_000
#: Positions of a row of names: a longer document has several, which share what reaches over their edges.
BLOCK = 1 << 14
#: Bytes of text that a worker splits at a time.
TEXT_SLICE = 4 << 20
#: Parts that a language's phrases are ranked in before they are ranked together.
PARTS = 64

#: Names in a block of text: how far each stands from the one before (the first from the block's beginning), and its number.
ROWS = "block long, gaps array<int>, ids array<long>"


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of every word of ``texts``: its row, its position (a break between pieces has one too), and its
    number among the distinct words, the last result."""
    marked = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), r"[.,;:!?\x0A-\x0D]", " \n ")
    parts = pc.split_pattern_regex(marked, r"[\x20\x09]+")
    tokens = parts.flatten().dictionary_encode()
    lengths = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    code = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    word = ~pc.is_in(tokens.dictionary, pa.array(["", "\n"], tokens.dictionary.type)).to_numpy(zero_copy_only=False)
    keep = word[code] if len(code) else np.zeros(0, bool)
    return rows[keep], at[keep], code[keep], tokens.dictionary


def _text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Row numbers, languages (encoded) and the words of slices of ``row, lang, text``."""
    for batch in batches:
        for a, b in slices(batch.column(2), TEXT_SLICE):
            ids, langs, texts = (batch.column(i).slice(a, b - a) for i in range(3))
            yield ids.to_numpy(zero_copy_only=False), pc.fill_null(langs, UNKNOWN).dictionary_encode(), _split(texts)


def _keys(langs: pa.DictionaryArray, row: np.ndarray, code: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (language, word) of tokens: language and word of each, each token's, and counts."""
    lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row] if len(row) else row
    which, back, n = np.unique(lang * len(words) + code, return_inverse=True, return_counts=True)
    return which // max(1, len(words)), which % max(1, len(words)), back, n


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, word, n`` of each slice; with a null word, all words of the language."""
    for _, langs, (row, _, code, words) in _text_slices(batches):
        lang, word, _, n = _keys(langs, row, code, words)
        sums = np.bincount(lang, weights=n, minlength=len(langs.dictionary)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([
            pa.concat_arrays([langs.dictionary.take(pa.array(lang)), langs.dictionary]),
            pa.concat_arrays([words.take(pa.array(word)), pa.nulls(len(sums), words.type)]),
            pa.array(np.concatenate([n, sums]), pa.int64()),
        ], names=["lang", "word", "n"])


def _rows(block: np.ndarray, at: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """``ROWS`` of positions that are sorted by block."""
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
    offsets, gaps = pa.array(np.r_[starts, len(block)], pa.int32()), np.diff(at, prepend=0)
    gaps[starts] = at[starts]
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((gaps, pa.int32()), (ids, pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array(block[starts], pa.int64()), *lists], names=["block", "gaps", "ids"])


def _blocked(row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which tokens, in which order, and the row and block of each: the first words of a block stand at the
    end of the one before it too, as far as a phrase can reach."""
    order, block = np.arange(len(at)), at // BLOCK
    over = np.flatnonzero((at % BLOCK < LONGEST - 1) & (block > 0))
    if len(over):
        order, block = np.concatenate([order, over]), np.concatenate([block, block[over] - 1])
        by = np.lexsort((at[order], block, row[order]))
        order, block = order[by], block[by]
    return order, row[order], block


def _pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, position, and both numbers of every two names of ``ROWS`` that begin one word apart."""
    lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    gaps, ids = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2))
    sums, starts = np.cumsum(gaps, dtype=np.int64), np.cumsum(lengths) - lengths
    some = lengths > 0
    at = sums - np.repeat(sums[starts[some]] - gaps[starts[some]], lengths[some])
    near = np.flatnonzero((row[1:] == row[:-1]) & (gaps[1:] == 1)) if len(row) else row
    return row[near], at[near], ids[near], ids[near + 1]


def _counted_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``left, right, f`` of each batch; a pair counts in the block that it begins in."""
    for batch in batches:
        _, at, left, right = _pairs(batch)
        own = at < BLOCK
        known, code = np.unique(np.concatenate([left[own], right[own]]), return_inverse=True)
        half = len(code) // 2
        pairs, n = np.unique(code[:half] * len(known) + code[half:], return_counts=True)
        columns = (known[pairs // max(1, len(known))], known[pairs % max(1, len(known))], n)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["left", "right", "f"])


def _texts(df: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return df.select(F.monotonically_increasing_id().alias("row"), named(lang_col).cast("string").alias("lang"), named(text_col).cast("string").alias("text"))


def _numbered(df: DataFrame) -> DataFrame:
    """``df``, written down, with an ``id`` from 0 on without gaps: a partition's numbers follow those of the ones before."""
    made = cut(df.withColumn("__at", F.monotonically_increasing_id()))
    part, nth = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = {r["part"]: r["n"] for r in made.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, starts = 0, []
    for p in sorted(sizes):
        starts.append((p, before))
        before += sizes[p]
    table = df.sparkSession.createDataFrame(starts, "__part long, __start long")
    return cut(made.join(F.broadcast(table), part == F.col("__part")).withColumn("id", F.col("__start") + nth).drop("__at", "__part", "__start"))


def _named_words(texts: DataFrame, names: DataFrame, broadcast_names: int) -> DataFrame:
    """``ROWS``: the positions of the words that have names. A name's key is the word, a space, the language."""
    keyed = names.select(F.concat("phrase", F.lit(" "), "lang").alias("key"), "id")
    few = names.count() <= broadcast_names
    table = keyed.toArrow() if few else None
    shared = texts.sparkSession.sparkContext.broadcast((table["key"].combine_chunks(), table["id"].to_numpy())) if few else None

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for ids, langs, (row, at, code, words) in _text_slices(batches):
            lang, word, back, _ = _keys(langs, row, code, words)
            parts = [words.take(pa.array(word)), langs.dictionary.take(pa.array(lang))]
            yield ids, row, at, pc.binary_join_element_wise(*parts, " "), back

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, numbers = shared.value
        for ids, row, at, keys, back in keys_of(batches):
            found = pc.index_in(keys, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)[back]
            keep = np.flatnonzero(found >= 0)
            order, row, block = _blocked(row[keep], at[keep])
            at, found = at[keep][order], found[keep][order]
            # a row's blocks follow one another: told apart by number, they need not be known by it later
            number = np.cumsum(np.r_[0, (row[1:] != row[:-1]) | (block[1:] != block[:-1])]) if len(row) else row
            yield _rows(number, at - block * BLOCK, numbers[found] if len(found) else found)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, row, at, keys, back in keys_of(batches):
            order, row, block = _blocked(row, at)
            columns = [pa.array(ids[row], pa.int64()), pa.array(block, pa.int64()), pa.array(at[order] - block * BLOCK, pa.int32()), keys.take(pa.array(back[order]))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "block", "at", "key"])

    if few:
        return texts.mapInArrow(looked_up, ROWS)
    return _gathered(texts.mapInArrow(spread, "row long, block long, at int, key string").join(keyed, "key"), "row", "block")


def _written(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` as a table in the shared folder: of small numbers, by dictionaries, not the 12 bytes each of a checkpoint."""
    rows.write.option("parquet.dictionary.page.size", 16 << 20).parquet(path)
    return rows.sparkSession.read.schema(ROWS).parquet(path)


def _gathered(positions: DataFrame, *by: str) -> DataFrame:
    """``ROWS`` of single positions; a row holds a block's, no more."""
    held = positions.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("held")).select(F.col("held.at").alias("at"), F.col("held.id").alias("ids"))
    before = F.concat(F.array(F.lit(0)), F.slice("at", 1, F.size("at") - 1))
    return held.select(F.lit(0).cast("long").alias("block"), F.zip_with("at", before, lambda x, y: x - y).alias("gaps"), "ids")


def _named_pairs(rows: DataFrame, names: DataFrame, below: int, broadcast_names: int) -> DataFrame:
    """``ROWS``: the positions of the pairs that have names, of parts that are numbered under ``below``."""
    if names.count() <= broadcast_names:
        table = names.select("left", "right", "id").toArrow()
        left, right, ids = (table[c].to_numpy() for c in ("left", "right", "id"))
        order = np.argsort(left * below + right)
        shared = rows.sparkSession.sparkContext.broadcast(((left * below + right)[order], ids[order]))

        def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, numbers = shared.value
            for batch in batches:
                row, at, left, right = _pairs(batch)
                code = left * below + right
                place = np.searchsorted(known, code)
                keep = np.flatnonzero(known[np.minimum(place, len(known) - 1)] == code) if len(known) else place[:0]
                yield _rows(row[keep], at[keep], numbers[place[keep]])

        return rows.mapInArrow(looked_up, ROWS)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, left, right = _pairs(batch)
            columns = [batch.column(0).take(pa.array(row)), pa.array(at, pa.int32()), pa.array(left, pa.int64()), pa.array(right, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "at", "left", "right"])

    told = rows.withColumn("block", F.monotonically_increasing_id())
    positions = told.mapInArrow(spread, "block long, at int, left long, right long")
    return _gathered(positions.join(names.select("left", "right", "id"), ["left", "right"]), "block")


def _frequent_pairs(rows: DataFrame, least: int) -> DataFrame:
    counts = rows.mapInArrow(_counted_pairs, "left long, right long, f long").groupBy("left", "right").agg(F.sum("f").alias("f"))
    return _numbered(counts.where(F.col("f") >= least))


def _described(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """``pairs`` with their words, and the frequencies of their first 1, 2, ... words and of their last ones, from those of their parts."""
    left = parts.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("first"), F.concat("firsts", F.array("f")).alias("firsts"))
    right = parts.select(F.col("id").alias("right"), "last", F.concat("lasts", F.array("f")).alias("lasts"))
    made = pairs.join(left, "left").join(right, "right")
    return made.select("id", "left", "right", "lang", F.concat("first", F.lit(" "), "last").alias("phrase"), "last", "f", "firsts", "lasts")


def _scored(phrases: DataFrame, size: int) -> DataFrame:
    """``phrases`` of ``size`` words with their lowest-scoring cut. Decimals hold the products exactly."""
    exact: Callable = lambda x: x.cast("decimal(19,0)")
    cuts = []
    for k in range(1, size):
        left, right = F.col("firsts")[k - 1], F.col("lasts")[size - k - 1]
        score = F.call_function("div", exact(F.col("f")) * F.lit(SCALE).cast("decimal(7,0)"), exact(left) + exact(right))
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    best = F.array_min(F.array(*cuts))
    return phrases.withColumn("best", best).select("id", "lang", "phrase", F.col("f").alias("a"), "best.l", "best.r", "best.score")


def collocations(
    df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, reported: int = REPORTED, broadcast_names: int = BROADCAST_NAMES
) -> DataFrame:
    """The ``reported`` best phrases of two to four words of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Texts, A-Z lower-cased, are cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these at spaces and tabs into
    words. A phrase with ``a >= least`` occurrences is a candidate; the cut into ``l`` and ``r`` is the
    lowest-scoring one, the first of equal ones; candidates that a longer one covers by 80 % go.

    A null language is ``und``, together with documents that are called so; a null, empty or blank text has
    no words. Repeated rows count as often as they come. Extra columns aren't read, and an empty table or one
    without frequent phrases gives no rows. Equal scores are ordered by ``a``, then by the phrase's bytes.

    Frequencies are summed by batch before they are shuffled. Names that fit ``broadcast_names`` are
    looked up where the positions lie, more are joined to them; the result is the same.
    """
    bound_batches(df.sparkSession)
    texts = _texts(df, lang_col, text_col)
    counts = texts.mapInArrow(_counted_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    counts = cut(counts.where(F.col("word").isNull() | (F.col("f") >= least)))
    words = _numbered(counts.where(F.col("word").isNotNull()).select("lang", F.col("word").alias("phrase"), "f"))
    none = F.array().cast("array<long>")
    level = words.select("id", "lang", "phrase", F.col("phrase").alias("last"), "f", none.alias("firsts"), none.alias("lasts"))
    folder = f"{shared_folder(df.sparkSession)}/phrases-{uuid.uuid4().hex}"
    rows, below, found = _written(_named_words(texts, words, broadcast_names), f"{folder}/1"), words.count(), []
    for size in range(2, LONGEST + 1):
        pairs = _frequent_pairs(rows, least)
        level = cut(_described(pairs, level))
        if size < LONGEST:
            rows = _written(_named_pairs(rows, pairs, below, broadcast_names), f"{folder}/{size}")
            below = pairs.count()
        found.append((size, level))
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)  # what follows reads the levels alone
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    parts = []
    for i, (size, phrases) in enumerate(found):
        scored = _scored(phrases, size)
        if i + 1 < len(found):
            longer = found[i + 1][1]
            cover = longer.select(F.col("left").alias("id"), "f").union(longer.select(F.col("right").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("cover"))
            scored = scored.join(cover, "id", "left").where(F.col("cover").isNull() | (100 * F.col("cover") < COVERED * F.col("a"))).drop("cover")
        parts.append(scored.drop("id"))
    best = parts[0].union(parts[1]).union(parts[2])
    order = (F.col("score").desc(), F.col("a").desc(), "phrase")
    salted = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    for by in (("lang", "part"), ("lang",)):
        salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= reported)
    sums = counts.where(F.col("word").isNull()).select("lang", F.col("f").alias("n"))
    return salted.join(sums, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_UPPER = "".join(map(chr, range(65, 91)))

#: The same rows by counting every phrase as text.
ORACLE_SQL = rf"""
    WITH p AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws
               FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
    t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM p GROUP BY lang),
    g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
          FROM p, (SELECT unnest([1, 2, 3, 4]) AS k)),
    f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= {LEAST}),
    w AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
    c AS (SELECT lang, k, phrase, f, j, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:], ' ') AS tail
          FROM w, (SELECT unnest([1, 2, 3]) AS j) WHERE j < k),
    s AS (SELECT c.lang, c.k, c.phrase, c.f AS a, j, h.f AS l, e.f AS r, ({SCALE}::HUGEINT * c.f) // (h.f + e.f) AS score
          FROM c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f e ON e.lang = c.lang AND e.phrase = c.tail),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
    i AS (SELECT lang, array_to_string(ws[x:x + y - 1], ' ') AS phrase, max(f) AS cover
          FROM w, (SELECT unnest([1, 2, 3]) AS x), (SELECT unnest([2, 3]) AS y) WHERE y < k AND x + y - 1 <= k GROUP BY ALL),
    k AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE cover IS NULL OR 100 * cover < {COVERED} * a),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
    SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM r JOIN t USING (lang) WHERE rank <= {REPORTED}
"""
