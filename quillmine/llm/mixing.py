"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The words of a source, its documents in a hashed order, are cut into blocks. A source's target is
a number of draws of its blocks: whole passes and a part of one more. A tree over the output
shards splits the vector of all sources' quotas in two, again and again, by a multivariate
hypergeometric draw, so every shard gets an exact number of draws of every source. A shard's draws
are consecutive numbers, which a permutation of the source's blocks turns into blocks; within a
shard they are shuffled by a hash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from .common import WORD, cut, named, unused

WEIGHTS = (5, 2, 1)
SHARE = 1.5
PASSES = 2
BLOCK_WORDS = 4096
SHARD_BLOCKS = 256
#: Bounds of what the driver holds: sources, shards of the whole mix, and numbers in the table of both.
MAX_SOURCES = 100_000
MAX_SHARDS = 4096
MAX_TABLE = 1_000_000
#: Words of a shard, on average, that lie in one task when the mix is laid out in its order.
GROUP_WORDS = 1 << 16
#: Documents that one cumulative sum runs over, on average.
BUCKET_ROWS = 250
MAX_BUCKETS = 1 << 16
SEED = 20_260


@dataclass
class Source:
    name: str | None
    words: int
    target: float
    block: int = 1
    blocks: int = 0
    draws: int = 0
    last: int = 0
    step: int = 1
    shift: int = 0
    ends: tuple[int, ...] = ()


def fill_targets(words: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> list[float]:
    """Split ``share`` times all words by the repeating weights; none above ``passes`` times its
    own words, the excess goes to the others by weight."""
    total = share * sum(words)
    weight = [weights[i % len(weights)] for i in range(len(words))]
    capped: set[int] = set()
    while True:
        free = [i for i in range(len(words)) if i not in capped]
        left, over = total - sum(passes * words[i] for i in capped), sum(weight[i] for i in free)
        full = {i for i in free if left * weight[i] / over > passes * words[i]}
        if not full:
            return [float(passes * w) if i in capped else left * weight[i] / over for i, w in enumerate(words)]
        capped |= full


def split_tree(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Draws of each source that each shard gets: ``[shard, source]``.

    A node deals its exact total of draws over its two halves in proportion to their shards; which
    sources the left half's draws come from is a multivariate hypergeometric draw.
    """
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(lo: int, hi: int, have: list[int]) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left_total, rest = sum(have) * (mid - lo) // (hi - lo), sum(have)
        left, need = [], left_total
        for n in have:  # one source after another, each conditioned on those before
            rest -= n
            low, high = max(0, need - rest), min(n, need)
            k = low if low == high else _hypergeometric(rng, n, rest, need)
            left.append(min(max(k, low), high))
            need -= left[-1]
        split(lo, mid, left)
        split(mid, hi, [n - k for n, k in zip(have, left)])

    split(0, shards, list(quotas))
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    # beyond the generator's range, by inversion: weights relative to the mode from the ratios of neighbouring terms,
    # over all counts within 40 standard deviations or so (what lies outside is below any double's resolution)
    low, high, n = max(0, draws - bad), min(good, draws), good + bad
    mode = (draws + 1) * (good + 1) // (n + 2)
    reach = int(40 * math.sqrt(draws * (good / n) * (bad / n) * ((n - draws) / (n - 1)))) + 40
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    sums = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


def plan(sizes: list[tuple[str | None, int]], block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, tree_seed: int | None = None) -> tuple[list[Source], int]:
    """Sources in code point order (null last) with targets, blocks, permutation and shards' draws.
    The tree's own seed decides which shard gets which draws, and no source's total."""
    sizes = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    targets = fill_targets([w for _, w in sizes], weights)
    rng = np.random.default_rng(seed)
    found = []
    for (name, words), target in zip(sizes, targets):
        s = Source(name, words, target)
        want = min(round(target), PASSES * words)
        if words and want:
            s.block = min(block_words, words)
            s.blocks = -(-words // s.block)
            s.step = next(k for k in iter(lambda: int(rng.integers(1, s.blocks + 1)), None) if math.gcd(k, s.blocks) == 1)
            s.shift = int(rng.integers(0, s.blocks))
            whole, rest = divmod(want, words)
            s.draws = whole * s.blocks
            short = s.blocks * s.block - words  # what the last block lacks
            at = ((s.blocks - 1) * s.step + s.shift) % s.blocks  # the last block's turn in a pass
            full = rest // s.block
            s.last = rest - full * s.block
            if at < full:
                s.last += short
                full, s.last = full + s.last // s.block, s.last % s.block
            if at == full and s.last > s.block - short:
                full, s.last = full + 1, s.last - (s.block - short)
            s.draws += full + (s.last > 0)
            s.last = s.last or s.block
        found.append(s)
    most = max(1, min(MAX_SHARDS, MAX_TABLE // max(1, len(found))))
    shards = min(most, max(1, -(-sum(s.draws for s in found) // shard_blocks)))
    dealt = split_tree([s.draws for s in found], shards, seed if tree_seed is None else tree_seed).cumsum(axis=0)
    for i, s in enumerate(found):
        s.ends = tuple(int(x) for x in dealt[:, i])
    return found, shards


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, tree_seed: int | None = None) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken, source, pieces``.

    ``pieces`` lists what the mix takes of the row: ``start`` and ``words`` (a range of its words),
    ``pass``, ``shard``, the output shard that the tree dealt this draw to, and ``turn``, its place in
    the shard's shuffled order. Null texts and
    texts without a word have size 0 and no piece. A null source is a source of its own. Rows that
    repeat an id are rows of their own, told apart by their order in the hash where they tie, which
    is the same for equal rows. Extra columns are ignored; an empty table gives no rows.

    Only (id, source, size) is shuffled. The cumulative sums that lay a source's documents out run
    over hash buckets of some ``BUCKET_ROWS`` rows, so a hot source spreads over many; their bases
    come from a table of one row per source and bucket. The driver gets one row per source.
    """
    return _lay_out(_sizes(df, id_col, text_col, source_col, seed), block_words, shard_blocks, seed, weights, tree_seed).drop("shards")


def _sizes(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, mark: str | None = None) -> DataFrame:
    return df.select(
        named(id_col).alias("doc_id"),
        named(source_col).alias("source"),
        F.regexp_count(F.coalesce(named(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        *([F.col(mark).alias("mark")] if mark else []),
    ).withColumn("order", F.xxhash64("doc_id", F.lit(seed)))


def _lay_out(rows: DataFrame, block_words: int, shard_blocks: int, seed: int, weights: tuple[int, ...], tree_seed: int | None = None) -> DataFrame:
    spark = rows.sparkSession
    rows = cut(rows)
    found = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sources, shards = plan([(r["source"], r["words"]) for r in found], block_words, shard_blocks, seed, weights, tree_seed)
    most = max([r["n"] for r in found], default=0)
    buckets = min(MAX_BUCKETS, max(1, -(-most // BUCKET_ROWS)))
    schema = StructType(
        [StructField("key", StringType()), StructField("target", DoubleType())]
        + [StructField(c, LongType()) for c in ("source_size", "block", "blocks", "draws", "last", "step", "shift")]
        + [StructField("ends", ArrayType(LongType()))]
    )
    table = spark.createDataFrame([(s.name, s.target, s.words, s.block, s.blocks, s.draws, s.last, s.step, s.shift, list(s.ends)) for s in sources], schema)

    rows = rows.withColumn("bucket", F.pmod("order", F.lit(buckets)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = rows.withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0)))
    laid = laid.join(sums, laid["source"].eqNullSafe(sums["s"]) & (laid["bucket"] == sums["b"])).withColumn("at", F.col("at") + F.col("base"))
    # one row per source, MAX_TABLE numbers of shards' ends in all (or one for each source)
    laid = laid.join(F.broadcast(table), laid["source"].eqNullSafe(table["key"]))

    # each (block, pass) that a document's words [at, at + size) touch
    touched = F.when((F.col("size") > 0) & (F.col("draws") > 0), F.sequence(F.expr("at div block"), F.expr("(at + size - 1) div block"))).otherwise(F.array().cast("array<bigint>"))
    laid = laid.withColumn("touched", touched)
    piece = """
        flatten(transform(touched, i -> transform(sequence(0L, 1L), p -> named_struct(
            'start', greatest(at, i * block) - at,
            'words', least(at + size, i * block + if(p * blocks + pmod(i * step + shift, blocks) = draws - 1, last, block))
                     - greatest(at, i * block),
            'pass', p,
            'draw', p * blocks + pmod(i * step + shift, blocks)))))
    """
    laid = laid.withColumn("pieces", F.expr(f"filter({piece}, x -> x.draw < draws and x.words > 0)"))
    # the shard of a draw: how many shards end at or before it
    return laid.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.expr("aggregate(pieces, 0L, (s, x) -> s + x.words)").alias("taken"),
        "source",
        F.expr(f"""transform(pieces, x -> named_struct('start', x.start, 'words', x.words, 'pass', x.pass,
            'shard', cast({_rank("x.draw", shards)} as bigint), 'turn', xxhash64(x.draw, source, doc_id, x.start, {seed})))""").alias("pieces"),
        F.lit(shards).alias("shards"),
        *([F.col("mark")] if "mark" in rows.columns else []),
    )


def _rank(draw: str, shards: int) -> str:
    """Number of ``ends`` that are at most ``draw``, by bisection written out as an expression."""
    if shards == 1:
        return "0"
    halvings = (shards - 1).bit_length()
    return f"aggregate(sequence(1, {halvings}), named_struct('lo', 0, 'hi', {shards - 1}), (s, k) -> if(s.lo >= s.hi, s, if(ends[(s.lo + s.hi) div 2] <= {draw}, named_struct('lo', cast((s.lo + s.hi) div 2 + 1 as int), 'hi', s.hi), named_struct('lo', s.lo, 'hi', cast((s.lo + s.hi) div 2 as int)))), s -> s.lo)"


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars", seed: int = SEED, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, weights: tuple[int, ...] = WEIGHTS, tree_seed: int | None = None, group_words: int = GROUP_WORDS) -> DataFrame:
    """The mix itself: ``df``'s rows once for each pass that takes words of them, with the text cut
    to those words (the whole text, unchanged, where it takes all), in the order of the mix: the
    rows of a shard lie together, by turn, a row where its first words in that pass do. A task holds
    a range of turns of a shard, some ``group_words`` words, or several.

    All columns are kept; ``length_col`` is brought up to date if there is such a column. Rows
    without an id can't be told apart and are left out, as are rows without a word; rows that repeat
    an id count as one document, that with the least hash of text and source. An empty table gives
    no rows.
    """
    key, mark, words_of, pass_at, parts_at, shard_at, turn_at, group_at, own_mark = (unused(df, x) for x in ("mix_id", "mix_mark", "mix_size", "mix_pass", "mix_parts", "mix_shard", "mix_turn", "mix_group", "mix_own"))
    marked = df.where(named(id_col).isNotNull()).withColumn(mark, F.xxhash64(named(text_col), named(source_col)))
    sizes = _sizes(marked, id_col, text_col, source_col, seed, mark)
    sizes = sizes.groupBy("doc_id", "order").agg(F.min_by(F.struct("source", "size", "mark"), F.struct("mark", "size")).alias("own")).select("doc_id", "own.*", "order")
    sizes = cut(sizes)
    laid = _lay_out(sizes, block_words, shard_blocks, seed, weights, tree_seed).where("taken > 0")
    words = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] * SHARE
    parts = laid.select(F.col("doc_id").alias(key), F.col("size").alias(words_of), F.explode(F.sequence(F.lit(0), F.lit(PASSES - 1))).alias(pass_at), "pieces", "shards", F.col("mark").alias(own_mark))
    parts = parts.select("*", F.expr(f"array_sort(filter(pieces, x -> x.pass = `{pass_at}`), (x, y) -> cast(x.start - y.start as int))").alias(parts_at)).where(f"size(`{parts_at}`) > 0")
    # a shard's turns in as many ranges as it has groups of words
    groups = F.greatest(F.lit(1.0), F.ceil(F.lit(words) / F.col("shards") / group_words)).cast("double")
    first = F.col(parts_at)[0]
    parts = parts.select(
        key, own_mark, words_of, pass_at, F.transform(parts_at, lambda p: F.struct(p["start"].alias("start"), p["words"].alias("words"))).alias(parts_at),
        first["shard"].alias(shard_at), first["turn"].alias(turn_at), F.floor((first["turn"].cast("double") / 2.0**64 + 0.5) * groups).alias(group_at),
    )
    out = marked.join(parts, (named(id_col) == F.col(key)) & (F.col(mark) == F.col(own_mark)))
    out = out.dropDuplicates([key, own_mark, pass_at])  # equal rows; they lie together after the join
    text = f"`{text_col}`"
    words_in = f"regexp_extract_all({text}, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)"
    cut_text = f"array_join(flatten(transform(`{parts_at}`, p -> slice({words_in}, cast(p.start + 1 as int), cast(p.words as int)))), ' ')"
    whole = f"aggregate(`{parts_at}`, 0L, (s, p) -> s + p.words) = `{words_of}`"
    out = out.withColumn(text_col, F.expr(f"if({whole}, {text}, {cut_text})"))
    if length_col and length_col in df.columns:
        out = out.withColumn(length_col, F.length(named(text_col)).cast(df.schema[length_col].dataType))
    out = out.repartition(F.col(shard_at), F.col(group_at)).sortWithinPartitions(shard_at, turn_at, key, pass_at)
    return out.select(*map(named, df.columns))
