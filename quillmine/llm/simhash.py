"""Near-duplicate detection: SimHash fingerprints linked by covering locality-sensitive hashing."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, map_texts, unused

SEED = 42
SHINGLE_WORDS = 3
RADIUS = 2
#: Buckets up to this size compare their pairs; larger ones go through single-bit neighbours.
PAIR_BUCKET = 32
#: Shingle hashes that are turned into bit counts at a time.
CHUNK = 1 << 18

#: A byte's eight bits, spread over the eight bytes of a word.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def shingle_hashes(text: bytes | None, words: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 of each shingle of the text, A-Z lower-cased; the whole sequence if it is shorter."""
    w = (text or b"").lower().split()
    if not w:
        return []
    h = xxhash.xxh64_intdigest
    if len(w) < words:
        return [h(b" ".join(w), SEED)]
    return [h(b" ".join(q), SEED) for q in zip(*(w[i:] for i in range(words)))]


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    lanes = _SPREAD[hashes.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)  # a byte holds 255
    return sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes | None) -> int:
    """Unsigned 64-bit SimHash of a whole text; zero if it has no word."""
    hashes = shingle_hashes(text)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        counts += _bit_counts(np.array(hashes[i : i + CHUNK], np.uint64))
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """Masks such that any two words of ``bits`` bits within ``radius`` agree under one of them.

    Bit i gets a vector m(i) of radius + 1 binary digits; the mask of a non-zero vector v holds the
    bits with an odd inner product <m(i), v>. At most ``radius`` bits differ, their vectors span
    less than the whole space, so some v is orthogonal to all of them and its mask misses them all.
    """
    size = 1 << (radius + 1)
    vectors = [i % (size - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if bin(m & v).count("1") % 2) for v in range(1, size)]


def _as_long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, radius: int = RADIUS, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """Edges ``a, b`` between ids of ``prints(fp long, node long)``, distinct fp, whose transitive
    closure joins exactly the fingerprints within ``radius`` (2 at most) of each other.

    Each mask gives a table of buckets. Buckets of up to ``pair_bucket`` fingerprints compare their
    pairs. A larger one deals each member out to itself and to its single-bit neighbours within the
    bits that the mask leaves free: two members within distance 2 meet in one of these, members
    that meet there are within distance 2, and no more than one for each free bit and one can meet.
    """
    if not 1 <= radius <= 2:
        raise ValueError("radius must be 1 or 2")
    masks = covering_masks(radius)
    tables = F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_as_long(m))).alias("key")) for i, m in enumerate(masks)))
    dealt = prints.select("fp", "node", F.explode(tables).alias("x")).select("fp", "node", "x.t", "x.key")
    sizes = dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    dealt = dealt.join(sizes, ["t", "key"])

    def near(x: Column, y: Column) -> Column:
        return F.bit_count(x["fp"].bitwiseXOR(y["fp"])) <= radius

    member = F.struct("fp", "node")
    small = dealt.where(F.col("size") <= pair_bucket).groupBy("t", "key").agg(F.collect_list(member).alias("members"))
    small = small.select("members", F.explode("members").alias("m")).select(
        F.col("m.node").alias("a"),
        F.explode(F.filter("members", lambda y: (y["node"] < F.col("m.node")) & near(F.col("m"), y))).alias("y"),
    ).select("a", F.col("y.node").alias("b"))

    flips = [F.array(F.lit(0), *(F.lit(_as_long(1 << i)) for i in range(64) if not m >> i & 1)) for m in masks]
    choice = F.element_at(F.array(*flips), F.col("t") + 1)
    large = dealt.where(F.col("size") > pair_bucket).select("fp", "node", F.explode(F.transform(choice, lambda b: F.col("fp").bitwiseXOR(b))).alias("v"))
    large = large.groupBy("v").agg(F.collect_set(member).alias("members")).where(F.size("members") > 1)
    if radius == 2:
        large = large.select(F.array_min(F.transform("members", lambda m: m["node"])).alias("b"), F.explode("members.node").alias("a")).where("a <> b")
    else:
        large = large.select("v", F.explode("members").alias("m"), "members").select(
            F.col("m.node").alias("a"),
            F.explode(F.filter("members", lambda y: (y["node"] < F.col("m.node")) & near(F.col("m"), y))).alias("y"),
        ).select("a", F.col("y.node").alias("b"))
    return small.union(large.select("a", "b"))


def simhash_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``, the smallest id reachable
    over fingerprints within ``radius`` bits.

    Equal fingerprints collapse first, so a group of copies, however large, is one fingerprint.
    Null, empty and blank texts have fingerprint zero and link like any other. Rows that repeat an
    id each get a row. A null id never becomes a component's id unless all ids of its fingerprint
    are null: these rows get a null component. Extra columns are ignored.
    """
    prints = cut(map_texts(df, id_col, text_col, "doc_id long, fp long", lambda: lambda doc, text: [(doc, _as_long(fingerprint(text)))], "binary"))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("node"))
    components = connected_components(links(nodes.where("node is not null"), radius))
    labels = nodes.join(components, nodes["node"] == components["id"], "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(labels, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose id is the smallest of its component, with their columns; one row
    where several repeat that id, and every row without an id."""
    kept_id = unused(df, "kept_id")
    kept = simhash_dedup(df, id_col, text_col).where("doc_id = component_id").select(F.col("doc_id").alias(kept_id)).distinct()
    once = df.where(F.col(id_col).isNotNull()).dropDuplicates([id_col])
    return once.join(kept, once[id_col] == kept[kept_id], "left_semi").union(df.where(F.col(id_col).isNull()))
