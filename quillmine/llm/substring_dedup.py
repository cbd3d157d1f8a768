"""Near-duplicate passages across documents, found through compact windows.

A passage of ``SPAN`` shingles or more is looked for through all subsequences of exactly that many
shingles. Its signatures are its ``depth`` lowest shingles in an order that is one for all documents: those
that more documents have come later (by powers of four), the others by a hash. Two subsequences of similarity 0.8 differ in 5 of
46 shingles at most, so two of the seven lowest of either are among the seven lowest of the other: none
of them fails to meet. The starts of the subsequences that have a shingle among their lowest lie between a first
and a last one, a compact window; where those of two documents meet, the interval of starts that both
hold, aligned at the shingle, are the candidates. Each group elects its first occurrence and all candidates of
the others are verified against it, word by word; what equals it is done with. Of what stays, each start of a subsequence,
counted from the shingle, elects others, and in the end all pairs are compared that aren't both similar to one that was elected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .common import bound_batches, cut, named, release

SHINGLE = 5
#: Shingles of the shortest passage: 50 words.
SPAN = 46
FUNCTIONS = 4
SIMILARITY = 0.8
#: The bitmap of repeated shingles has eight bits or so for each, and 2^MOST_BITS (32 MB) at most; with fewer than two for each it tells of
#: fewer shingles. Which ones it takes for repeated that are not, and which it tells of, no result depends on.
LEAST_BITS, MOST_BITS = 20, 28
#: Elections in each group at most before all pairs of what stays are compared; a key's lowest bits tell which of
#: those elected its subsequences are similar to, directly or by way of others.
ELECTIONS = 4
#: Places of a group that hold the same start (counted from the shingle), up to which all their pairs are compared without another election.
FEW = 8
#: Signatures that subsequences have in common at least, if they are similar.
EVIDENCE = 2
#: Shingles that more documents have than each of these come later in the order, those of most documents last: a subsequence with six
#: shingles of a rarer kind than a passage that thousands of documents have doesn't meet all of these in that passage's groups.
LEVELS = tuple(16 << 2 * i for i in range(12))
#: Ids of documents up to which they are broadcast (8 bytes each).
BROADCAST_IDS = 500_000
#: Parts by which shingles are counted: a power of two, no more than 2^LEAST_BITS / 8.
PARTS = 1024
#: Documents that a task compares with one first occurrence; those of a more common one are dealt over several.
CLAIMS = 1024
SEED = 99
#: Bytes of text that are hashed at a time; a longer text goes alone. Shingles that are ranked at a time.
LOAD, PIECE = 1 << 21, 1 << 16
#: Starts that are counted at a time; those of one document and what it claims together.
STARTS = 1 << 21

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that scatters 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _ODD, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class WordHashes:
    """64-bit hashes of the words of lower-cased (A-Z) texts, whole arrays at a time: a polynomial
    over the bytes from prefix sums, with word starts moved to power zero, then scattered."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)
        self.inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            self.up = _powers(n)
            down = np.full(n, self.inverse, np.uint64)
            down[:1] = 1
            self.down = np.multiply.accumulate(down)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all texts' words, and where each text's begin (one more at the end)."""
        data = np.frombuffer(b" ".join(t.lower() for t in texts) + b" ", np.uint8)
        self._grow(len(data))
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
        starts, ends = edge[0::2], edge[1::2]
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)])])
            hashes = _mix((sums[ends] - sums[starts]) * self.down[starts])
        bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        return hashes, np.searchsorted(starts, bounds)

    def stretches(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of ``words[start:end]``."""
        self._grow(len(words) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(words * self.up[: len(words)])])
            return _mix((sums[ends] - sums[starts]) * self.down[starts])


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    if len(words) < size:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(words) - size + 1, np.uint64)
        for i in range(size):
            out = _mix(out * _ODD + words[i : len(words) - size + 1 + i])
    return out


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each ``span`` consecutive values: of blocks from either end."""
    n = len(h) - span + 1
    pad = -len(h) % span
    full = np.concatenate([h, np.full(pad, np.iinfo(h.dtype).max, h.dtype)]).reshape(-1, span)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[span - 1 : span - 1 + n])


def compact_windows(h: np.ndarray, begin: np.ndarray, end: np.ndarray, span: int = SPAN) -> np.ndarray:
    """``[left, centre, right]`` of the compact windows that are ``span`` or wider, by centre, of
    texts that lie at ``begin..end`` (one for each position, end exclusive): every subsequence
    within left..right that holds centre has its least (leftmost) hash there.

    They are the nodes of the texts' Cartesian trees that cover ``span`` positions. Such nodes are
    the minima of the subsequences of that length, and so are their parents; the trees are built
    over these positions alone, all at once (:func:`_parents`).
    """
    if len(h) < span:
        return np.empty((0, 3), np.int64)
    bits = np.uint64(len(h).bit_length())
    place = np.arange(len(h), dtype=np.uint64)
    value = (h >> bits << bits) | place  # equal hashes: the leftmost is less
    whole = np.arange(len(h) - span + 1) + span <= end[: len(h) - span + 1]
    at = (_least(value, span)[whole] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    centres = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
    values, first, stop = value[centres], begin[centres], end[centres]
    ahead = _parents(values, first)
    behind = len(centres) - 1 - _parents(values[::-1], first[::-1])[::-1]
    own = np.append(centres, 0)
    left = np.where(ahead >= 0, own[ahead] + 1, first)
    right = np.where(behind < len(centres), own[behind] - 1, stop - 1)
    return np.stack([left, centres, right], axis=1)


def _parents(values: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each value the place of the nearest lesser one before it in its text, -1 if there is none: links of
    the Cartesian trees, each jumping along the others' until it meets a lesser value."""
    n = len(values)
    link = np.arange(n) - 1
    link[np.flatnonzero(np.diff(text, prepend=-1))] = -1
    open_ = np.flatnonzero(link >= 0)
    while len(open_):
        to = link[open_]
        open_ = open_[values[to] > values[open_]]  # the others have met theirs
        link[open_] = link[link[open_]]
        open_ = open_[link[open_] >= 0]
    return link


def _kth_least(value: np.ndarray, span: int, depth: int) -> np.ndarray:
    """The ``depth``-th least of each ``span`` consecutive values, from the lowest ones of blocks from either end."""
    n, out = len(value) - span + 1, []
    none = np.iinfo(value.dtype).max
    step = max(1, PIECE // span) * span
    for i in range(0, n, step):
        own = value[i : i + step + span - 1]
        blocks = -(-len(own) // span) + 1  # one more, for what begins with a block has nothing of the next
        full = np.concatenate([own, np.full(blocks * span - len(own), none, value.dtype)]).reshape(blocks, span).T.copy()
        back, ahead = (np.empty((depth, span, blocks), value.dtype) for _ in range(2))
        for lows, places, without in ((back, range(span - 1, -1, -1), False), (ahead, range(span), True)):
            least = np.full((depth, blocks), none, value.dtype)
            for at in places:
                if without:
                    lows[:, at] = least
                x = full[at]
                for k in range(depth):
                    least[k], x = np.minimum(least[k], x), np.maximum(least[k], x)
                if not without:
                    lows[:, at] = least
        back, ahead = back[:, :, :-1], ahead[:, :, 1:]
        high = np.minimum(back[-1], ahead[-1])
        for k in range(depth - 1):
            np.minimum(high, np.maximum(back[k], ahead[depth - 2 - k]), out=high)
        out.append(high.T.ravel()[: min(step, n - i)])
    return np.concatenate(out)


def lowest_windows(value: np.ndarray, before: np.ndarray, end: np.ndarray, span: int, depth: int, wanted: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """``[first, centre, last]`` of the ``wanted`` positions that are among the ``depth`` lowest of all subsequences of ``span`` that
    start at first..last, within their text (which ends at ``end``, one for each position): a row for each run of such starts.
    And the starts of those that are one shingle again and again.

    A shingle counts once in a subsequence, where it comes first (``before`` is the place of the same one before each). Of a
    subsequence with ``n`` different ones so many count that one similar to it, with fewer, has ``EVIDENCE`` of them.
    """
    n = len(value) - span + 1
    if n < 1:
        return np.empty((0, 3), np.int64), np.empty(0, np.int64)
    place, none = np.arange(len(value)), np.uint64(0xFFFFFFFFFFFFFFFF)
    high = np.zeros(len(value) + span - 1, np.uint64)  # by start + span - 1: the highest that counts, 0 where a text ends in it
    again = np.flatnonzero(before > place - span)
    opened = np.bincount(np.maximum(again - span + 1, 0), minlength=n + span) - np.bincount(before[again] + 1, minlength=n + span)
    inside = place[:n] + span <= end[:n]
    odd = inside & (np.cumsum(opened)[:n] > 0)
    high[span - 1 : len(value)] = np.where(inside, _kth_least(value, span, depth), np.uint64(0))
    every = np.lib.stride_tricks.sliding_window_view(value, span)
    odd, alone = np.flatnonzero(odd), []
    for i in range(0, len(odd), 8192):
        some = odd[i : i + 8192]
        rows = np.sort(np.where(before[some[:, None] + np.arange(span)] >= some[:, None], none, every[some]), axis=1)
        count = (rows != none).sum(axis=1)
        taken = np.clip(count - np.ceil(similarity * count - 1e-9).astype(np.int64) + EVIDENCE, 1, count)
        high[some + span - 1] = rows[np.arange(len(some)), taken - 1]
        alone.append(some[count == 1])
    centres = np.flatnonzero(value <= ~_least(~high, span))
    own, least = value[centres], np.maximum(centres - span, before[centres]) + 1
    first, last = least.copy(), centres.copy()
    for starts, by in ((first, 1), (last, -1)):  # each moves on until it is held
        open_ = np.arange(len(centres))
        while len(open_):
            open_ = open_[own[open_] > high[starts[open_] + span - 1]]
            starts[open_] += by
            open_ = open_[(starts[open_] >= least[open_]) & (starts[open_] <= centres[open_])]
    real = np.flatnonzero((first <= last) & wanted[centres])
    first, centre, last, own = first[real], centres[real], last[real], own[real]
    counts = last - first + 1
    of = np.repeat(np.arange(len(first)), counts)
    starts = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts - first, counts)
    held = np.flatnonzero(own[of] <= high[starts + span - 1])  # what lies between may have lower ones that neither end has
    starts, of = starts[held], of[held]
    heads = np.flatnonzero(np.append(True, (np.diff(of) != 0) | (np.diff(starts) != 1))[: len(of)])
    return np.stack([starts[heads], centre[of[heads]], starts[np.append(heads, len(starts))[1:] - 1]], axis=1), np.concatenate([np.empty(0, np.int64), *alone])


def _before(base: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The place of the same shingle before each in its text, -1 if there is none."""
    bits = np.uint64(len(base).bit_length())
    rows = np.sort(base >> bits << bits | np.arange(len(base), dtype=np.uint64))
    order = (rows & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    alike, equal = rows[1:] >> bits == rows[:-1] >> bits, base[order][1:] == base[order][:-1]
    if (alike & ~equal).any():  # different shingles that agree but for their last digits
        order = np.argsort(base, kind="stable")
        equal = base[order][1:] == base[order][:-1]
    same = np.flatnonzero(equal)
    same = same[begin[order[same + 1]] == begin[order[same]]]
    out = np.full(len(base), -1)
    out[order[same + 1]] = order[same]
    return out


def depth_of(span: int, similarity: float) -> tuple[int, int]:
    """How many of the lowest shingles make signatures, and how many of these two subsequences that are similar share at least."""
    apart = span - math.ceil(2 * similarity / (1 + similarity) * span - 1e-9)
    depth = min(span, apart + EVIDENCE)
    return depth, max(1, depth - apart)


def _shingled(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """``text, shingle, begin, end``: the shingles of texts whose words lie between the ``bounds``, and where each one's text lies among them."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    base = shingles(words, size)[np.repeat(bounds[:-1] - np.cumsum(counts) + counts, counts) + np.arange(len(text))] if len(text) else np.empty(0, np.uint64)
    ends = np.cumsum(counts)
    return text, base, (ends - counts)[text], ends[text]


def _codes(every: np.ndarray) -> np.ndarray:
    """The part of each shingle by its lowest bits, and its 32 highest: what it is counted by."""
    return (every & np.uint64(PARTS - 1)) << np.uint64(32) | every >> np.uint64(32)


def _bit_of(codes: np.ndarray, each: int, level: int) -> np.ndarray:
    """The bit of a code (its 32 bits) in its part's piece: its lowest digits, or for a level other ones, so that what gets into one bitmap
    by error doesn't get into the next for it."""
    if level:
        odd = int(_mix(np.array([SEED + level], np.uint64))[0]) & 0xFFFFFFFF | 1
        codes = (codes * np.uint64(odd) & np.uint64(0xFFFFFFFF)) >> np.uint64(33 - each.bit_length())
    return codes & np.uint64(each - 1)


def _in_bits(bits: np.ndarray, every: np.ndarray, level: int = 0) -> np.ndarray:
    """1 where the bitmap has the bit of a shingle."""
    each = max(1, 8 * len(bits) // PARTS)
    at = (every & np.uint64(PARTS - 1)) * np.uint64(each) + _bit_of(every >> np.uint64(32), each, level) & np.uint64(8 * len(bits) - 1)
    return bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1


def signatures(words: np.ndarray, bounds: np.ndarray, functions: int = FUNCTIONS, span: int = SPAN, size: int = SHINGLE, depth: int = 0, common: np.ndarray | list[np.ndarray] | None = None, repeated: np.ndarray | None = None, known: int = 1 << 32) -> tuple[np.ndarray, ...]:
    """``text, key, centre, first, last`` for texts whose words lie between the ``bounds``: under a
    function, the subsequences of ``span`` shingles that start at first..last have their least hash
    at centre; with the function it makes the key. With a ``depth`` they have it among so many lowest, those last whose bits are ``common`` (of several bitmaps, in the most). With the bits of
    those that are ``repeated`` the others come first, and they make no signatures, for no other text has them. These bits tell of
    shingles below ``known`` (by their 32 highest digits); the others come between the repeated and the common ones."""
    text, base, begin, end = _shingled(words, bounds, size)
    parts = [[] for _ in range(5)]
    with np.errstate(over="ignore"):
        if depth:
            every = _mix(base * _ODD)
            kind, told = np.zeros(len(base), np.uint64), every >> np.uint64(32) < np.uint64(known)
            bits = np.uint64(len(base).bit_length())
            if repeated is not None:
                kind = np.where(told, _in_bits(repeated, every), 2).astype(np.uint64)
            levels = [] if common is None else [(0, common)] if isinstance(common, np.ndarray) else list(enumerate(common, 1))
            above = np.flatnonzero(kind > 0) if repeated is not None else np.arange(len(base))
            for level, its in levels:  # each is a part of the one before, so few get by error into the higher ones
                above = above[_in_bits(its, every[above], level) > 0]
                kind[above] = 2 + max(1, level)
            value = every >> np.uint64(4) | kind << np.uint64(60)
            windows, alone = lowest_windows(value >> bits << bits | np.arange(len(base), dtype=np.uint64), _before(base, begin), end, span, depth, kind > 0 if repeated is not None else np.ones(len(base), bool))
            if repeated is not None:
                alone = alone[kind[alone] > 0]
            first, centre, last = np.concatenate([windows, np.repeat(alone[:, None], 3, axis=1)]).T
            key = every[centre]
            key[len(windows) :] = _mix(key[len(windows) :])  # a single shingle under two keys, for EVIDENCE
            parts = [[x] for x in (text[centre], key.view(np.int64) & ~np.int64((1 << ELECTIONS) - 1), *(x - begin[centre] for x in (centre, first, last)))]
        for f in range(0 if depth else functions):
            h = _mix(base ^ _mix(np.uint64(SEED + f) * _ODD))
            left, centre, right = compact_windows(h, begin, end, span).T
            first, last = np.maximum(left, centre - span + 1), np.minimum(centre, right - span + 1)
            key = _mix(h[centre] * _ODD + np.uint64(f))
            for part, x in zip(parts, (text[centre], key.view(np.int64), centre - begin[centre], first - begin[centre], last - begin[centre])):
                part.append(x)
    kinds = (np.int64, np.int64, np.int32, np.int32, np.int32)
    return tuple(np.concatenate(x).astype(k) if x else np.empty(0, k) for x, k in zip(parts, kinds))


def _loads(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= LOAD:
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def pack_place(centre: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A place as one number: the centre, and how far before it first and last lie."""
    return centre.astype(np.int64) << 16 | (centre - first).astype(np.int64) << 8 | (centre - last).astype(np.int64)


def unpack_place(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    centre = place >> 16
    return centre, centre - (place >> 8 & 255), centre - (place & 255)


def _places(order: np.ndarray, new: np.ndarray, text: np.ndarray, key: np.ndarray, centre: np.ndarray, first: np.ndarray, last: np.ndarray, place: np.ndarray, bounds: np.ndarray, words: np.ndarray, hashes: WordHashes, span: int, size: int) -> np.ndarray:
    """Of keys that a text has in several places (``order``, by text and key; ``new`` where these change) the
    places to keep: text that repeats itself has the same signature at every step, and of places with the
    same words one in each span does."""
    nth = (centre[order] - centre[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]) // span
    begin = bounds[text[order]] + first[order]
    own = hashes.stretches(words, begin, begin + last[order] - first[order] + span + size - 1)
    with np.errstate(over="ignore"):  # and the extent: words and centre make the place
        own = own ^ _mix((place[order] & 0xFFFF).astype(np.uint64) + _ODD)
    by = np.lexsort((place[order], own, nth, key[order], text[order]))
    order, own, nth = order[by], own[by], nth[by]
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (text[order][1:] != text[order][:-1]) | (nth[1:] != nth[:-1]) | (own[1:] != own[:-1])
    return order[new]


def signature_rows(df: DataFrame, functions: int = FUNCTIONS, span: int = SPAN, size: int = SHINGLE, among: bytes | None = None, thin: bool = True, depth: int = 0, common: list[bytes] = (), repeated: bytes | None = None, known: int = 1 << 32) -> DataFrame:
    """``key, doc, place`` of ``df(doc, text)``, of the keys that the bits ``among`` let through: the first place of each key in
    a document, or (not ``thin``) all places, but for those that repeat the words of another one within ``span`` shingles."""
    sc = df.sparkSession.sparkContext
    shared, others = (None if x is None else sc.broadcast(x) for x in (among, repeated))
    lasts = [sc.broadcast(x) for x in common]
    held = to_arrow_schema(StructType.fromDDL("key long, doc long, place long"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        bits, several_have = (None if x is None else np.frombuffer(x.value, np.uint8) for x in (shared, others))
        put_last = [np.frombuffer(x.value, np.uint8) for x in lasts]
        for batch in batches:
            docs, texts = batch.column(0).to_numpy(zero_copy_only=False), [t or b"" for t in batch.column(1).to_pylist()]
            for at, end in _loads(texts):
                words, bounds = hashes(texts[at:end])
                text, key, centre, first, last = signatures(words, bounds, functions, span, size, depth, put_last, several_have, known)
                place = pack_place(centre, first, last)
                some = np.arange(len(key))
                if bits is not None:
                    some = np.flatnonzero(_in_bits(bits, key.view(np.uint64)))
                with np.errstate(over="ignore"):  # a text's places of one key come by place: a stable sort keeps them so
                    own_key = key[some].view(np.uint64) ^ _mix(text[some].astype(np.uint64) + _ODD)
                by = np.argsort(own_key, kind="stable")
                order, new = some[by], np.ones(len(by), bool)
                new[1:] = own_key[by][1:] != own_key[by][:-1]
                if thin:
                    chosen = order[new]
                else:
                    several = ~new
                    several[:-1] |= ~new[1:]
                    chosen = np.concatenate([order[~several], _places(order[several], new[several], text, key, centre, first, last, place, bounds, words, hashes, span, size)])
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key[chosen], docs[at:end][text[chosen]], place[chosen])], schema=held)

    return df.select("doc", "text").mapInArrow(rows, "key long, doc long, place long")


#: The columns of :func:`counted_shingles`.
COUNTED = ("repeated", *(f"common{i}" for i in range(len(LEVELS))))


def counted_shingles(texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``part, repeated, common0, common1, ...``: for each part the codes of the shingles that several rows of ``texts(text)`` have, and
    of those that more than each of ``LEVELS`` have, 32 bits each. A few others count with them that have a code in common."""
    schema = ", ".join(["part int", *(f"{c} binary" for c in COUNTED)])
    held, counted = (to_arrow_schema(StructType.fromDDL(x)) for x in ("part int, codes binary", schema))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            for at, end in _loads(texts):
                text, base, _, _ = _shingled(*hashes(texts[at:end]), size)
                with np.errstate(over="ignore"):
                    codes = _codes(_mix(base * _ODD))
                # once for each text; those with a shingle are fewer than 2^20 in a load
                own = np.sort(codes << np.uint64(20) | (np.cumsum(np.diff(text, prepend=text[:1]) > 0)).astype(np.uint64))
                own = own[np.diff(own, prepend=~own[:1]) != 0] >> np.uint64(20)
                ends = np.searchsorted(own, np.arange(1, PARTS + 1, dtype=np.uint64) << np.uint64(32))
                offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
                blobs = pa.BinaryArray.from_buffers(pa.binary(), PARTS, [None, pa.py_buffer(offsets), pa.py_buffer(own.astype(np.uint32))])
                some = np.flatnonzero(np.diff(offsets))
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), blobs.take(pa.array(some))], schema=held)

    def count(table: pa.Table) -> pa.Table:
        codes = np.sort(np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint32))
        heads = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        n = np.diff(heads, append=len(codes))
        return pa.Table.from_arrays([table.column("part").combine_chunks()[:1], *(pa.array([codes[heads[n > least]].tobytes()], pa.binary()) for least in (1, *LEVELS))], schema=counted)

    return texts.select("text").mapInArrow(rows, "part int, codes binary").groupBy("part").applyInArrow(count, schema)


def bits_for(count: int) -> int:
    """The logarithm of a bitmap's bits for so many shingles."""
    return min(MOST_BITS, max(LEAST_BITS, (8 * count).bit_length()))


def code_bits(counted: DataFrame, name: str, log2_bits: int, known: int, level: int = 0) -> bytes:
    """A bitmap of the codes ``name`` below ``known``, a piece from each part."""
    each = (1 << log2_bits) // PARTS
    held = to_arrow_schema(StructType.fromDDL("part int, bits binary"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for codes in batch.column(1).to_pylist():
                codes, bits = np.frombuffer(codes, np.uint32).astype(np.uint64), np.zeros(each, bool)
                bits[_bit_of(codes[codes < np.uint64(known)], each, level).astype(np.int64)] = True
                out.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], schema=held)

    out = bytearray(1 << log2_bits >> 3)
    for r in counted.select("part", name).mapInArrow(pieces, "part int, bits binary").collect():
        out[r["part"] * (each >> 3) : (r["part"] + 1) * (each >> 3)] = r["bits"]
    return bytes(out)


#: ``claims`` holds the keys of a run and its places with their lows and highs (:func:`pack_claims`).
RUN = "doc long, rep long, shift int, start int, claims binary, theirs binary"


def cut_runs(rows: list[tuple], words: np.ndarray, span: int = SPAN, size: int = SHINGLE) -> Iterator[tuple]:
    """What a first occurrence has to show for the ``(doc, rep, keys, places, reps)`` that claim it: for each of these and
    each diagonal, runs ``doc, rep, shift, start, claims, its words``. A place's aligned common subsequences
    start at low..high; if there is none, low is above high and no words are needed."""
    row = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    keys, places, reps = (np.concatenate([np.empty(0, np.int64), *(r[i] for r in rows)]) for i in (2, 3, 4))
    centre, first, last = unpack_place(places)
    rcentre, rfirst, rlast = unpack_place(reps)
    shift = rcentre - centre
    low, high = np.maximum(first, rfirst - shift), np.minimum(last, rlast - shift)
    wide = span + size - 1
    none = low > high
    order = np.lexsort((low, none, shift, row))
    keys, places, low, high, shift, row, none = (x[order] for x in (keys, places, low, high, shift, row, none))
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (shift[1:] != shift[:-1]) | (none[1:] != none[:-1])
    apart = np.cumsum(new) << 40  # no run reaches into the next row's or diagonal's
    reach = np.maximum.accumulate(np.append(0, np.where(none, 0, high + wide) + apart))
    new |= ~none & (low + apart > reach[:-1])
    heads = np.flatnonzero(new)
    packed = memoryview(pack_claims(keys, places, low, high))
    for i, j in zip(heads.tolist(), [*heads[1:].tolist(), len(row)]):
        doc, rep, d = *rows[row[i]][:2], int(shift[i])
        claims = bytes(packed[16 * i : 16 * j])
        if none[i]:
            yield doc, rep, d, 0, claims, b""
        else:
            start = int(low[i])
            yield doc, rep, d, start, claims, words[start + d : int(reach[j] - apart[i]) + d].tobytes()


def _distinct(windows: np.ndarray) -> np.ndarray:
    windows = np.sort(windows, axis=1)
    return 1 + (windows[:, 1:] != windows[:, :-1]).sum(axis=1)


def jaccards(a: np.ndarray, b: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """Jaccard similarity of the subsequences of ``span`` shingles of ``a`` and ``b`` that start ``at``."""
    out = np.zeros(len(at))
    steps = np.arange(span)
    for i in range(0, len(at), 4096):  # bounded, however many there are
        x, y = (z[at[i : i + 4096, None] + steps] for z in (a, b))
        union = _distinct(np.concatenate([x, y], axis=1))
        out[i : i + 4096] = (_distinct(x) + _distinct(y) - union) / union
    return out


def _sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(x)])


def _near(mine: np.ndarray, theirs: np.ndarray, run: np.ndarray, inside: np.ndarray, at: np.ndarray, span: int, size: int, similarity: float) -> np.ndarray:
    """Similarities of the subsequences ``at``, of words of many runs that lie one after another: ``run`` is
    each word's, ``inside`` whether a shingle begins there. 0 where too many shingles of the first are
    nowhere in the other's run, which is told by one sort for all runs."""
    pad = np.zeros(min(size - 1, len(mine)), np.uint64)
    with np.errstate(over="ignore"):
        apart = _mix(run.astype(np.uint64) + np.uint64(1))
        a, b = (_mix(np.concatenate([shingles(x, size), pad]) ^ apart) for x in (mine, theirs))
    real = np.flatnonzero(inside)
    order = real[np.argsort(a[real], kind="stable")]
    here, there = a[order], np.sort(b[real])
    place = np.searchsorted(there, here)
    in_b, first = np.zeros(len(a), bool), np.zeros(len(a), bool)
    in_b[order] = there[np.minimum(place, len(there) - 1)] == here
    first[order] = np.concatenate([[True], here[1:] != here[:-1]])[: len(here)]
    shared, lacking = _sums(in_b), _sums(first & ~in_b)
    most, least = shared[at + span] - shared[at], lacking[at + span] - lacking[at]
    out = np.zeros(len(at))
    near = np.flatnonzero(most >= similarity * (most + least) - 1e-9)
    out[near] = jaccards(a, b, at[near], span)
    return out


def run_scores(mine: np.ndarray, theirs: np.ndarray, begin: np.ndarray, sizes: np.ndarray, lows: np.ndarray, highs: np.ndarray, of: np.ndarray, span: int = SPAN, size: int = SHINGLE, similarity: float = SIMILARITY) -> np.ndarray:
    """Jaccard similarity of the aligned subsequences that start at each word of many runs, ``sizes``
    words each from ``begin`` on in ``mine`` and ``theirs``; 0 for those below ``similarity`` and those that
    no low..high (counted from its run's first word; claims' runs are ``of``) holds."""
    n, wide = len(mine), span + size - 1
    if not n:
        return np.zeros(0)
    run = np.repeat(np.arange(len(sizes)), sizes)
    left = sizes[run] - (np.arange(n) - begin[run])  # words to the end of the run
    own = np.flatnonzero((lows <= highs) & (highs + wide <= sizes[of]))
    steps = np.bincount(begin[of[own]] + lows[own], minlength=n + 1) - np.bincount(begin[of[own]] + highs[own] + 1, minlength=n + 1)
    wanted = (np.cumsum(steps)[:n] > 0) & (left >= wide)
    other = _sums(mine != theirs)
    same = other[np.minimum(np.arange(n) + wide, n)] == other[:-1]
    scores = (wanted & same).astype(np.float64)
    rest = wanted & ~same
    live = np.zeros(len(sizes), bool)
    live[run[rest]] = True
    words = np.flatnonzero(live[run])  # of the runs that have more to tell
    if len(words):
        at = np.flatnonzero(rest[words])
        scores[words[at]] = _near(mine[words], theirs[words], run[words], left[words] >= size, at, span, size, similarity)
    return np.where(scores >= similarity, scores, 0.0)


def similarities(mine: np.ndarray, theirs: np.ndarray, start: int, lows: np.ndarray, highs: np.ndarray, span: int = SPAN, size: int = SHINGLE, similarity: float = SIMILARITY) -> np.ndarray:
    """:func:`run_scores` of a single run that begins at ``start``, of its subsequences alone."""
    n = len(mine) - span - size + 2
    if len(mine) != len(theirs) or n < 1:
        return np.zeros(0)
    one = np.zeros(len(lows), np.int64)
    return run_scores(mine, theirs, np.array([0]), np.array([len(mine)]), lows - start, highs - start, one, span, size, similarity)[:n]


def passages_of(scores: np.ndarray, mine: np.ndarray, theirs: np.ndarray, start: int, wide: int) -> list[tuple[int, int, float]]:
    """What holds, joined where it touches; it begins and ends with words that agree."""
    at = np.flatnonzero(scores)
    heads = np.flatnonzero(np.concatenate([[True], np.diff(at) > wide])) if len(at) else at
    out = []
    for i, j in zip(heads, [*heads[1:], len(at)]):  # similar subsequences reach over the passage's ends, to words that differ
        x, y = int(at[i]), int(at[j - 1]) + wide
        same = np.flatnonzero(mine[x:y] == theirs[x:y])
        out.append((start + x + int(same[0]), start + x + int(same[-1]) + 1, float(scores[at[i:j]].min())))
    return out


def _starts(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All starts of the places, and which place each is of."""
    _, first, last = unpack_place(places)
    counts = last - first + 1
    of = np.repeat(np.arange(len(places)), counts)
    return np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts - first, counts), of


def _runs(keys: np.ndarray, centre: np.ndarray, starts: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``keys, places`` of starts that follow one another with one centre in a place, and the places that they are of."""
    new = np.ones(len(starts), bool)
    new[1:] = (of[1:] != of[:-1]) | (starts[1:] != starts[:-1] + 1) | (centre[1:] != centre[:-1]) | (keys[1:] != keys[:-1])
    heads = np.flatnonzero(new)
    ends = np.append(heads, len(starts))[1:] - 1
    return keys[heads], pack_place(centre[heads], starts[heads], starts[ends]), of[heads]


def pack_claims(keys: np.ndarray, places: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> bytes:
    """Two 64-bit numbers for each claim; lows and highs lie at most 255 before their centres."""
    centre = places >> 16
    return np.stack([keys, places << 16 | (centre - lows) << 8 | (centre - highs)], axis=1).tobytes()


def unpack_claims(data: bytes) -> tuple[np.ndarray, ...]:
    """``keys, places, lows, highs``, of many runs' claims one after another too."""
    keys, packed = np.frombuffer(data, np.int64).reshape(-1, 2).T
    centre = packed >> 32
    return keys, packed >> 16, centre - (packed >> 8 & 255), centre - (packed & 255)


class Texts:
    """Texts with the runs that are to be verified, some at a time: ``(id, its words' hashes, runs)``, a run being
    ``(rep, shift, start, claims, theirs)``."""

    def __init__(self, texts: list[tuple[int, np.ndarray, list[tuple]]], span: int, size: int):
        self.span, self.size, self.wide = span, size, span + size - 1
        self.ids = np.array([d for d, _, _ in texts], np.int64)
        counts = np.array([len(w) for _, w, _ in texts], np.int64)
        self.begin, self.end = np.cumsum(counts) - counts, np.cumsum(counts)
        self.words = np.concatenate([np.empty(0, np.uint64), *(w for _, w, _ in texts)])
        self.runs = [(i, *run) for i, (_, _, runs) in enumerate(texts) for run in runs]
        self.text = np.array([r[0] for r in self.runs], np.int64)  # of a run
        self.start = np.array([r[3] for r in self.runs], np.int64)
        claims = [r[4] for r in self.runs]
        self.run = np.repeat(np.arange(len(claims)), [len(c) // 16 for c in claims])  # of a claim
        self.key, self.place, self.low, self.high = unpack_claims(b"".join(claims))
        # a claim beyond its text's end is one of an id that repeats with another text
        fits = unpack_place(self.place)[2] + self.wide <= counts[self.text[self.run]]
        self.run, self.key, self.place, self.low, self.high = (x[fits] for x in (self.run, self.key, self.place, self.low, self.high))

    def verify(self, similarity: float) -> list[tuple]:
        """``(id, rep, start, end, rep start, rep end, least similarity)`` of the passages."""
        theirs = [np.frombuffer(r[5], np.uint32) for r in self.runs]
        words = self.words.astype(np.uint32)
        mine = [words[self.begin[r[0]] + r[3] : min(self.begin[r[0]] + r[3] + len(t), self.end[r[0]])] for r, t in zip(self.runs, theirs)]
        theirs = [t[: len(m)] for m, t in zip(mine, theirs)]
        sizes = np.array([len(m) for m in mine], np.int64)
        self.at, self.sizes = np.cumsum(sizes) - sizes, sizes
        mine, theirs = (np.concatenate([np.empty(0, np.uint32), *x]) for x in (mine, theirs))
        first = self.start[self.run]
        self.scores = run_scores(mine, theirs, self.at, sizes, self.low - first, self.high - first, self.run, self.span, self.size, similarity)
        found = []
        self.covered = np.zeros(len(words) + 1, np.int64)
        held = np.flatnonzero(self.scores)
        for k in np.unique(np.searchsorted(self.at, held, side="right") - 1).tolist() if len(held) else []:
            i, rep, d, start, _, _ = self.runs[k]
            own = slice(self.at[k], self.at[k] + sizes[k])
            for a, b, s in passages_of(self.scores[own], mine[own], theirs[own], start, self.wide):
                found.append((int(self.ids[i]), rep, a, b, a + d, b + d, s))
                self.covered[self.begin[i] + a] += 1
                self.covered[self.begin[i] + b] -= 1
        self.covered = _sums(np.cumsum(self.covered)[:-1] > 0)
        return found

    def left(self, evidence: int, number: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``key, place, text`` (its number) of the claims' starts that fewer than ``evidence`` claims don't hold.

        With the ``number`` of an election, those that are similar to what was elected have its bit in their keys, and
        those that equal it are gone, after the first election from all groups (what they equal comes before them and
        is in all of these). Without one, all that are verified are gone, and those that passages cover by half."""
        starts, of = _starts(self.place)
        run = self.run[of]
        here = starts + self.begin[self.text[run]]
        at = starts - self.start[run]
        score = np.zeros(len(starts))
        inside = np.flatnonzero((at >= 0) & (at < self.sizes[run]))
        score[inside] = self.scores[self.at[run[inside]] + at[inside]]
        keys = self.key[of]
        if number is None:
            gone = (score > 0) | (2 * (self.covered[here + self.wide] - self.covered[here]) >= self.wide)
        else:
            keys = keys | (score > 0).astype(np.int64) << number
            gone = score == 1
            if not number:
                gone = np.bincount(here, gone, 1)[here] > 0
        if evidence > 1:
            gone |= np.bincount(here, minlength=1)[here] < evidence
        some = np.flatnonzero(~gone)
        starts, of = starts[some], of[some]
        key, place, of = _runs(keys[some], (self.place >> 16)[of], starts, of)
        return key, place, self.text[self.run[of]]

    def carried(self, evidence: int, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``id, key, place`` of what is left after an election."""
        key, place, text = self.left(evidence, number)
        order = np.lexsort((place, key, text))
        key, place, text = key[order], place[order], text[order]
        new = np.ones(len(key), bool)
        new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1]) | (place[1:] != place[:-1])
        return self.ids[text[new]], key[new], place[new]


def evident(places: np.ndarray, group: np.ndarray, least: int) -> np.ndarray:
    """The places, cut to the starts from the first to the last that ``least`` of their ``group`` (numbers that
    ascend) hold; -1 for none. Each function's places hold a start once at most."""
    out = np.full(len(places), -1)
    if not len(places):
        return out
    centre, first, last = unpack_place(places)
    heads = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    counts = np.diff(heads, append=len(group))
    begin = np.minimum.reduceat(first, heads)
    sizes = np.maximum.reduceat(last, heads) - begin + 2
    ends = np.cumsum(sizes)
    lie = np.repeat(ends - sizes - begin, counts)  # groups side by side
    load = np.repeat(ends // STARTS, counts)
    for own in np.split(np.arange(len(places)), np.flatnonzero(np.diff(load)) + 1):
        back = lie[own] - (first[own] + lie[own]).min()
        a, b = first[own] + back, last[own] + back
        n = int(b.max()) + 2
        at = np.flatnonzero(np.cumsum(np.bincount(a, minlength=n) - np.bincount(b + 1, minlength=n)) >= least)
        if len(at):
            i, j = np.searchsorted(at, a), np.searchsorted(at, b, side="right") - 1
            new = pack_place(centre[own], at[np.minimum(i, len(at) - 1)] - back, at[np.maximum(j, 0)] - back)
            out[own] = np.where(i <= j, new, -1)
    return out


def _pairs(claims: DataFrame, least: int, *by: str) -> DataFrame:
    """``doc, rep, keys, places, reps`` from ``claims(doc, key, place, rep, rep_place)``: what a document
    claims of one first occurrence, of the starts that ``least`` of its claims hold, or of those of one pair (``by``).
    A document's claims are bounded by its own places."""
    schema = "doc long, rep long, keys array<long>, places array<long>, reps array<long>"
    held = to_arrow_schema(StructType.fromDDL(schema))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            claims, bounds = batch.column(1).values, batch.column(1).offsets.to_numpy()
            key, place, rep, rep_place = (claims.field(c).to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]] for c in ("key", "place", "rep", "rep_place"))
            group = np.repeat(np.arange(len(batch)), np.diff(bounds))
            place = evident(place, group, least) if least > 1 else place
            kept = np.flatnonzero(place >= 0)
            kept = kept[np.lexsort((rep[kept], group[kept]))]
            group, rep = group[kept], rep[kept]
            heads = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (rep[1:] != rep[:-1]))[: len(kept)])
            ends = pa.array(np.append(heads, len(kept)), pa.int32())
            lists = (pa.ListArray.from_arrays(ends, pa.array(x[kept], pa.int64()), type=f.type) for x, f in zip((key, place, rep_place), list(held)[2:]))
            docs = batch.column(0).to_numpy(zero_copy_only=False)[group[heads]]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(rep[heads], pa.int64()), *lists], schema=held)

    grouped = claims.groupBy("doc", *by).agg(F.collect_set(F.struct("key", "place", "rep", "rep_place")).alias("claims"))
    return grouped.where(F.size("claims") >= least).select("doc", "claims").mapInArrow(dealt, schema)


def _reach(place: str) -> tuple[Column, Column]:
    """How far before its centre a place's last start and its first one lie."""
    return tuple(F.shiftright(place, n).bitwiseAND(F.lit(255).cast("long")) for n in (0, 8))


def _meet(place: str, other: str) -> Column:
    """Whether two places, aligned at their centres, have a start in common."""
    ahead, back = zip(_reach(place), _reach(other))
    return F.least(*back) >= F.greatest(*ahead)


def _cut_to(place: str, least: Column, most: Column) -> Column:
    """A place with starts that lie ``least`` to ``most`` before its centre alone."""
    return F.shiftleft(F.shiftright(place, 16), 16).bitwiseOR(F.shiftleft(most, 8)).bitwiseOR(least)


def _joining(rows: DataFrame, evidence: int) -> DataFrame:
    """``rows(key, doc, place)`` without, at each start, the ``evidence - 1`` of its keys that most rows have. Of so many keys as two
    similar subsequences share the rarest is not among these in either (the order is one for all), so they still meet."""
    sizes = cut(rows.groupBy(_group().alias("group")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW))
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_IDS else sizes
    counted = rows.join(sizes, _group() == F.col("group"), "left").select("doc", "key", "place", F.coalesce("n", F.lit(0)).alias("n"))
    held = to_arrow_schema(StructType.fromDDL("key long, doc long, place long"))

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, bounds = batch.column(1).values, batch.column(1).offsets.to_numpy()
            key, place, n = (own.field(c).to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]] for c in ("key", "place", "n"))
            starts, of = _starts(place)
            doc, group = np.repeat(np.arange(len(batch)), np.diff(bounds))[of], key[of] >> ELECTIONS
            order = np.lexsort((group, n[of], starts, doc))
            last = np.append((np.diff(doc[order]) != 0) | (np.diff(starts[order]) != 0), True)[: len(order)]
            ends = np.flatnonzero(last)[np.cumsum(last) - last]  # of the same start
            kept = order[ends - np.arange(len(order)) >= evidence - 1]
            kept = kept[np.lexsort((starts[kept], of[kept]))]
            key, place, of = _runs(key[of[kept]], place[of[kept]] >> 16, starts[kept], of[kept])
            docs = batch.column(0).to_numpy(zero_copy_only=False)[np.searchsorted(bounds - bounds[0], of, side="right") - 1]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, docs, place)], schema=held)

    return counted.groupBy("doc").agg(F.collect_set(F.struct("key", "place", "n")).alias("own")).mapInArrow(rarest, "key long, doc long, place long")


def _elected(rows: DataFrame, number: int) -> DataFrame:
    """``group, least, most, rep, rep_place, rep_key``: the starts of each group, least to most before the shingle, for which one of
    ``rows`` is elected: first that with most starts (an edit near a shingle leaves it fewer, so most are similar to this one), then any,
    which is most often one of the greatest cluster. No one is where ``FEW`` rows or fewer are; where one document alone is, or all are similar to one that was elected,
    there is nothing to be compared."""
    ahead, back = _reach("place")
    at = rows.select(_group().alias("group"), "key", "doc", "place", F.explode(F.sequence(ahead, back)).alias("at"))
    starts = back - ahead if number == 1 else F.lit(0)
    best = F.max(F.struct(starts.alias("starts"), F.xxhash64("doc", F.lit(number)).alias("hash"), "doc", "place", "key"))
    at = at.groupBy("group", "at").agg(best.alias("rep"), F.count(F.lit(1)).alias("n"), F.min("doc").alias("first"), F.max("doc").alias("last"), F.bit_and("key").alias("all"))
    at = at.where("first < last").where(~_near_one("all")).withColumn("rep", F.when(F.col("n") > FEW, F.col("rep")))
    by = Window.partitionBy("group", "rep").orderBy("at")
    runs = at.select("group", "rep", "at", (F.col("at") - F.row_number().over(by)).alias("run")).groupBy("group", "rep", "run").agg(F.min("at").alias("least"), F.max("at").alias("most"))
    return runs.select("group", "least", "most", F.col("rep.doc").alias("rep"), _cut_to("rep.place", F.col("least"), F.col("most")).alias("rep_place"), F.col("rep.key").alias("rep_key"))


CHECKED = "doc long, rep long, start int, end int, rep_start int, rep_end int, similarity double, key long, place long"


def _next_to_text(rows: DataFrame, texts: DataFrame, by: str, *order: str) -> DataFrame:
    """``rows`` and the texts that they need, dealt by ``by`` so that each text comes right before its
    rows: ``text`` is null in these. A text is moved once for each ``CLAIMS`` rows of it."""
    many = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CLAIMS)
    many = cut(many.select(F.col(by).alias("common"), F.ceil(F.col("n") / CLAIMS).cast("int").alias("parts")))
    many = F.broadcast(many) if many.count() <= BROADCAST_IDS else many
    spread = F.when(F.col("parts") > 1, F.pmod(F.xxhash64(*order), F.col("parts"))).otherwise(0).cast("int")
    dealt = rows.join(many, rows[by] == many["common"], "left").select(*rows.columns, spread.alias("part"), F.lit(None).cast("binary").alias("text"))
    # a text's row has its document's id in every number's place, for numbers with nulls among them become inexact on the way
    own = texts.join(many, texts["doc"] == many["common"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)))
    filled = [(F.col("doc").cast(f.dataType) if f.dataType.typeName() in ("long", "integer") else F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema]
    both = dealt.unionByName(own.select(*filled, "part", "text"))
    return both.repartition(by, "part").sortWithinPartitions(by, "part", F.col("text").isNull(), *order)


def _needed(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of some documents; their ids go to the texts while they are few."""
    ids = cut(ids.distinct())
    return texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc", "left_semi")


def _check(pairs: DataFrame, texts: DataFrame, span: int, size: int, similarity: float, evidence: int, number: int | None) -> DataFrame:
    """Verify ``pairs(doc, rep, keys, places, reps)``: passages, and after the election ``number`` the signatures of
    the subsequences that are left.
    A first occurrence's further places claim it too, only to be grouped again.

    The first occurrences' words travel, cut to what is claimed; a text goes to where it is claimed
    from and comes before its claims there, once, so it is hashed once and no claim carries it.
    Words are compared by 32 bits each; a passage needs some forty-five equal ones in place.
    """
    held = to_arrow_schema(StructType.fromDDL(CHECKED))

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, words = WordHashes(), np.empty(0, np.uint32)
        for batch in batches:
            out, some = [], []
            for doc, rep, keys, places, reps, text in zip(*(batch[c].array for c in ("doc", "rep", "keys", "places", "reps", "text"))):
                if text is not None:
                    out += cut_runs(some, words, span, size)
                    words, some = hashes([text])[0].astype(np.uint32), []
                elif doc == rep:
                    centre = places >> 16
                    out.append((doc, rep, 0, 0, pack_claims(keys, places, centre, centre - 1), b""))
                else:
                    some.append((doc, rep, keys, places, reps))
            out += cut_runs(some, words, span, size)
            yield pd.DataFrame(out, columns=["doc", "rep", "shift", "start", "claims", "theirs"])

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, texts, load = WordHashes(), [], 0
        for batch in batches:
            for doc, rep, shift, start, claims, theirs, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "rep", "shift", "start", "claims", "theirs", "text"))):
                if text is None:
                    if number is None and load > LOAD:  # nothing is carried on, for which a text's claims are needed together
                        yield _told(texts, hashes)
                        texts = [(*texts[-1][:2], [])]
                        load = 8 * len(texts[0][1])
                    texts[-1][2].append((rep, shift, start, claims, theirs))
                    load += 4 * len(theirs) + 8 * len(claims)
                    continue
                if load > LOAD:
                    yield _told(texts, hashes)
                    texts, load = [], 0
                texts.append((doc, hashes([text])[0], []))
                load += len(text)
        yield _told(texts, hashes)

    def _told(texts: list[tuple], hashes: WordHashes) -> pa.RecordBatch:
        """Passages, and then documents, keys and places of what is left."""
        work = Texts([t for t in texts if t[2]], span, size)
        found = work.verify(similarity)
        new = (np.empty(0, np.int64),) * 3 if number is None else work.carried(evidence, number)
        new, old = dict(zip(("doc", "key", "place"), new)), dict(zip((f.name for f in held), zip(*found)))
        n = len(new["key"])
        columns = [pa.concat_arrays([pa.array(old.get(f.name, [None] * len(found)), f.type), pa.array(new[f.name], f.type) if f.name in new else pa.nulls(n, f.type)]) for f in held]
        return pa.RecordBatch.from_arrays(columns, schema=held)

    claimed = _next_to_text(pairs, _needed(texts, pairs.select(F.col("rep").alias("doc"))), "rep", "doc")
    runs = cut(claimed.mapInPandas(cut_out, RUN))
    return _next_to_text(runs, _needed(texts, runs.select("doc")), "doc", "doc").mapInArrow(checked, CHECKED)


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Passages that a document shares with an earlier one: ``doc_id, rep_id, start, end,
    rep_start, rep_end, similarity``; places in words, end exclusive, rep_id < doc_id.

    All occurrences of a passage link to its first one, so a passage that a third of all documents
    share gives a row for each and no pairs among them. Words compare without regard to the case of
    A-Z. Null, empty and short texts have no passage; rows without an id are left out; rows that
    repeat an id count as one document (any of them where they differ). Extra columns are ignored;
    an empty table gives no rows.

    Subsequences of 46 different shingles that are similar enough, aligned at a shingle that is among the lowest of both,
    are always compared, or both are similar to one that both were compared with: rows join everything that is similar,
    directly or by way of others. Rows are no list of all pairs.
    """
    if not 1 <= span <= 255:
        raise ValueError("span must be from 1 to 255")
    spark = df.sparkSession
    bound_batches(spark)
    texts = df.where(named(id_col).isNotNull() & named(text_col).isNotNull()).select(named(id_col).cast("long").alias("doc"), named(text_col).cast("binary").alias("text"))
    depth, evidence = depth_of(span, similarity)
    columns = ["doc", "rep", "start", "end", "rep_start", "rep_end", "similarity"]
    passages = spark.createDataFrame([], "doc long, rep long, start int, end int, rep_start int, rep_end int, similarity double")
    rows = _repeated(texts, span, size, depth)
    # keys of several documents, with their first occurrence
    reps = rows.groupBy(_group().alias("group")).agg(F.min(F.struct("doc", "place")).alias("rep"), F.min("doc").alias("least"), F.max("doc").alias("most"))
    reps = cut(reps.where("least < most").select("group", F.col("rep.doc").alias("rep"), F.col("rep.place").alias("rep_place")))
    if reps.isEmpty():
        return _ordered(passages)
    claims = rows.join(reps, _group() == F.col("group")).where("doc <> rep or place <> rep_place")
    checked = cut(_check(cut(_pairs(claims, evidence)), texts, span, size, similarity, evidence, 0))
    passages = passages.union(checked.where("start is not null").select(*columns))
    rows = cut(_joining(checked.where("key is not null").select("key", "doc", "place").distinct(), evidence))
    release(spark)  # without it an executor of 3 GB was too small on the check's hot input
    few = []
    for number in range(1, ELECTIONS):
        reps = cut(_elected(rows, number))
        ahead, back = _reach("place")
        least, most = F.greatest(ahead, "least"), F.least(back, "most")
        parts = rows.join(reps, _group() == F.col("group")).where(least <= most).select("key", "doc", _cut_to("place", least, most).alias("place"), "rep", "rep_place", "rep_key")
        few.append(cut(parts.where("rep is null").select("key", "doc", "place")))
        if reps.where("rep is not null").isEmpty():
            rows = None
            break
        parts = parts.where("doc <> rep or shiftright(place, 16) <> shiftright(rep_place, 16)")
        claims, apart = parts.where(~_near_one("key", "rep_key")), parts.where(_near_one("key", "rep_key"))
        checked = cut(_check(cut(_pairs(claims, 1)), texts, span, size, similarity, 1, number))
        passages = passages.union(checked.where("start is not null").select(*columns))
        apart = apart.select(F.col("key").bitwiseOR(F.lit(1 << number).cast("long")).alias("key"), "doc", "place")
        rows = cut(checked.where("key is not null").select("key", "doc", "place").union(apart).distinct())
        release(spark)
    for more in few:
        rows = more if rows is None else rows.union(more)
    own, other = rows.withColumn("group", _group()), rows.select(_group().alias("group"), F.col("key").alias("rep_key"), F.col("doc").alias("rep"), F.col("place").alias("rep_place"))
    rest = own.join(other, "group").where(F.col("rep") < F.col("doc")).where(~_near_one("key", "rep_key")).where(_meet("place", "rep_place"))
    pairs = cut(_pairs(rest.select("doc", F.col("group").alias("key"), "place", "rep", "rep_place").withColumn("pair", F.col("rep")), 1, "pair"))
    if not pairs.isEmpty():
        release(spark)
        passages = passages.union(cut(_check(pairs, texts, span, size, similarity, 1, None)).select(*columns))
    return _ordered(passages)


def _group() -> Column:
    """What a key groups by."""
    return F.shiftright("key", ELECTIONS)


def _near_one(*keys: str) -> Column:
    """Whether subsequences with these keys are all similar to one that was elected."""
    both = F.lit((1 << ELECTIONS) - 1).cast("long")
    for k in keys:
        both = both.bitwiseAND(F.col(k))
    return both != 0


def _repeated(texts: DataFrame, span: int, size: int, depth: int) -> DataFrame:
    """``key, doc, place`` of the signatures that several documents have (and of some that one has), when what one document has
    comes first, and last what most have."""
    found = cut(counted_shingles(texts, size))
    count, *levels = map(int, found.agg(*(F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) / 4 for c in COUNTED)).first())
    known = min(1 << 32, (1 << MOST_BITS + 31) // max(1, count))  # two bits for each repeated one that the bitmap tells of
    repeated = code_bits(found, "repeated", bits_for(count), known)
    common = [code_bits(found, f"common{i}", bits_for(n), 1 << 32, i + 1) for i, n in enumerate(levels) if n]
    del found
    release(texts.sparkSession)
    return cut(signature_rows(texts, span=span, size=size, thin=False, depth=depth, common=common, repeated=repeated, known=known))


def _ordered(passages: DataFrame) -> DataFrame:
    """The later document of each pair first."""
    swapped = F.col("doc") < F.col("rep")
    names = {"doc_id": ("doc", "rep"), "rep_id": ("rep", "doc"), "start": ("start", "rep_start"), "end": ("end", "rep_end"), "rep_start": ("rep_start", "start"), "rep_end": ("rep_end", "end")}
    return passages.select(*(F.when(swapped, F.col(b)).otherwise(F.col(a)).alias(c) for c, (a, b) in names.items()), "similarity").distinct()
