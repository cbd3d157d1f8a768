"""Packing tokenised documents into fixed windows, best-fit decreasing."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import cut, map_texts

WINDOW = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Pieces that one packing task takes on average.
TASK_PIECES = 20_000
#: Units whose ids a worker remembers: so many of late, and as many from before that.
WORD_CACHE = 150_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public tokenizer's file on the machine that runs this."""
    import public_tokenizers

    return public_tokenizers.path(name)


# Lower-case letters, digits and white space below U+0250, as the tokenizer's own pattern has them.
_LOW = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff\u0100-\u024f"
_NUM = "0-9\xb2\xb3\xb9\xbc-\xbe"
_UNITS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LOW}]+|[{_NUM}]|[^\t-\r \x85\xa0{_LOW}{_NUM}]+")
#: Texts with other letters, before or after lower-casing, a dotted capital I or a special token's text take the
#: tokenizer's own way.
_OTHER = re.compile("[^\x00-\u024f]|\u0130|<\\|")
_HIGH = re.compile("[^\x00-\u024f]")


def _byte_letters() -> list[str]:
    """The printable letter that byte-level BPE writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordEncoder:
    """Ids of whole texts by the word tokenizer, each distinct unit encoded once while remembered.

    Its tokens never cross white space, which it drops, nor its pattern's units. Texts of letters
    below U+0250 are lower-cased and cut into units here; other texts are split at ASCII white
    space and each word goes through the tokenizer.
    """

    def __init__(self, path: str | None = None, cache: int = WORD_CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or tokenizer_path())
        self.units: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.words: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.cache = cache
        self.letters = _byte_letters()

    def _unit(self, unit: str) -> bytes:
        letters = self.letters
        mapped = unit if unit.isascii() and unit.isalnum() else "".join([letters[b] for b in unit.encode()])
        return struct_ids([t.id for t in self.tokenizer.model.tokenize(mapped)])

    def _word(self, word: str) -> bytes:
        return struct_ids(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _all(self, parts: list[str], known: tuple[dict[str, bytes], dict[str, bytes]], find) -> bytes:
        """Ids of the parts. When the newer memory is full it becomes the older one; what is used again
        comes back from there, so common units are never forgotten."""
        new, old = known
        missing = set(parts).difference(new)
        if missing:
            if len(new) + len(missing) > self.cache:
                old.clear()
                old.update(new)
                new.clear()
                missing = set(parts)
            for w in missing:
                new[w] = old.get(w) or find(w)
        return b"".join(map(new.__getitem__, parts))

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids."""
        text = text or ""
        if not _OTHER.search(text):
            low = text.lower()
            if text.isascii() or not _HIGH.search(low):
                return self._all(_UNITS.findall(low), self.units, self._unit)
        return self._all([w.decode() for w in text.encode().split()], self.words, self._word)


def struct_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def cut_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, path: str | None = None) -> DataFrame:
    """Pieces of every document: full windows first, then what is left.

    ``doc_id, start, length, ids_crc32, doc_tokens``; ids end with ``END_ID``, so a null, empty or
    blank text is that one id.
    """

    def start():
        encoder, end = WordEncoder(path), END_ID.to_bytes(4, "little")

        def pieces(doc: int | None, text: str | None) -> Iterator[tuple]:
            ids = encoder.encode(text) + end
            n = len(ids) // 4
            for at in range(0, n, window):
                part = ids[4 * at : 4 * (at + window)]
                yield doc, at, len(part) // 4, zlib.crc32(part), n

        return pieces

    return map_texts(df, id_col, text_col, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long", start)


class OpenWindows:
    """Segment tree over remaining capacities 1..window: the leaf of a capacity holds the open
    windows with exactly that much room, an inner node whether any leaf below it holds one."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.any = [False] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, key: int) -> None:
        if not room:
            return
        self.at[room].append(key)
        i = room + self.size
        while i and not self.any[i]:
            self.any[i] = True
            i >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out a window with the least room that is enough: ``(room, key)``."""
        any_, i = self.any, need + self.size
        while not any_[i]:  # the first subtree right of ``need`` that holds a window
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1
            if i & (i - 1) == 0:  # past the last node of a level
                return None
        while i < self.size:
            i = 2 * i if any_[2 * i] else 2 * i + 1
        room = i - self.size
        key = self.at[room].pop()
        if not self.at[room]:
            while i and not (i < self.size and (any_[2 * i] or any_[2 * i + 1])):
                any_[i] = False
                i >>= 1
        return room, key


def _put(tree: OpenWindows, filled: list[int], length: int, window: int) -> tuple[int, int]:
    """Put a piece into the tightest open window, or a new one: ``(window, offset)``."""
    found = tree.tightest(length) if length < window else None
    if found is None:
        room, key = window, len(filled)
        filled.append(0)
    else:
        room, key = found
    offset = filled[key]
    filled[key] += length
    tree.add(room - length, key)
    return key, offset


def pack(pieces: DataFrame, window: int = WINDOW, task_pieces: int = TASK_PIECES) -> DataFrame:
    """Pack ``pieces`` (of :func:`cut_pieces`, lengths from 1 to ``window``): adds ``sequence_id``
    and ``offset``, gapless from 0 within a sequence.

    Pieces are dealt over tasks by a hash; a task takes them in descending length and puts each
    into its tightest open window. It holds one number for each window it has opened. A sequence id
    is the task's number times 2^40 plus the window's, so reruns agree. Input columns are kept.
    """
    pieces = cut(pieces)
    n = max(1, -(-pieces.count() // task_pieces))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() << 40
        tree, filled = OpenWindows(window), []
        for batch in batches:
            placed = [_put(tree, filled, length, window) for length in batch["length"].tolist()]
            yield batch.assign(sequence_id=[base + k for k, _ in placed], offset=[o for _, o in placed])

    dealt = pieces.repartition(n, F.xxhash64("doc_id", "start", "ids_crc32"))
    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return dealt.sortWithinPartitions(F.desc("length"), "doc_id", "start", "ids_crc32").mapInPandas(place, schema)


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, path: str | None = None) -> DataFrame:
    """Tokenise and pack: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Every id of every row lies in exactly one piece. Null, empty and blank texts are the end id
    alone. Repeated rows are packed as often as they occur; a null id stays null. Extra columns are
    ignored; an empty table gives no rows.
    """
    return pack(cut_pieces(df, id_col, text_col, window, path), window)
