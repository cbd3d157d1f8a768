"""Secret scans: fixed patterns, and strings that zstandard can't predict from what is around them."""

from __future__ import annotations

import bisect
import collections
import hashlib
import itertools
import re

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, named

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run shorter than the least length can't be part of a longer one, so only long runs are looked for.
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

#: An identifier in code: a name before a sign that assigns, calls, indexes or reaches into it.
IDENTIFIER = r"([A-Za-z_][A-Za-z_]{2,14})(?=\x20?[=:(\[{]|\.[A-Za-z_])"
#: The dictionary: so many identifiers of the corpus, those of the most documents; at least so many documents each.
DICTIONARY_WORDS = 4096
DICTIONARY_DOCS = 5
#: Words that make the text around a candidate sensitive.
SENSITIVE = re.compile(r"(?ai)passw|pwd|secret|token|api.?key|access.?key|private.?key|credential|auth|bearer|signature|passphrase")
#: What makes a sensitive word speak of what follows it.
ASSIGNED = re.compile(r"""["']?\x20*[:=]""")
#: The first characters of a candidate, and all of it from there on.
HEAD = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+")
#: Names change from small to capital letters too, but seldom write two capitals in a row.
_RISES, _CAPITALS = re.compile("[a-z][A-Z]"), re.compile("(?=[A-Z][A-Z])")
LEAST = 16
#: Runs that are no secret however long.
ALPHABETS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789 0123456789abcdef 12345678 00000000 xxxxxxxx"
#: Characters before or after a candidate in which a sensitive word must stand.
REACH = 48
#: Characters on either side that prime the compressor.
AROUND = 512
#: Marginal compressed bytes for each byte of a candidate from which it counts as novel.
NOVELTY = 0.6


def identifiers(df: DataFrame, text_col: str = "text", words: int = DICTIONARY_WORDS, docs: int = DICTIONARY_DOCS) -> str:
    """The corpus's own identifiers, those of the most rows last (a compressor reaches near bytes
    for less). All rows are counted; names of letters and underscores of 15 at most can't hold a
    candidate. The driver gets ``words`` rows."""
    found = df.select(F.explode(F.array_distinct(F.regexp_extract_all(named(text_col), F.lit(IDENTIFIER), F.lit(1)))).alias("word"))
    counted = found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= docs)
    return " ".join(r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(words).collect()[::-1])


class NoveltyMeter:
    """Bytes that a string adds to its surroundings when zstandard compresses both, primed with
    a dictionary of identifiers and the alphabets that codes are written in."""

    def __init__(self, words: str = "", level: int = 3):
        primer = f"{ALPHABETS} {words}".encode()
        held = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False)

    def size(self, data: bytes) -> int:
        return len(self.compressor.compress(data))

    def novelty(self, before: str, candidate: str, after: str) -> float:
        around, own = (before + after).encode("utf-8", "replace"), candidate.encode("utf-8", "replace")
        return (self.size(around + own) - self.size(around)) / max(1, len(own))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the fixed patterns' whole matches, in code points."""
    spans = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    spans += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    spans += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs that chance may have drawn, with a sensitive word at most ``REACH`` characters before them, or as near behind them
    on the same line, unless that word is assigned something itself; in order, of any length. A text without a sensitive
    word isn't looked through."""
    words = [m.span() for m in SENSITIVE.finditer(text)]
    if not words:
        return []
    begins, ends = [a for a, b in words if not ASSIGNED.match(text, b)], [b for _, b in words]
    found, seen = [], 0
    while head := HEAD.search(text, seen):
        start, seen = head.start(), CANDIDATE.match(text, head.start()).end()
        last, following = bisect.bisect_right(ends, start), bisect.bisect_left(begins, seen)
        after = last > 0 and start - ends[last - 1] <= REACH
        before = following < len(begins) and begins[following] - seen <= REACH and "\n" not in text[seen : begins[following]]
        if (after or before) and drawn(text[start:seen]):
            found.append((start, seen))
    return found


def measured_spans(text: str, meter: NoveltyMeter, covered: list[tuple[int, int, str]], least: float = NOVELTY) -> tuple[list[tuple[int, int, str]], int, float | None]:
    """Candidates that stay incompressible and touch no covered span, how many candidates were measured, and the greatest novelty
    of those that lie in a covered one (null without one)."""
    found, known = [], None
    covered = sorted(covered)
    starts, reach = [a for a, _, _ in covered], list(itertools.accumulate((b for _, b, _ in covered), max))
    measured = candidates(text)
    for start, end in measured:
        novelty = meter.novelty(text[max(0, start - AROUND) : start], text[start:end], text[end : end + AROUND])
        before = bisect.bisect_left(starts, end)  # spans that begin before its end; does one reach into it?
        if before and reach[before - 1] > start:
            known = max(novelty, known or 0.0)
        elif novelty >= least:
            found.append((start, end, "novel"))
    return found, len(measured), known


def novel_spans(text: str, meter: NoveltyMeter, covered: list[tuple[int, int, str]], least: float = NOVELTY) -> list[tuple[int, int, str]]:
    """The first of :func:`measured_spans`."""
    return measured_spans(text, meter, covered, least)[0]


def drawn(candidate: str) -> bool:
    """Whether a string may be a code rather than a word or a name: it has a digit, or cases as chance mixes them."""
    return any(c.isdigit() for c in candidate) or (len(_RISES.findall(candidate)) > 1 and len(_CAPITALS.findall(candidate)) > 1)


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", novelty: float = NOVELTY, words: str | None = None) -> DataFrame:
    """One row per input row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel, n_candidates,
    base_novelty``: the strings near a sensitive word that were measured, and the greatest novelty of those within base spans.

    ``words`` primes the novelty meter; without it the identifiers of all of ``df`` do
    (:func:`identifiers`: one aggregation of distinct names). Whole texts are scanned where they
    lie; nothing else is shuffled. A null text counts as empty, a null id stays null, repeated rows
    are repeated, extra columns are ignored and an empty table gives no rows. Offsets count code
    points, ends exclusive.
    """
    words = identifiers(df, text_col) if words is None else words

    def start():
        meter = NoveltyMeter(words)

        def scanned(doc: int | None, text: str | None) -> list[tuple]:
            text = text or ""
            base = base_spans(text)
            novel, measured, known = measured_spans(text, meter, base, novelty)
            spans = base + novel
            n = collections.Counter(s[2] for s in spans)
            return [(doc, n["assign"], n["access"], n["hex"], hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), n["novel"], measured, known)]

        return scanned

    return map_texts(df, id_col, text_col, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long, n_candidates long, base_novelty double", start)
