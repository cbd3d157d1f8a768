"""Quality rules: base counts, and a conditional random field that labels lines."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .common import bound_batches, bounded_sample, cut, named, slices
from .line_dedup import BROADCAST_LINES, boilerplate, line_key, occurrences

SPACES = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50
#: Share of a document's words in content lines from which it is kept.
CONTENT_SHARE = 0.5
#: Training: labelled documents of each quality at most, and of each the features of so many lines that follow one
#: another, from a place in the document that its hash decides (a bound on rows and on text).
DOCS_PER_CLASS = 600
TRAIN_LINES = 48
STEPS = 80
#: Rounds in which the lines' hidden labels are guessed anew, and how much each line of a document leans to its label.
GUESSES = 3
LEAN = 1.0
RATE = 0.1
DECAY = 1e-3
SEED = 11

#: Words that notices and navigation repeat.
NOTICE = re.compile(rb"(?i)copyright|licen[cs]e|all rights|cookie|subscribe|click here|log ?in|sign up|share this|read more|terms of")
FEATURES = 14
BOILERPLATE, CONTENT = 0, 1


@dataclass
class Base:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > MOST_REPEATED * self.n_words


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window which the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
    v = len(index)
    pairs = ids[:-1] * v + ids[1:]
    if v**3 >= 1 << 62:
        pairs, v = np.unique(pairs, return_inverse=True)[1].astype(np.int64), max(v, 1)
    _, inverse, counts = np.unique(pairs[:-1] * v + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= twice
    return int(covered.sum())


def measure(text: bytes) -> tuple[Base, list[bytes], list[bool]]:
    """Base counts; the lines, and whether each has a word and equals an earlier one."""
    words = text.split()
    lines, seen, dup = text.split(b"\n"), set(), []
    for line in lines:
        has = bool(line.strip(SPACES))
        dup.append(has and line in seen)
        seen.add(line)
    chars = len(text.translate(None, SPACES + bytes(range(0x80, 0xC0))))  # continuation bytes aside
    base = Base(len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), sum(dup), repeat_words(words))
    return base, lines, dup


def features(line: bytes, dup: bool, spread: bool) -> list[float]:
    """What the field sees of a line: ``dup`` if it repeats an earlier one of its document, ``spread``
    if it stands on many sites."""
    words = line.split()
    n, size = len(words), max(1, len(line.translate(None, SPACES)))
    ascii_upper = len(line) - len(line.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    letters = max(1, len(line) - len(line.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")))
    digits = len(line) - len(line.translate(None, b"0123456789"))
    symbols = len(line) - len(line.translate(None, b"#*$%&|<>{}[]\\^~_=+@"))
    marks = line.count(b"!")
    return [
        1.0,
        min(n, 60) / 30,
        float(n < 4),
        size / max(1, n) / 10,
        min(1.0, 6 * symbols / size),
        min(1.0, ascii_upper / letters),
        min(1.0, 4 * digits / size),
        min(1.0, 6 * marks / size),
        float(dup),
        1 - len(set(words)) / max(1, n),
        float(line.rstrip(SPACES)[-1:] in (b".", b"?", b'"', b")")),
        float(NOTICE.search(line) is not None),
        len(line.translate(None, b"abcdefghijklmnopqrstuvwxyz ")) / max(1, len(line)),
        float(spread),
    ]


class LineField:
    """Linear-chain conditional random field over lines with labels boilerplate and content.

    ``emit`` holds the content label's weights of a line's features (boilerplate's are zero),
    ``step`` the scores of neighbouring labels and ``first`` of the first line's.
    """

    def __init__(self):
        self.emit = np.zeros(FEATURES)
        self.step = np.zeros((2, 2))
        self.first = np.zeros(2)

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean negative log likelihood by the forward-backward algorithm and its gradients.

        ``x`` [document, line, feature], ``y`` and ``mask`` [document, line]; a document's lines
        come first.
        """
        docs, lines = y.shape
        score = np.stack([np.zeros_like(y, float), x @ self.emit], axis=2)
        fwd, back = np.empty((docs, lines, 2)), np.zeros((docs, lines, 2))
        fwd[:, 0] = self.first + score[:, 0]
        for t in range(1, lines):
            new = np.logaddexp.reduce(fwd[:, t - 1, :, None] + self.step, axis=1) + score[:, t]
            fwd[:, t] = np.where(mask[:, t, None], new, fwd[:, t - 1])
        for t in range(lines - 2, -1, -1):
            new = np.logaddexp.reduce(self.step + (score[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
            back[:, t] = np.where(mask[:, t + 1, None], new, back[:, t + 1])
        total = np.logaddexp.reduce(fwd[:, -1], axis=1)
        one = np.exp(fwd + back - total[:, None, None]) * mask[:, :, None]
        two = fwd[:, :-1, :, None] + self.step + (score + back)[:, 1:, None, :] - total[:, None, None, None]
        two = np.exp(np.minimum(two, 0)) * mask[:, 1:, None, None]
        gold = np.stack([1 - y, y], axis=2) * mask[:, :, None]
        gold_two = gold[:, :-1, :, None] * gold[:, 1:, None, :]
        own = (gold[:, :, 1] * score[:, :, 1]).sum() + (gold[:, 0] * self.first).sum() + (gold_two * self.step).sum()
        grads = [np.einsum("dl,dlf->f", (one - gold)[:, :, 1], x), (two - gold_two).sum(axis=(0, 1)), (one - gold)[:, 0].sum(axis=0)]
        return (total.sum() - own) / docs, [g / docs for g in grads]

    def train(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, steps: int = STEPS, rate: float = RATE, alone: bool = False) -> float:
        """Gradient steps (Adam) from where the field is; ``alone``: of the features' weights only."""
        params = [self.emit] if alone else [self.emit, self.step, self.first]
        first, second, loss = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0.0
        for k in range(1, steps + 1):
            loss, grads = self.gradients(x, y, mask)
            for p, g, m, v in zip(params, grads, first, second):
                g = g + DECAY * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate / (1 - 0.9**k) * m / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        return float(loss)

    def decode(self, x: np.ndarray, lean: np.ndarray | float = 0.0) -> list[int]:
        """The best labels of one document's lines, by the Viterbi algorithm; ties go to content.
        ``lean`` is added to the content label's score, of all lines or of each."""
        emit = (x @ self.emit + lean).tolist()
        (bb, bc), (cb, cc) = self.step.tolist()
        b, c, back = self.first[0], self.first[1] + emit[0], []
        for e in emit[1:]:
            from_b, from_c = b + bb > c + cb, b + bc > c + cc
            back.append((from_b, from_c))
            b, c = (b + bb if from_b else c + cb), (b + bc if from_c else c + cc) + e
        label = BOILERPLATE if b > c else CONTENT
        out = [label]
        for from_b, from_c in reversed(back):
            label = BOILERPLATE if (from_b if label == BOILERPLATE else from_c) else CONTENT
            out.append(label)
        return out[::-1]


class Spread:
    """Tells the lines that stand on many sites, by their hashes."""

    def __init__(self, keys: frozenset[bytes] = frozenset()):
        self.keys = keys

    def __call__(self, line: bytes) -> bool:
        return bool(self.keys) and hashlib.md5(line.strip(SPACES)).digest() in self.keys


def line_features(lines: list[bytes], dup: list[bool], spread: list[bool]) -> tuple[list[list[float]], list[int]]:
    """Features and words of the lines that have a word."""
    some = [(features(x, d, s), len(x.split())) for x, d, s in zip(lines, dup, spread) if x.strip(SPACES)]
    return [f for f, _ in some], [n for _, n in some]


def fit(found: list[tuple[int, np.ndarray]], steps: int = STEPS, guesses: int = GUESSES, lean: float = LEAN) -> LineField | None:
    """A field from ``(quality, features)`` of documents, whose lines' labels are hidden.

    A document's quality is evidence on its lines, not their label. At first each line is guessed
    to be as its document, but that spread lines are boilerplate wherever they stand, and only the
    features' weights are fitted, line by line: such labels never change within a document, so
    steps fitted to them would carry one label through every document. Then, in turns, the lines
    are guessed anew (the field's best labelling where each line leans to its document's quality
    and spread lines stay boilerplate) and the whole field is fitted to the guess.
    None if one of the qualities has no document.
    """
    if len({label for label, _ in found}) < 2:
        return None
    length = max(len(x) for _, x in found)
    x, mask = np.zeros((len(found), length, FEATURES)), np.zeros((len(found), length), bool)
    for i, (_, own) in enumerate(found):
        x[i, : len(own)], mask[i, : len(own)] = own, True
    spread = x[:, :, -1] > 0
    y = np.array([label for label, _ in found])[:, None] * mask * ~spread
    field = LineField()
    for turn in range(guesses):
        field.train(x, y, mask, steps if not turn else steps // 2, alone=not turn)  # later fits begin where the one before ended
        if turn + 1 < guesses:
            for i, (label, own) in enumerate(found):
                leaning = np.where(spread[i, : len(own)], -1e6, lean if label else -lean)
                y[i, : len(own)] = field.decode(own, leaning)
    return field


def spread_lines(df: DataFrame, site_col: str = "source", text_col: str = "text") -> DataFrame:
    """``key`` of the lines that stand on many sites (:func:`~.line_dedup.boilerplate`), counted over all of ``df``."""
    return cut(boilerplate(cut(occurrences(df, site_col, text_col))))


def train(df: DataFrame, labels: DataFrame, spread: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality") -> LineField | None:
    """Fit the field to a bounded sample of labelled documents (:func:`fit`); None if one of the
    qualities 0 and 1 has no document with a word. Features are computed where the documents lie."""
    marked = labels.select(F.col(label_id).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and id is not null")
    chosen = bounded_sample(marked, DOCS_PER_CLASS, SEED, 2)
    rows = with_spread(df.select(named(id_col).cast("long").alias("doc"), named(text_col).cast("binary").alias("text")), spread)
    # at most DOCS_PER_CLASS rows of each class, so small enough to broadcast
    rows = rows.join(F.broadcast(chosen), rows["doc"] == chosen["id"])
    # an id that repeats is ranked once more, and tasks keep no more rows than the bound
    rank = F.row_number().over(Window.partitionBy("label").orderBy("doc", F.xxhash64("text")))
    rows = rows.withColumn("n", rank).where(F.col("n") <= DOCS_PER_CLASS).drop("n")
    bound_batches(df.sparkSession)
    tell = _teller(rows, spread)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told = tell()
        for batch in batches:
            out = []
            for doc, text, label, marks in zip(batch["doc"], batch["text"], batch["label"], batch["spread"]):
                _, lines, dup = measure(text or b"")
                x, _ = line_features(lines, dup, told(lines, marks))
                first = zlib.crc32(str(doc).encode()) % max(1, len(x) - TRAIN_LINES + 1)
                out.append((doc, label, np.array(x[first : first + TRAIN_LINES], np.float64).tobytes()))
            yield pd.DataFrame(out, columns=["doc", "label", "x"])

    found = rows.select("doc", "text", "label", "spread").mapInPandas(measured, "doc long, label int, x binary").collect()
    order = sorted(found, key=lambda r: (r["doc"], r["label"], r["x"]))
    return fit([(r["label"], np.frombuffer(r["x"]).reshape(-1, FEATURES)) for r in order if r["x"]])


def with_spread(rows: DataFrame, spread: DataFrame | None, most: int = BROADCAST_LINES) -> DataFrame:
    """``rows(.., text)`` with ``spread``, the places of its lines that are among the hashes: null while
    these are few enough to go to every task (:func:`_teller`), else by a join of hashes."""
    if spread is None or spread.count() <= most:
        return rows.withColumn("spread", F.lit(None).cast("array<int>"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    lines = rows.select("row", F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("at", "line"))
    places = lines.select("row", "at", line_key(F.col("line")).alias("key")).join(spread, "key", "left_semi").groupBy("row").agg(F.collect_list("at").alias("spread"))
    return rows.join(places, "row", "left").drop("row").withColumn("spread", F.coalesce("spread", F.array().cast("array<int>")))


def _teller(rows: DataFrame, spread: DataFrame | None, most: int = BROADCAST_LINES):
    """What makes, in a task, the function from lines and places to a flag for each line."""
    few = spread is not None and spread.count() <= most
    shared = rows.sparkSession.sparkContext.broadcast(frozenset(bytes(r["key"]) for r in spread.collect()) if few else frozenset())

    def start():
        known = Spread(shared.value)

        def told(lines: list[bytes], places) -> list[bool]:
            if places is not None:
                held = set(places)
                return [i in held for i in range(len(lines))]
            return [known(x) for x in lines]

        return told

    return start


def quality(df: DataFrame, field: LineField | None, spread: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", share: float = CONTENT_SHARE) -> DataFrame:
    """One row per input row: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, content_share, n_lines, n_content``.

    The field labels every line with a word of every whole text; ``content_share`` is the share of
    the words in content lines, ``n_content`` the number of these among ``n_lines``. Texts are read
    where they lie; nothing is shuffled while the spread lines' hashes fit their bound. A null,
    empty or blank text has no words, fails the base rules and is not kept. A null id stays null,
    repeated rows are repeated, extra columns are ignored, an empty table gives no rows. Without a
    field the base rules decide.
    """
    bound_batches(df.sparkSession)
    rows = with_spread(df.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("binary").alias("text")), spread)
    tell = _teller(rows, spread)
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, n_lines long, n_content long"
    held = to_arrow_schema(StructType.fromDDL(schema))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = tell()
        for batch in batches:
            docs, texts, marks = batch.columns
            for a, b in slices(texts):
                rows = []
                for doc, text, places in zip(*(c.slice(a, b - a).to_pylist() for c in (docs, texts, marks))):
                    base, lines, dup = measure(text or b"")
                    x, words = line_features(lines, dup, told(lines, places) if field is not None else [False] * len(lines))
                    labels = field.decode(np.array(x)) if field is not None and x else [CONTENT] * len(x)
                    part = sum(n for n, label in zip(words, labels) if label == CONTENT) / sum(words) if words else 0.0
                    failed = base.failed
                    rows.append((doc, base.n_words, base.word_chars, base.n_symbols, base.n_dup_lines, base.n_repeat_words, failed, not failed and part >= share, part, len(x), sum(labels)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), held)], schema=held)

    return rows.select("doc_id", "text", "spread").mapInArrow(measured, schema)
