"""The full-text query language: parsing, and matching as one DataFrame plan.

Grammar, loosest first: OR, AND, NOT, then juxtaposition of phrases (implicit AND). A phrase is
words or quoted strings joined by ``+``, with ``*`` after it for a prefix and ``^`` before it for a
column's start. ``NEAR(p q, n)`` wants its phrases within n tokens. ``col:``, ``{a b}:`` and their
negations with ``-`` restrict a phrase or a parenthesis to columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import COLUMNS, TextIndex, query_tokens

K1, B = 1.2, 0.75
IDF_FLOOR = 1e-6
NEAR_DISTANCE = 10


class QuerySyntaxError(ValueError):
    """The text is no query."""


@dataclass
class Phrase:
    terms: list[str]
    prefix: bool = False
    initial: bool = False
    columns: frozenset[int] = frozenset(range(len(COLUMNS)))


@dataclass
class Node:
    """``op`` is or, and, not, near or phrase; near and phrase have ``phrases``, the others ``parts``."""

    op: str
    parts: list[Node] = field(default_factory=list)
    phrases: list[Phrase] = field(default_factory=list)
    distance: int = NEAR_DISTANCE

    def leaves(self) -> list[Phrase]:
        return self.phrases + [p for x in self.parts for p in x.leaves()]

    def empty(self) -> bool:
        return self.op == "phrase" and not self.phrases[0].terms


_LEX = re.compile(r'\s*(?:(?P<quoted>"(?:[^"]|"")*")|(?P<word>[A-Za-z0-9_\x1a\x80-\U0010ffff]+)|(?P<mark>[(){}:,+*^-]))')


def _lex(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.rstrip(" \t\n\r")
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise QuerySyntaxError(f"unexpected {text[at:].lstrip()[:1]!r}")
        at = m.end()
        if m["quoted"]:
            out.append(("string", m["quoted"][1:-1].replace('""', '"')))
        elif m["word"]:
            out.append((m["word"], m["word"]) if m["word"] in ("AND", "OR", "NOT") else ("word", m["word"]))
        else:
            out.append((m["mark"], m["mark"]))
    return out


class _Parser:
    def __init__(self, text: str, tokenizer: str):
        self.items, self.at, self.tokenizer = _lex(text), 0, tokenizer

    def kind(self, ahead: int = 0) -> str:
        return self.items[self.at + ahead][0] if self.at + ahead < len(self.items) else "end"

    def take(self, *kinds: str) -> str:
        if self.kind() not in kinds:
            raise QuerySyntaxError(f"expected {' or '.join(kinds)}, found {self.kind()}")
        self.at += 1
        return self.items[self.at - 1][1]

    def parse(self) -> Node:
        out = self.chain(("OR", "AND", "NOT"))
        if self.kind() != "end":
            self.take("end")
        return out

    def chain(self, ops: tuple[str, ...]) -> Node:
        """A left-associative chain of the first operator over chains of the others."""
        if not ops:
            return self.operand()
        out = self.chain(ops[1:])
        while self.kind() == ops[0]:
            self.at += 1
            out = Node(ops[0].lower(), [out, self.chain(ops[1:])])
        return out

    def operand(self) -> Node:
        if self.kind() == "(":
            return self.group()
        columns = self.columns()
        if columns is not None and self.kind() == "(":
            return _restrict(self.group(), columns)
        found = [_restrict(self.near(), columns)]
        while self.kind() in ("word", "string", "^", "{", "-"):
            columns = self.columns()
            found.append(_restrict(self.near(), columns))
        if self.kind() == "(":
            raise QuerySyntaxError("a parenthesis needs an operator before it")
        found = [x for x in found if not x.empty()] or found[:1]
        return found[0] if len(found) == 1 else Node("and", found)

    def group(self) -> Node:
        self.take("(")
        out = self.chain(("OR", "AND", "NOT"))
        self.take(")")
        return out

    def columns(self) -> frozenset[int] | None:
        """A column filter with its colon, if one stands here."""
        start, negated = self.at, self.kind() == "-"
        self.at += negated
        if self.kind() == "{":
            self.at += 1
            names = []
            while self.kind() in ("word", "string"):
                names.append(self.take("word", "string"))
            self.take("}")
            if not names:
                raise QuerySyntaxError("no column")
        elif self.kind() in ("word", "string") and self.kind(1) == ":":
            names = [self.take("word", "string")]
        elif negated:
            raise QuerySyntaxError("expected a column")
        else:
            self.at = start
            return None
        self.take(":")
        unknown = [n for n in names if n.lower() not in COLUMNS]
        if unknown:
            raise QuerySyntaxError(f"no such column: {unknown[0]}")
        found = frozenset(COLUMNS.index(n.lower()) for n in names)
        return frozenset(range(len(COLUMNS))) - found if negated else found

    def near(self) -> Node:
        if self.kind() == "word" and self.kind(1) == "(":
            if self.take("word") != "NEAR":
                raise QuerySyntaxError("only NEAR takes a parenthesis")
            self.take("(")
            phrases = []
            while self.kind() in ("word", "string") or not phrases:
                phrases.append(self.phrase(may_begin=False))
            distance = NEAR_DISTANCE
            if self.kind() == ",":
                self.at += 1
                number = self.take("word", "string")
                if not re.fullmatch("[0-9]+", number):
                    raise QuerySyntaxError("NEAR wants a number")
                distance = int(number)
            self.take(")")
            phrases = [p for p in phrases if p.terms] or phrases[:1]
            return Node("near", phrases=phrases, distance=distance) if len(phrases) > 1 else Node("phrase", phrases=phrases)
        return Node("phrase", phrases=[self.phrase()])

    def phrase(self, may_begin: bool = True) -> Phrase:
        initial = may_begin and self.kind() == "^"
        self.at += initial
        terms: list[str] = []
        while True:
            terms += query_tokens(self.take("word", "string"), self.tokenizer)
            prefix = self.kind() == "*"
            self.at += prefix
            if self.kind() != "+":
                return Phrase(terms, prefix, initial)
            if prefix:
                raise QuerySyntaxError("a prefix ends its phrase")
            self.at += 1


def _restrict(node: Node, columns: frozenset[int] | None) -> Node:
    if columns is not None:
        for p in node.leaves():
            p.columns &= columns
    return node


def parse(text: str, tokenizer: str = "native") -> Node:
    """The tree of a query; raises :class:`QuerySyntaxError`."""
    if not text.strip():
        raise QuerySyntaxError("empty query")
    return _Parser(text, tokenizer).parse()


def _starts(phrase: int, tree: Phrase, col: int) -> Column:
    """Where the phrase starts in a column, from its terms' positions."""
    slots = [F.col(f"s{phrase}_{i}_{col}") for i in range(len(tree.terms))]
    first = F.filter(slots[0], lambda p: p == 0) if tree.initial else slots[0]
    if len(slots) == 1:
        return first
    return F.filter(first, lambda p: _all([F.array_contains(s, p + i) for i, s in enumerate(slots) if i]))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out &= c
    return out


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out |= c
    return out


def near_trimmed(positions: list[list[int]], sizes: list[int], distance: int) -> list[list[int]]:
    """Of each phrase's starts in a column, those that meet the others': all starts lie so that no
    phrase ends more than ``distance`` tokens before the last one's start. One cursor per phrase
    moves on; whenever all agree their starts are kept, and the one moves on whose next start is the least."""
    at, kept = [0] * len(positions), [[] for _ in positions]
    if not all(positions):
        return kept
    while True:
        last = max(p[i] for p, i in zip(positions, at))
        settled = False
        while not settled:
            settled = True
            for k, p in enumerate(positions):
                while at[k] < len(p) and p[at[k]] < last - sizes[k] - distance:
                    at[k] += 1
                if at[k] == len(p):
                    return kept
                if p[at[k]] > last:
                    last, settled = p[at[k]], False
        for k, p in enumerate(positions):
            if not kept[k] or p[at[k]] > kept[k][-1]:
                kept[k].append(p[at[k]])
        upcoming = [(p[i + 1], k) for k, (p, i) in enumerate(zip(positions, at)) if i + 1 < len(p)]
        if not upcoming:
            return kept
        at[min(upcoming)[1]] += 1


def _trim(columns: list[Column], sizes: list[int], distance: int) -> Column:
    """:func:`near_trimmed` over Arrow batches: an array of the phrases' starts."""

    def batch(starts: pd.DataFrame) -> pd.Series:
        rows = zip(*(starts[c] for c in starts.columns))
        return pd.Series([near_trimmed([list(x) for x in row], sizes, distance) for row in rows])

    packed = F.struct(*(c.alias(f"x{i}") for i, c in enumerate(columns)))
    return F.pandas_udf(batch, "array<array<int>>")(packed)


def _nears(node: Node) -> list[Node]:
    return ([node] if node.op == "near" else []) + [x for p in node.parts for x in _nears(p)]


def _matches(node: Node, numbers: dict[int, int]) -> Column:
    """The node's truth for a row that has the phrases' starts."""
    if node.op == "phrase":
        return F.col(f"tf{numbers[id(node.phrases[0])]}") > 0
    if node.op == "near":
        return F.col(f"tf{numbers[id(node.phrases[0])]}") > 0
    parts = [_matches(x, numbers) for x in node.parts]
    if node.op == "or":
        return _any(parts)
    return _all(parts) if node.op == "and" else parts[0] & ~parts[1]


def _counted(node: Node, numbers: dict[int, int], under: Column, out: dict[int, Column]) -> dict[int, Column]:
    """For each phrase, whether all nodes above it match; what NOT takes away never counts."""
    here = under & _matches(node, numbers)
    for p in node.phrases:
        out[numbers[id(p)]] = here
    for x in node.parts[: 1 if node.op == "not" else None]:
        _counted(x, numbers, here, out)
    return out


def term_filter(phrases: list[Phrase], term: Column) -> Column:
    """Whether a term occurs in the phrases; equalities and prefixes, which reach the scan."""
    plain = sorted({t for p in phrases for t in (p.terms[:-1] if p.prefix else p.terms)})
    out = term.isin(plain) if plain else F.lit(False)
    for start in sorted({p.terms[-1] for p in phrases if p.prefix}):
        out |= term.startswith(start)
    return out


def match(index: TextIndex, query: str | Node, strict: bool = False) -> DataFrame:
    """``chunk_id, bm25``: rows that match, with their scores (negative, lower is better).

    Statistics are index-wide. A text that is no query matches nothing unless ``strict``. Only the
    query's terms' postings are read; they are grouped by chunk once, and the whole expression is
    evaluated on that row.
    """
    empty = index.lengths.select("chunk_id", F.lit(0.0).alias("bm25")).where("false")
    try:
        tree = parse(query, index.tokenizer) if isinstance(query, str) else query
    except QuerySyntaxError:
        if strict:
            raise
        return empty
    leaves = tree.leaves()
    known = [p for p in leaves if p.terms]
    if not known:
        return empty
    numbers = {id(p): i for i, p in enumerate(leaves)}

    slots = []
    for p in known:
        for j, t in enumerate(p.terms):
            here = F.col("term").startswith(t) if p.prefix and j == len(p.terms) - 1 else F.col("term") == t
            for c in sorted(p.columns):
                held = F.collect_list(F.when(here & (F.col("col") == c), F.col("positions")))
                slots.append(F.array_sort(F.flatten(held)).alias(f"s{numbers[id(p)]}_{j}_{c}"))
    if not slots:  # every phrase is kept out of every column
        return empty
    exact = None if any(p.prefix for p in known) else sorted({t for p in known for t in p.terms})
    grouped = index.of_terms(term_filter(known, F.col("term")), exact).groupBy("chunk_id").agg(*slots)
    empty_list = F.array().cast("array<int>")
    for p in leaves:
        i = numbers[id(p)]
        for c in range(len(COLUMNS)):
            grouped = grouped.withColumn(f"p{i}_{c}", _starts(i, p, c) if p.terms and c in p.columns else empty_list)
        grouped = grouped.withColumn(f"in{i}", sum((F.size(f"p{i}_{c}") for c in range(len(COLUMNS))), F.lit(0)) > 0)
    for node in _nears(tree):  # of a NEAR's phrases only what meets counts
        own = [numbers[id(p)] for p in node.phrases]
        for c in sorted(frozenset.intersection(*(p.columns for p in node.phrases))):
            met = _trim([F.col(f"p{i}_{c}") for i in own], [len(p.terms) for p in node.phrases], node.distance)
            grouped = grouped.withColumn("__met", met).withColumns({f"p{i}_{c}": F.col("__met")[k] for k, i in enumerate(own)})
    grouped = grouped.withColumns({f"tf{i}": sum((F.size(f"p{i}_{c}") for c in range(len(COLUMNS))), F.lit(0)) for i in range(len(leaves))})
    counted = _counted(tree, numbers, F.lit(True), {})
    tfs = [F.when(counted.get(i, F.lit(False)), F.col(f"tf{i}")).otherwise(0).alias(f"tf{i}") for i in range(len(leaves))]
    grouped = grouped.select("chunk_id", *(f"in{i}" for i in range(len(leaves))), *tfs, _matches(tree, numbers).alias("hit"))

    # one row: how many rows each phrase is in, next to the corpus statistics
    counts = grouped.agg(*(F.count_if(f"in{i}").alias(f"n{i}") for i in range(len(leaves))))
    stats = index.lengths.agg(F.count(F.lit(1)).alias("rows"), F.avg("length").alias("avgdl"))
    scored = grouped.where("hit").join(index.lengths, "chunk_id").crossJoin(F.broadcast(counts.crossJoin(stats)))
    score = F.lit(0.0)
    for i in range(len(leaves)):
        n, tf = F.coalesce(F.col(f"n{i}"), F.lit(0)), F.col(f"tf{i}")
        idf = F.log((F.col("rows") - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, F.lit(IDF_FLOOR)).otherwise(idf)
        score += F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("avgdl")))).otherwise(0.0)
    return scored.select("chunk_id", (-score).alias("bm25"))
