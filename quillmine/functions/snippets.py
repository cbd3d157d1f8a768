"""What a hit shows: prose, code blocks and tables of its text, and the window around its matches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.fts import Phrase
from ..operators.index import _fold

DESCRIPTION_LENGTH = 400
WINDOW_TOKENS = 32
PARTS = "struct<description:string,code_blocks:array<struct<language:string,code:string>>,tables:array<struct<headers:array<string>,rows:array<array<string>>>>>"

_HEADING = re.compile(r"#{1,6}\s+.*$")
_FENCE = "```"


def clip(text: str, length: int = DESCRIPTION_LENGTH) -> str:
    flat = " ".join(text.split())
    return flat[:length] + "..." if len(flat) > length else flat


def pipe_cells(line: str) -> list[str] | None:
    """The cells of a line that begins and ends with a pipe."""
    line = line.strip()
    if len(line) < 2 or line[0] != "|" or line[-1] != "|":
        return None
    return [cell.strip() for cell in line[1:-1].split("|")]


def draws_rule(cells: list[str] | None) -> bool:
    """Whether cells draw the line under a header: dashes, a colon at either end allowed."""
    dashes = [cell.removeprefix(":").removesuffix(":") for cell in cells or [""]]
    return all(d and not d.strip("-") for d in dashes)


def table(lines: list[str]) -> dict | None:
    """Lines of a header, a rule and more as a table; lines without pipes among them are passed over."""
    header, rule, *rest = [pipe_cells(line) for line in lines] + [None, None]
    if len(rest) < 3 or header is None or not draws_rule(rule):
        return None
    return {"headers": header, "rows": [row for row in rest if row is not None]}


def _prose(lines: list[str]) -> str:
    """A paragraph's text without its headings."""
    bare = (line.strip() for line in lines)
    return clip(" ".join(line for line in bare if line and not _HEADING.match(line)))


def snippet_parts(markdown: str | None) -> dict:
    """The first prose paragraph (clipped), the fenced code blocks and the pipe tables, read line by line.

    A fence takes its lines out of the paragraph around it, which goes on behind it; one that nothing closes is prose. A text
    without any mark of these is prose as a whole.
    """
    out = {"description": "", "code_blocks": [], "tables": []}
    lines = (markdown or "").split("\n")
    if not any(line.startswith("#") or _FENCE in line or "|" in line for line in lines):
        return out | {"description": clip(markdown or "")}
    closing = [i for i, line in enumerate(lines) if line.endswith(_FENCE)]
    paragraph, code, language = [], None, None
    for i, line in enumerate([*lines, ""]):
        if code is not None:  # within a fence
            if line.endswith(_FENCE):
                out["code_blocks"].append({"language": language, "code": "\n".join([*code, line.removesuffix(_FENCE)]).strip()})
                code = None
            else:
                code.append(line)
        elif line.startswith(_FENCE) and closing and closing[-1] > i:
            code, language = [], line.removeprefix(_FENCE).strip() or None
        elif line:
            paragraph.append(line)
        else:  # a paragraph's end
            text = "\n".join(paragraph).strip()
            found = table(text.split("\n")) if text else None
            if found:
                out["tables"].append(found)
            elif not out["description"]:
                out["description"] = _prose(paragraph)
            paragraph = []
    return out


def parts_of(markdown: Column) -> Column:
    """:func:`snippet_parts` over Arrow batches; apply it after the last limit."""

    def batch(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([snippet_parts(t) for t in texts], columns=["description", "code_blocks", "tables"])

    return F.pandas_udf(batch, PARTS)(markdown)


def token_spans(text: str, folded: bool) -> list[tuple[str, int, int]]:
    """``(token, start, end)`` in the text."""
    out: list[tuple[str, int, int]] = []
    run, start = "", None
    for i, c in enumerate(text + " "):
        f = _fold(c)
        if f == " ":
            if start is not None and run:
                out.append((run, start, i))
            run, start = "", None
        else:
            start = i if start is None else start
            run += f if folded or f == "" and start == i else c.lower()
    return out


def snippet(text: str, phrases: list[Phrase], tokens: int = WINDOW_TOKENS, folded: bool = False, marks: tuple[str, str, str] = ("<<", ">>", "...")) -> str:
    """A window of the text's tokens with the phrases' matches marked.

    The window with the most different phrases wins, then the one with the most matches, then the
    first; matches stand in its middle where the text allows. Without a match the text's start is
    shown unmarked. Dots stand where the text goes on.
    """
    spans = token_spans(text, folded)
    words = [s[0] for s in spans]
    hits: list[tuple[int, int, int]] = []  # start token, end token, phrase
    for k, p in enumerate(phrases):
        n = len(p.terms)
        for i in range(len(words) - n + 1 if n and 0 in p.columns else 0):
            same = words[i : i + n - 1] == p.terms[:-1]
            last = words[i + n - 1].startswith(p.terms[-1]) if p.prefix else words[i + n - 1] == p.terms[-1]
            if same and last and (not p.initial or i == 0):
                hits.append((i, i + n, k))
    hits.sort()
    best, found = (0, 0), None
    for at, (first, _, _) in enumerate(hits):
        inside = [h for h in hits[at:] if h[0] >= first and h[1] <= first + tokens]
        score = (len({h[2] for h in inside}), len(inside))
        if score > best:
            best, found = score, (first, max([h[1] for h in inside], default=first))
    begin = 0
    if found:
        begin = max(0, min(found[0] - (tokens - (found[1] - found[0])) // 2, len(words) - tokens))
    end = min(len(words), begin + tokens)
    if not words:
        return text
    at = spans[begin][1] if begin else 0
    stop = spans[end - 1][2] if end < len(words) else len(text)
    merged: list[list[int]] = []
    for a, b, _ in (h for h in hits if h[0] >= begin and h[1] <= end):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out = [marks[2]] if begin else []
    for a, b in merged:
        out += [text[at : spans[a][1]], marks[0], text[spans[a][1] : spans[b - 1][2]], marks[1]]
        at = spans[b - 1][2]
    return "".join([*out, text[at:stop], *([marks[2]] if end < len(words) else [])])


def snippet_of(text: Column, phrases: list[Phrase], folded: bool = False) -> Column:
    """:func:`snippet` over Arrow batches."""

    def batch(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: snippet(t or "", phrases, folded=folded))

    return F.pandas_udf(batch, "string")(text)
