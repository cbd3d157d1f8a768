"""Personal data: validated values are replaced by format-preserving Feistel pseudonyms."""

from __future__ import annotations

import bisect
import calendar
import collections
import functools
import hashlib
import itertools
import math
import re

from pyspark.sql import DataFrame

from .common import map_texts

ROUNDS = 8
KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "date")
FIRST_YEAR, LAST_YEAR = 1900, 2099

_TEXT = re.compile(r"[0-9@]")
_EMAIL = re.compile(r"(?a)(?<![\w.+-])[A-Za-z0-9](?:[\w.+-]{0,62}[A-Za-z0-9_])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w-])")
_NUMBER = re.compile(
    r"""(?ax)
    (?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\ ?[A-Z0-9]{4}){2,7}(?:\ ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
    |(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9]))
    |(?P<date>(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![\w/-]|\.[0-9]))
    |(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
    |(?P<phone>(?<![\w+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\)\ ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\w]|[.-][0-9]))
    |(?P<card>(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w]|[.-][0-9]))
    """
)


def permute(n: int, size: int, tweak: str, key: bytes) -> int:
    """A keyed permutation of 0..size-1: a Feistel network over two digits of nearly equal radix,
    walked on while it leaves the range. On a few values it is a small table by nature: a one-letter
    name becomes one of 26."""
    if size < 2:
        return n
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    while True:
        left, right = divmod(n, b)
        for i in range(ROUNDS):
            h = hashlib.blake2b(f"{tweak}:{size}:{i}:{left if i % 2 else right}".encode(), key=key[:64], digest_size=32)
            f = int.from_bytes(h.digest(), "big")
            if i % 2:
                right = (right + f) % b
            else:
                left = (left + f) % a
        n = left * b + right
        if n < size:
            return n


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _refill(shape: str, digits: str) -> str:
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _mixed(text: str, tweak: str, key: bytes) -> str:
    """Permute letters within their case and digits, leaving all else."""
    radix = [26 if c.isalpha() else 10 if c.isdigit() else 1 for c in text]
    base = [ord("a") if c.islower() else ord("A") if c.isalpha() else ord("0") if c.isdigit() else ord(c) for c in text]
    n, size = 0, 1
    for c, r, b in zip(text, radix, base):
        n, size = n * r + ord(c) - b, size * r
    n, out = permute(n, size, tweak + ":" + "".join(map(str, radix)), key), []
    for r, b in zip(reversed(radix), reversed(base)):
        n, digit = divmod(n, r)
        out.append(chr(b + digit))
    return "".join(reversed(out))


def _email(text: str, key: bytes) -> str:
    local, _, host = text.rpartition("@")
    name, dot, top = host.rpartition(".")
    return f"{_mixed(local, 'local', key)}@{'.'.join(_mixed(x, 'host', key) for x in name.split('.'))}{dot}{top}"


def _card(text: str, key: bytes) -> str | None:
    d = _digits(text)
    if not luhn(d) or len(set(d)) == 1:
        return None
    body = str(permute(int(d[:-1]), 10 ** (len(d) - 1), "card", key)).zfill(len(d) - 1)
    return _refill(text, body + next(x for x in "0123456789" if luhn(body + x)))


def _ssn(text: str, key: bytes) -> str | None:
    area, group, serial = (int(x) for x in text.split("-"))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    areas = [*range(1, 666), *range(667, 900)]
    n = permute((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, len(areas) * 99 * 9999, "ssn", key)
    n, serial = divmod(n, 9999)
    area, group = divmod(n, 99)
    return f"{areas[area]:03}-{group + 1:02}-{serial + 1:04}"


def _phone(text: str, key: bytes) -> str | None:
    d = _digits(text)
    if not 9 <= len(d) <= 15:
        return None
    keep = len(re.match(r"\+?([0-9]*)", text)[1]) if text.startswith("+") else 0
    keep = keep if keep <= 3 else 0  # the country's code stays
    own = d[keep:]
    return _refill(text, d[:keep] + str(permute(int(own), 10 ** len(own), f"phone:{keep}", key)).zfill(len(own)))


def _ip(text: str, key: bytes) -> str | None:
    parts = text.split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
        return None
    n = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip", key)
    return ".".join(map(str, n.to_bytes(4, "big")))


def _iban(text: str, key: bytes) -> str | None:
    bare = text.replace(" ", "")

    def rest(country: str, check: str, body: str) -> int:
        return int("".join(str(int(c, 36)) for c in body + country + check)) % 97

    if not 15 <= len(bare) <= 34 or rest(bare[:2], bare[2:4], bare[4:]) != 1:
        return None
    body = _mixed(bare[4:], "iban" + bare[:2], key)
    new = bare[:2] + f"{98 - rest(bare[:2], '00', body):02}" + body
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in text)


@functools.cache
def _days(leap: bool, widths: tuple[int, int], order: str) -> tuple[list[tuple[int, int]], dict[tuple[int, int], int]]:
    """The pairs of numbers that a date of a year can be written with in two fields of these widths (a
    field of one digit holds 1 to 9), and their places. ``order``: "md", "dm", or "any" where either reads."""
    year = 2000 if leap else 1999
    last = [0, *(calendar.monthrange(year, m)[1] for m in range(1, 13))]

    def valid(m: int, d: int) -> bool:
        return 1 <= m <= 12 and 1 <= d <= last[m]

    most = [9 if w == 1 else 31 for w in widths]
    found = [(a, b) for a in range(1, most[0] + 1) for b in range(1, most[1] + 1) if (order != "dm" and valid(a, b)) or (order != "md" and valid(b, a))]
    return found, {x: i for i, x in enumerate(found)}


@functools.cache
def _years(widths: tuple[int, int], order: str) -> list[int]:
    """Dates before each year from FIRST_YEAR on, and of all years."""
    sizes = [len(_days(calendar.isleap(y), widths, order)[0]) for y in range(FIRST_YEAR, LAST_YEAR + 1)]
    return list(itertools.accumulate(sizes, initial=0))


def _date(text: str, key: bytes) -> str | None:
    """Dates are permuted among all strings of their written shape (the mark, which field is the
    year, the other fields' widths) that are dates, so no two of a shape become the same. Where
    day and month can't be told apart (slashes, year last) a string counts that is a date either way."""
    mark = next(c for c in text if not c.isdigit())
    parts = text.split(mark)
    ahead = len(parts[0]) == 4
    year, pair = int(parts[0] if ahead else parts[2]), parts[1:] if ahead else parts[:2]
    order = "md" if ahead else "any" if mark == "/" else "dm"
    widths = (len(pair[0]), len(pair[1]))
    if not FIRST_YEAR <= year <= LAST_YEAR:
        return None
    at = _days(calendar.isleap(year), widths, order)[1].get((int(pair[0]), int(pair[1])))
    if at is None:
        return None
    before = _years(widths, order)
    n = permute(before[year - FIRST_YEAR] + at, before[-1], f"date:{mark}:{ahead}:{widths}", key)
    y = bisect.bisect_right(before, n) - 1
    new = _days(calendar.isleap(FIRST_YEAR + y), widths, order)[0][n - before[y]]
    fields = [f"{x:0{w}}" for x, w in zip(new, widths)]
    return mark.join([str(FIRST_YEAR + y), *fields] if ahead else [*fields, str(FIRST_YEAR + y)])


REPLACE = {"email": _email, "iban": _iban, "card": _card, "ssn": _ssn, "phone": _phone, "ip": _ip, "date": _date}


def pseudonymise(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with its personal values replaced, and ``(start, end, kind)`` of the originals."""
    if not _TEXT.search(text):
        return text, []
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        found += [(*m.span(), "email", _email(m[0], key)) for m in _EMAIL.finditer(text)]
    taken = [(a, b) for a, b, _, _ in found]  # in order and apart
    at = next_taken = 0
    while m := _NUMBER.search(text, at):
        kind = m.lastgroup
        while next_taken < len(taken) and taken[next_taken][1] <= m.start():
            next_taken += 1
        new = None if next_taken < len(taken) and taken[next_taken][0] < m.end() else REPLACE[kind](m[0], key)
        if new is None:  # look again from within: what failed may hold another kind
            step = re.compile(r"[A-Za-z0-9]+").match(text, m.start())
            at = max(m.start() + 1, step.end() if step else 0)
            continue
        found.append((*m.span(), kind, new))
        at = m.end()
    out, last = [], 0
    for a, b, _, new in sorted(found):
        out += [text[last:a], new]
        last = b
    return "".join([*out, text[last:]]), [(a, b, k) for a, b, k, _ in sorted(found)]


def pseudonymise_documents(df: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, text, n_email, n_iban, n_card, n_ssn, n_phone, n_ip,
    n_date, spans``; spans are kind:start:end in the original text, code points, end exclusive.

    Values count only where they are valid: card numbers and IBANs by their check digits, social
    security numbers by their ranges, addresses by their octets, dates by the calendar. A value's
    pseudonym has its format, is valid again and depends on the value and the key alone, so equal
    strings stay equal across documents (so not an address in other cases, nor a day in another shape) and different ones of a format stay different. Texts are
    read where they lie. A null text stays null, without spans; a null id stays null, repeated rows
    are repeated, extra columns are ignored and an empty table gives no rows.
    """

    def replaced(doc: int | None, text: str | None) -> list[tuple]:
        new, spans = pseudonymise(text, key) if text is not None else (None, [])
        counts = collections.Counter(k for _, _, k in spans)
        return [(doc, new, *(counts[k] for k in KINDS), ",".join(f"{k}:{a}:{b}" for a, b, k in spans))]

    return map_texts(df, id_col, text_col, "doc_id long, text string, " + ", ".join(f"n_{k} long" for k in KINDS) + ", spans string", lambda: replaced)
