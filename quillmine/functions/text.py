"""Scalar text functions as Column expressions. Lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as scripts for the web know it, beyond the ASCII class.
WHITE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NOT_CJK = r"[^\x{3000}-\x{9FFF}\x{A000}-\x{A4CF}\x{F900}-\x{FAFF}\x{20000}-\x{2FFFF}]"
DESCRIPTION_LENGTH = 400


def trimmed(s: Column) -> Column:
    return F.regexp_replace(s, f"^{WHITE}+|{WHITE}+$", "")


def collapsed(s: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return trimmed(F.regexp_replace(s, f"{WHITE}+", " "))


def token_count(s: Column) -> Column:
    """An estimate of tokens: a quarter of the UTF-8 bytes, or the CJK characters if they are more."""
    s = F.coalesce(s, F.lit(""))
    return F.ceil(F.greatest(F.octet_length(s) / F.lit(4.0), F.length(F.regexp_replace(s, NOT_CJK, "")).cast("double"))).cast("long")


def utf8_size(s: Column) -> Column:
    return F.octet_length(s).cast("long")


def content_hash(s: Column) -> Column:
    return F.sha2(s, 256)


def text_length(html: Column) -> Column:
    """Characters of text in markup: tags are spaces, white space collapses."""
    return F.length(collapsed(F.regexp_replace(html, "<[^>]+>", " "))).cast("long")


def count_tables(html: Column) -> Column:
    return F.regexp_count(html, F.lit(r"(?i)<table[\s>]")).cast("long")


def rewrap_orphan_rows(html: Column) -> Column:
    """Runs of table rows inside a table of their own."""
    return F.regexp_replace(html, r"(?is)((?:<tr\b.*?</tr>\s*)+)", "<table><tbody>$1</tbody></table>")


def clip_description(s: Column, length: int = DESCRIPTION_LENGTH) -> Column:
    flat = collapsed(s)
    return F.when(F.length(flat) > length, F.concat(F.substring(flat, 1, length), F.lit("..."))).otherwise(flat)


def snippet_fallback(s: Column, length: int = 200) -> Column:
    return F.substring(s, 1, length)


def split_cells(row: Column) -> Column:
    """Cells of a table row in pipes."""
    bare = F.regexp_replace(F.regexp_replace(row, r"^\|", ""), r"\|\s*$", "")
    return F.transform(F.split(bare, r"\|"), trimmed)


def truncated(s: Column, length: int) -> tuple[Column, Column]:
    """The first ``length`` characters, and whether more follow."""
    return F.substring(s, 1, length), F.length(s) > length


def truncate_utf8(s: Column, size: int) -> Column:
    """The longest prefix of whole characters in ``size`` bytes."""
    head = F.substring(s.cast("binary"), 1, size)
    # a cut character's first bytes go with it
    kept = F.regexp_replace(F.hex(head), r"(?:C[0-9A-F]|D[0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-7](?:[89AB][0-9A-F]){0,2})$", "")
    aligned = F.when(F.length(kept) % 2 == 0, kept).otherwise(F.hex(head))
    return F.when(F.octet_length(s) <= size, s).otherwise(F.decode(F.unhex(aligned), "UTF-8"))


def html_title(html: Column) -> Column:
    """The title element's text, else the first h1's, by pattern; null if there is neither."""

    def first(tag: str) -> Column:
        found = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
        return trimmed(F.regexp_replace(found, "<[^>]+>", ""))

    title, h1 = first("title"), first("h1")
    return F.when(title != "", title).when(html.rlike(r"(?is)<h1\b[^>]*>.*?</h1>"), h1)


def html_links(html: Column) -> Column:
    """Raw href values of all links, by pattern."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']+)["']"""), F.lit(1))


def iso_time(milliseconds: Column) -> Column:
    """Milliseconds since 1970 as ISO 8601 in UTC, with three digits of the second."""
    seconds = F.timestamp_millis(milliseconds)
    return F.date_format(F.to_utc_timestamp(seconds, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
