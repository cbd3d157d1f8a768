"""Sitemaps: parsing, gzip, and following an index."""

from __future__ import annotations

import gzip
from collections.abc import Callable, Iterable
from urllib.parse import urlsplit
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut

FOLLOW = 8
SITEMAP = "struct<urls:array<string>,sitemaps:array<string>>"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def parse_sitemap(xml: str | None) -> dict:
    """``urls`` of a urlset or ``sitemaps`` of an index, http(s) only, in order, each once; a text
    that is no such XML has neither. A document type is refused, so nothing expands."""
    out: dict[str, list[str]] = {"urls": [], "sitemaps": []}
    if not xml or "<!DOCTYPE" in xml:
        return out
    try:
        root = ElementTree.fromstring(xml.strip().encode())
    except (ElementTree.ParseError, ValueError):
        return out
    place = {"urlset": ("urls", "url"), "sitemapindex": ("sitemaps", "sitemap")}.get(_local(root.tag))
    if place:
        locs = ((x.text or "").strip() for e in root if _local(e.tag) == place[1] for x in e if _local(x.tag) == "loc")
        out[place[0]] = list(dict.fromkeys(x for x in locs if x.startswith(("http://", "https://"))))
    return out


def is_gzip(url: str) -> bool:
    return urlsplit(url).path.lower().endswith(".gz")


def inflate(body: bytes) -> str:
    """A gzipped sitemap's text; "" if it is damaged."""
    try:
        return gzip.decompress(body).decode("utf-8", "replace")
    except (OSError, EOFError, ValueError):
        return ""


def sitemaps_of(xml: Column) -> Column:
    """:func:`parse_sitemap` over Arrow batches."""

    def batch(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_sitemap(t) for t in texts], columns=["urls", "sitemaps"])

    return F.pandas_udf(batch, SITEMAP)(xml)


def load_sitemap(base: str, read: Callable[[str], str], declared: Iterable[str] = (), follow: int = FOLLOW) -> list[str]:
    """All URLs of the declared and the usual sitemaps of a site, in order, each once; at most
    ``follow`` documents are read, failures included. ``read`` gives a document's text or ""."""
    split = urlsplit(base)
    origin = f"{split.scheme}://{split.netloc}"
    queue = list(dict.fromkeys([*declared, f"{origin}/sitemap.xml", f"{origin}/sitemap_index.xml"]))
    seen: set[str] = set()
    found: dict[str, None] = {}
    while queue and len(seen) < follow:
        url = queue.pop(0)
        if url in seen:
            continue
        seen.add(url)
        parsed = parse_sitemap(read(url))
        found |= dict.fromkeys(parsed["urls"])
        queue += parsed["sitemaps"]
    return list(found)


def sitemap_urls(roots: DataFrame, source: Callable[[DataFrame], DataFrame], follow: int = FOLLOW) -> DataFrame:
    """``site, url``, each once, of the sitemaps of many sites: ``roots(site, url, ord)`` and what they point to.

    All sites' documents of a level are read together through the page ``source`` and parsed where they lie. Of a
    site at most ``follow`` documents are read, failures included, in the order of their first mention level by level; one document
    read for one site isn't read for it again. A document that fails, or is no sitemap, has no URLs.
    """
    order = F.row_number().over(Window.partitionBy("site").orderBy("turn", "url"))
    level = roots.groupBy("site", "url").agg(F.min(F.struct(F.lit(0).cast("long").alias("parent"), F.col("ord").cast("long").alias("at"))).alias("turn"))
    level = cut(level.withColumn("nth", order.cast("long")).where(F.col("nth") <= follow))
    seen, found = level, []
    while not level.isEmpty():
        bodies = source(level.select("url").distinct()).select("url", F.when(F.col("status") == 200, F.col("body")).alias("body"))
        read = cut(level.join(bodies, "url").select("site", "nth", sitemaps_of(F.col("body")).alias("x")))
        found.append(read.select("site", F.explode("x.urls").alias("url")))
        more = read.select("site", "nth", F.posexplode("x.sitemaps").alias("at", "url"))
        more = more.groupBy("site", "url").agg(F.min(F.struct(F.col("nth").alias("parent"), F.col("at").cast("long").alias("at"))).alias("turn"))
        more = more.join(seen.select("site", "url"), ["site", "url"], "left_anti")
        used = seen.groupBy("site").agg(F.count(F.lit(1)).alias("used"))
        level = cut(more.join(used, "site").withColumn("nth", order + F.col("used")).where(F.col("nth") <= follow).drop("used"))
        seen = seen.unionByName(level)
    every = found[0] if found else roots.select("site", "url").where("false")
    for x in found[1:]:
        every = every.unionByName(x)
    return every.distinct()
