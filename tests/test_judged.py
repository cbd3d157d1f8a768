"""Links judged by native expressions and in Python."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmine.functions.robots import parse_robots
from quillmine.functions.urls import _or_none, normalize
from quillmine.plans import crawl

ROBOTS = "User-agent: *\nDisallow: /docs/x\nAllow: /docs/x/y\nDisallow: /*.pdf$\nDisallow: /*?a=\n"
OPTIONS = [
    crawl.CrawlOptions("https://h.org/docs/"), crawl.CrawlOptions("https://h.org/docs"), crawl.CrawlOptions("http://h.org:8080/", robots=parse_robots(ROBOTS)),
    crawl.CrawlOptions("https://h.org/docs/", include=["/docs/**", "!**/z.html"], exclude=["**/private/**", "/docs/x*"], robots=parse_robots(ROBOTS)), crawl.CrawlOptions("https://h.org/", exclude=["/[a-c]/**"]),
    crawl.CrawlOptions("https://h.org/", robots=parse_robots("User-agent: *\n" + "\n".join(f"Disallow: /docs/{i}" for i in range(200)))),
]


def some_urls(n):
    draw = random.Random(8)
    part = lambda: draw.choice(["docs", "x", "y", "private", "z.html", "index.html", "a.pdf", "1", "A_b-c"] if draw.random() < 0.85 else ["b~", "é", "%41", "..", ".", ""])
    made = []
    for _ in range(n):
        path = "/".join(part() for _ in range(draw.randrange(5)))
        query = "&".join(draw.choice(["a=1", "b=", "utm_source=q", "ref=1", "z=1&a=2"] if draw.random() < 0.85 else ["b", "c=x y", "é=1", "k=v=w", "%41=b", ""]) for _ in range(draw.randrange(4)))
        made.append(draw.choice(["https://h.org", "https://H.org:443", "http://h.org:8080", "http://h.org:80", "https://other.org", "HTTPS://h.org", "https://u@h.org", "https://h.org:99999"]) + draw.choice(["/", "/docs/"]) + path + (f"?{query}" if query else draw.choice(["", "?"])) + draw.choice(["", "#top", "#a b"]))
    return [*made, None, "", "mailto:x@y", "/docs", "https://", "ftp://h.org/x", "https://h.org", "https://h.org?", "https://h.org/docs/?b=2&a=1&b=1#x"]


@pytest.mark.parametrize("number", range(len(OPTIONS)))
def test_judged(spark, number):
    o = OPTIONS[number]
    urls = some_urls(600)
    got = spark.createDataFrame(list(enumerate(urls)), "i int, u string").select("i", F.col("u").rlike(crawl.PLAIN).alias("plain"), crawl.judged(F.col("u"), o).alias("j")).orderBy("i").collect()
    for r, u in zip(got, urls):
        norm = None if u is None else _or_none(normalize, u, o.base_url)
        assert (r["j"]["url"], r["j"]["accepted"]) == (norm, None if norm is None else crawl.accepts(norm, o)), u
    assert sum(bool(r["plain"]) for r in got) > 100 and (number < 2 or pd.Series([r["j"]["accepted"] for r in got]).nunique() == 2)
