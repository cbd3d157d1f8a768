"""Sitemaps of many sites at once against following one site's by itself."""

from quillmine.sources.fetch import table_source
from quillmine.sources.sitemap import load_sitemap, sitemap_urls

A, B = "https://a.org", "https://b.org"


def urlset(*urls):
    return "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"


def index(*urls):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>"


STORED = {
    f"{A}/sitemap.xml": index(f"{A}/1.xml", f"{A}/2.xml", f"{A}/sitemap.xml", f"{A}/gone.xml"), f"{A}/1.xml": urlset(f"{A}/p", f"{A}/q", f"{A}/p"), f"{A}/2.xml": index(f"{A}/3.xml", f"{A}/1.xml"),
    f"{A}/3.xml": urlset(f"{A}/r", "ftp://a.org/x"), f"{B}/sitemap.xml": index(*(f"{B}/{i}.xml" for i in range(20))), f"{B}/extra.xml": urlset(f"{B}/e"), f"{B}/sitemap_index.xml": "<html>no sitemap</html>",
    **{f"{B}/{i}.xml": urlset(f"{B}/p{i}") for i in range(20)},
}


def test_many_sites(spark):
    source = table_source(spark.createDataFrame(list(STORED.items()), "url string, html string"))
    declared = {A: [], B: [f"{B}/extra.xml", f"{B}/extra.xml"], "https://c.org": []}
    rows = [(s, u, i) for s, more in declared.items() for i, u in enumerate([*more, f"{s}/sitemap.xml", f"{s}/sitemap_index.xml"])]
    got = sitemap_urls(spark.createDataFrame(rows, "site string, url string, ord int"), source).collect()
    want = {(s, u) for s, more in declared.items() for u in load_sitemap(s, lambda url: STORED.get(url, ""), more)}
    assert {(r["site"], r["url"]) for r in got} == want and len(got) == len(want)
    assert {u for s, u in want if s == A} == {f"{A}/p", f"{A}/q", f"{A}/r"} and len([1 for s, _ in want if s == B]) == 6  # eight documents: five of twenty parts


def test_no_sites(spark):
    source = table_source(spark.createDataFrame([], "url string, html string"))
    assert sitemap_urls(spark.createDataFrame([], "site string, url string, ord int"), source).count() == 0
