import gzip

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmine.functions import chunking, html, robots, snippets, text, urls
from quillmine.operators.fts import parse
from quillmine.sources import fetch, sitemap


def test_url_normalize():
    n = urls.normalize
    assert n("https://Example.ORG:443/a/index.html?b=2&a=1#x") == "https://example.org/a/?a=1&b=2"
    assert n("http://h.org:80/x/index.htm") == "http://h.org/x/"
    assert n("https://h.org/a?utm_source=g&keep=1&fbclid=3") == "https://h.org/a?keep=1"
    assert n("https://h.org/?utm_source=g&a=1", strip_trackers=False) == "https://h.org/?a=1&utm_source=g"
    assert n("https://h.org/docs/intro", "https://h.org/docs/") == "https://h.org/docs/intro/"
    assert n("https://h.org/docs/p.html", "https://h.org/docs/") == "https://h.org/docs/p.html"
    assert n("https://h.org/docs/intro/", "https://h.org/docs") == "https://h.org/docs/intro"
    assert n("https://h.org/l?page=2&p=3&k=y", strip_params=("page", "p")) == "https://h.org/l?k=y"
    assert n("https://h.org/p?b&a=x%20y&a=1&z=%C3%A9") == "https://h.org/p?a=x+y&a=1&b=&z=%C3%A9"
    assert n("https://h.org") == "https://h.org/"
    assert n("https://h.org/a/./b/../c") == "https://h.org/a/c"
    assert n("https://h.org:8080/x") == "https://h.org:8080/x"
    for bad in ("not-a-url", "/relative", "http://", "mailto:a@b.c", ""):
        assert urls._or_none(n, bad) is None


def test_url_predicates():
    assert urls.same_origin("https://a.b/x", "https://a.b:443/y") and not urls.same_origin("https://a.b/", "http://a.b/")
    assert not urls.same_origin("nope", "https://a.b")
    assert urls.under_base("https://a.b/docs", "https://a.b/docs/") and urls.under_base("https://a.b/docs/x", "https://a.b/docs")
    assert not urls.under_base("https://a.b/docs-old", "https://a.b/docs") and not urls.under_base("https://c.b/docs", "https://a.b/docs")


def test_globs():
    m = urls.match_patterns
    assert m("/a/b", []) and m("/a/b", None)
    assert m("/docs/api/v1", ["/docs/**"]) and not m("/blog/p", ["/docs/**"])
    assert m("/docs/a", ["/docs/*"]) and not m("/docs/a/b", ["/docs/*"])
    assert not m("/docs/private/x", ["/docs/**", "!/docs/private/**"]) and m("/docs/x", ["/docs/**", "!/docs/private/**"])
    assert not m("/docs/.git", ["/docs/*"]) and m("/docs/.git", ["/docs/.*"])
    assert urls.excluded("/private/x", ["/private/**"]) and not urls.excluded("/", ["/private/**"]) and not urls.excluded("/a", ["!/private/**"])


def test_native_urls_agree(spark):
    cases = ["https://Ex.org:443/a/index.html?b=2&a=1#f", "http://h.org/x?utm_source=1", "https://h.org", "https://h.org/d?x", "nope"]
    rows = spark.createDataFrame([(c,) for c in cases], "u string")
    got = [r["n"] for r in rows.select(urls.native_normalized(F.col("u")).alias("n")).collect()]
    assert got == [urls._or_none(urls.normalize, c) for c in cases]
    based = rows.select(urls.native_normalized(F.col("u"), "https://h.org/a/").alias("n"), urls.normalized(F.col("u"), "https://h.org/a/").alias("m")).collect()
    assert all(r["n"] == r["m"] for r in based)


def test_robots():
    r = robots.parse_robots("User-agent: *\nDisallow: /private\nAllow: /private/ok\nCrawl-delay: 2\nSitemap: https://h.org/s.xml\n\nUser-agent: quillmine\nDisallow: /q$\n")
    assert not r.allowed("https://h.org/private/x", "other") and r.allowed("https://h.org/private/ok/1", "other")
    assert r.allowed("https://h.org/private/x", "quillmine/1.0") and not r.allowed("https://h.org/q", "quillmine/1.0") and r.allowed("https://h.org/qq", "quillmine")
    assert r.delay("other") == 2 and r.sitemaps == ["https://h.org/s.xml"]
    for junk in ("", None, "garbage", "Disallow: /x"):
        assert robots.parse_robots(junk).allowed("https://h.org/x", "a")
    assert not robots.parse_robots("User-agent: *\nDisallow: /*.pdf$").allowed("https://h.org/a/b.pdf", "x")


def test_sitemaps(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    urlset = f"<?xml version='1.0'?><urlset {ns}><url><loc> https://h.org/a </loc></url><url><loc>https://h.org/a</loc></url><url><loc>ftp://h/b</loc></url></urlset>"
    index = f"<sitemapindex {ns}><sitemap><loc>https://h.org/1.xml</loc></sitemap></sitemapindex>"
    assert sitemap.parse_sitemap(urlset) == {"urls": ["https://h.org/a"], "sitemaps": []}
    assert sitemap.parse_sitemap(index) == {"urls": [], "sitemaps": ["https://h.org/1.xml"]}
    for bad in ("", None, "<urlset><url>", "hello"):
        assert sitemap.parse_sitemap(bad) == {"urls": [], "sitemaps": []}
    assert sitemap.inflate(gzip.compress(b"x")) == "x" and sitemap.inflate(b"bad") == "" and sitemap.is_gzip("https://h.org/S.XML.GZ?x")
    stored = {"https://h.org/sitemap.xml": index, "https://h.org/1.xml": urlset}
    assert sitemap.load_sitemap("https://h.org/d", lambda u: stored.get(u, "")) == ["https://h.org/a"]
    assert sitemap.load_sitemap("https://h.org/d", lambda u: stored.get(u, ""), follow=2) == []
    got = spark.createDataFrame([(urlset,)], "x string").select(sitemap.sitemaps_of(F.col("x")).alias("s")).first()["s"]
    assert got["urls"] == ["https://h.org/a"]


def test_fetch_retries():
    waits, calls = [], []
    answers = [fetch.Response(503), OSError("reset"), fetch.Response(429, {"retry-after": "2"}), fetch.Response(200, {}, "ok")]

    def get(url):
        calls.append(url)
        a = answers[len(calls) - 1]
        if isinstance(a, Exception):
            raise a
        return a

    assert fetch.fetch("u", get, sleep=waits.append).body == "ok" and waits[2] == 2 and waits[0] <= 0.5 and waits[1] <= 1
    assert fetch.fetch("u", lambda u: fetch.Response(500), retries=1, sleep=waits.append).status == 500
    assert fetch.retry_after("1.5") == 1.5 and fetch.retry_after("-1") is None and fetch.retry_after("x") is None
    assert fetch.retry_after("Thu, 01 Jan 1970 00:00:10 GMT", now=4) == 6
    data = iter([b"ab", b"cd", b""])
    assert fetch.bounded(lambda n: next(data)[:n], 3) == (b"abc", True)
    assert fetch.requests_per_second(4) == 0.25 and fetch.requests_per_second(None) == 2


def test_chunking():
    md = "intro\n\n# A\ntext\n## B\n```\n# no heading\n```\n### C\n\n#### D\nd\n##### E\ne\n# F"
    got = chunking.chunk(md)
    assert [c["heading_path"] for c in got] == ["", "A", "A > B", "A > B > C", "A > B > C > D", "F"]
    assert [c["ord"] for c in got] == list(range(6)) and "# no heading" in got[2]["text"] and "##### E" in got[4]["text"]
    assert chunking.chunk("") == chunking.chunk(None) == chunking.chunk("  \n ") == []
    long = "\n\n".join(f"paragraph {i} " + "word " * 40 for i in range(40))
    parts = chunking.chunk("# T\n" + long)
    assert len(parts) > 1 and all(p["heading_path"] == "T" for p in parts)
    assert parts[1]["text"].split("\n\n")[0] in parts[0]["text"]
    assert chunking.chunk("# T\n" + long, overlap=0)[1]["text"] in parts[1]["text"]


def test_leaf_labels():
    f = chunking.leaf_label
    assert f("- [`Name`](x) rest", "P") == "Name" and f("* `code` rest", "P") == "code" and f("plain", "P") is None and f("```\nx", "P") is None
    assert f("## P\n\n##### Sub", "A > P") == "Sub" and f("## P\nprose", "A > P") is None
    assert len(f("# " + "x" * 200, "")) == 80
    assert chunking.with_label("A", "A") == "A" and chunking.with_label("A > B", "B") == "A > B" and chunking.with_label("", "L") == "L" and chunking.with_label("A", "L") == "A > L"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["# A", "## B", "text", "", "```", "~~~", "more words here", "#### D"]), max_size=40))
def test_chunks_cover_every_line(lines):
    got = chunking.chunk("\n".join(lines), max_tokens=8, overlap=0)
    assert [c["ord"] for c in got] == list(range(len(got)))
    kept = [x.strip() for c in got for x in c["text"].split("\n") if x.strip()]
    assert kept == [x.strip() for x in lines if x.strip()]


def test_token_counts(spark):
    cases = ["", "a" * 100, "かな" * 50, "😀" * 50, None, "é"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s string")
    got = [r["n"] for r in rows.select("i", text.token_count(F.col("s")).alias("n")).orderBy("i").collect()]
    assert got == [chunking.token_count(c or "") for c in cases] == [0, 25, 100, 50, 0, 1]


def test_snippet_parts():
    p = snippets.snippet_parts
    assert p("") == p(None) == {"description": "", "code_blocks": [], "tables": []}
    assert p("plain  prose\nhere")["description"] == "plain prose here"
    assert len(p("x" * 1000)["description"]) == 403
    got = p("# Head\n\nProse one\nline two.\n\n```ts\nlet a = 1\n```\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 |\n\nlater")
    assert got["description"] == "Prose one line two."
    assert got["code_blocks"] == [{"language": "ts", "code": "let a = 1"}] and got["tables"] == [{"headers": ["a", "b"], "rows": [["1", "2"], ["3"]]}]
    assert p("```\nx\n```")["code_blocks"] == [{"language": None, "code": "x"}]
    assert p("| a |\n| 1 |\n| 2 |")["tables"] == []


def test_snippet_parts_of_fences():
    p = snippets.snippet_parts
    assert p("before\n```\nx\n```\nafter")["description"] == "before after"  # the fence leaves no word behind
    assert p("```py\nnever closed\n\n| a |")["code_blocks"] == [] and p("```py\nnever closed")["description"] == "```py never closed"
    got = p("```\na\n\n| x | y |\nb```\n\n```\n```\n\nCODE")
    assert [c["code"] for c in got["code_blocks"]] == ["a\n\n| x | y |\nb", ""] and got["tables"] == [] and got["description"] == "CODE"
    assert p("one\n\ntwo")["description"] == "one two" and p("one\n\ntwo\n\n# h")["description"] == "one"


def test_markdown_keeps_text_as_it_stands():
    """Text nodes with what Markdown would read as markup, and with the same characters where it wouldn't."""
    for said, written in {
        "# no heading": "\\# no heading", "#hash": "#hash", "> quote": "\\> quote", "a > b": "a > b", "- item": "\\- item", "-5 degrees": "-5 degrees", "+ item": "\\+ item", "+5": "+5", "1. one": "1\\. one", "2) two": "2\\) two",
        "1.5 is": "1.5 is", "===": "\\===", "---": "\\---", "~~~": "\\~\\~\\~", "~ 5": "~ 5", "a*b*": "a\\*b\\*", "2 * 3": "2 * 3", "snake_case_name": "snake_case_name", "_it_": "\\_it\\_", "a`b": "a\\`b", "[x](y)": "\\[x](y)",
        "a < b": "a < b", "&lt;b>": "\\<b>", "C:\\dir": "C:\\dir", "\\*": "\\\\\\*",
    }.items():
        assert html.html_to_markdown(f"<p>{said}</p>").strip() == written, said


def test_snippet_window():
    words = " ".join(f"w{i}" for i in range(100))
    leaves = parse("w50").leaves()
    got = snippets.snippet(words, leaves)
    assert got.startswith("...") and got.endswith("...") and "<<w50>>" in got and len(got.replace("...", " ").split()) == 32
    assert snippets.snippet("a b c", parse("b").leaves()) == "a <<b>> c"
    assert snippets.snippet("a b c", parse("zzz").leaves()) == "a b c"
    assert snippets.snippet("a b c d", parse('"b c"').leaves()) == "a <<b c>> d"


def test_text_functions(spark):
    row = spark.createDataFrame([("<p>a <b>b</b></p>  c", "| a | b |  ", "x<TABLE><tr><td>1</td></tr></table>", "éé")], "h string, r string, t string, u string")
    got = row.select(
        text.text_length(F.col("h")).alias("n"), text.split_cells(F.col("r")).alias("c"), text.count_tables(F.col("t")).alias("k"),
        text.rewrap_orphan_rows(F.lit("<tr><td>1</td></tr> <tr></tr>x")).alias("w"), text.truncate_utf8(F.col("u"), 3).alias("cut"), text.utf8_size(F.col("u")).alias("b"),
    ).first()
    assert got["n"] == 5 and got["c"] == ["a", "b"] and got["k"] == 1 and got["b"] == 4 and got["cut"] == "é"
    assert got["w"] == "<table><tbody><tr><td>1</td></tr> <tr></tr></tbody></table>x"


PAGE = """<!doctype html><html><head><title> My page </title><base href="https://h.org/docs/"></head><body>
<nav><a href="/nav">n</a></nav><main><h1>Head</h1><p>Some long enough paragraph, with commas, and <a href="rel">a link</a>, to count as content.</p>
<pre><code class="language-ts">let x = 1;
</code></pre><table><thead><tr><th>A</th><th>B</th></tr></thead><tbody><tr><td>1</td><td>2|3</td></tr></tbody></table>
<ul><li>one<li>two</ul><p>gone <del>old</del> <strong>bold</strong> <em>it</em> <code>c</code></p><img src="i.png" srcset="x 2x" alt="pic"></main><footer>f</footer>
<script>var a = "</p>";</script></body></html>"""


def test_extract_and_markdown():
    got = html.extract("https://h.org/x", PAGE)
    assert got["url"] == "https://h.org/docs/" and got["title"] == "My page"
    assert "<nav" not in got["content_html"] and "srcset" not in got["content_html"] and "https://h.org/docs/rel" in got["content_html"]
    md = html.html_to_markdown(got["content_html"])
    assert "# Head" in md and "```ts\nlet x = 1;\n```" in md and "[a link](https://h.org/docs/rel)" in md
    assert "| A | B |\n| --- | --- |\n| 1 | 2\\|3 |" in md and "-   one" in md and "~old~" in md and "**bold**" in md and "_it_" in md and "`c`" in md
    assert html.extract("u", "") is None and html.extract("u", None) is None and html.extract("u", "   ") is None
    assert html.html_to_markdown("") == "" and html.html_to_markdown(None) == ""


def test_spec_tables():
    rows = "".join(f"<tr><td>field{i}</td><td>string</td><td>true</td><td>What {i} is.</td></tr>" for i in range(15))
    page = f"<body><p>Fields of the service, as they are, one by one, in order.</p><table><tr><th>n</th><th>t</th><th>r</th><th>d</th></tr>{rows}</table></body>"
    got = html.extract("https://h.org/", page)["content_html"]
    assert got.count("<h4>field") == 15 and "<p>string · true</p>" in got and "data-spec-table" in got
    assert "#### field3" in html.html_to_markdown(got)


def test_shallow_page_falls_back_to_main():
    body = "".join(f"<h2>S{i}</h2><p>p{i}</p>" for i in range(40))
    got = html.extract("https://h.org/", f"<body><main>{body}</main></body>")
    assert got["content_html"].count("<h2>") == 40


def test_links():
    assert html.collect_links('<a href="/a">x</a><nav><a href="b?c#d">y</a></nav><a href="http://[bad">z</a><a>n</a>', "https://h.org/p/") == ["https://h.org/a", "https://h.org/p/b?c#d"]
    assert html.collect_links(None, "https://h.org") == []
