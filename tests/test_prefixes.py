"""Joins of URLs with sites and robots rules against the functions that judge one URL at a time."""

import random

from quillmine.functions.robots import parse_robots
from quillmine.functions.urls import under_base
from quillmine.operators import prefixes, ranking

HOSTS = ["https://a.org", "http://a.org", "https://b.org:8080"]


def some_paths(seed, n):
    draw = random.Random(seed)
    return ["/" + "/".join(draw.choice(["docs", "docs2", "a", "b.html", "x y", "é", ""]) for _ in range(draw.randrange(5))) for _ in range(n)]


def test_owning_site(spark):
    draw = random.Random(1)
    bases = [(i, draw.choice(HOSTS) + p) for i, p in enumerate(some_paths(2, 25))] + [(99, "not a url"), (100, None), (7, "https://a.org/docs")]
    urls = [draw.choice(HOSTS) + p + draw.choice(["", "?q=/docs/", "#f"]) for p in some_paths(3, 80)] + ["none", None, "https://c.org/docs/", "https://a.org"]
    got = prefixes.owning_site(spark.createDataFrame([(u,) for u in urls], "url string"), spark.createDataFrame(bases, "site_id long, base_url string")).collect()
    assert len(got) == len(urls)
    plain = lambda x: x is not None and "é" not in x and " " not in x and "//" not in x[8:]  # noqa: E731  what both forms read alike
    checked = 0
    for r in got:
        if r["url"] is None or not plain(r["url"]):
            continue
        # bases that one form reads and the other doesn't can't own a plain URL
        want = min((i for i, b in bases if b and plain(b) and under_base(r["url"], b)), default=None)
        assert r["site_id"] == want, r["url"]
        checked += want is not None
    assert checked > 20


ROBOTS = {
    HOSTS[0]: "User-agent: *\nDisallow: /docs\nAllow: /docs/a\nDisallow: /*.html$\nDisallow: /a*b\nAllow: /a/b.html",
    HOSTS[1]: "User-agent: other\nDisallow: /\n\nUser-agent: quillmine\nDisallow: /docs2/\nAllow: /docs2/$\nDisallow: /*q=\nDisallow: /%C3%A9\n",
    HOSTS[2]: "User-agent: *\nDisallow: /\nAllow: /$\nDisallow:\nAllow: /docs/a$/x",
}


def test_robots_over_many_origins(spark):
    agent = "quillmine/1.0"
    urls = [h + p + t for h in (*HOSTS, "https://no.rules") for p in [*some_paths(4, 40), "/docs/a", "/docs", "/a/b.html", "/docs2/", "", "/docs/a$/x", "/é"] for t in ("", "?q=1", "#f")] + [None, "no url"]
    robots = spark.createDataFrame([*ROBOTS.items(), ("https://empty.org", None)], "origin string, text string")
    got = prefixes.allowed(spark.createDataFrame(list(enumerate(urls)), "n long, url string"), robots, agent)
    assert got.columns == ["n", "url", "allowed"] and got.count() == len(urls)
    for r in got.collect():
        origin = "/".join((r["url"] or "").split("/")[:3]).split("?")[0].split("#")[0]
        want = parse_robots(ROBOTS.get(origin)).allowed(r["url"], agent) if r["url"] and "://" in r["url"] else True
        assert r["allowed"] == want, r["url"]


def test_no_product_of_an_origin(spark):
    """A host with many bases: what is joined grows with a URL's own beginnings."""
    bases = spark.range(3000).selectExpr("id as site_id", "concat('https://a.org/s', id, '/') as base_url")
    urls = spark.range(2000).selectExpr("concat('https://a.org/s', id, '/x') as url")
    got = prefixes.owning_site(urls, bases)
    assert got.where("url = concat('https://a.org/s', site_id, '/x')").count() == 2000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_positions(spark):
    rows = [(x % 37, x) for x in range(500)]
    got = ranking.positions(spark.createDataFrame(rows, "a long, b long").repartition(7), "a", "b").collect()
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["position"])] == sorted(rows) and {r["position"] for r in got} == set(range(1, 501))
    assert ranking.positions(spark.createDataFrame([], "a long"), "a").count() == 0
