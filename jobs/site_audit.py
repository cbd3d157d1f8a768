"""Audit crawled sites: an inventory of pages, the links that lead nowhere, and totals of each site.

Reads raw pages (``page_id, url, html``) and writes three tables, whole, each time alike:

- ``pages``, partitioned by ``part`` (a hash of the host): each page's address, title, length, hash, the smallest page with the same
  content, its links, how many stay on its host, how many of these lead to no page, and how many pages refer to it
- ``frontier``, likewise: addresses on known hosts that pages refer to and no page has, with the number of referring pages
- ``sites``: totals of each host, as JSON

    spark-submit jobs/site_audit.py --pages PATH --output PATH
"""

from __future__ import annotations

import os
import sys
import uuid

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command, log
from quillmine.functions import text, urls
from quillmine.plans.queries import LINK, PARTS, QUERY_TAIL, URLS, W
from quillmine.sources.shared import cut, shared_folder


PAGES = (
    "page_id long, address string, host string, title string, text_length long, size long, content_hash string, duplicate_of long, "
    "links long, inside long, missing long, referrers long"
)
FRONTIER = "host string, address string, referrers long, first_referrer long"


def run(spark: SparkSession, pages: str, output: str, parts: int = 16) -> dict:
    """Audit the pages in ``pages`` into ``output``; counts of what was read and written.

    Rows without an id or an absolute URL are left out and counted. Of several rows of a page the links are put together.
    """
    found = spark.read.parquet(pages).select("page_id", "url", "html")
    address, host = urls.native_normalized(F.col("url")), urls.host_of(F.col("url"))
    known = found.where("page_id is not null").select("page_id", "url", address.alias("address"), host.alias("host"), "html").where("address is not null")
    rows = known.select(
        "page_id", "address", "host", text.html_title(F.col("html")).alias("title"), text.text_length(F.col("html")).alias("text_length"),
        text.utf8_size(F.col("html")).alias("size"), text.content_hash(F.col("html")).alias("content_hash"),
    )
    target = urls.native_normalized(urls.native_resolved(F.col("href"), F.col("url")))
    links = known.select("page_id", "url", "host", F.explode(text.html_links(F.col("html"))).alias("href")).select("page_id", "host", target.alias("target"))
    links = links.where("target is not null").distinct().withColumn("inside", urls.host_of(F.col("target")) == F.col("host"))
    addresses = known.select(F.col("address").alias("target"), F.lit(True).alias("there")).distinct()
    # pages are parsed and their links resolved once, for all three tables
    edges = cut(links.join(addresses, "target", "left").withColumn("there", F.coalesce("there", F.lit(False))))
    out = edges.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.count_if("inside").alias("inside"), F.count_if(F.col("inside") & ~F.col("there")).alias("missing"))
    referred = edges.where("there").groupBy(F.col("target").alias("address")).agg(F.count_distinct("page_id").alias("referrers"))
    first = rows.groupBy("content_hash").agg(F.min("page_id").alias("first_page"))
    part = F.pmod(F.crc32(F.encode("host", "utf-8")), F.lit(parts)).cast("int").alias("part")
    audited = rows.join(out, "page_id", "left").join(referred, "address", "left").join(first, "content_hash", "left").select(
        "page_id", "address", "host", "title", "text_length", "size", "content_hash", F.when(F.col("first_page") < F.col("page_id"), F.col("first_page")).alias("duplicate_of"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("links", "inside", "missing", "referrers")), part,
    )
    _write(audited, "page_id", f"{output}/pages")
    hosts = known.select("host").distinct()
    absent = edges.where(~F.col("there")).select("page_id", F.col("target").alias("address"), urls.host_of(F.col("target")).alias("host")).join(hosts, "host", "left_semi")
    absent = absent.groupBy("host", "address").agg(F.count_distinct("page_id").alias("referrers"), F.min("page_id").alias("first_referrer"))
    _write(absent.select("host", "address", "referrers", "first_referrer", part), "address", f"{output}/frontier")
    written, frontier = spark.read.schema(PAGES).parquet(f"{output}/pages"), spark.read.schema(FRONTIER).parquet(f"{output}/frontier")
    sums = {"pages": F.count(F.lit(1)), "duplicates": F.count("duplicate_of"), "bytes": F.sum("size"), "links": F.sum("links"), "missing": F.sum("missing"), "unreferred": F.count_if(F.col("referrers") == 0)}
    sites = written.groupBy("host").agg(*(c.alias(n) for n, c in sums.items())).join(frontier.groupBy("host").agg(F.count(F.lit(1)).alias("frontier")), "host", "left")
    sites.fillna(0, ["frontier"]).write.mode("overwrite").json(f"{output}/sites")
    done = {"rows_read": found.count(), "pages": written.count(), "frontier": frontier.count(), "sites": spark.read.schema("host string").json(f"{output}/sites").count()}
    done["left_out"] = done["rows_read"] - done["pages"]
    log.info("read %d rows of %s; wrote %d pages, %d absent addresses and %d sites to %s", done["rows_read"], pages, done["pages"], done["frontier"], done["sites"], output)
    return done


def _write(df: DataFrame, order: str, path: str) -> None:
    """``df`` by ``part``, a hot part over several tasks."""
    df.repartition("part", F.pmod(F.xxhash64(order), F.lit(8))).sortWithinPartitions("part", "host", order).write.mode("overwrite").partitionBy("part").parquet(path)


def output_of(spark: SparkSession, output: str) -> DataFrame:
    """What the job has written: a row for each page, with the totals of its site."""
    sites = spark.read.schema("host string, pages long, duplicates long, bytes long, links long, missing long, unreferred long, frontier long").json(f"{output}/sites")
    totals = sites.select("host", *(F.col(c).alias(f"site_{c}") for c in sites.columns if c != "host"))
    return spark.read.schema(PAGES).parquet(f"{output}/pages").drop("part").join(totals, "host")


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job over the whole of ``pages``, twice into one new folder."""
    output = f"{shared_folder(spark)}/job2-{uuid.uuid4().hex}/output"
    for _ in range(2):
        run(spark, f"{sf_dir}/pages.parquet", output)
    return output_of(spark, output)


_TARGETS = URLS.replace("page_id, url, lower", "page_id, own, url, lower").replace("page_id, url, scheme", "page_id, own, url, scheme").replace("u AS (", "tu AS (", 1).replace("n AS (", "tn AS (").replace("FROM pages)", "FROM h)").replace("FROM u)", "FROM tu)")

ORACLE_SQL = rf"""
    WITH {URLS}, a AS (SELECT page_id, scheme || '://' || host || path || {QUERY_TAIL} AS address, host, html FROM n JOIN pages USING (page_id) WHERE host <> ''),
    r AS (SELECT page_id, address, host, regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1), '<[^>]+>', '', 'g'), '^{W}+|{W}+$', '', 'g') AS title,
            length(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '{W}+', ' ', 'g'), '^{W}+|{W}+$', '', 'g'))::BIGINT AS text_length, strlen(html)::BIGINT AS size, sha256(html) AS content_hash FROM a),
    g AS (SELECT page_id, u.host AS own, scheme, u.host, u.path, unnest(regexp_extract_all(html, '{LINK}', 1)) AS href FROM u JOIN pages USING (page_id)),
    h AS (SELECT page_id, own, CASE WHEN regexp_matches(href, '(?i)^https?://') THEN href WHEN starts_with(href, '//') THEN scheme || ':' || href WHEN starts_with(href, '/') THEN scheme || '://' || host || href
            WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') OR href[1] IN ('?', '#') THEN NULL ELSE scheme || '://' || host || regexp_replace(path, '[^/]*$', '') || href END AS url FROM g),
    {_TARGETS},
    l AS (SELECT DISTINCT page_id, own, host, scheme || '://' || host || path || {QUERY_TAIL} AS target FROM tn WHERE regexp_matches(url, {PARTS}) AND host <> ''),
    e AS (SELECT *, target IN (SELECT address FROM a) AS there FROM l),
    o AS (SELECT page_id, count(*) AS links, count(*) FILTER (host = own) AS inside, count(*) FILTER (host = own AND NOT there) AS missing FROM e GROUP BY page_id),
    f AS (SELECT target AS address, count(DISTINCT page_id) AS referrers FROM e WHERE there GROUP BY target),
    c AS (SELECT content_hash, min(page_id) AS first_page FROM r GROUP BY content_hash),
    p AS (SELECT r.*, CASE WHEN first_page < page_id THEN first_page END AS duplicate_of, coalesce(links, 0) AS links, coalesce(inside, 0) AS inside, coalesce(missing, 0) AS missing, coalesce(referrers, 0) AS referrers
          FROM r LEFT JOIN o USING (page_id) LEFT JOIN f USING (address) JOIN c USING (content_hash)),
    b AS (SELECT host, count(DISTINCT target) AS frontier FROM e WHERE NOT there AND host IN (SELECT host FROM a) GROUP BY host),
    s AS (SELECT host, count(*) AS site_pages, count(duplicate_of) AS site_duplicates, sum(size)::BIGINT AS site_bytes, sum(links)::BIGINT AS site_links, sum(missing)::BIGINT AS site_missing, count(*) FILTER (referrers = 0) AS site_unreferred
          FROM p GROUP BY host)
    SELECT p.*, site_pages, site_duplicates, site_bytes, site_links, site_missing, site_unreferred, coalesce(frontier, 0) AS site_frontier FROM p JOIN s USING (host) LEFT JOIN b USING (host)
"""

if __name__ == "__main__":
    command("site_audit", run, os.path.join(os.path.dirname(os.path.abspath(__file__)), "site_audit.json"))
