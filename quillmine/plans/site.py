"""The operations of a collection: add, refresh, list, inspect and remove sites; get and search pages."""

from __future__ import annotations

import collections
import datetime
import functools
import threading
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunking import explode_chunks
from ..functions.html import page_markdown
from ..functions.robots import Robots, parse_robots
from ..functions.urls import normalize, parse
from ..operators.index import TextIndex, lengths, postings
from ..operators.store import (
    Collection, bucket_of, change_counts, classify, ensure_dimension, fetched_pages, matched_chunks, owning_site, page_id_of, put_meta, register_site, replace_chunks,
    replace_index, set_robots, site_bucket, site_counts, store_vectors, touch_crawled, upsert_pages, with_chunk_ids, without_pages, without_site,
)
from ..schema import OPTIONS, REFRESH, SITE_BUCKETS, checked, one_of
from ..sources.embeddings import Embedder, embedded, probe
from ..sources.fetch import Response, load_robots, requests_per_second
from ..sources.shared import cut
from ..sources.sitemap import load_sitemap
from .crawl import CrawlOptions, PageSource, crawl
from .search import Corpus, search, site_guard

#: Fetched pages that are remembered, and for how long.
REMEMBERED, REMEMBERED_FOR = 50, datetime.timedelta(minutes=30)
INDEXING, FAILED, IDLE = "indexing", "failed", "idle"


@dataclass
class Report:
    site_id: int
    base_url: str
    pages_added: int = 0
    pages_updated: int = 0
    pages_unchanged: int = 0
    pages_skipped: int = 0
    chunks_embedded: int = 0
    warnings: tuple[str, ...] = ()
    error: str | None = None
    status: str = IDLE
    started_at: datetime.datetime | None = None
    already_existed: bool = False


@dataclass
class Task:
    """A crawl that runs, or the last one of a site."""

    report: Report
    thread: threading.Thread | None = None
    exception: BaseException | None = None


def derive_name(base_url: str) -> str:
    _, host, port, path, _, _ = parse(base_url)
    return f"{host}{f':{port}' if port else ''}{path.removesuffix('/')}"


def origin(url: str) -> str:
    scheme, host, port, *_ = parse(url)
    return f"{scheme}://{host}{f':{port}' if port else ''}"


def options_json(options: Column) -> Column:
    return F.to_json(options)


def parsed_options(text: Column) -> Column:
    """Stored options; what can't be parsed counts as none."""
    return F.coalesce(F.from_json(text, OPTIONS), F.from_json(F.lit("{}"), OPTIONS))


def iso(when: datetime.datetime | None) -> str:
    return "never" if when is None else when.isoformat(timespec="milliseconds")


class Library:
    """A collection with its page source and, if there is one, its embedder.

    The embedder is tried once, at its first use: if it doesn't answer, pages are indexed and
    searched without vectors; if its vectors have another length than the stored ones, or it is
    another ``model``, these go. Crawls may run in the background; a call for a site that is being
    crawled joins that crawl.
    """

    def __init__(self, spark: SparkSession, folder: str, source: PageSource, embed: Embedder | None = None, now: Callable[[], datetime.datetime] = datetime.datetime.now, model: str | None = None):
        self.spark, self.store, self.source, self.embed, self.now, self.model = spark, Collection(spark, folder), source, embed, now, model
        self.running: dict[int, Task] = {}
        self.last: dict[int, Task] = {}
        self.robots: dict[str, Robots] = {}
        self.remembered: collections.OrderedDict[str, tuple] = collections.OrderedDict()
        self.lock = threading.Lock()
        self._embedder: tuple[Embedder | None, str | None] | None = None

    # ---- embeddings

    def embedder(self) -> tuple[Embedder | None, str | None]:
        """The embedder if it answers, else the reason why there is none."""
        if self._embedder is None:
            dimension, reason = probe(self.embed)
            if dimension is not None:
                tables = self.store.tables()
                model = tables["meta"].where(F.col("key") == "model").first()
                vectors, meta, changed = ensure_dimension(tables["vectors"], tables["meta"], dimension)
                other = self.model is not None and model is not None and model["value"] != self.model
                if self.model is not None and (model is None or other):
                    meta = put_meta(meta, {"model": self.model})
                if changed or other:
                    self.store.commit({"vectors": vectors.limit(0), "meta": meta})
                elif self.model is not None and model is None:
                    self.store.commit({"meta": meta})
            self._embedder = (self.embed, None) if dimension is not None else (None, reason)
        return self._embedder

    # ---- changes

    def ingest(self, pages: DataFrame) -> tuple[dict[str, DataFrame], dict[str, list[int]], dict]:
        """Tables after ``pages(site_id, url, title, markdown, fetched_at, depth[, etag,
        last_modified])`` came in, the buckets of theirs that it concerns, and counts by state.

        Only buckets that a page lies in are read. Only changed pages are cut into chunks, and of these only
        such are indexed and embedded, each once, as the page didn't have before, wherever they stand in it now; one
        whose request fails stays without a vector until its page changes again.
        """
        for c in ("etag", "last_modified"):
            if c not in pages.columns:
                pages = pages.withColumn(c, F.lit(None).cast("string"))
        came = cut(fetched_pages(pages))
        here = self._buckets(came.select(page_id_of(F.col("site_id"), F.col("url")).alias("id")))
        tables = self.store.tables(here)
        new = cut(classify(tables["pages"], came))
        changed = cut(new.where("state <> 'unchanged'"))
        counts = change_counts(new).first().asDict()
        out, buckets = {"pages": upsert_pages(tables["pages"], new)}, {"pages": here}
        there = self._buckets(changed.select(F.col("page_id").alias("id")))
        counts["chunks_embedded"] = 0
        if there:
            tables = self.store.tables(there)
            chunks = explode_chunks(changed.select("page_id", "markdown"))
            chunks = cut(with_chunk_ids(chunks))
            gone, added = (cut(x) for x in matched_chunks(tables["chunks"].join(changed.select("page_id"), "page_id", "left_semi"), chunks))
            fresh = chunks.join(added, "chunk_id", "left_semi")
            out["chunks"] = replace_chunks(tables["chunks"], changed, chunks)
            out["postings"] = replace_index(tables["postings"], gone, postings(fresh))
            out["lengths"] = replace_index(tables["lengths"], gone, lengths(fresh))
            vectors = chunks.select("chunk_id", F.lit(None).cast("array<float>").alias("embedding")).where("false")
            embed = self.embedder()[0]
            if embed is not None:
                wanting = chunks.join(tables["vectors"].select("chunk_id"), "chunk_id", "left_anti")  # new, or without a vector so far
                made = cut(wanting.select("chunk_id", embedded(F.col("text"), embed).alias("e")))
                vectors = made.where("e.vector is not null").select("chunk_id", F.col("e.vector").alias("embedding"))
                failed = made.agg(F.count("e.error").alias("n"), F.max("e.error").alias("why"), F.count_if(F.size("e.vector") > 0).alias("made")).first()
                counts["chunks_embedded"] = failed["made"]
                if failed["n"]:
                    counts["embedding_error"] = f"{failed['n']} chunk(s) have no vector: {failed['why']}"
            out["vectors"] = store_vectors(tables["vectors"], vectors, out["chunks"])
            buckets |= {n: there for n in ("chunks", "postings", "lengths", "vectors")}
        return out, buckets, counts

    def _buckets(self, ids: DataFrame) -> list[int]:
        """The distinct buckets of some ids: 4096 at most."""
        return [r["b"] for r in ids.select(bucket_of("id").alias("b")).distinct().collect()]

    def _site_buckets(self, site_id: int) -> list[int]:
        places = self.spark.range(SITE_BUCKETS).select(site_bucket(F.lit(site_id).cast("long"), F.col("id")).alias("b"))
        return [r["b"] for r in places.distinct().collect()]

    def _own(self, site_id: int) -> tuple[dict[str, DataFrame], dict[str, list[int]]]:
        """The tables in a site's buckets, and these."""
        here = self._site_buckets(site_id)
        return self.store.tables(here), {n: here for n in ("pages", "chunks", "vectors", "postings", "lengths")}

    # ---- crawling

    def _read(self, url: str) -> Response:
        """One small document through the page source; a status of 0 if it gives none."""
        row = self.source(self.spark.createDataFrame([(url,)], "url string")).select("status", "body").first()
        return Response((row and row["status"]) or 0, {}, (row and row["body"]) or "", url)

    def _rules(self, url: str) -> tuple[Robots, str]:
        """The robots.txt of the URL's origin."""
        rules, text = load_robots(origin(url), self._read)
        self.robots[origin(url)] = rules
        return rules, text

    def _crawl(self, report: Report, options: CrawlOptions, robots_txt: str | None, mode: str) -> None:
        site_id, found_seeds = report.site_id, list(options.seeds)
        if mode == "full":
            tables, buckets = self._own(site_id)
            gone = without_pages(tables, F.col("site_id") == site_id)
            self.store.commit({k: gone[k] for k in buckets}, buckets)
        if robots_txt is None:
            options.robots, robots_txt = self._rules(options.base_url)
        else:
            options.robots = parse_robots(robots_txt)
        options.per_second = requests_per_second(options.robots.delay(options.agent), None)
        declared = load_sitemap(options.base_url, lambda url: (a := self._read(url)).status == 200 and a.body or "", options.robots.sitemaps)
        options.seeds = [*found_seeds, *declared]
        failures: list[str] = []

        def level_done(level: DataFrame) -> None:
            """Make a level's pages part of the collection as soon as they are there: a crawl that breaks off keeps its levels."""
            pages = level.select(F.lit(site_id).cast("long").alias("site_id"), "url", "title", "markdown", F.lit(self.now()).alias("fetched_at"), "depth", "etag", "last_modified")
            changed, buckets, counts = self.ingest(pages)
            self.store.commit(changed, buckets)
            if failed := counts.pop("embedding_error", None):
                failures.append(failed)
            for name, value in counts.items():
                setattr(report, name, getattr(report, name) + (value or 0))

        for name in ("pages_added", "pages_updated", "pages_unchanged", "chunks_embedded"):
            setattr(report, name, 0)
        found = crawl(self.spark, self.source, options, level_done=level_done)
        sites = set_robots(self.store.tables([])["sites"], site_id, robots_txt)
        self.store.commit({"sites": touch_crawled(sites, site_id, self.now())})
        report.pages_skipped = found.skipped
        report.warnings = (*found.warnings, *failures)

    def _start(self, report: Report, options: CrawlOptions, robots_txt: str | None, mode: str, wait: bool) -> Report:
        """Crawl in a thread of its own, or join the crawl of the site that is running."""
        with self.lock:
            task = self.running.get(report.site_id)
            if task is None:
                report.started_at, report.status = self.now(), INDEXING
                task = self.running[report.site_id] = Task(report)

                def work() -> None:
                    try:
                        self._crawl(report, options, robots_txt, mode)
                        report.status = IDLE
                    except Exception as e:  # noqa: BLE001  whatever ends a crawl is its status
                        report.error, report.status, task.exception = str(e), FAILED, e
                    finally:
                        with self.lock:
                            self.last[report.site_id] = self.running.pop(report.site_id)

                task.thread = threading.Thread(target=work, name=f"crawl-{report.site_id}", daemon=True)
                task.thread.start()
        if wait:
            task.thread.join()
            if task.exception is not None:
                raise task.exception
        return task.report

    def add_site(
        self, base_url: str, name: str | None = None, seeds: list[str] | None = None, include: list[str] | None = None, exclude: list[str] | None = None,
        max_depth: int | None = None, max_pages: int | None = None, robots_txt: str | None = None, wait: bool = True,
    ) -> Report:
        """Register the base URL (once) and crawl it with these options, from its sitemaps' URLs and
        ``seeds``, by its robots.txt (or the text given). Without ``wait`` the crawl goes on in the
        background: the report is filled in as it ends."""
        base = normalize(base_url, base_url)
        held = {"include_patterns": include, "exclude_patterns": exclude, "max_depth": max_depth, "max_pages": max_pages}
        options = CrawlOptions(base, seeds or [], include or [], exclude or [], max_depth, max_pages)
        sites, site_id, new = register_site(self.store.tables([])["sites"], base, name or derive_name(base), held, self.now())
        if new:
            self.store.commit({"sites": sites})
        return self._start(Report(site_id, base, already_existed=not new), options, robots_txt, "diff", wait)

    def site(self, site_id: int):
        row = self.store.tables([])["sites"].where(F.col("site_id") == site_id).first()
        if row is None:
            raise LookupError(f"there is no site {site_id}")
        return row

    def refresh_site(self, site_id: int, mode: str = "diff", wait: bool = True) -> Report:
        """Crawl again with the stored options; ``full`` forgets the site's pages first."""
        one_of("mode", mode, REFRESH)
        row = self.site(site_id)
        o = row["crawl_options"]
        options = CrawlOptions(row["base_url"], [], (o and o["include_patterns"]) or [], (o and o["exclude_patterns"]) or [], o and o["max_depth"], o and o["max_pages"])
        return self._start(Report(site_id, row["base_url"], already_existed=True), options, None, mode, wait)

    def refresh_page(self, url: str) -> str:
        """Ask for a stored page again, with its etag and date, if the source takes them: what became of it
        (``unchanged`` also where the server says that nothing changed)."""
        url = normalize(url)
        row = self.store.tables()["pages"].where(F.col("url") == url).orderBy("page_id").first()
        if row is None:
            raise LookupError(f"not stored: {url}")
        wanted = self.spark.createDataFrame([(url, row["etag"], row["last_modified"])], "url string, etag string, last_modified string")
        answer = cut(self.source(wanted))
        got = answer.select("status", page_markdown(F.col("url"), F.col("body")).alias("page")).first()
        headers = (answer.select("headers").first()["headers"] if "headers" in answer.columns else None) or {}
        if got["status"] not in (200, 304) or (got["status"] == 200 and (got["page"] is None or got["page"]["markdown"] is None)):
            raise LookupError(f"no content ({got['status']}): {url}")
        title, markdown = (row["title"], row["markdown"]) if got["status"] == 304 else (got["page"]["title"], got["page"]["markdown"])
        held = (row["site_id"], url, title, markdown, self.now(), row["depth"], headers.get("etag", row["etag"]), headers.get("last-modified", row["last_modified"]))
        page = self.spark.createDataFrame([held], "site_id long, url string, title string, markdown string, fetched_at timestamp, depth int, etag string, last_modified string")
        changed, buckets, counts = self.ingest(page)
        self.store.commit(changed, buckets)
        return "unchanged" if counts["pages_unchanged"] else "updated"

    def remove_site(self, site_id: int) -> dict[str, int]:
        """Remove a site with all it has; the counts of what went."""
        self.site(site_id)
        tables, buckets = self._own(site_id)
        counts = site_counts(tables["sites"], tables["pages"], tables["chunks"]).where(F.col("site_id") == site_id).first()
        left = without_site(tables, site_id)
        self.store.commit({k: left[k] for k in ("sites", *buckets)}, buckets)
        self.last.pop(site_id, None)
        return {"pages": counts["page_count"], "chunks": counts["chunk_count"]}

    # ---- what there is

    def list_sites(self) -> DataFrame:
        tables = self.store.tables()
        return listed_sites(tables["sites"], tables["pages"], tables["chunks"], list(self.running))

    def index_status(self, site_id: int) -> dict:
        self.site(site_id)
        tables = self._own(site_id)[0]
        task, running = self.running.get(site_id) or self.last.get(site_id), site_id in self.running
        errors = {site_id: task.report.error} if task and task.report.error else {}
        row = status_of(tables["sites"].where(F.col("site_id") == site_id), tables["pages"], tables["chunks"], [site_id] if running else [], errors).first()
        return {**row.asDict(), "started_at": task.report.started_at if running else None, "warnings": list(task.report.warnings) if task else []}

    def get_doc(self, url: str, max_chars: int | None = None, persist: bool = False, robots_txt: str | None = None) -> dict:
        """A page's Markdown: stored, remembered, or fetched (if the robots.txt of its origin allows) and,
        with ``persist``, stored under its site."""
        max_chars, url = checked("max_chars", max_chars), normalize(url)
        tables = self.store.tables()
        row = tables["pages"].where(F.col("url") == url).orderBy("page_id").select("url", "title", "markdown", "fetched_at").first()
        if row:
            return _document(row["url"], row["title"], row["markdown"], row["fetched_at"], max_chars, "cache")
        known = self._recall(url)
        if known and not persist:
            return _document(url, *known, max_chars, "memory-cache")
        rules = parse_robots(robots_txt) if robots_txt is not None else self.robots.get(origin(url)) or self._rules(url)[0]
        if not rules.allowed(url, CrawlOptions(url).agent):
            raise PermissionError(f"its site's robots.txt keeps this page from us: {url}")
        wanted = self.spark.createDataFrame([(url,)], "url string")
        site = owning_site(wanted, tables["sites"]).first()["site_id"] if persist else None
        if persist and site is None:
            raise LookupError(f"no site of the collection holds {url}: add the site, or fetch the page without storing it")
        answer = cut(self.source(wanted))
        got = answer.select("status", page_markdown(F.col("url"), F.col("body")).alias("page")).first()
        if got["status"] != 200:
            raise LookupError(f"the server answered {got['status']} for {url}")
        if got["page"] is None or got["page"]["markdown"] is None:
            raise ValueError(f"there is no content to read in {url}")
        title, markdown, now = got["page"]["title"], got["page"]["markdown"], self.now()
        if site is not None:
            headers = (answer.select("headers").first()["headers"] if "headers" in answer.columns else None) or {}
            held = (site, url, title, markdown, now, 0, headers.get("etag"), headers.get("last-modified"))
            page = self.spark.createDataFrame([held], "site_id long, url string, title string, markdown string, fetched_at timestamp, depth int, etag string, last_modified string")
            changed, buckets, _ = self.ingest(page)
            self.store.commit(changed, buckets)
        else:
            self.remembered[url] = (title, markdown, now)
        return {**_document(url, title, markdown, now, max_chars, "fetched"), "persisted": site is not None, "site_id": site}

    def _recall(self, url: str) -> tuple | None:
        """A page that was fetched lately. Old ones are forgotten, as are those beyond the bound."""
        now = self.now()
        for k in [k for k, (_, _, at) in self.remembered.items() if now - at > REMEMBERED_FOR]:
            del self.remembered[k]
        while len(self.remembered) > REMEMBERED:
            self.remembered.popitem(last=False)
        return self.remembered.get(url)

    # ---- search

    def index(self, tokenizer: str = "native") -> TextIndex:
        """The stored text index; another tokenizer's is built from the chunks."""
        tables = self.store.tables()
        return TextIndex(tables["postings"], tables["lengths"]) if tokenizer == "native" else TextIndex.build(tables["chunks"], tokenizer)

    def search(self, query: str, site_id: int | None = None, **options) -> tuple[DataFrame, str]:
        """Hits and the mode that ran. A site that isn't there is an error; of one without pages see
        :meth:`hint`."""
        tables = self.store.tables()
        if site_id is not None:
            site_guard(tables["sites"], tables["pages"], site_id)
        embed = self.embedder()[0] if self.embed is not None and options.get("mode") != "bm25" else None
        of_query = None if embed is None else functools.partial(_first, embed)
        corpus = Corpus(tables["chunks"], tables["pages"], TextIndex(tables["postings"], tables["lengths"]), tables["vectors"] if embed else None, of_query)
        return search(corpus, query, site_id=site_id, **options)

    def hint(self, site_id: int) -> str | None:
        """What to tell one who searches a site without pages; None if it has some."""
        tables = self.store.tables(self._site_buckets(site_id))
        return site_guard(tables["sites"], tables["pages"], site_id, site_id in self.running)


def status_of(sites: DataFrame, pages: DataFrame, chunks: DataFrame, running: list[int], errors: dict[int, str]) -> DataFrame:
    """``site_id, name, base_url, status, page_count, chunk_count, last_crawled_at, error``: indexing while it
    is being crawled, failed if its last crawl ended in an error, else idle."""
    failed = F.lit(None).cast("string")
    for site_id, error in errors.items():
        failed = F.when(F.col("site_id") == site_id, error).otherwise(failed)
    indexing = F.col("site_id").isin(running) if running else F.lit(False)
    state = F.when(indexing, INDEXING).when(F.col("error").isNotNull(), FAILED).otherwise(IDLE)
    counted = site_counts(sites, pages, chunks).withColumn("error", failed)
    return counted.select("site_id", "name", "base_url", state.alias("status"), "page_count", "chunk_count", "last_crawled_at", "error")


def _first(embed: Embedder, query: str) -> list[float]:
    return embed([query])[0]


def listed_sites(sites: DataFrame, pages: DataFrame, chunks: DataFrame, running: list[int]) -> DataFrame:
    """``site_id, name, base_url, page_count, created_at, last_crawled_at, indexing`` by id."""
    counted = site_counts(sites, pages, chunks)
    indexing = F.col("site_id").isin(running) if running else F.lit(False)
    return counted.select("site_id", "name", "base_url", "page_count", "created_at", "last_crawled_at", indexing.alias("indexing")).orderBy("site_id")


def _document(url: str, title: str | None, markdown: str, fetched, most: int, source: str) -> dict:
    return {"url": url, "title": title, "markdown": markdown[:most], "source": source, "fetched_at": fetched, "truncated": len(markdown) > most, "persisted": False}


# ---- in a line


def _with_warnings(line: str, warnings) -> str:
    return "\n".join([line, *(f"  ! {w}" for w in warnings)])


def report_line(r: Report) -> str:
    """A crawl's report in a line, and one for each warning."""
    said = {INDEXING: "being crawled", FAILED: f"the crawl failed ({r.error})"}.get(r.status, f"{r.pages_added} new, {r.pages_updated} changed, {r.pages_unchanged} as before, {r.pages_skipped} left out")
    return _with_warnings(f"[{r.site_id}] {r.base_url}: {said}", r.warnings)


def status_line(status: dict) -> str:
    since = f" since {iso(status['started_at'])}" if status["started_at"] else ""
    return _with_warnings(f"[{status['site_id']}] {status['name']}: {status['status']}{since}; pages {status['page_count']}, chunks {status['chunk_count']}", status["warnings"])


def site_lines(listed: DataFrame) -> str:
    """The sites, a line each."""
    rows = listed.collect()
    lines = [f"[{r['site_id']}] {r['name']} <{r['base_url']}> pages {r['page_count']}, crawled {iso(r['last_crawled_at'])}{', indexing' if r['indexing'] else ''}" for r in rows]
    return "\n".join(lines) or "The collection has no sites."
