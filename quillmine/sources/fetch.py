"""The page source: polite HTTP fetching in executors, behind a pluggable function."""

from __future__ import annotations

import http.client
import math
import random
import threading
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from email.utils import parsedate_to_datetime
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.robots import Robots, parse_robots
from ..functions.urls import origin_of
from .sitemap import inflate, is_gzip

AGENT = "quillmine/1.0"
TIMEOUT, BODY_BYTES, RETRIES, RETRY_BASE = 20.0, 5 << 20, 3, 0.5
PER_SECOND = 2.0
#: Requests under way: of a task, and to one origin.
AT_ONCE, PER_ORIGIN = 8, 2
#: What a server's wish to wait counts for at most, in seconds.
LONGEST_WAIT = 120.0
#: What a bad connection, answer, encoding or address raises.
FAILURES = (OSError, ValueError, zlib.error, http.client.HTTPException)
FETCHED = "url string, status int, headers map<string,string>, body string, final_url string, truncated boolean, error string"


@dataclass
class Response:
    status: int
    headers: dict[str, str] = field(default_factory=dict)
    body: str = ""
    url: str = ""
    truncated: bool = False


def backoff(attempt: int, base: float = RETRY_BASE, draw: Callable[[], float] = random.random) -> float:
    """Seconds to wait: anything up to the base doubled for each attempt."""
    return draw() * base * 2**attempt


def retry_after(value: str | None, now: float | None = None) -> float | None:
    """Seconds that a Retry-After header asks for: a number, or until a date."""
    if not value:
        return None
    try:
        seconds = float(value)
        return math.ceil(seconds * 1000) / 1000 if seconds >= 0 and math.isfinite(seconds) else None
    except ValueError:
        pass
    try:
        return max(0.0, parsedate_to_datetime(value).timestamp() - (time.time() if now is None else now))
    except (TypeError, ValueError):
        return None


def bounded(read: Callable[[int], bytes], most: int) -> tuple[bytes, bool]:
    """At most ``most`` bytes, and whether there were more."""
    out, size = [], 0
    while size <= most and (part := read(min(1 << 16, most + 1 - size))):
        out.append(part)
        size += len(part)
    data = b"".join(out)
    return data[:most], size > most


def _decoded(data: bytes, encoding: str | None, most: int) -> tuple[bytes, bool]:
    if encoding not in ("gzip", "deflate"):
        return data, False
    engine = zlib.decompressobj(31 if encoding == "gzip" else 15)
    out = engine.decompress(data, most + 1)
    return out[:most], len(out) > most


def http_get(url: str, agent: str = AGENT, etag: str | None = None, modified: str | None = None, timeout: float = TIMEOUT, most: int = BODY_BYTES) -> Response:
    """One request. ``etag`` and ``modified`` make it conditional. HTTP errors are responses."""
    headers = {"User-Agent": agent, "Accept": "text/html, text/*;q=0.7, */*;q=0.3", "Accept-Encoding": "gzip, deflate"}
    if etag:
        headers["If-None-Match"] = etag
    if modified:
        headers["If-Modified-Since"] = modified
    try:
        answer = urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout)
    except urllib.error.HTTPError as e:
        answer = e
    with answer:
        found = {k.lower(): v for k, v in answer.headers.items()}
        if answer.status == 304:
            return Response(304, found, "", answer.url or url)
        data, more = bounded(answer.read, most)
        declared = found.get("content-length", "")
        if not more and declared.isdigit() and len(data) < int(declared):
            raise http.client.IncompleteRead(data, int(declared) - len(data))
        data, rest = _decoded(data, found.get("content-encoding"), most)
        body = inflate(data) if is_gzip(url) and data[:2] == b"\x1f\x8b" else data.decode("utf-8", "ignore" if more or rest else "replace")
        return Response(answer.status, found, body, answer.url or url, more or rest)


def fetch(url: str, get: Callable[..., Response] = http_get, retries: int = RETRIES, base: float = RETRY_BASE, sleep: Callable[[float], None] = time.sleep, **options) -> Response:
    """``get`` with retries: 429 waits as it asks (``LONGEST_WAIT`` at most), 5xx and failures back off. The last
    response is returned as it is; an error of the last attempt is raised if there was no response."""
    last: Response | None = None
    for attempt in range(retries + 1):
        try:
            answer = get(url, **options)
        except FAILURES:
            if attempt == retries:
                if last is not None:
                    return last
                raise
            sleep(backoff(attempt, base))
            continue
        again = answer.status == 429 or 500 <= answer.status < 600
        if not again or attempt == retries:
            return answer
        last = Response(answer.status, answer.headers, "", answer.url)
        asked = retry_after(answer.headers.get("retry-after")) if answer.status == 429 else None
        sleep(backoff(attempt, base) if asked is None else min(asked, LONGEST_WAIT))
    raise AssertionError("unreachable")


def requests_per_second(delay: float | None, default: float | None = PER_SECOND) -> float | None:
    """A crawl delay as a rate; delays of more than a second are honoured."""
    return 1 / delay if delay and delay > 0 else default


def load_robots(origin: str, get: Callable[[str], Response]) -> tuple[Robots, str]:
    """The origin's rules and their text; anything but a 200 allows all."""
    try:
        answer = get(f"{origin}/robots.txt")
    except FAILURES:
        return parse_robots(""), ""
    text = answer.body if answer.status == 200 else ""
    return parse_robots(text), text


def fetch_pages(urls: DataFrame, get: Callable[..., Response] = http_get, per_second: float = PER_SECOND, conditional: bool = True, partitions: int | None = None, at_once: int = AT_ONCE, per_origin: int = PER_ORIGIN, **options) -> DataFrame:
    """Fetch ``urls(url[, per_second][, etag, last_modified])``: a row of ``FETCHED`` for each.

    An origin's URLs lie in one task, which spaces its requests out, so a site sees one client at
    its rate (a row's own ``per_second``, where it has one) whatever the cluster's size, and
    ``per_origin`` requests at once; a task has ``at_once`` under way. Failed URLs have a null status and an error; no answer, however broken, ends the task. Rows with an etag or a
    date of their last change ask for the page only if it is another one (``conditional``).
    """

    def answered(r: dict, slot: threading.Semaphore) -> tuple:
        known = {"etag": r.get("etag"), "modified": r.get("last_modified")} if conditional else {}
        try:
            a = fetch(r["url"], get, **known, **options)
            return r["url"], a.status, a.headers, a.body, a.url or r["url"], a.truncated, None
        except FAILURES as e:
            return r["url"], None, None, None, r["url"], False, f"{type(e).__name__}: {e}"
        finally:
            slot.release()

    def fetched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        next_at: dict[str, float] = {}
        slots: dict[str, threading.Semaphore] = {}
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                waiting = []
                for r in batch.to_dict("records"):
                    slot = slots.setdefault(r["origin"], threading.Semaphore(per_origin))
                    slot.acquire()
                    wait = next_at.get(r["origin"], 0) - time.monotonic()
                    if wait > 0:
                        time.sleep(wait)
                    next_at[r["origin"]] = time.monotonic() + 1 / (r.get("per_second") or per_second)
                    waiting.append(pool.submit(answered, r, slot))
                rows = [x.result() for x in waiting]
                out = pd.DataFrame(rows, columns=["url", "status", "headers", "body", "final_url", "truncated", "error"])
                yield out.astype({"status": "Int32"})

    columns = ["url", *(c for c in ("per_second", "etag", "last_modified") if c in urls.columns)]
    dealt = urls.select(*columns, origin_of(F.col("url")).alias("origin"))
    dealt = dealt.repartition(partitions, "origin") if partitions else dealt.repartition("origin")
    return dealt.mapInPandas(fetched, FETCHED)


def table_source(pages: DataFrame, url: str = "url", body: str = "html") -> Callable[[DataFrame], DataFrame]:
    """A page source over stored responses: a function from ``urls(url)`` to ``url, status, body``,
    404 where nothing is stored."""
    stored = pages.select(F.col(url).alias("__url"), F.col(body).alias("body"))

    def read(urls: DataFrame) -> DataFrame:
        joined = urls.join(stored, urls["url"] == stored["__url"], "left")
        return joined.select("url", F.when(F.col("__url").isNull(), 404).otherwise(200).alias("status"), "body")

    return read


def http_source(**options) -> Callable[[DataFrame], DataFrame]:
    """A page source over the network, with the options of :func:`fetch_pages`."""
    return partial(_fetched, options=options)


def _fetched(urls: DataFrame, options: dict) -> DataFrame:
    return fetch_pages(urls, **options).select("url", "status", "body", "headers")
