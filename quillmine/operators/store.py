"""Changes of a collection's tables as transformations: each takes tables and returns new ones.

Nothing is updated in place. A change is a join of the stored rows with what came in, which makes
it safe to run again; :class:`Collection` writes the results as a new snapshot. Rows are dealt over
buckets by their ids, and a change reads and writes the buckets that it touches.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import content_hash, utf8_size
from ..schema import BUCKET_BITS, BUCKETED, SITE_BUCKETS, SORTED, TABLES, VERSION
from .prefixes import owning_site as owning_site  # beside the other relations of a collection's tables

PAGE_CONTENT = ("title", "etag", "last_modified", "content_hash", "markdown", "markdown_size", "fetched_at", "depth")
PAGE_TOUCHED = ("etag", "last_modified", "fetched_at")
STATES = ("inserted", "updated", "unchanged")


def stable_id(*columns: Column | str) -> Column:
    """A positive id from a row's natural key, the same in every run and on every executor."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 63) - 1))


def bucket_of(id_: Column | str) -> Column:
    """The bucket of a page's or a chunk's id: its low bits."""
    return F.col(id_).bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)) if isinstance(id_, str) else id_.bitwiseAND(F.lit((1 << BUCKET_BITS) - 1))


def _in_bucket(hash_: Column, bucket: Column) -> Column:
    return hash_.bitwiseAND(F.lit(((1 << 63) - 1) ^ ((1 << BUCKET_BITS) - 1))).bitwiseOR(bucket.cast("long"))


def site_bucket(site_id: Column, place: Column) -> Column:
    return F.pmod(F.xxhash64(site_id, place.cast("long")), F.lit(1 << BUCKET_BITS))


def page_id_of(site_id: Column, url: Column) -> Column:
    """A page's id from its natural key. A site's pages lie in ``SITE_BUCKETS`` buckets, by the URL."""
    hashed = F.xxhash64(site_id, url)
    return _in_bucket(hashed, site_bucket(site_id, F.pmod(F.shiftrightunsigned(hashed, 40), F.lit(SITE_BUCKETS))))


def chunk_id_of(page_id: Column, nth: Column, heading_path: Column, text: Column) -> Column:
    """A chunk's id, in its page's bucket: it depends on what the chunk says, not on where it stands. ``nth``
    counts equal ones of a page."""
    return _in_bucket(F.xxhash64(page_id, nth, heading_path, text), bucket_of(page_id))


def with_chunk_ids(chunks: DataFrame) -> DataFrame:
    """``chunks(page_id, ord, heading_path, text, ...)`` with ``chunk_id``: the first of several equal chunks of a page has
    the same id whatever comes before it, and so on."""
    nth = F.row_number().over(Window.partitionBy("page_id", "heading_path", "text").orderBy("ord"))
    told = chunks.withColumn("__nth", nth)
    return told.withColumn("chunk_id", chunk_id_of(F.col("page_id"), F.col("__nth"), F.col("heading_path"), F.col("text"))).drop("__nth")


def matched_chunks(stored: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``chunk_id`` of the stored chunks that no new one equals, and of the new ones that no stored one equals: a
    multiset match, for equal chunks have ids by their number."""
    old, now = stored.select("chunk_id"), new.select("chunk_id")
    return old.join(now, "chunk_id", "left_anti"), now.join(old, "chunk_id", "left_anti")


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in ``order``."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", first).where(F.col("__n") == 1).drop("__n")


def fetched_pages(pages: DataFrame) -> DataFrame:
    """Incoming pages (site_id, url, markdown, ...) with hash and size, the last of each URL."""
    hashed = pages.withColumn("content_hash", content_hash(F.col("markdown"))).withColumn("markdown_size", utf8_size(F.col("markdown")))
    return latest(hashed, ["site_id", "url"], F.desc("fetched_at"), F.desc("content_hash"))


def classify(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming pages with ``state`` (inserted, updated or unchanged) and the stored ``page_id``.

    Only key, id and hash of what is stored take part in the join.
    """
    old = stored.select("site_id", "url", "page_id", F.col("content_hash").alias("__old_hash"))
    state = (
        F.when(F.col("page_id").isNull(), "inserted")
        .when(F.col("__old_hash") == F.col("content_hash"), "unchanged")
        .otherwise("updated")
    )
    new = incoming.drop("page_id").join(old, ["site_id", "url"], "left").withColumn("state", state).drop("__old_hash")
    return new.withColumn("page_id", F.coalesce("page_id", page_id_of(F.col("site_id"), F.col("url"))))


def upsert_pages(stored: DataFrame, classified: DataFrame) -> DataFrame:
    """Stored pages after the change: new ones added, changed ones replaced, unchanged ones touched
    (title, depth and content stay), the others as they are."""
    names = stored.columns
    new = classified.select("site_id", "url", F.col("page_id").alias("__id"), F.col("state").alias("__state"), *(F.col(c).alias(f"__{c}") for c in PAGE_CONTENT))
    both = stored.join(new, ["site_id", "url"], "full_outer")

    def value(c: str) -> Column:
        if c == "page_id":
            return F.coalesce("page_id", "__id")
        if c not in PAGE_CONTENT:
            return F.col(c)
        replaced = F.col("__state").isin("inserted", "updated")
        touched = F.col("__state") == "unchanged" if c in PAGE_TOUCHED else F.lit(False)
        return F.when(replaced | touched, F.col(f"__{c}")).otherwise(F.col(c))

    return both.select(*(value(c).alias(c) for c in names))


def replace_chunks(stored: DataFrame, changed: DataFrame, new: DataFrame) -> DataFrame:
    """Stored chunks without those of ``changed(page_id)`` pages, and the new ones."""
    kept = stored.join(changed.select("page_id").distinct(), "page_id", "left_anti")
    return kept.select(*stored.columns).unionByName(new.select(*stored.columns))


def replace_index(stored: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """Stored postings or lengths without those of ``gone(chunk_id)``, and the new ones."""
    kept = stored.join(gone.select("chunk_id"), "chunk_id", "left_anti")
    return kept.select(*stored.columns).unionByName(new.select(*stored.columns))


def store_vectors(stored: DataFrame, new: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Stored vectors with the new ones in place of the old; empty vectors are no vectors, and those
    of chunks that are gone (if ``chunks`` is given) go too. ``new`` is read twice: write it down
    first where it is dear."""
    new = new.where(F.size("embedding") > 0)
    out = stored.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new.select(*stored.columns))
    return out if chunks is None else out.join(chunks.select("chunk_id"), "chunk_id", "left_semi")


def ensure_dimension(vectors: DataFrame, meta: DataFrame, dimension: int) -> tuple[DataFrame, DataFrame, bool]:
    """Vectors and meta for a dimension, and whether the vectors had to go for it."""
    if isinstance(dimension, bool) or not isinstance(dimension, int) or dimension < 1:
        raise ValueError("the dimension must be a positive integer")
    row = meta.where(F.col("key") == "dim").first()
    if row and row["value"] == str(dimension):
        return vectors, meta, False
    return vectors.limit(0), put_meta(meta, {"dim": str(dimension)}), True


def put_meta(meta: DataFrame, values: dict[str, str]) -> DataFrame:
    """Key-value rows with these in place of the old."""
    new = meta.sparkSession.createDataFrame(list(values.items()), meta.schema)
    return meta.join(new.select("key"), "key", "left_anti").unionByName(new)


def latest_values(rows: DataFrame, key: str, value: str, *order: Column) -> DataFrame:
    """Last writer wins: ``key, value`` of each key's first row in ``order``."""
    return latest(rows, [key], *order).select(F.col(key).alias("key"), F.col(value).alias("value"))


def register_site(sites: DataFrame, base_url: str, name: str, options: dict | None, now) -> tuple[DataFrame, int, bool]:
    """Sites with the (normalised) base URL registered, its id, and whether it is new. A stored site
    keeps its options."""
    row = sites.where(F.col("base_url") == base_url).select("site_id").first()
    if row:
        return sites, row["site_id"], False
    options = options or {}
    held = tuple(options.get(k) for k in ("include_patterns", "exclude_patterns", "max_depth", "max_pages"))
    new = sites.sparkSession.createDataFrame([(None, base_url, name, None, held, now, now, None)], sites.schema)
    new = new.withColumn("site_id", stable_id("base_url"))
    return sites.unionByName(new), new.first()["site_id"], True


def touch_crawled(sites: DataFrame, site_id: int, now) -> DataFrame:
    here = F.col("site_id") == site_id
    return sites.withColumns({c: F.when(here, F.lit(now)).otherwise(F.col(c)) for c in ("updated_at", "last_crawled_at")})


def set_robots(sites: DataFrame, site_id: int, text: str | None) -> DataFrame:
    """Store a site's robots.txt, if there is any text."""
    if not text:
        return sites
    return sites.withColumn("robots_txt", F.when(F.col("site_id") == site_id, F.lit(text)).otherwise(F.col("robots_txt")))


def without_site(tables: dict[str, DataFrame], site_id: int) -> dict[str, DataFrame]:
    """All tables without a site, its pages, their chunks and vectors."""
    return {**without_pages(tables, F.col("site_id") == site_id), "sites": tables["sites"].where(F.col("site_id") != site_id)}


def without_pages(tables: dict[str, DataFrame], which: Column) -> dict[str, DataFrame]:
    """All tables without some pages, their chunks, and these chunks' vectors and postings."""
    pages = tables["pages"].where(which).select("page_id")
    chunks = tables["chunks"].join(pages, "page_id", "left_semi").select("chunk_id")
    return {
        **tables,
        "pages": tables["pages"].where(~which),
        "chunks": tables["chunks"].join(pages, "page_id", "left_anti").select(*tables["chunks"].columns),
        **{n: tables[n].join(chunks, "chunk_id", "left_anti").select(*tables[n].columns) for n in ("vectors", "postings", "lengths") if n in tables},
    }


def keep_listed(pages: DataFrame, site_id: int, urls: DataFrame) -> DataFrame:
    """Pages without those of a site whose URL isn't listed; an empty list takes them all."""
    gone = pages.where(F.col("site_id") == site_id).join(urls.select("url"), "url", "left_anti").select("page_id")
    return pages.join(gone, "page_id", "left_anti").select(*pages.columns)


def site_counts(sites: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every site with its numbers of pages and chunks. Both are counted before they are joined."""
    per_page = chunks.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    counted = pages.select("site_id", "page_id").join(per_page, "page_id", "left")
    counted = counted.groupBy("site_id").agg(F.count(F.lit(1)).alias("page_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunk_count"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("page_count", "chunk_count")}
    return sites.join(counted, "site_id", "left").withColumns(zero)


def page_chunk_counts(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every page with its number of chunks, none included."""
    counted = chunks.groupBy("page_id").agg(F.count("chunk_id").alias("chunk_count"))
    return pages.select("page_id", "url").join(counted, "page_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def heading_frequency(chunks: DataFrame, top: int = 20) -> DataFrame:
    found = chunks.groupBy("heading_path").agg(F.count(F.lit(1)).alias("n"))
    return found.orderBy(F.desc("n"), "heading_path").limit(top)


def largest_page(pages: DataFrame) -> DataFrame:
    return pages.orderBy(F.desc("markdown_size"), "page_id").limit(1)


def change_counts(classified: DataFrame, skipped: int | Column = 0) -> DataFrame:
    """One row: pages added, updated, unchanged and skipped."""
    names = dict(zip(STATES, ("pages_added", "pages_updated", "pages_unchanged")))
    found = classified.agg(*(F.count_if(F.col("state") == s).alias(n) for s, n in names.items()))
    return found.withColumn("pages_skipped", F.lit(skipped).cast("long"))


class Conflict(RuntimeError):
    """Another writer has changed the same rows since they were read."""


class Collection:
    """A collection's tables on storage that all executors share.

    The large tables lie in buckets (the low bits of their ids). A change writes new folders for
    the buckets that it touches and then one listing, a small file that names every bucket's
    current folder; readers follow the newest complete listing. What is being read is never
    overwritten, and a lost driver leaves the last listing as it was. A listing is made under the
    next number, which only one writer can; the other one merges its buckets into the newer listing
    and tries again, or is told of the :class:`Conflict` if they are the same. (The file system
    must refuse to create a file that exists, as HDFS and local disks do.)
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        fs, path = self._fs(), self._path()
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.removeprefix("snapshot-")) for n in names if n.startswith("snapshot-"))

    def _read(self, number: int, patience: float = 5.0) -> dict | None:
        """A listing; None if its writer didn't finish it (it is given a while)."""
        name, fs = f"snapshot-{number:010}", self._fs()
        until = time.monotonic() + patience
        while True:
            if fs.getFileStatus(self._path(name)).isDirectory():  # as the first version wrote them
                rows = self.spark.read.schema("table string, place string, version int").json(f"{self.folder}/{name}").collect()
                return {"version": 1, "places": {(r["table"], None): r["place"] for r in rows}}
            stream = fs.open(self._path(name))
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                found = json.loads(text)
                return {"version": found["version"], "places": {(t, b): p for t, b, p in found["places"]}}
            except (ValueError, KeyError):
                if time.monotonic() > until:
                    return None
                time.sleep(0.1)

    def listing(self) -> tuple[int, dict]:
        """The newest complete listing, and the highest number that was taken when it was looked for
        (-1: none yet; it is another one's if a writer died over it)."""
        numbers = self._numbers()
        for number in reversed(numbers):
            found = self._read(number)
            if found is not None:
                return numbers[-1], found
        return max(numbers, default=-1), {"version": VERSION, "places": {}}

    def places(self) -> dict[tuple[str, int | None], str]:
        """Where each table's, or bucket's, current rows lie."""
        return self.listing()[1]["places"]

    def tables(self, buckets: Iterable[int] | None = None) -> dict[str, DataFrame]:
        """All tables, of these buckets alone if they are given."""
        version, places = (x := self.listing()[1])["version"], x["places"]
        if version != VERSION:
            raise RuntimeError(f"the collection is of version {version}: migrate() it to {VERSION}")
        wanted = None if buckets is None else set(buckets)
        out = {}
        for name, schema in TABLES.items():
            held = [p for (t, b), p in sorted(places.items(), key=str) if t == name and (b is None or wanted is None or b in wanted)]
            out[name] = self.spark.read.schema(schema).parquet(*held) if held else self.spark.createDataFrame([], schema)
        return out

    def _write(self, name: str, df: DataFrame) -> dict[tuple[str, int | None], str]:
        """Write a table's rows to a new folder; where each bucket lies in it."""
        place = f"{self.folder}/data/{name}-{uuid.uuid4().hex}"
        fields = self.spark.createDataFrame([], TABLES[name]).schema
        df = df.select(*(F.col(f.name).cast(f.dataType) for f in fields))
        order = SORTED.get(name, ())
        if name not in BUCKETED:
            df.write.parquet(place)
            return {(name, None): place}
        df = df.withColumn("bucket", bucket_of(BUCKETED[name]))
        df.repartition("bucket").sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(place)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        names = [s.getPath().getName() for s in self._fs().listStatus(path)]
        return {(name, int(n.removeprefix("bucket="))): f"{place}/{n}" for n in names if n.startswith("bucket=")}

    def commit(self, changed: dict[str, DataFrame], buckets: dict[str, Iterable[int]] | None = None) -> int:
        """Write changed tables and make them current together; the listing's number.

        Of a table in ``buckets`` only these buckets are replaced, by the rows given (none: they
        become empty); others are replaced whole.
        """
        base = self.listing()[1]
        written: dict[tuple[str, int | None], str] = {}
        for name, df in changed.items():
            written |= self._write(name, df)
        whole = {n for n in changed if n not in (buckets or {})}
        touched = {(n, b) for n, own in (buckets or {}).items() if n in changed for b in own}

        def ours(key: tuple[str, int | None]) -> bool:
            return key[0] in whole or key in touched

        if stray := [k for k in written if not ours(k)]:
            raise ValueError(f"rows outside of the buckets that are replaced: {stray[:3]}")
        while True:
            top, now = self.listing()
            if any(ours(k) and now["places"].get(k) != base["places"].get(k) for k in now["places"].keys() | base["places"].keys()):
                raise Conflict(f"changed meanwhile: {sorted(changed)}")
            places = {k: p for k, p in now["places"].items() if not ours(k)} | written
            text = json.dumps({"version": VERSION, "places": [[t, b, p] for (t, b), p in sorted(places.items(), key=str)]})
            if self._create(f"snapshot-{top + 1:010}", text):
                return top + 1

    def _create(self, name: str, text: str) -> bool:
        """Make a file with this text; False if there is one."""
        try:
            stream = self._fs().create(self._path(name), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName() or self._fs().exists(self._path(name)):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def migrate(self) -> int:
        """Bring an older collection to this version; the version that it had. Ids are made anew
        (they say where rows lie) and the text index is derived from the chunks."""
        from .index import lengths, postings

        _, found = self.listing()
        if found["version"] == VERSION:
            return VERSION
        old = {n: self.spark.read.schema(TABLES[n]).parquet(p) for (n, _), p in found["places"].items()}
        empty = {n: self.spark.createDataFrame([], s) for n, s in TABLES.items()}
        pages = old.get("pages", empty["pages"]).withColumn("new_page", page_id_of(F.col("site_id"), F.col("url")))
        chunks = old.get("chunks", empty["chunks"]).join(pages.select("page_id", "new_page"), "page_id")
        told = with_chunk_ids(chunks.select(F.col("chunk_id").alias("old_chunk"), F.col("new_page").alias("page_id"), "ord", "heading_path", "text"))
        chunks = chunks.join(told.select(F.col("old_chunk").alias("chunk_id"), F.col("chunk_id").alias("new_chunk")), "chunk_id")
        vectors = old.get("vectors", empty["vectors"]).join(chunks.select("chunk_id", "new_chunk"), "chunk_id")
        renamed = chunks.drop("page_id", "chunk_id").withColumnsRenamed({"new_page": "page_id", "new_chunk": "chunk_id"})
        self.commit({
            **{n: old[n] for n in ("sites", "meta") if n in old},
            "pages": pages.drop("page_id").withColumnRenamed("new_page", "page_id"), "chunks": renamed,
            "vectors": vectors.drop("chunk_id").withColumnRenamed("new_chunk", "chunk_id"), "postings": postings(renamed), "lengths": lengths(renamed),
        })
        return found["version"]

    def vacuum(self) -> int:
        """Delete folders and listings that the current listing doesn't need; how many folders went.
        Run it when no reader follows an older listing and no writer is at work."""
        fs, data = self._fs(), self._path("data")
        number, found = self.listing()
        for n in self._numbers():
            if n < number:
                fs.delete(self._path(f"snapshot-{n:010}"), True)
        named = {p.rsplit("/bucket=", 1)[0].rsplit("/", 1)[1] for p in found["places"].values()}
        used = {p for p in found["places"].values()}
        gone = 0
        for status in fs.listStatus(data) if fs.exists(data) else []:
            path = status.getPath()
            if path.getName() not in named:
                gone += bool(fs.delete(path, True))
                continue
            for part in fs.listStatus(path):
                name = part.getPath().getName()
                if name.startswith("bucket=") and f"{self.folder}/data/{path.getName()}/{name}" not in used:
                    gone += bool(fs.delete(part.getPath(), True))
        return gone
