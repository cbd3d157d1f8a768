"""Tables of a collection."""

from __future__ import annotations

SITES = (
    "site_id long, base_url string, name string, robots_txt string, "
    "crawl_options struct<include_patterns:array<string>,exclude_patterns:array<string>,max_depth:int,max_pages:int>, "
    "created_at timestamp, updated_at timestamp, last_crawled_at timestamp"
)
PAGES = (
    "page_id long, site_id long, url string, title string, etag string, last_modified string, content_hash string, "
    "markdown string, markdown_size long, fetched_at timestamp, depth int"
)
CHUNKS = "chunk_id long, page_id long, ord int, heading_path string, text string, token_count int"
VECTORS = "chunk_id long, embedding array<float>"
POSTINGS = "chunk_id long, col int, term string, positions array<int>"
LENGTHS = "chunk_id long, length long"
META = "key string, value string"
TABLES = {"sites": SITES, "pages": PAGES, "chunks": CHUNKS, "vectors": VECTORS, "postings": POSTINGS, "lengths": LENGTHS, "meta": META}
#: The id whose low bits say in which bucket a row of a table lies; the other tables are small and lie whole.
BUCKETED = {"pages": "page_id", "chunks": "page_id", "vectors": "chunk_id", "postings": "chunk_id", "lengths": "chunk_id"}
#: Order of a table's rows within its files, so that row groups are pruned.
SORTED = {"postings": ("term", "chunk_id"), "pages": ("url",)}
BUCKET_BITS = 12
#: Buckets that a site's pages are dealt over.
SITE_BUCKETS = 16
#: 1: tables lie whole, no index. 2: buckets, and the text index is stored.
VERSION = 2
OPTIONS = "struct<includePatterns:array<string>,excludePatterns:array<string>,maxDepth:int,maxPages:int>"

# Bounds of the arguments: least, most, default.
LIMITS = {
    "top_k": (1, 50, 10),
    "max_per_page": (1, 50, 2),
    "max_chars": (100, 500_000, 60_000),
    "max_depth": (0, 20, 5),
    "max_pages": (1, 20_000, 2000),
}
MODES = ("auto", "bm25", "vector", "hybrid")
REFRESH = ("diff", "full")


def checked(name: str, value: int | None) -> int:
    """An argument within its bounds, or its default; raises ValueError."""
    least, most, default = LIMITS[name]
    value = default if value is None else value
    if isinstance(value, bool) or not isinstance(value, int) or not least <= value <= most:
        raise ValueError(f"{name} must be an integer from {least} to {most}")
    return value


def one_of(name: str, value: str, known: tuple[str, ...]) -> str:
    if value not in known:
        raise ValueError(f"{name} must be one of {', '.join(known)}")
    return value
