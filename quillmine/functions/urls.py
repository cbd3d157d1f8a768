"""URL functions: native Column expressions, and full normalisation in Python."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import parse_qsl, quote, urlencode, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKERS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "ref_src")
DEFAULT_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}
FILE_TAIL = r"\.[A-Za-z0-9]{1,6}$"

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


# ---- Python, for every URL of the web standard's special schemes


def parse(url: str, base: str | None = None) -> tuple[str, str, int | None, str, str, str]:
    """``scheme, host, port, path, query, fragment``; raises ValueError for what is no such URL."""
    url = url.strip("".join(map(chr, range(33)))).translate({9: None, 10: None, 13: None})
    if base is not None:
        url = urljoin(base, url)
    m = re.match(r"(?i)([a-z][a-z0-9+.-]*):[/\\]*", url)
    if not m or m[1].lower() not in DEFAULT_PORTS:
        raise ValueError(f"not an absolute URL: {url!r}")
    head, mark, tail = url[m.end() :].partition("#")
    split = urlsplit(f"{m[1].lower()}://{head.split('?')[0].replace(chr(92), '/')}{'?' + head.split('?', 1)[1] if '?' in head else ''}")
    host = (split.hostname or "").lower()
    if not host or re.search(r"[\x00-\x20#/<>?@\\^|%]", host):
        raise ValueError(f"no host: {url!r}")
    if ":" in host:
        host = f"[{ipaddress.IPv6Address(host).compressed}]"
    elif not host.isascii():
        host = host.encode("idna").decode()
    port = None if split.port == DEFAULT_PORTS[split.scheme] else split.port
    out: list[str] = []
    segments = split.path.split("/")[1:] if split.path else [""]
    for i, s in enumerate(segments):
        dots = s.lower().replace("%2e", ".")
        if dots in (".", ".."):
            out = out[: -1 if out and dots == ".." else len(out)] + ([""] if i == len(segments) - 1 else [])
        else:
            out.append(s)
    path = "/" + quote("/".join(out), safe="!$%&'()*+,-./:;=@[]_|~^")
    return split.scheme, host, port, path, split.query, quote(tail, safe="!#$%&'()*+,-./:;=?@[]_~") if mark else ""


def _host(host: str, port: int | None) -> str:
    return host if port is None else f"{host}:{port}"


def normalize(url: str, base: str | None = None, strip_trackers: bool = True, strip_params: tuple[str, ...] = ()) -> str:
    """The canonical form: no fragment, default port, index page or trackers; parameters stably
    sorted and re-encoded; with ``base``, the trailing slash as the base has it. Raises ValueError."""
    scheme, host, port, path, query, _ = parse(url)
    path = re.sub(r"/index\.html?$", "/", path)
    base_path = None
    if base:
        try:
            base_path = parse(base)[3]
        except ValueError:
            pass
    if base_path is not None and path != "/":
        if base_path.endswith("/"):
            if not path.endswith("/") and not re.search(FILE_TAIL, path.rsplit("/", 1)[1]):
                path += "/"
        elif path.endswith("/"):
            path = path.rstrip("/") or "/"
    drop = {*(TRACKERS if strip_trackers else ()), *strip_params}
    pairs = sorted(((k, v) for k, v in parse_qsl(query, keep_blank_values=True, separator="&") if k not in drop), key=lambda kv: kv[0].encode("utf-16-be", "surrogatepass"))
    text = urlencode(pairs, safe="*").replace("~", "%7E")
    return f"{scheme}://{_host(host, port)}{path}{'?' + text if text else ''}"


def same_origin(a: str, b: str) -> bool:
    try:
        return parse(a)[:3] == parse(b)[:3]
    except ValueError:
        return False


def under_base(url: str, base: str) -> bool:
    """Same scheme, host and port, and the path below the base's, whole segments."""
    try:
        u, b = parse(url), parse(base)
    except ValueError:
        return False
    return u[:3] == b[:3] and (u[3].rstrip("/") + "/" if u[3] != "/" else "/").startswith(b[3] if b[3].endswith("/") else b[3] + "/")


def absolute(href: str, page: str) -> str | None:
    """``href`` as seen from ``page``; null if it is no URL. Other schemes stay as they are."""
    href = href.strip("".join(map(chr, range(33))))
    try:
        if re.match(r"(?i)(?!https?:|ftp:|wss?:)[a-z][a-z0-9+.-]*:", href):
            return href
        scheme, host, port, path, query, fragment = parse(href, page)
    except ValueError:
        return None
    return f"{scheme}://{_host(host, port)}{path}{'?' + query.replace(' ', '%20') if query else ''}{'#' + fragment if fragment else ''}"


def glob_regex(pattern: str) -> str:
    """A regular expression for a path glob: ``**`` crosses slashes, ``*`` and ``?`` don't; braces
    are alternatives, brackets classes; a segment that begins with a dot wants a dot in the glob."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        fresh = i == 0 or pattern[i - 1] == "/"
        dotless = r"(?!\.)" if fresh else ""
        if pattern.startswith("**", i) and fresh and (i + 2 == len(pattern) or pattern[i + 2] == "/"):
            if i + 2 == len(pattern):
                out.append(r"(?:(?!\.)[^/]+(?:/(?!\.)[^/]+)*/?)?")
                i += 2
            else:
                out.append(r"(?:(?!\.)[^/]*/)*")
                i += 3
            continue
        if c == "*":
            while i + 1 < len(pattern) and pattern[i + 1] == "*":
                i += 1
            alone = fresh and (i + 1 == len(pattern) or pattern[i + 1] == "/")
            out.append(dotless + ("[^/]+" if alone and "/" not in pattern[:i] and len(pattern) == 1 else "[^/]*"))
        elif c == "?":
            out.append(dotless + "[^/]")
        elif c == "{" and "}" in pattern[i:]:
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[:1] in ("!", "^") else body).replace("\\", "\\\\") + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def match_patterns(path: str, patterns: list[str] | tuple[str, ...] | None) -> bool:
    """Whether a path matches one of the positive globs (if any) and none of the ``!`` ones."""
    positive, negative = _signed(patterns)
    return (not positive or any(re.search(p, path) for p in positive)) and not any(re.search(p, path) for p in negative)


def _signed(patterns) -> tuple[list[str], list[str]]:
    patterns = patterns or []

    def compiled(p: str) -> str:
        # a leading slash of the path is no hidden segment; "/" itself matches **/*
        return "^/?$|" + glob_regex(p) if p in ("**/*", "**") else glob_regex(p)

    return [compiled(p) for p in patterns if not p.startswith("!")], [compiled(p[1:]) for p in patterns if p.startswith("!")]


def excluded(path: str, patterns: list[str] | tuple[str, ...] | None) -> bool:
    """Whether exclude globs (with or without ``!``) take a path out."""
    return bool(patterns) and not match_patterns(path, ["**/*", *(p if p.startswith("!") else "!" + p for p in patterns)])


def _or_none(f, *args, **kwargs):
    try:
        return f(*args, **kwargs)
    except ValueError:
        return None


def normalized(url: Column, base: str | None = None, strip_trackers: bool = True, strip_params: tuple[str, ...] = ()) -> Column:
    """:func:`normalize` over Arrow batches; null where there is no URL."""

    def batch(urls: pd.Series) -> pd.Series:
        return urls.map(lambda u: None if u is None else _or_none(normalize, u, base, strip_trackers, strip_params))

    return F.pandas_udf(batch, "string")(url)


# ---- native expressions, for URLs whose parameters need no re-encoding


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def host_of(url: Column) -> Column:
    """Host and port, lower-cased, the default port dropped."""
    host = F.lower(F.regexp_replace(F.regexp_extract(url, _PARTS, 2), "^[^@]*@", ""))
    drop = F.when(scheme_of(url) == "http", F.regexp_replace(host, ":80$", "")).when(scheme_of(url) == "https", F.regexp_replace(host, ":443$", ""))
    return F.regexp_replace(F.coalesce(drop, host), ":$", "")


def path_of(url: Column) -> Column:
    path = F.regexp_extract(url, _PARTS, 3)
    return F.when(path == "", F.lit("/")).otherwise(path)


def origin_of(url: Column) -> Column:
    return F.concat(scheme_of(url), F.lit("://"), host_of(url))


def native_normalized(url: Column, base: str | None = None, strip_trackers: bool = True, strip_params: tuple[str, ...] = ()) -> Column:
    """:func:`normalize` in the JVM; null where there is no URL. Escapes are left as they are."""
    path = F.regexp_replace(path_of(url), r"/index\.html?$", "/")
    if base is not None:
        if parse(base)[3].endswith("/"):
            bare = ~path.endswith("/") & ~path.rlike(r"/[^/]*" + FILE_TAIL)
            path = F.when(bare, F.concat(path, F.lit("/"))).otherwise(path)
        else:
            stripped = F.regexp_replace(path, "/+$", "")
            path = F.when(stripped == "", F.lit("/")).otherwise(stripped)
    drop = [*(TRACKERS if strip_trackers else ()), *strip_params]
    query = F.regexp_replace(F.regexp_extract(url, _PARTS, 4), r"^\?", "")
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p, i: F.struct(
        F.regexp_extract(p, "^([^=]*)", 1).alias("k"), i.alias("i"), F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))).alias("p")))
    pairs = F.array_sort(F.filter(pairs, lambda x: ~x["k"].isin(drop)))
    text = F.array_join(F.transform(pairs, lambda x: x["p"]), "&")
    out = F.concat(origin_of(url), path, F.when(text != "", F.concat(F.lit("?"), text)).otherwise(""))
    return F.when(url.rlike(_PARTS) & (host_of(url) != ""), out)


def native_resolved(href: Column, page: Column) -> Column:
    """A link as its page ``page`` means it, in the JVM: absolute, or relative to the scheme, the host or the folder. Null
    for other schemes, and for links that only change the query or the fragment. Dots in paths are left as they are."""
    folder = F.regexp_replace(path_of(page), "[^/]*$", "")
    out = F.when(href.rlike("(?i)^https?://"), href).when(href.startswith("//"), F.concat(scheme_of(page), F.lit(":"), href))
    out = out.when(href.startswith("/"), F.concat(origin_of(page), href))
    return out.when(~href.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|[?#]|$)"), F.concat(origin_of(page), folder, href))


def native_same_origin(a: Column, b: Column) -> Column:
    return F.coalesce(a.rlike(_PARTS) & b.rlike(_PARTS) & (origin_of(a) == origin_of(b)), F.lit(False))


def native_under_base(url: Column, base: Column) -> Column:
    def slashed(p: Column) -> Column:
        return F.when(p.endswith("/"), p).otherwise(F.concat(p, F.lit("/")))

    return F.coalesce(native_same_origin(url, base) & slashed(path_of(url)).startswith(slashed(path_of(base))), F.lit(False))


def native_match_patterns(path: Column, patterns: list[str] | tuple[str, ...] | None) -> Column:
    positive, negative = _signed(patterns)
    out = F.lit(not positive)
    for p in positive:
        out |= path.rlike(p)
    for p in negative:
        out &= ~path.rlike(p)
    return out


def derive_name(url: Column) -> Column:
    """Host and path, without a trailing slash."""
    return F.concat(host_of(url), F.regexp_replace(path_of(url), "/$", ""))
