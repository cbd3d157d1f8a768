"""Joins of paths with the prefixes that cover them, as equal joins.

A path meets only those prefixes that it has: its beginnings are listed at the lengths that the prefixes of
its group (an origin) have at all, and joined by group and beginning. Nothing is compared with all
prefixes of a group, however many there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.robots import _escaped, parse_robots
from ..functions.urls import _PARTS, origin_of, path_of

RULES = "origin string, allow boolean, pattern string, head string, regex string"


def covered(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``paths(group, path)``, each once, with the columns of every row of ``prefixes(group, prefix, ...)`` that begins it."""
    lengths = prefixes.groupBy("group").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    at = paths.select("group", "path").distinct().join(lengths, "group").select("group", "path", F.explode("lengths").alias("length"))
    begun = at.where(F.col("length") <= F.length("path")).select("group", "path", F.substring(F.col("path"), F.lit(1), F.col("length")).alias("prefix"))
    return begun.join(prefixes, ["group", "prefix"])


def owning_site(urls: DataFrame, sites: DataFrame) -> DataFrame:
    """The first site (by id) whose base URL covers each URL: ``url, site_id``, null if none.

    A base covers its own path and what lies below it in whole segments, on its scheme, host and port.
    """
    slashed = lambda p: F.when(p.endswith("/"), p).otherwise(F.concat(p, F.lit("/")))
    place = lambda url: (origin_of(F.col(url)).alias("group"), slashed(path_of(F.col(url))))
    group, path = place("base_url")
    bases = sites.where(F.col("base_url").rlike(_PARTS)).select(group, path.alias("prefix"), "site_id").groupBy("group", "prefix").agg(F.min("site_id").alias("site_id"))
    group, path = place("url")
    held = urls.select("url", group, path.alias("path"))
    first = covered(held.where(F.col("url").rlike(_PARTS)), bases).groupBy("group", "path").agg(F.min("site_id").alias("site_id"))
    return held.join(first, ["group", "path"], "left").select("url", "site_id")


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """``RULES`` for ``agent`` of ``robots(origin, text)``: a row for each rule of the groups that concern it.

    ``head`` is the pattern up to its first wildcard or end mark, ``regex`` the rest as a regular expression, null if
    there is none.
    """

    def rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for origin, text in zip(batch["origin"], batch["text"]):
                for group in parse_robots(text)._for(agent):
                    for allow, pattern in group.rules:
                        head = re.match(r"[^*]*?(?=\*|\$?$)", pattern)[0]
                        end = pattern.endswith("$")
                        rest = ".*".join(re.escape(p) for p in pattern[len(head) :].removesuffix("$").split("*"))
                        rows.append((origin, allow, pattern, head, rest + ("$" if end else "") if rest or end else None))
            yield pd.DataFrame(rows, columns=["origin", "allow", "pattern", "head", "regex"])

    return robots.select("origin", "text").mapInPandas(rules, RULES)


def allowed(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """``urls(url, ...)`` with ``allowed``, for frontiers over many origins: the rules of each URL's origin decide.

    The longest rule that fits wins, Allow among equals; no rule, no text of the origin, and what is no URL: allowed.
    A URL meets the rules whose literal beginning it has; only these few are matched in full.
    """

    @F.pandas_udf("string")
    def escaped(path: pd.Series) -> pd.Series:
        return path.map(_escaped, na_action="ignore")

    held = urls.withColumn("group", origin_of(F.col("url")))
    query = F.regexp_extract("url", r"^[^?#]*(\?[^#]+)", 1)
    held = held.withColumn("path", F.when(F.col("url").rlike(_PARTS), F.concat(escaped(path_of(F.col("url"))), query)))
    rules = robots_rules(robots, agent).withColumnsRenamed({"origin": "group", "head": "prefix"})
    met = covered(held.where("path is not null"), rules)
    rest = F.expr("substring(path, length(prefix) + 1)")
    met = met.where(F.col("regex").isNull() | F.rlike(rest, F.concat(F.lit("^(?d:"), "regex", F.lit(")"))))
    best = met.groupBy("group", "path").agg(F.max_by("allow", F.struct(F.length("pattern"), "allow")).alias("allowed"))
    return held.join(best, ["group", "path"], "left").select(*urls.columns, F.coalesce("allowed", F.lit(True)).alias("allowed"))
