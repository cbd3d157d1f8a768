"""Allow and block URLs: by rules of hosts and paths, elsewhere by boosted trees on the URL's form.

The trees learn from labelled URLs; the registered query's labels are the verdicts of its rules. A
URL's features are lengths, depth, the share of digits, entropy, counts of parameters, and
statistics of its suffixes: of the host's last labels, of the path's first directory and of the
file's ending, how many URLs have them and which share of the labelled ones is blocked.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, cut, named

ALLOW, BLOCK = "allow", "block"
#: Rules of the registered query: verdict, host, path.
RULES = ((ALLOW, "org", "/"), (BLOCK, "example.org", "/es/"), (BLOCK, "example.org", "/en/1"), (ALLOW, "com", "/fr/"), (BLOCK, "com", "/de/"))
#: A list of rules up to this long is part of the plan's expressions; a longer one, or a table, is joined.
MOST_LITERAL = 64
#: Labelled URLs of each label that the trees are fitted on: the first in a hashed order.
SAMPLE = 20_000
#: Statistics leave out a fifth of the labels for the URLs of that fifth, so that none sees its own label.
FOLDS = 5
#: Labels that the general share weighs as much as.
PRIOR = 2.0
TREES, DEPTH, STEP = 20, 4, 0.2
#: Suffixes up to this many are broadcast with their statistics; more are joined.
BROADCAST_SUFFIXES = 100_000
SUFFIXES = ("tld", "site", "zone", "directory", "ending")
FORM = ("url_length", "host_length", "path_length", "depth", "labels", "digits", "entropy", "parameters", "query_length")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased, and from there up
    to ``?``, ``#`` or the end; both are empty without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    upper = "".join(map(chr, range(65, 91)))
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """``size, host_size, verdict, rule`` of the longest rule that fits, null if none does. A rule fits its host
    and all subdomains if the path starts with the rule's. Of equal lengths the longer host wins, of equal rules block."""
    found = []
    for verdict, h, p in rules:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found.append(F.when(fits, F.struct(F.lit(len(h + p)).alias("size"), F.lit(len(h)).alias("host_size"), F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))))
    none = F.lit(None).cast("struct<size:int,host_size:int,verdict:string,rule:string>")
    return F.array_max(F.array_compact(F.array(none, *found)))


def with_rules(df: DataFrame, rules: DataFrame) -> DataFrame:
    """``df(host, path, ...)`` with ``fit``, what :func:`rule_of` gives, for a table ``verdict, host, path`` of any size.

    Equal joins alone: a URL's host gives its endings (no longer than the rules' hosts), an ending that has rules
    gives the lengths of their paths, and these give the beginnings of the path that can be a rule's.
    """
    rules = rules.select(F.col("host").alias("ending"), F.col("path").alias("start"), "verdict").groupBy("ending", "start").agg(F.max("verdict").alias("verdict"))
    lengths = rules.groupBy("ending").agg(F.collect_set(F.length("start")).alias("lengths"))
    most = rules.agg(F.max(F.size(F.split("ending", r"\.")))).first()[0] or 1
    labels = F.split("host", r"\.")
    n = F.least(F.size(labels), F.lit(most))
    urls = df.select("host", "path").distinct().select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, -i, i), "."))).alias("ending"))
    starts = urls.join(lengths, "ending").select("host", "path", "ending", F.explode("lengths").alias("length")).where(F.col("length") <= F.length("path"))
    starts = starts.withColumn("start", F.substring(F.col("path"), F.lit(1), F.col("length")))
    text = F.concat("ending", "start")
    fit = F.struct(F.length(text).alias("size"), F.length("ending").alias("host_size"), F.col("verdict"), text.alias("rule"))
    fits = starts.join(rules, ["ending", "start"]).groupBy("host", "path").agg(F.max(fit).alias("fit"))
    return df.join(fits, ["host", "path"], "left")


def _entropy(text: Column) -> Column:
    """Bits of a character of ``text``."""
    chars = F.split(text, "")
    size = F.size(chars).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / size
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda sum_, c: sum_ - share(c) * F.log2(share(c)))


def featured(df: DataFrame, url: Column) -> DataFrame:
    """``df(host, path, ...)`` with the columns ``FORM`` and the suffixes ``SUFFIXES``."""
    url = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    count = lambda text, mark: (F.length(text) - F.length(F.replace(text, F.lit(mark)))).cast("double")
    last = lambda i: F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(i)), i), ".")
    form = {
        "url_length": F.length(url), "host_length": F.length("host"), "path_length": F.length("path"), "depth": count(F.col("path"), "/"), "labels": F.size(labels),
        "digits": F.when(url == "", 0.0).otherwise(F.length(F.regexp_replace(url, "[^0-9]", "")) / F.length(url)), "entropy": F.when(url == "", 0.0).otherwise(_entropy(url)),
        "parameters": F.size(F.filter(F.split(query, "&"), lambda p: p != "")), "query_length": F.length(query),
    }
    first = F.regexp_extract("path", "^/([^/]*)/", 1)
    suffix = {"tld": last(1), "site": last(2), "zone": last(3), "directory": first, "ending": F.regexp_extract("path", r"\.([^./]*)$", 1)}
    return df.select("*", *(c.cast("double").alias(n) for n, c in form.items()), *(F.xxhash64(c).alias(n) for n, c in suffix.items()))


@dataclass
class UrlModel:
    """Boosted trees and the statistics of suffixes that they look at; without both labels, the only one's share."""

    trees: GBTClassificationModel | None
    stats: DataFrame
    few: bool
    share: float

    def features(self, df: DataFrame, fold: Column | None = None) -> DataFrame:
        """Features of ``featured`` URLs as one vector, the statistics without the labels of ``fold``."""
        out, names = df, list(FORM)
        for kind in SUFFIXES:
            of = self.stats.where(F.col("kind") == kind).select(F.col("suffix").alias(kind), F.struct("n", "labelled", "blocked", "by_fold").alias(f"of_{kind}"))
            out = out.join(F.broadcast(of) if self.few else of, kind, "left")
            own = F.col(f"of_{kind}.by_fold")[fold] if fold is not None else None
            known, bad = (F.col(f"of_{kind}.{c}") - (own[c] if own is not None else 0) for c in ("labelled", "blocked"))
            bad, known = F.coalesce(bad, F.lit(0)), F.coalesce(known, F.lit(0))
            out = out.withColumn(f"{kind}_share", (bad + PRIOR * self.share) / (known + PRIOR)).withColumn(f"{kind}_count", F.log1p(F.coalesce(F.col(f"of_{kind}.n"), F.lit(0))))
            out = out.drop(f"of_{kind}")
            names += [f"{kind}_share", f"{kind}_count"]
        return VectorAssembler(inputCols=names, outputCol="features").transform(out)

    def scored(self, df: DataFrame) -> DataFrame:
        """``df`` of ``featured`` URLs with ``score``, the probability of block."""
        if self.trees is None:
            return df.withColumn("score", F.lit(self.share))
        return self.trees.transform(self.features(df)).withColumn("score", vector_to_array("probability")[1])


def _statistics(urls: DataFrame) -> DataFrame:
    """``kind, suffix, n, labelled, blocked, by_fold`` of the suffixes of ``urls(SUFFIXES, label, fold)``."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("suffix")) for k in SUFFIXES)))
    known, bad = F.count("label"), F.sum(F.coalesce("label", F.lit(0.0)))
    by_fold = [F.struct(F.count(F.when(F.col("fold") == i, F.col("label"))).alias("labelled"), F.sum(F.when(F.col("fold") == i, F.coalesce("label", F.lit(0.0))).otherwise(0.0)).alias("blocked")) for i in range(FOLDS)]
    return urls.select("label", "fold", kinds.alias("of")).groupBy("of.kind", "of.suffix").agg(F.count(F.lit(1)).alias("n"), known.alias("labelled"), bad.alias("blocked"), F.array(*by_fold).alias("by_fold"))


def fit(urls: DataFrame, broadcast_suffixes: int = BROADCAST_SUFFIXES, sample: int = SAMPLE) -> UrlModel:
    """A model of ``urls(url, host, path, label)``, label 1 for block, 0 for allow, null for unknown. Statistics are
    those of all URLs; the trees are fitted on ``sample`` distinct ones of each label at most."""
    fold = F.pmod(F.xxhash64("url", F.lit(7)), F.lit(FOLDS)).cast("int")
    narrow = featured(urls.select("url", "host", "path", "label"), F.col("url")).withColumn("fold", fold)
    stats = cut(_statistics(narrow))
    # every URL has one suffix of a kind, so one kind's sums are all URLs'
    known = stats.where(F.col("kind") == "tld").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("bad")).first()
    n, bad = known["n"] or 0, known["bad"] or 0.0
    model = UrlModel(None, stats, stats.count() <= broadcast_suffixes, bad / n if n else 0.0)
    if not 0 < bad < n:
        return model
    labelled = urls.where(F.col("label").isNotNull()).select("url", "label")
    chosen = bounded_sample(labelled.groupBy("url").agg(F.max("label").alias("label")).select(F.col("url").alias("id"), "label"), sample, 11, 2)
    host, path = host_and_path(F.col("url"))
    rows = featured(chosen.select(F.col("id").alias("url"), "label").select("*", host.alias("host"), path.alias("path")), F.col("url"))
    rows = model.features(rows.withColumn("fold", fold), F.col("fold")).select("url", "features", "label")
    # a bounded number of rows: one partition, in one order, so that sums of doubles come out alike
    rows = cut(rows.repartition(1).sortWithinPartitions("url").select("features", "label"))
    model.trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=1).fit(rows)
    return model


def judged(df: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, url_col: str = "url", labels: DataFrame | None = None, broadcast_suffixes: int = BROADCAST_SUFFIXES) -> DataFrame:
    """``df`` with ``host, path, rule, verdict, score``: the longest rule's verdict, else the trees' (block from a
    ``score`` of 0.5 on; ``score`` is theirs in every row).

    ``labels(url, label)`` are URLs to learn from (1: block); without them the URLs that rules decide are. A null URL
    and one without ``://`` have an empty host and path, no rule, and get the trees' verdict like any other. Without
    labels of both kinds the score is the share of blocked ones, 0 if there are none. Repeated rows are judged alike, and learned
    from once. Columns that are called like the new ones are replaced, others kept; an empty table gives no rows.
    """
    new = ("host", "path", "rule", "verdict", "score")
    rows = df.select(F.struct(*(named(c) for c in df.columns if c.lower() not in new)).alias("row"), named(url_col).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.select("row", "url", host.alias("host"), path.alias("path"))
    if isinstance(rules, DataFrame) or len(rules) > MOST_LITERAL:
        table = rules if isinstance(rules, DataFrame) else df.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")
        rows = with_rules(rows, table)
    else:
        rows = rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    of_rule = F.when(F.col("fit.verdict") == BLOCK, 1.0).when(F.col("fit.verdict") == ALLOW, 0.0)
    if labels is None:
        known = rows.select("url", "host", "path", of_rule.alias("label"))
    else:
        given = labels.select(F.col("url").cast("string"), F.col("label").cast("double")).groupBy("url").agg(F.max("label").alias("label"))
        known = rows.select("url").union(given.select("url")).distinct().join(given, "url", "left").select("url", host.alias("host"), path.alias("path"), "label")
    model = fit(known, broadcast_suffixes)
    out = model.scored(featured(rows, F.col("url")))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("score") >= 0.5, BLOCK).otherwise(ALLOW))
    kept = [c for c in df.columns if c.lower() not in new]
    return out.select(*(F.col("row")[c].alias(c) for c in kept), "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.col("score"))
