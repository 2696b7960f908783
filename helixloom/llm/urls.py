"""URL filter: every URL is expanded into host-suffix and path-prefix expressions, which meet the rules' expressions in an
equi-join on short hash prefixes; the full digest and then the rule's own path confirm a hit, and the longest rule decides. Column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX_BYTES = 4
DEFAULT = "allow"
# (host, path, action): fixed values of the registered query
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path from there up to ``? #`` or the end. Both empty for a
    null url or one without ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^[^?#]*", 0)
    return F.translate(host, *LOWER), path


def _folder(path: Column) -> Column:
    """The path up to and with its last slash; empty without one."""
    return F.regexp_extract(path, r"(?s)^.*/", 0)


def _digest(host: Column, folder: Column) -> Column:
    return F.unhex(F.sha2(F.concat(host, F.lit("\n"), folder), 256))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, action string")


def rule_expressions(rules: DataFrame) -> DataFrame:
    """A rule is looked up under its host and its path's folder; its short and full digest, and its place in the order of precedence: the
    longest host and path together, then the longer host, then block before allow. Rules with a null field are left out, repeated ones count once."""
    r = rules.select(F.translate("host", *LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("action").alias("r_action")).dropna().distinct()
    d = _digest(F.col("r_host"), _folder(F.col("r_path")))
    return r.withColumn("r_full", d).withColumn("r_short", F.substring(d, 1, PREFIX_BYTES)).withColumn(
        "r_rank", F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), (F.col("r_action") == "block").cast("int").alias("b")))


def reach(rules: DataFrame) -> tuple[int, int]:
    """Characters of the longest rule host and of the longest rule folder: nothing beyond them can meet a rule."""
    r = rules.agg(F.max(F.length("host")), F.max(F.length(_folder(F.col("path"))))).first()
    return r[0] or 0, r[1] or 0


def host_end(host: Column, longest: int) -> Column:
    """What follows a dot in it are the suffixes of the host at a label, as far as they are no longer than the longest rule host."""
    return F.when(F.length(host) <= longest, F.concat(F.lit("."), host)).otherwise(F.right(host, F.lit(longest + 1)))


def expressions(end: Column, start: Column) -> Column:
    """All (digest) expressions of a URL: each suffix of the host at a label, with each prefix of the path that ends in a slash, and with the
    empty prefix; from the host's end and the path's start that rules can reach."""
    labels = F.split(end, r"\.")
    suffixes = F.when(F.size(labels) > 1, F.transform(F.sequence(F.lit(2), F.greatest(F.size(labels), F.lit(2))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(F.array().cast("array<string>"))
    parts = F.split(start, "/")
    folders = F.when(F.size(parts) < 2, F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(folders, lambda f: _digest(s, f))))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row for each input row: ``rule`` is the deciding rule's host and path, a path of one slash
    or null; ``verdict`` its action, or allow without a rule.

    A URL is expanded from the end of its host and the start of its path, as long as the longest rule's: exact, and a URL of any length costs no more
    than the rules do. Distinct pairs of these are expanded, not rows, so a host with a third of all pages costs its distinct folders. A null or
    host-less url has no expression. Rules are broadcast only if the optimizer finds them small; else the join splits hot keys.
    """
    host, path = host_and_path(F.col(f"`{url}`"))
    longest, deepest = reach(rules)
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"_end": F.when(F.col("host") != "", host_end(F.col("host"), longest)).otherwise(""), "_start": _folder(F.substring("path", 1, deepest))})
    ex = rule_expressions(rules)
    # a rule's path beyond its folder can only be tested on the row's own path
    kinds = rows.where("_end <> ''").select("_end", "_start").distinct()
    seen = kinds.select("_end", "_start", F.explode(expressions(F.col("_end"), F.col("_start"))).alias("_full"))
    seen = seen.withColumn("_short", F.substring("_full", 1, PREFIX_BYTES))
    hits = seen.join(ex, seen["_short"] == ex["r_short"]).where(F.col("_full") == F.col("r_full"))
    hits = hits.groupBy("_end", "_start").agg(F.collect_list(F.struct("r_rank", "r_host", "r_path", "r_action")).alias("_rules"))  # at most one list entry for each rule of one host and folder
    out = rows.join(hits, ["_end", "_start"], "left")
    fits = F.filter("_rules", lambda r: F.startswith(F.col("path"), r["r_path"]))
    best = out.withColumn("_best", F.array_max(fits))
    return best.select("page_id", "host", "path", F.concat(F.col("_best.r_host"), F.col("_best.r_path")).alias("rule"), F.coalesce(F.col("_best.r_action"), F.lit(DEFAULT)).alias("verdict"))
