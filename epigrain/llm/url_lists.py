"""URL filters over dated lists: entries become validity intervals, and every capture is judged as of its fetch time.

A list entry says that a pattern was added to or removed from a list at some time. Patterns are hosts (which cover their
subdomains) or directories of a host (which cover what lies below). Each pattern's entries become intervals [since, until); the last
one is open. A capture's URL yields the keys that could match it, its host's suffixes and its path's directories, and the as-of join
keeps the intervals that hold its fetch time. A capture is blocked if a block list is active for it and no allow list is.

Keys are made only as deep as the deepest pattern, so a URL with thousands of parts costs no more than any other. Rows carry no page
content. A key that a third of all captures share is split by the engine's skewed-join handling; the sums per capture have a key each.

Null URLs and URLs without a host match nothing; a capture without fetch time matches nothing. Entries with a null pattern, time or
action are void. Entries that repeat count once; if a pattern is added and removed at the same time, it is removed. Rows that repeat
a capture are judged each by itself. Empty lists block nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

HOST = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def intervals(entries: DataFrame) -> DataFrame:
    """(list_name, allows, pattern, since, until) from entries (list_name, allows, pattern, action, at)."""
    known = entries.where("pattern IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')")
    dated = known.groupBy("list_name", "allows", F.lower("pattern").alias("pattern"), "at").agg(F.max("action").alias("action"))
    order = Window.partitionBy("list_name", "allows", "pattern").orderBy("at")
    spans = dated.withColumn("until", F.lead("at").over(order)).where("action = 'add'")
    return spans.select("list_name", "allows", "pattern", F.col("at").alias("since"), "until")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def url_keys(url: Column, labels: int, directories: int) -> Column:
    """The patterns that could match a URL: suffixes of its host of up to ``labels`` labels, and its first ``directories`` directories."""
    host = host_of(url)
    parts = F.split(host, r"\.")
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(max(labels, 1)))), lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."))
    pieces = F.split(F.lower(F.regexp_extract(url, PATH, 1)), "/")
    deep = F.least(F.size(pieces) - 2, F.lit(directories))  # what follows the last slash is no directory
    prefixes = F.when(
        deep >= 1,
        F.transform(F.sequence(F.lit(1), F.greatest(deep, F.lit(1))), lambda k: F.concat(host, F.array_join(F.slice(pieces, 1, k + 1), "/"), F.lit("/"))),
    ).otherwise(F.array().cast("array<string>"))
    return F.when(F.coalesce(host, F.lit("")) != "", F.array_distinct(F.concat(suffixes, prefixes))).otherwise(F.array().cast("array<string>"))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, url, fetched_at, blocked, n_block, n_allow, lists) per capture (page_id, url, fetched_at)."""
    spans = intervals(entries)
    path = F.regexp_extract("pattern", "/.*", 0)
    deepest = spans.agg(
        F.max(F.size(F.split(F.regexp_extract("pattern", "^[^/]*", 0), r"\."))).alias("labels"), F.max(F.size(F.split(path, "/")) - 2).alias("directories")
    ).first()
    rows = captures.select("page_id", "url", "fetched_at").withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "captures")  # a repeated task then gives a row the number it had
    keys = rows.select("row", "fetched_at", F.explode(url_keys(F.col("url"), deepest.labels or 1, max(deepest.directories or 0, 0))).alias("pattern"))
    active = keys.join(spans, "pattern").where("fetched_at >= since AND (until IS NULL OR fetched_at < until)")
    told = active.groupBy("row").agg(
        F.count_if(~F.col("allows")).alias("n_block"), F.count_if("allows").alias("n_allow"), F.array_join(F.sort_array(F.collect_set("list_name")), ",").alias("lists")
    )
    n_block, n_allow = F.coalesce("n_block", F.lit(0).cast("long")), F.coalesce("n_allow", F.lit(0).cast("long"))
    return rows.join(told, "row", "left").select(
        "page_id", "url", "fetched_at", ((n_block > 0) & (n_allow == 0)).alias("blocked"), n_block.alias("n_block"), n_allow.alias("n_allow"), F.coalesce("lists", F.lit("")).alias("lists")
    )
