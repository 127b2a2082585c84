"""URL filtering against dated lists: an entry counts for a capture if it was active at fetch time.

List entries (kind, pattern, action, day) add or remove a pattern on a day. Per pattern the
last action of each day counts, and days become validity intervals [day, next day with an
entry). Kinds: `domain` matches a host and everything below it, `host` the host alone,
`prefix` the host and leading whole path segments, none for a host alone; empty segments do
not count.

A capture's url is turned into all patterns it could match; an equality join with the
intervals, cut at year ends so that a join key holds at most a year of days, leaves the
interval that contains the fetch day. Only years in which something was fetched are made. Captures are first reduced to distinct (url, day), so
a host with a third of all captures costs its distinct urls only.

Defined cases: a null or unparsable url or a null fetch day matches nothing and is not
blocked; entries with a null pattern, kind, action or day are void; of several actions of
one pattern on one day `remove` wins; repeated captures come back as often as they came in;
an empty list blocks nothing. All columns of the captures are kept; those named like an
output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FOREVER = "9999-12-31"
#: fixed values: kinds by how specific they are
KINDS = ("domain", "host", "prefix")


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, pattern, valid_from, valid_to): days on which a pattern is listed, valid_to excluded."""
    days = (
        entries.where("kind is not null and pattern is not null and day is not null and action in ('add', 'remove')")
        .groupBy("kind", F.lower("pattern").alias("pattern"), F.col("day").cast("date").alias("day"))
        .agg(F.max("action").alias("action"))  # 'remove' sorts after 'add'
    )
    order = Window.partitionBy("kind", "pattern").orderBy("day")
    following = F.coalesce(F.lead("day").over(order), F.lit(FOREVER).cast("date"))
    return days.select("kind", "pattern", "action", F.col("day").alias("valid_from"), following.alias("valid_to")).where("action = 'add'").drop("action")


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def _keys(depth: int) -> Column:
    """(kind, pattern) structs a url could match; `depth` is the longest listed prefix in segments."""
    labels = F.split("_host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.regexp_extract("url", r"^[^:]+://[^/?#]*/([^?#]*)", 1)
    segments = F.slice(F.filter(F.split(path, "/"), lambda s: s != ""), 1, max(1, depth))
    prefixes = F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(max(1, depth))), lambda i: i <= F.size(segments)),
        lambda i: F.lower(F.concat_ws("/", F.col("_host"), F.array_join(F.slice(segments, 1, i), "/"))),
    )
    both = [F.transform(parents, lambda p: F.struct(F.lit("domain").alias("kind"), p.alias("pattern")))]
    both.append(F.array(F.struct(F.lit("host").alias("kind"), F.col("_host").alias("pattern"))))
    both.append(F.array(F.struct(F.lit("prefix").alias("kind"), F.col("_host").alias("pattern"))))
    if depth:
        both.append(F.transform(prefixes, lambda p: F.struct(F.lit("prefix").alias("kind"), p.alias("pattern"))))
    return F.concat(*both)


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """`captures` (url, fetched: date, ...) with blocked, matched_kind, matched_pattern, listed_since and n_matches.

    The reported entry is the most specific one: prefix before host before domain, then the longest pattern.
    """
    listed = intervals(entries)
    parts = listed.where("kind = 'prefix'").agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 0
    # one number a year of the captures reaches the driver
    fetched = captures.select(F.year(F.col("fetched").cast("date")).alias("year")).where("year is not null").distinct()
    years = F.array(*(F.lit(y) for y in sorted(r.year for r in fetched.collect()))).cast("array<int>")
    years = F.filter(years, lambda y: y.between(F.year("valid_from"), F.year("valid_to")))
    listed = listed.where("valid_from < valid_to").withColumn("year", F.explode(years))
    new = ("blocked", "matched_kind", "matched_pattern", "listed_since", "n_matches")
    kept = [c for c in captures.columns if c not in new]
    asked = captures.select("url", F.col("fetched").cast("date").alias("day")).distinct().withColumn("_host", host_of(F.col("url")))
    keys = asked.where("_host is not null and day is not null").select("url", "day", F.explode(_keys(parts)).alias("k"))
    keys = keys.select("url", "day", "k.kind", "k.pattern", F.year("day").alias("year")).distinct()
    active = keys.join(listed, ["kind", "pattern", "year"]).where("valid_from <= day and day < valid_to")
    rank = F.when(F.col("kind") == "prefix", 2).when(F.col("kind") == "host", 1).otherwise(0)
    verdict = active.groupBy("url", "day").agg(
        F.count(F.lit(1)).alias("n_matches"),
        F.max(F.struct(rank.alias("rank"), F.length("pattern").alias("size"), "pattern", "kind", "valid_from")).alias("best"),
    )
    return (
        captures.select(*kept)
        .withColumn("_day", F.col("fetched").cast("date"))
        .join(verdict.select(F.col("url").alias("_url"), F.col("day").alias("_vday"), "n_matches", "best"), (F.col("url") == F.col("_url")) & (F.col("_day") == F.col("_vday")), "left")
        .select(
            *kept,
            F.col("n_matches").isNotNull().alias("blocked"),
            F.col("best.kind").alias("matched_kind"),
            F.col("best.pattern").alias("matched_pattern"),
            F.col("best.valid_from").alias("listed_since"),
            F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"),
        )
    )
