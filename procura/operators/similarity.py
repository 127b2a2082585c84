"""Exact similarity joins on distinct strings, planned as equi-joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def typo_pairs(
    queries: DataFrame,
    candidates: DataFrame,
    limit: Callable[[Column], Column],
    longest: Callable[[Column], Column],
) -> DataFrame:
    """Pairs (query, candidate, distance) with edit distance <= limit(length(query)).

    Both inputs have one column `key` of distinct, non-empty strings. Partition scheme of
    Pass-Join (Li et al., VLDB 2011): a candidate cut into k+1 segments must share one of
    them with the query, at a place shifted by no more than the edits on either side
    allow. Segments meet through an equi-join; no length band or cross product is built.
    `longest(n)` bounds the query lengths that may reach a candidate of length n.
    """
    cut = lambda i: F.floor(i * c("clen") / (c("k") + 1)).cast("int")
    n = F.length("key")
    kmax = limit(longest(n))
    segments = (
        candidates.select("key", n.alias("clen"), kmax.alias("kmax"), limit(F.greatest(F.lit(0), n - kmax)).alias("kmin"))
        .withColumn("k", F.explode(F.sequence("kmin", "kmax")))
        .withColumn("i", F.explode(F.sequence(F.lit(0), c("k"))))
        .select(
            c("key").alias("candidate"),
            "k",
            "clen",
            "i",
            F.substring("key", cut(c("i")) + 1, cut(c("i") + 1) - cut(c("i"))).alias("segment"),
        )
    )
    probes = (
        queries.select("key", F.length("key").alias("qlen"))
        .withColumn("k", limit(c("qlen")))
        .withColumn("clen", F.explode(F.sequence(F.greatest(F.lit(1), c("qlen") - c("k")), c("qlen") + c("k"))))
        .withColumn("i", F.explode(F.sequence(F.lit(0), c("k"))))
        .withColumns({"at": cut(c("i")), "size": cut(c("i") + 1) - cut(c("i")), "gap": c("qlen") - c("clen")})
        .withColumns(
            {
                "lo": F.greatest(F.lit(0), c("at") - F.floor((c("k") - c("gap")) / 2).cast("int")),
                "hi": F.least(c("qlen") - c("size"), c("at") + F.floor((c("k") + c("gap")) / 2).cast("int")),
            }
        )
        .where("hi >= lo")
        .withColumn("start", F.explode(F.sequence("lo", "hi")))
        .select(c("key").alias("query"), "k", "clen", "i", F.substring("key", c("start") + 1, c("size")).alias("segment"))
        .distinct()
    )
    return (
        probes.join(segments, ["k", "clen", "i", "segment"])
        .select("query", "candidate", "k")
        .distinct()
        .withColumn("distance", F.levenshtein("query", "candidate"))
        .where("distance <= k")
        .drop("k")
    )


def _words(key: Column) -> Column:
    return F.filter(F.split(key, " "), lambda w: w != "")


def subset_pairs(queries: DataFrame, candidates: DataFrame, max_extra: int = 2) -> DataFrame:
    """Pairs (query, candidate) where one word set holds the other.

    The raw word counts differ by 1..max_extra. The smaller side is looked up through its
    rarest word and the exact size of the larger side only, so a word that occurs in a
    third of all keys does not pair those keys with each other.
    """
    sides = {
        name: df.select("key", _words(c("key")).alias("words")).withColumn("n", F.size("words")).where("n >= 1")
        for name, df in (("q", queries), ("c", candidates))
    }
    exploded = {name: d.withColumn("word", F.explode(F.array_distinct("words"))) for name, d in sides.items()}
    frequency = (
        exploded["q"].select("word").unionByName(exploded["c"].select("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    )

    def inside(small: str, large: str) -> DataFrame:
        anchors = (
            exploded[small]
            .join(frequency, "word")
            .groupBy("key", "n")
            .agg(F.min(F.struct("df", "word"))["word"].alias("word"), F.first("words").alias("words"))
            .withColumn("ln", F.explode(F.sequence(c("n") + 1, c("n") + max_extra)))
            .select(c("key").alias("small"), c("words").alias("few"), "word", "ln")
        )
        holders = exploded[large].select(c("key").alias("large"), c("words").alias("many"), "word", c("n").alias("ln"))
        return anchors.join(holders, ["word", "ln"]).where(F.size(F.array_except("few", "many")) == 0)

    return (
        inside("q", "c")
        .select(c("small").alias("query"), c("large").alias("candidate"))
        .unionByName(inside("c", "q").select(c("large").alias("query"), c("small").alias("candidate")))
    )
