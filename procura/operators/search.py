"""Typo-tolerant catalogue search whose work stays bounded by what its first results need.

The catalogue is dealt into small chunks of neighbouring names. A word or bigram that occurs
in a third of all names is then a list of chunks, never one key with all those rows. Each
query reads its chunks in the order of the best result they could still hold and stops once
its last listed result beats all that is left, which is exact (threshold algorithm, Fagin et
al., PODS 2001). All queries advance together in rounds of growing budgets.

`browse.search_products` gives the same lists in one pass: quicker for catalogues of some
ten thousand names, but it compares all names that share a query's rarest word.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procura.functions.once import add_once
from procura.functions.text import search_typo_limit, word_tokens
from procura.operators.browse import firsts_of_names
from procura.operators.match import ANY_SECTOR
from procura.operators.similarity import typo_pairs
from procura.session import cut_lineage

c = F.col
RESULTS = 8
CHUNK = 256
FIRST_BUDGET = 1024
GROWTH = 16
_ASKED = ["query", "asked_sector"]


def _grams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters; none for texts of fewer than two."""
    starts = F.when(F.length(text) >= 2, F.sequence(F.lit(1), F.length(text) - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.concat(F.lit("g:"), F.substring(F.lower(text), i, F.lit(2)))))


def _words(text: Column) -> Column:
    return F.array_distinct(word_tokens(text))


def _dealt(products: DataFrame, limit: int) -> DataFrame:
    """Active products that a list of `limit` may hold, with the chunk of names they lie in."""
    active = products.where(c("status") == "ACTIVE").select("product_id", F.coalesce("standard_name", F.lit("")).alias("standard_name"), "sector")
    active = cut_lineage(firsts_of_names(active, limit, "sector", "standard_name"))
    ranges = int(products.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = active.repartitionByRange(ranges, "standard_name", "product_id").withColumn("_range", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("_range").orderBy("standard_name", "product_id"))
    return ranged.withColumn("chunk", c("_range").cast("long") * (1 << 40) + F.floor(place / CHUNK)).drop("_range")


def _nearest(d: DataFrame) -> DataFrame:
    """Whether each (query, q_words, standard_name, words) is a hit and how near: `exact`, `distance`.

    Every query word's nearest word is sought once a row, among words of a length that may lie within its limit.
    """

    def nearest(q: Column) -> Column:
        most = search_typo_limit(F.length(q))
        inside = F.filter("words", lambda w: F.abs(F.length(w) - F.length(q)) <= most)
        near = F.array_min(F.transform(inside, lambda w: F.levenshtein(q, w)))
        return F.when(near <= most, near)

    # the sum is null as soon as one word has nothing near
    summed = F.aggregate(F.transform("q_words", nearest), F.when(F.size("q_words") > 0, 0), lambda a, b: a + b)
    d = d.withColumn("exact", F.lower("standard_name").contains(F.lower("query")))
    d = add_once(d, "distance", F.when(c("exact"), 0).otherwise(summed))
    return d.where("distance is not null").drop("q_words", "words")


def _probes(asked: DataFrame, cells: DataFrame) -> DataFrame:
    """Keys each query looks up, with the least (tier, distance) a name found there can have.

    A containing name holds the query's rarest bigram. A name within the limits of all words
    holds a word near the one with the fewest such names; what the other words add is at
    least the distance to their nearest word of the whole catalogue.
    """
    rows_of = cells.groupBy("key").agg(F.sum("n").alias("reach"))
    grams = asked.select(*_ASKED, F.explode(_grams(c("query"))).alias("key")).join(rows_of, "key", "left")
    # a bigram without names ends the search for containing names
    rarest = grams.groupBy(*_ASKED).agg(F.min_by("key", F.struct(F.coalesce("reach", F.lit(0)), "key")).alias("key"))
    exact = rarest.withColumns({"tier": F.lit(0), "least": F.lit(0)})

    words = asked.select(*_ASKED, F.explode(_words(c("query"))).alias("word"))
    vocabulary = rows_of.where(c("key").startswith("w:"))
    pairs = typo_pairs(
        words.select(c("word").alias("key")).distinct(),
        vocabulary.select(F.substring("key", 3, 1 << 30).alias("key")),
        search_typo_limit,
        lambda n: F.floor((n + 1) * 3 / 2).cast("int") + 2,
    )
    near = cut_lineage(pairs.select(c("query").alias("word"), F.concat(F.lit("w:"), c("candidate")).alias("key"), "distance"))
    weight = near.join(vocabulary, "key").groupBy("word").agg(F.sum("reach").alias("reach"), F.min("distance").alias("nearest"))
    # a word without near names leaves nothing to find
    start = (
        words.join(weight, "word", "left")
        .groupBy(*_ASKED)
        .agg(
            F.min_by(F.struct("word", "nearest"), F.struct("reach", "word")).alias("rare"),
            F.sum("nearest").alias("all"),
            F.bool_and(c("nearest").isNotNull()).alias("open"),
        )
        .where("open")
        .select(*_ASKED, c("rare.word").alias("word"), (c("all") - c("rare.nearest")).alias("others"))
    )
    typo = start.join(near, "word").select(*_ASKED, "key", F.lit(1).alias("tier"), (c("distance") + c("others")).cast("int").alias("least"))
    return exact.unionByName(typo)


def search_products(products: DataFrame, queries: DataFrame, limit: int = RESULTS, first_budget: int = FIRST_BUDGET) -> DataFrame:
    """Best `limit` products of every query at once: (query, asked_sector, rank, product_id, standard_name, exact, distance).

    Names that contain the query come first, by name; then names in which every query word
    has a word within its limit, by summed distance, name and id. `queries` may carry a
    `sector` that narrows the catalogue; null or `ANY_SECTOR` searches all of it. Queries
    of fewer than two characters find nothing; repeated ones are answered once. `limit`
    is the list's length; the catalogue is searched whole.
    """
    sector = F.coalesce("sector", F.lit(ANY_SECTOR)) if "sector" in queries.columns else F.lit(ANY_SECTOR)
    asked = queries.select(F.trim("query").alias("query"), sector.alias("asked_sector")).where(F.length("query") >= 2).distinct()
    dealt = cut_lineage(_dealt(products, limit))
    name = c("standard_name")
    keys = F.concat(F.transform(_words(name), lambda w: F.concat(F.lit("w:"), w)), _grams(name))
    postings = dealt.select(F.explode(keys).alias("key"), "sector", "chunk", "product_id")
    firsts = dealt.groupBy("sector", "chunk").agg(F.min("standard_name").alias("first_name"))
    cells = postings.groupBy("key", "sector", "chunk").agg(F.count(F.lit(1)).alias("n"))
    at_first = cells.sector.eqNullSafe(firsts.sector) & (cells.chunk == firsts.chunk)
    cells = cut_lineage(cells.join(firsts, at_first).select("key", cells.sector, cells.chunk, "n", "first_name"))

    bound = F.struct("tier", "least", "first_name")
    in_sector = (c("asked_sector") == ANY_SECTOR) | (c("asked_sector") == c("sector"))
    probes = cut_lineage(_probes(asked, cells))
    # of the catalogue's words and bigrams only those that some query looks up are stored
    postings = cut_lineage(postings.join(probes.select("key").distinct(), "key", "left_semi"))
    units = probes.join(cells, "key").where(in_sector)
    earlier = Window.partitionBy(*_ASKED).orderBy("tier", "least", "first_name", "key", "sector", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    units = units.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    late = F.floor(F.log(c("before") / first_budget) / log(GROWTH)) + 1
    units = cut_lineage(units.withColumn("round", F.when(c("before") < first_budget, 0).otherwise(late).cast("int")))

    ordered = Window.partitionBy(*_ASKED).orderBy(c("exact").desc(), "distance", "standard_name", "product_id")
    texts = dealt.select("product_id", "standard_name", word_tokens(name).alias("words"))
    hits = None
    for number in range((units.agg(F.max("round").alias("n")).first()["n"] or 0) + 1):
        todo = units.where(c("round") == number)
        if hits is not None:
            last = hits.where(c("rank") == limit).select(*_ASKED, F.struct(F.when(c("exact"), 0).otherwise(1), "distance", "standard_name").alias("last"))
            todo = todo.join(last, _ASKED, "left").where(c("last").isNull() | (bound <= c("last")))
        todo = todo.select(*_ASKED, "key", "sector", "chunk").withColumn("q_words", word_tokens(c("query")))
        same = (todo.key == postings.key) & (todo.chunk == postings.chunk) & todo.sector.eqNullSafe(postings.sector)
        reached = todo.join(postings, same).select(*_ASKED, "q_words", "product_id").distinct()
        found = _nearest(reached.join(texts, "product_id")).select(*_ASKED, "product_id", "standard_name", "exact", "distance")
        if hits is not None:
            found = found.unionByName(hits.drop("rank")).distinct()
        hits = cut_lineage(found.withColumn("rank", F.row_number().over(ordered)).where(c("rank") <= limit))
    return hits.select(*_ASKED, "rank", "product_id", "standard_name", "exact", "distance")
