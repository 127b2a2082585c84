"""Catalogue search, offer browsing, supplier and warehouse lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procura.functions.text import is_safe_expiration, search_typo_limit, word_tokens
from procura.operators.pricing import is_measured, latest_files
from procura.operators.similarity import typo_pairs
from procura.session import cut_lineage

c = F.col
SEARCH_RESULTS = 8
SORTS = {"product": "standard_name", "laboratory": "laboratory_name", "unitPrice": "unit_price", "availability": "availability"}


def supplier_overview(suppliers: DataFrame, offers: DataFrame, files: DataFrame, sector: str | None = None, name: str | None = None) -> DataFrame:
    """Active suppliers with current offer count and last upload; sort by name to show."""
    latest = latest_files(files)
    # counts per (supplier, file) first: no row-level join, no hot supplier
    per_file = offers.where(c("status") == "ACTIVE").groupBy("supplier_id", "source_file_id").agg(F.count(F.lit(1)).alias("n"))
    counted = (
        per_file.join(latest.select("supplier_id", "latest_file_id"), "supplier_id", "left")
        .where(c("source_file_id").isNull() | (c("source_file_id") == c("latest_file_id")))
        .groupBy("supplier_id")
        .agg(F.sum("n").alias("offer_count"))
    )
    shown = suppliers.where(c("status") == "ACTIVE")
    if sector is not None:
        shown = shown.where(F.array_contains("sectors", sector))
    if name:
        shown = shown.where(F.lower("supplier_name").contains(name.lower()))
    return (
        shown.join(counted, "supplier_id", "left")
        .join(latest, "supplier_id", "left")
        .select("supplier_id", "supplier_name", "sectors", F.coalesce("offer_count", F.lit(0)).alias("offer_count"), "latest_processed_at", "latest_file_name")
    )


def browse_offers(offers: DataFrame, supplier_id: str, text: str = "") -> DataFrame:
    """One supplier's current offers (enriched, strict rule), optionally filtered by text."""
    d = offers.where(c("supplier_id") == supplier_id)
    if text.strip():
        q = text.strip().lower()
        d = d.where(
            F.lower("standard_name").contains(q)
            | F.lower("active_ingredient").contains(q)
            | F.coalesce(F.lower("supplier_product_code").contains(q), F.lit(False))
        )
    measured = is_measured(c("presentation_unit"))
    return d.withColumns(
        {
            "purchase_quantity": F.when(measured, 1).otherwise(c("presentation_quantity")),
            "purchase_unit": F.when(measured, "unidad").otherwise(c("presentation_unit")),
            "expires_soon": c("expiration_label").isNotNull() & ~is_safe_expiration(c("expiration_label")),
        }
    )


def _page_order(sort: str, descending: bool) -> list[Column]:
    field = SORTS.get(sort, SORTS["product"])
    key = c(field) if field == "unit_price" else F.collate(F.coalesce(c(field), F.lit("")), "es_CI_AI")
    return [key.desc() if descending else key.asc(), c("offer_id").asc()]


def _page_bounds(page: int, limit: int) -> tuple[int, int]:
    size = min(200, max(1, limit))
    return (max(1, page) - 1) * size, size


def offers_page(rows: DataFrame, sort: str = "product", descending: bool = False, page: int = 1, limit: int = 50) -> DataFrame:
    """One page; text sorts use Spanish order without case or accents, ties by offer id."""
    first, size = _page_bounds(page, limit)
    return rows.orderBy(*_page_order(sort, descending)).offset(first).limit(size)


def ranked_page(rows: DataFrame, sort: str = "product", descending: bool = False, page: int = 1, limit: int = 50) -> tuple[DataFrame, int]:
    """The same page with `position` (from 1) among all rows, and the number of rows; for pages at any depth.

    Rows are dealt into ranges of the order and counted; only the ranges that the page
    touches are sorted, so a deep page neither sorts all rows nor passes those before it
    through one task. One count a range reaches the driver.
    """
    first, size = _page_bounds(page, limit)
    order = _page_order(sort, descending)
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    counts = {r["_range"]: r["n"] for r in dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = {}, 0
    for number in sorted(counts):
        starts[number], total = total, total + counts[number]
    touched = [n for n in starts if starts[n] < first + size and starts[n] + counts[n] > first]
    skipped = starts[touched[0]] if touched else 0
    inside = dealt.where(c("_range").isin(touched)).orderBy(*order).offset(first - skipped if touched else 0).limit(size)
    # at most 200 rows are numbered
    place = F.row_number().over(Window.orderBy(*order)) + first
    return inside.withColumn("position", place.cast("long")).drop("_range"), total


def firsts_of_names(products: DataFrame, limit: int, *name: str) -> DataFrame:
    """Of products alike in `name` the `limit` with the smallest ids; lists that end ties by id and hold `limit` rows need no more."""
    w = Window.partitionBy(*name).orderBy("product_id")
    return products.withColumn("_place", F.row_number().over(w)).where(c("_place") <= limit).drop("_place")


def search_products(products: DataFrame, queries: DataFrame, limit: int = SEARCH_RESULTS) -> DataFrame:
    """Typo-tolerant catalogue search for many queries at once: (query, rank, product_id, ..).

    Substring hits come first by name, then products in which every query word has a word
    within its limit, by summed distance. Typo hits start from the query's rarest matching
    word only; the other words are checked on that row. The catalogue is searched whole: of
    products with one name those behind `limit` others are in no list and are left out first.
    The catalogue's side of a join is shuffled, never broadcast.
    """
    active = products.where(c("status") == "ACTIVE").select("product_id", "standard_name")
    active = cut_lineage(firsts_of_names(active, limit, "standard_name"))
    asked = queries.select(F.trim("query").alias("query")).where(F.length("query") >= 2).distinct()
    lists = asked.withColumn("q_words", word_tokens(c("query"))).where(F.size("q_words") > 0)
    q_words = lists.select("query", "q_words", F.explode(F.array_distinct("q_words")).alias("q_word"))
    tokens = active.withColumn("words", word_tokens(c("standard_name")))
    postings = tokens.select("product_id", "standard_name", "words", F.explode(F.array_distinct("words")).alias("word"))
    vocabulary = cut_lineage(postings.groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    near = typo_pairs(
        q_words.select(c("q_word").alias("key")).distinct(),
        vocabulary.select(c("word").alias("key")),
        search_typo_limit,
        lambda n: F.floor((n + 1) * 3 / 2).cast("int") + 2,
    )
    near = cut_lineage(near.select(c("query").alias("q_word"), c("candidate").alias("word")))
    weight = near.join(vocabulary, "word").groupBy("q_word").agg(F.sum("df").alias("reach"))
    rarest = (
        q_words.join(weight, "q_word", "left")
        .groupBy("query")
        .agg(F.min_by(F.struct("q_word", "q_words"), F.struct(F.coalesce("reach", F.lit(0)), "q_word")).alias("r"))
        .select("query", "r.q_word", "r.q_words")
    )
    reached = rarest.join(near, "q_word").join(postings.hint("merge"), "word").select("query", "q_words", "product_id", "standard_name", "words").distinct()
    best = F.transform("q_words", lambda q: F.struct(
        F.array_min(F.transform("words", lambda w: F.levenshtein(q, w))).alias("d"), search_typo_limit(F.length(q)).alias("k")))
    typo = (
        reached.withColumn("best", best)
        .where(F.forall("best", lambda b: b["d"] <= b["k"]))
        .withColumn("distance", F.aggregate("best", F.lit(0), lambda a, b: a + b["d"]))
        .withColumn("exact", F.lower("standard_name").contains(F.lower("query")))
        .select("query", "product_id", "standard_name", "exact", "distance")
    )
    # a substring need not be a whole word, so exact hits are looked up on their own
    exact = substring_hits(active, asked).withColumns({"exact": F.lit(True), "distance": F.lit(0)})
    both = exact.unionByName(typo.where(~c("exact")))
    w = Window.partitionBy("query").orderBy(c("exact").desc(), "distance", "standard_name", "product_id")
    return both.withColumn("rank", F.row_number().over(w)).where(c("rank") <= limit)


def substring_hits(active: DataFrame, asked: DataFrame, gram: int = 2) -> DataFrame:
    """Products whose name contains the query, found through the query's rarest bigram.

    Any containing name holds every bigram of the query, so an equi-join on one of them is
    complete.
    """
    grams = lambda col: F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.length(col) - (gram - 1)), lambda i: F.substring(F.lower(col), i, F.lit(gram)))
    )
    names = active.where(F.length("standard_name") >= gram).select(
        "product_id", "standard_name", F.explode(grams(c("standard_name"))).alias("gram")
    )
    frequency = names.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    probes = (
        asked.select("query", F.explode(grams(c("query"))).alias("gram"))
        .join(frequency, "gram", "left")
        .groupBy("query")
        .agg(F.min_by("gram", F.struct(F.coalesce("df", F.lit(0)), "gram")).alias("gram"))
    )
    return probes.join(names.hint("merge"), "gram").where(F.lower("standard_name").contains(F.lower("query"))).select("query", "product_id", "standard_name")


def warehouse_list(stock: DataFrame, text: str = "") -> DataFrame:
    """Stock rows, newest first; the description falls back to the generic key."""
    d = stock.withColumn("product_name", F.coalesce("raw_product_name", "generic_key"))
    if text:
        d = d.where(F.lower("product_name").contains(text.lower()))
    return d.orderBy(c("updated_at").desc(), "generic_key")
