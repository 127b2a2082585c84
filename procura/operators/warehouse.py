"""Own stock: snapshot load and lookup by generic key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procura import schema as S
from procura.functions.once import spread
from procura.functions.text import generic_key_aliases, generic_key_from, ingredient_key, normalize_text, trim_text
from procura.operators.extract import extract_attributes
from procura.operators.match import expand_synonyms
from procura.sources.store import TableStore

c = F.col


def warehouse_snapshot(lines: DataFrame) -> DataFrame:
    """(text, quantity, row_no) -> one row per generic; unreadable texts keep their own key.

    Distinct texts are parsed once; the load replaces the previous snapshot.
    """
    named = lines.withColumn("text", trim_text(c("text"))).where(c("text") != "")
    per_text = named.groupBy("text").agg(
        F.sum(F.greatest(F.lit(0), F.coalesce(F.round("quantity"), F.lit(0)))).alias("quantity"), F.max("row_no").alias("row_no")
    )
    parsed = extract_attributes(spread(per_text), "text", False)
    key = F.coalesce(c("attrs")["generic_key"], normalize_text(c("text")))
    return (
        parsed.groupBy(key.alias("generic_key"))
        .agg(F.sum("quantity").cast("int").alias("quantity"), F.max_by("text", "row_no").alias("raw_product_name"))
        .where("quantity > 0")
    )


def store_snapshot(store: TableStore, lines: DataFrame, updated_at: Column, batch: str = "") -> None:
    """Replace the stored stock by the snapshot of `lines`; a reader of the earlier one is not disturbed."""
    snapshot = warehouse_snapshot(lines).select("generic_key", "quantity", "raw_product_name", updated_at.cast("timestamp").alias("updated_at"))
    store.commit({"warehouse": snapshot}, batch)


def stored_stock(store: TableStore) -> DataFrame:
    return store.read("warehouse", S.WAREHOUSE)


def warehouse_report(lines: DataFrame, snapshot: DataFrame) -> DataFrame:
    keys = snapshot.agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = lines.where(trim_text(c("text")) != "").agg(F.count(F.lit(1)).alias("total_rows"))
    return rows.withColumn("distinct_products", keys)


def warehouse_lookup(generics: DataFrame, stock: DataFrame, synonyms: DataFrame) -> DataFrame:
    """generic_key -> stock: own key or mass-unit aliases first, then synonym spellings.

    `generics` has the distinct generic keys with active_ingredient, concentration,
    concentration_unit and dosage_form.
    """
    g = generics.withColumn("ikey", ingredient_key(c("active_ingredient")))
    aliases = generic_key_aliases(c("ikey"), c("concentration"), c("concentration_unit"), c("dosage_form"))
    near = g.select("generic_key", F.explode(F.concat(F.array("generic_key"), aliases)).alias("stock_key"), F.lit(1).alias("priority"))
    terms = expand_synonyms(g.select(c("ikey").alias("raw")).distinct(), synonyms).select(c("raw").alias("ikey"), c("key").alias("term"))
    far = (
        g.join(terms, "ikey")
        .select(
            "generic_key",
            generic_key_from(c("term"), c("concentration"), c("concentration_unit"), c("dosage_form")).alias("stock_key"),
            F.lit(2).alias("priority"),
        )
        .where(c("stock_key") != c("generic_key"))
    )
    found = near.unionByName(far).join(stock.select(c("generic_key").alias("stock_key"), "quantity"), "stock_key")
    return found.groupBy("generic_key").agg(F.min_by("quantity", F.struct("priority", "stock_key")).alias("warehouse_stock"))
