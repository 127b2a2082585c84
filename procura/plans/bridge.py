"""Procurement roles for the generic star-schema tables the checks run on.

part -> products, supplier -> suppliers, lineitem -> offers and request lines,
orders/customer -> requests. Whole tables, no sampling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procura.functions.text import half_up
from procura.operators.skew import hot_keys, skew_join

c = F.col


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _form_is_tablet():
    return c("p_type").isin("STANDARD", "SMALL", "ECONOMY")


def _standard_name():
    strength, pack = _strength_and_pack()
    return F.concat(F.upper("p_name"), F.when(_form_is_tablet(), " TAB ").otherwise(" CAPS "), strength, F.lit("MG X"), pack.cast("string"))


def _strength_and_pack():
    return (50 * (1 + c("p_size") % 5)).cast("string"), (10 * (1 + c("p_partkey") % 5)).cast("int")


def list_parts(spark: SparkSession, sf: str) -> DataFrame:
    """(l_partkey, standard_name, p_brand): what a price list says of a part, for one join."""
    return table(spark, sf, "part").select(c("p_partkey").alias("l_partkey"), _standard_name().alias("standard_name"), "p_brand")


def products(spark: SparkSession, sf: str) -> DataFrame:
    strength, pack = _strength_and_pack()
    words = F.array_join(F.array_sort(F.split("p_name", " ")), " ")
    form = F.when(_form_is_tablet(), "Tableta").otherwise("Cápsula")
    generic = F.concat_ws(" ", words, strength, F.lit("mg"), F.when(_form_is_tablet(), "tableta").otherwise("capsula"))
    brand = F.upper(F.replace(c("p_brand"), F.lit("#"), F.lit("")))
    return table(spark, sf, "part").select(
        c("p_partkey").cast("string").alias("product_id"),
        _standard_name().alias("standard_name"),
        F.concat_ws(" ", generic, F.concat(F.lit("x"), pack.cast("string")), F.lower("p_brand")).alias("normalized_name"),
        generic.alias("generic_key"),
        F.upper("p_name").alias("active_ingredient"),
        words.alias("ingredient_key"),
        strength.alias("concentration"),
        F.lit("MG").alias("concentration_unit"),
        form.alias("dosage_form"),
        F.lit("Caja").alias("presentation_type"),
        pack.alias("presentation_quantity"),
        F.when(_form_is_tablet(), "tabletas").otherwise("cápsulas").alias("presentation_unit"),
        brand.alias("laboratory_id"),
        F.when(c("p_partkey") % 4 == 3, "ASEO").otherwise("MEDICAMENTOS").alias("sector"),
        F.lit("ACTIVE").alias("status"),
    )


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        c("s_suppkey").cast("string").alias("supplier_id"),
        c("s_name").alias("supplier_name"),
        (c("s_suppkey") % 10 == 0).alias("reports_expiry"),
        F.when(c("s_suppkey") % 3 == 0, F.array(F.lit("MEDICAMENTOS"), F.lit("ASEO")))
        .otherwise(F.array(F.lit("MEDICAMENTOS")))
        .alias("sectors"),
        F.lit("ACTIVE").alias("status"),
    )


def price_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed price-list rows: one list per supplier and year."""
    label = F.when(
        c("l_suppkey") % 10 == 0,
        F.when(c("l_linestatus") == "F", "SUPERIOR A 12 MESES").otherwise("ENTRE 6 Y 12 MESES"),
    )
    return table(spark, sf, "lineitem").select(
        c("l_suppkey").cast("string").alias("supplier_id"),
        c("l_partkey").cast("string").alias("product_id"),
        F.year("l_shipdate").alias("list_year"),
        F.concat_ws("-", c("l_suppkey").cast("string"), F.year("l_shipdate").cast("string")).alias("file_id"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice").alias("row_order"),
        F.lit(None).cast("string").alias("supplier_product_code"),
        label.alias("expiration_label"),
        half_up(c("l_extendedprice") / c("l_quantity"), 2).cast("decimal(14,2)").alias("price"),
        F.when(c("l_returnflag") == "A", "AVAILABLE")
        .when(c("l_returnflag") == "N", "UNKNOWN")
        .otherwise("OUT_OF_STOCK")
        .alias("availability"),
        F.when(c("l_returnflag") == "A", c("l_linenumber") * 10)
        .when(c("l_returnflag") == "R", 0)
        .cast("int")
        .alias("stock_quantity"),
    )


def files(spark: SparkSession, sf: str) -> DataFrame:
    rows = price_rows(spark, sf)
    return (
        rows.groupBy("supplier_id", "file_id", "list_year")
        .agg(F.count(F.lit(1)).alias("total_rows"))
        .select(
            "file_id",
            "supplier_id",
            F.concat(c("file_id"), F.lit(".csv")).alias("original_name"),
            F.make_timestamp(c("list_year"), F.lit(12), F.lit(31), F.lit(0), F.lit(0), F.lit(0)).alias("processed_at"),
            F.lit("PROCESSED").alias("status"),
            "total_rows",
        )
    )


def offers(spark: SparkSession, sf: str) -> DataFrame:
    """Last known state of every (supplier, product, label)."""
    rows = price_rows(spark, sf)
    # the file is named by supplier and year, so it need not be carried along
    last = F.max(F.struct("list_year", "row_order", "price", "availability", "stock_quantity")).alias("o")
    return (
        rows.groupBy("supplier_id", "product_id", "expiration_label")
        .agg(last)
        .select(
            F.concat_ws("|", "supplier_id", "product_id", F.coalesce("expiration_label", F.lit(""))).alias("offer_id"),
            "supplier_id",
            "product_id",
            F.lit(None).cast("string").alias("supplier_product_code"),
            "expiration_label",
            c("o.price").alias("price"),
            F.lit(None).cast("decimal(14,4)").alias("unit_price_as_imported"),
            c("o.availability").alias("availability"),
            c("o.stock_quantity").alias("stock_quantity"),
            F.concat_ws("-", "supplier_id", c("o.list_year").cast("string")).alias("source_file_id"),
            F.lit("ACTIVE").alias("status"),
        )
    )


def matched_items(spark: SparkSession, sf: str) -> DataFrame:
    """Request lines whose product is known: order = request, line = item."""
    lines = (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey", "l_linenumber", "l_partkey")
        .agg(F.max("l_quantity").cast("int").alias("requested_quantity"))
    )
    asked = F.when(c("l_linenumber") % 2 == 1, 10 * (1 + c("l_partkey") % 5)).cast("int")
    return lines.select(
        F.concat_ws("-", c("l_orderkey").cast("string"), c("l_linenumber").cast("string"), c("l_partkey").cast("string")).alias("item_id"),
        c("l_orderkey").cast("string").alias("request_id"),
        c("l_partkey").cast("string").alias("product_id"),
        "requested_quantity",
        asked.alias("requested_presentation_quantity"),
        F.lit("MATCH").alias("match_status"),
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        c("o_orderkey").cast("string").alias("request_id"), c("c_name").alias("customer_name")
    )


def stock_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Warehouse list: description and units of every seventh product's shelf."""
    return products(spark, sf).select(
        c("standard_name").alias("text"),
        c("product_id").cast("long").alias("row_no"),
        F.when(c("product_id").cast("long") % 7 == 0, c("presentation_quantity")).otherwise(0).alias("quantity"),
        "generic_key",
    )


def warehouse(spark: SparkSession, sf: str) -> DataFrame:
    return (
        stock_lines(spark, sf)
        .groupBy("generic_key")
        .agg(F.sum("quantity").cast("int").alias("quantity"))
        .where("quantity > 0")
    )


def generic_items(spark: SparkSession, sf: str, with_stock: bool = True) -> DataFrame:
    """Matched lines with their generic key and own stock, ready for net quantities."""
    known = products(spark, sf).select("product_id", "generic_key")
    if with_stock:
        stock = warehouse(spark, sf).select("generic_key", c("quantity").alias("warehouse_stock"))
        known = known.join(stock, "generic_key", "left")
    else:
        known = known.withColumn("warehouse_stock", F.lit(0))
    lines = matched_items(spark, sf)
    raw = table(spark, sf, "lineitem").select(c("l_partkey").cast("string").alias("product_id"))
    return skew_join(lines, known, ["product_id"], ["item_id"], "left", hot_keys(raw, ["product_id"]))
