"""Order, coverage and shortage lines of quoted requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procura.operators.pricing import DEMAND, TOTAL, availability_label
from procura.operators.skew import skew_join

c = F.col


def _with_client(items: DataFrame, requests: DataFrame) -> DataFrame:
    named = items.join(requests.select("request_id", "customer_name"), "request_id")
    own = c("client_name") if "client_name" in items.columns else F.lit(None).cast("string")
    return named.withColumn("client_name", F.coalesce(own, c("customer_name"))).drop("customer_name")


def supplier_order_lines(quotes: DataFrame, offers: DataFrame, requests: DataFrame, laboratories: DataFrame | None = None) -> DataFrame:
    """One line per item to buy, grouped by the supplier it goes to; with `laboratories` their names too."""
    detail = offers.select(
        c("offer_id").alias("selected_offer_id"),
        "supplier_product_code",
        c("standard_name").alias("product_name"),
        "laboratory_id",
        "availability",
        "stock_quantity",
    )
    picked = quotes.where((c("status") == "SELECTED") & (c("quantity") > 0))
    d = _with_client(picked.join(detail, "selected_offer_id"), requests)
    named = []
    if laboratories is not None:
        d = d.join(laboratories.select("laboratory_id", c("name").alias("laboratory_name")), "laboratory_id", "left")
        named = [F.coalesce("laboratory_name", F.lit("")).alias("laboratory_name")]
    return d.select(
        "request_id",
        "item_id",
        "client_name",
        "supplier_id",
        "supplier_name",
        "supplier_product_code",
        "product_name",
        availability_label(c("availability"), c("stock_quantity")).alias("availability_label"),
        c("warehouse_stock").alias("warehouse_covered"),
        "laboratory_id",
        *named,
        F.concat(F.lit("x"), c("package_size").cast("string"), F.lit(" "), c("presentation_unit")).alias("presentation"),
        c("packages").alias("packages"),
        "package_price",
        c("total_price").alias("total_cost"),
        "unit_price",
    )


def order_summary(lines: DataFrame, by_request: bool = True) -> DataFrame:
    keys = (["request_id"] if by_request else []) + ["supplier_id", "supplier_name"]
    return lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("products"), F.sum("total_cost").cast(TOTAL).alias("total"))


def covered_lines(quotes: DataFrame, requests: DataFrame) -> DataFrame:
    """Lines own stock covers in part or in full."""
    covered = quotes.where(c("warehouse_stock") > 0)
    name = F.coalesce(*[c(x) for x in ("matched_name", "original_text") if x in quotes.columns], F.lit(""))
    return _with_client(covered, requests).select(
        "request_id",
        "item_id",
        "client_name",
        name.alias("product_name"),
        "requested_quantity",
        F.least("requested_quantity", "warehouse_stock").alias("covered"),
        F.coalesce("quantity", F.lit(0)).alias("pending"),
    )


def unavailable_lines(quotes: DataFrame, options: DataFrame, requests: DataFrame, hot_demands: DataFrame | None = None) -> DataFrame:
    """Items to buy with options but no choice: one line per option, best stocked first."""
    chosen = quotes.where(c("selected_offer_id").isNotNull()).select("item_id")
    open_items = quotes.where(c("quantity") > 0).join(chosen, "item_id", "left_anti")
    if "excluded" in quotes.columns:
        open_items = open_items.where(~F.coalesce("excluded", F.lit(False)))
    name = F.coalesce(*[c(x) for x in ("matched_name", "original_text") if x in quotes.columns], F.lit(""))
    facts = options.select(
        *DEMAND,
        "offer_id",
        c("supplier_name").alias("option_supplier"),
        F.coalesce("discard_reason", availability_label(c("availability"), c("stock_quantity"))).alias("availability_label"),
        c("price").alias("option_price"),
        F.coalesce("stock_quantity", F.lit(-1)).alias("stock_rank"),
    )
    wanted = _with_client(open_items, requests).withColumn("product_name", name)
    lines = skew_join(wanted, facts, DEMAND, ["item_id"], "inner", hot_demands)
    return lines.select(
        "request_id",
        "item_id",
        "client_name",
        "product_name",
        c("option_supplier").alias("supplier_name"),
        "offer_id",
        "availability_label",
        c("option_price").alias("package_price"),
        F.coalesce("warehouse_stock", F.lit(0)).alias("warehouse_covered"),
        c("quantity").alias("pending"),
        "stock_rank",
    )


def write_orders(lines: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per supplier."""
    writer = lines.write.mode("overwrite").partitionBy("supplier_id")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
