"""Stored stock snapshots and whole requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from procura.operators import browse
from procura.operators import warehouse as WH
from procura.plans import bridge as B
from procura.plans.oracle_views import PRODUCTS, views
from procura.session import scratch_folder
from procura.sources.requests import validate_whole_requests
from procura.sources.store import TableStore

c = F.col


def _two_loads(spark, sf):
    """A store whose second snapshot, of fewer shelves with one unit more on each, replaced the first; and its lines."""
    store = TableStore(spark, scratch_folder(spark, "stock"))
    lines = B.stock_lines(spark, sf).select("text", "row_no", "quantity")
    WH.store_snapshot(store, lines, F.lit("2024-01-31 08:00:00"))
    later = lines.where(c("row_no") % 3 != 0).withColumn("quantity", c("quantity") + 1)
    WH.store_snapshot(store, later, F.lit("2024-02-29 08:00:00"))
    return store, later


def warehouse_list(spark, sf):
    """The stored stock by description, after a second load."""
    store, _ = _two_loads(spark, sf)
    found = browse.warehouse_list(WH.stored_stock(store), "tab")
    return found.select("generic_key", c("quantity").cast("long").alias("quantity"), "product_name", F.date_format("updated_at", "yyyy-MM-dd HH:mm").alias("updated_at"))


def warehouse_report(spark, sf):
    store, lines = _two_loads(spark, sf)
    return WH.warehouse_report(lines, WH.stored_stock(store))


def whole_requests(spark, sf):
    """Every order as one request: how many of its lines are taken in, or why none is."""
    number = c("l_orderkey")
    lines = B.table(spark, sf, "lineitem").select(
        number.cast("string").alias("request_id"),
        (c("l_linenumber") * 1000000 + c("l_partkey")).alias("line_no"),
        F.when(number % 31 == 0, "").otherwise("Hospital").alias("customer_name"),
        F.when(number % 13 == 0, "OTRO").otherwise("ASEO").alias("sector"),
        F.when(c("l_partkey") % 29 == 0, "").otherwise("x").alias("original_text"),
        (c("l_quantity") - 2).cast("int").alias("requested_quantity"),
        F.when(c("l_suppkey") % 37 == 0, "").when(c("l_suppkey") % 2 == 0, "Sede").alias("client_name"),
    )
    accepted, rejected = validate_whole_requests(lines)
    taken = accepted.groupBy("request_id").agg(F.lit("").alias("rejected_for"), F.count(F.lit(1)).alias("lines"))
    return taken.unionByName(rejected.withColumnRenamed("bad_lines", "lines"))


QUERIES = {"warehouse_list": warehouse_list, "warehouse_report": warehouse_report, "whole_requests": whole_requests}

_SHELF = """shelf AS (SELECT generic_key, sum(CASE WHEN p_partkey % 7 = 0 THEN presentation_quantity ELSE 0 END + 1) AS quantity,
  arg_max(standard_name, p_partkey) AS product_name, count(*) AS n FROM products WHERE p_partkey % 3 <> 0 GROUP BY 1)"""
ORACLES = {
    "warehouse_list": views(PRODUCTS, _SHELF)
    + """SELECT generic_key, CAST(quantity AS BIGINT) AS quantity, product_name, '2024-02-29 08:00' AS updated_at FROM shelf WHERE contains(lower(product_name), 'tab')""",
    "warehouse_report": views(PRODUCTS, _SHELF) + "SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS distinct_products FROM shelf",
    "whole_requests": """WITH j AS (SELECT CAST(l_orderkey AS VARCHAR) AS request_id, l_linenumber * 1000000 + l_partkey AS line_no,
    CASE WHEN l_orderkey % 31 = 0 THEN 'customer' WHEN l_orderkey % 13 = 0 THEN 'sector' WHEN l_partkey % 29 = 0 THEN 'text'
      WHEN CAST(l_quantity - 2 AS INTEGER) <= 0 THEN 'quantity' WHEN l_suppkey % 37 = 0 THEN 'client' END AS reason FROM lineitem)
SELECT request_id, coalesce(arg_min(reason, (line_no, reason)) FILTER (reason IS NOT NULL), '') AS rejected_for,
  CASE WHEN count(reason) > 0 THEN count(reason) ELSE count(*) END AS lines FROM j GROUP BY 1""",
}
