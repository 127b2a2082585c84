"""Registered pricing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procura.operators import pricing as P
from procura.operators.skew import hot_keys
from procura.plans import bridge as B
from procura.plans.oracle_views import (
    CURRENT, ENRICHED, ITEMS, LATEST, NET, OFFERS, PRICE_ROWS, PRICING, PRODUCTS, WAREHOUSE, views,
)
from procura.session import cut_lineage

c = F.col


def rich_offers(spark: SparkSession, sf: str) -> DataFrame:
    raw = B.price_rows(spark, sf)
    by_supplier, by_product = hot_keys(raw.select("supplier_id"), ["supplier_id"]), hot_keys(raw.select("product_id"), ["product_id"])
    current = P.current_offers(B.offers(spark, sf), B.files(spark, sf), hot_suppliers=by_supplier)
    return P.enriched_offers(current, B.products(spark, sf), B.suppliers(spark, sf), by_product, by_supplier)


def net_items(spark: SparkSession, sf: str) -> DataFrame:
    """Request lines net of own stock, written once: demands and quotes both read them."""
    return cut_lineage(P.net_quantities(B.generic_items(spark, sf)))


def quotes_of(items: DataFrame, selection: DataFrame, offers: DataFrame) -> DataFrame:
    return P.quote_items(items, selection, offers, hot_keys(items.select(*P.DEMAND), P.DEMAND))


def money(name: str, alias: str | None = None):
    return c(name).cast("double").alias(alias or name)


def latest_file_per_supplier(spark, sf):
    return P.latest_files(B.files(spark, sf)).select(
        "supplier_id", "latest_file_id", "latest_file_name", F.year("latest_processed_at").cast("long").alias("latest_year")
    )


def current_offers(spark, sf):
    return P.current_offers(B.offers(spark, sf), B.files(spark, sf)).select(
        "offer_id", "supplier_id", "product_id", "source_file_id", "availability", money("price")
    )


def net_quantity(spark, sf):
    return net_items(spark, sf).select(
        "item_id",
        c("requested_quantity").cast("long").alias("requested_quantity"),
        c("warehouse_stock").cast("long").alias("warehouse_stock"),
        c("quantity").cast("long").alias("quantity_to_purchase"),
        F.when(c("quantity") == 0, "COVERED_BY_STOCK").otherwise("TO_BUY").alias("status"),
    )


def best_offer_per_item(spark, sf):
    items, offers = net_items(spark, sf), rich_offers(spark, sf)
    selection = P.select_offers(P.distinct_demands(items), offers)
    return quotes_of(items, selection, offers).select(
        "item_id",
        "status",
        F.coalesce("selected_offer_id", F.lit("")).alias("selected_offer_id"),
        F.coalesce(c("packages"), F.lit(0)).cast("long").alias("packages"),
        F.coalesce(c("total_price").cast("double"), F.lit(-1.0)).alias("total_price"),
        F.coalesce(c("savings").cast("double"), F.lit(-1.0)).alias("savings"),
    )


def demand_selection(spark, sf):
    selection = P.select_offers(P.distinct_demands(net_items(spark, sf)), rich_offers(spark, sf))
    return selection.select(
        "generic_key",
        c("quantity").cast("long").alias("quantity"),
        c("asked_size").cast("long").alias("asked_size"),
        c("n_offers").cast("long").alias("n_offers"),
        c("n_eligible").cast("long").alias("n_eligible"),
        c("pool_size").cast("long").alias("pool_size"),
        F.coalesce("selected_offer_id", F.lit("")).alias("selected_offer_id"),
        F.coalesce(c("savings").cast("double"), F.lit(-1.0)).alias("savings"),
    )


PREFERRED = "7"


def preferred_supplier_rank(spark, sf):
    rules = P.PricingRules(preferred_supplier_id=PREFERRED, preferred_supplier_tolerance=0.1)
    selection = P.select_offers(P.distinct_demands(net_items(spark, sf)), rich_offers(spark, sf), rules=rules)
    return selection.where("selected_offer_id is not null").select(
        "generic_key",
        c("quantity").cast("long").alias("quantity"),
        c("asked_size").cast("long").alias("asked_size"),
        "selected_offer_id",
        money("total_price"),
    )


def compared_options(spark, sf):
    """The stored comparison: every option of every demand with its flag and reason."""
    demands, offers = P.distinct_demands(net_items(spark, sf)), rich_offers(spark, sf)
    options = P.mark_selected(P.compare_offers(demands, offers), P.select_offers(demands, offers))
    return options.select(
        "generic_key",
        c("quantity").cast("long").alias("quantity"),
        c("asked_size").cast("long").alias("asked_size"),
        "offer_id",
        c("packages").cast("long").alias("packages"),
        money("total_cost"),
        "eligible",
        F.coalesce("discard_reason", F.lit("")).alias("discard_reason"),
        "selected",
    )


def top20_alternatives(spark, sf):
    demands, offers = P.distinct_demands(net_items(spark, sf)), rich_offers(spark, sf)
    return P.top_alternatives(P.select_offers(demands, offers), offers).select(
        "generic_key",
        c("quantity").cast("long").alias("quantity"),
        c("asked_size").cast("long").alias("asked_size"),
        "offer_id",
        c("position").cast("long").alias("position"),
        money("unit_price"),
        money("total_cost"),
        "selected",
    )


def salted_offers(spark, sf):
    """All priced rows with supplier and product facts, every key above a 4096th of the rows salted; per supplier and form."""
    rows = B.price_rows(spark, sf).withColumn("offer_id", F.xxhash64("file_id", "product_id", "row_order"))
    by_supplier, by_product = hot_keys(rows.select("supplier_id"), ["supplier_id"], 0), hot_keys(rows.select("product_id"), ["product_id"], 0)
    rows = rows.withColumn("unit_price_as_imported", F.lit(None).cast("decimal(14,4)"))
    rich = P.enriched_offers(rows, B.products(spark, sf), B.suppliers(spark, sf), by_product, by_supplier)
    return rich.groupBy("supplier_name", "dosage_form").agg(
        F.count(F.lit(1)).cast("long").alias("n"),
        F.count_if("safe").cast("long").alias("n_safe"),
        F.sum("unit_price").cast("double").alias("unit_prices"),
        F.sum("price").cast("double").alias("prices"),
    )


def unit_prices(spark, sf):
    return rich_offers(spark, sf).select("offer_id", money("unit_price"), "safe")


def quote_reasons(spark, sf):
    items, offers = net_items(spark, sf), rich_offers(spark, sf)
    selection = P.select_offers(P.distinct_demands(items), offers)
    return quotes_of(items, selection, offers).select("item_id", "reason")


def quote_totals(spark, sf):
    items, offers = net_items(spark, sf), rich_offers(spark, sf)
    quotes = quotes_of(items, P.select_offers(P.distinct_demands(items), offers), offers)
    return P.request_totals(quotes).select("request_id", c("lines").cast("long").alias("lines"), money("total"), money("savings"))


_BASE = views(PRODUCTS, PRICE_ROWS, OFFERS, LATEST, CURRENT, ENRICHED)
_ALL = views(*PRICING)
QUOTED = _ALL + """, quoted AS (
  SELECT n.*, c.* EXCLUDE (generic_key, quantity, asked_size),
         CASE WHEN n.quantity = 0 THEN 'COVERED_BY_STOCK' WHEN c.n_offers IS NULL THEN 'NOT_FOUND'
              WHEN c.n_eligible = 0 THEN 'NO_STOCK' ELSE 'SELECTED' END AS status
  FROM net n LEFT JOIN chosen c USING (generic_key, quantity, asked_size))
"""


def _pesos(expr: str, decimals: int) -> str:
    whole = f"replace(format('{{:,}}', CAST(floor(round({expr},2) + {0.5 if decimals == 0 else 0}) AS BIGINT)), ',', '.')"
    if decimals == 0:
        return f"chr(36) || chr(160) || {whole}"
    cents = f"CAST(floor(({expr}) * 100 + 0.5) AS BIGINT)"
    return (
        f"chr(36) || chr(160) || replace(format('{{:,}}', {cents} // 100), ',', '.') || ',' || lpad(CAST({cents} % 100 AS VARCHAR), 2, '0')"
    )


QUERIES = {
    "latest_file_per_supplier": latest_file_per_supplier,
    "current_offers": current_offers,
    "net_quantity": net_quantity,
    "best_offer_per_item": best_offer_per_item,
    "demand_selection": demand_selection,
    "preferred_supplier_rank": preferred_supplier_rank,
    "compared_options": compared_options,
    "top20_alternatives": top20_alternatives,
    "unit_prices": unit_prices,
    "salted_offers": salted_offers,
    "quote_reasons": quote_reasons,
    "quote_totals": quote_totals,
}

ORACLES = {
    "latest_file_per_supplier": views(PRICE_ROWS, LATEST)
    + "SELECT supplier_id, latest_file_id, latest_file_id || '.csv' AS latest_file_name, CAST(latest_year AS BIGINT) AS latest_year FROM latest",
    "current_offers": views(PRICE_ROWS, OFFERS, LATEST, CURRENT)
    + "SELECT offer_id, supplier_id, product_id, source_file_id, availability, CAST(price AS DOUBLE) AS price FROM curr",
    "net_quantity": views(PRODUCTS, WAREHOUSE, ITEMS, NET)
    + """SELECT item_id, CAST(requested_quantity AS BIGINT) AS requested_quantity, CAST(warehouse_stock AS BIGINT) AS warehouse_stock,
       CAST(quantity AS BIGINT) AS quantity_to_purchase, CASE WHEN quantity = 0 THEN 'COVERED_BY_STOCK' ELSE 'TO_BUY' END AS status FROM net""",
    "best_offer_per_item": QUOTED
    + """SELECT item_id, status, CASE WHEN status='SELECTED' THEN selected_offer_id ELSE '' END AS selected_offer_id,
       CASE WHEN status='SELECTED' THEN packages ELSE 0 END AS packages,
       CASE WHEN status='SELECTED' THEN CAST(total_price AS DOUBLE) WHEN status='COVERED_BY_STOCK' THEN 0.0::DOUBLE ELSE -1.0::DOUBLE END AS total_price,
       CASE WHEN status='SELECTED' THEN CAST(savings AS DOUBLE) ELSE -1.0::DOUBLE END AS savings FROM quoted""",
    "demand_selection": _ALL
    + """SELECT generic_key, CAST(quantity AS BIGINT) AS quantity, CAST(asked_size AS BIGINT) AS asked_size, n_offers, n_eligible, pool_size,
       coalesce(selected_offer_id,'') AS selected_offer_id, coalesce(CAST(savings AS DOUBLE), -1.0::DOUBLE) AS savings FROM chosen""",
    "preferred_supplier_rank": _ALL
    + f""", pref AS (
  SELECT generic_key, quantity, asked_size, arg_min(offer_id, (total_cost, offer_id)) AS pref_offer, min(total_cost) AS pref_total
  FROM ranked WHERE in_pool AND supplier_id = '{PREFERRED}' GROUP BY ALL)
SELECT c.generic_key, CAST(c.quantity AS BIGINT) AS quantity, CAST(c.asked_size AS BIGINT) AS asked_size,
  CASE WHEN CAST(pref_total - total_price AS DOUBLE)/CAST(total_price AS DOUBLE) <= 0.1 THEN pref_offer ELSE selected_offer_id END AS selected_offer_id,
  CAST(CASE WHEN CAST(pref_total - total_price AS DOUBLE)/CAST(total_price AS DOUBLE) <= 0.1 THEN pref_total ELSE total_price END AS DOUBLE) AS total_price
FROM chosen c LEFT JOIN pref p USING (generic_key, quantity, asked_size) WHERE selected_offer_id IS NOT NULL""",
    "compared_options": _ALL
    + """SELECT generic_key, CAST(quantity AS BIGINT) AS quantity, CAST(asked_size AS BIGINT) AS asked_size, offer_id, packages,
       CAST(total_cost AS DOUBLE) AS total_cost, eligible, coalesce(discard_reason,'') AS discard_reason, (rk = 1 AND in_pool) AS selected FROM ranked""",
    "top20_alternatives": _ALL
    + """, pos AS (
  SELECT *, row_number() OVER (PARTITION BY generic_key, quantity, asked_size ORDER BY unit_price, offer_id) AS pos FROM ranked)
SELECT generic_key, CAST(quantity AS BIGINT) AS quantity, CAST(asked_size AS BIGINT) AS asked_size, offer_id, least(pos, 21) AS position,
  CAST(unit_price AS DOUBLE) AS unit_price, CAST(total_cost AS DOUBLE) AS total_cost, (rk = 1 AND in_pool) AS selected
FROM pos WHERE pos <= 20 OR (rk = 1 AND in_pool)""",
    "salted_offers": views(PRODUCTS, PRICE_ROWS, ENRICHED.replace("FROM curr o", "FROM price_rows o"))
    + """SELECT supplier_name, p.dosage_form, count(*) AS n, count(*) FILTER (safe) AS n_safe, CAST(sum(unit_price) AS DOUBLE) AS unit_prices, CAST(sum(price) AS DOUBLE) AS prices
FROM rich JOIN products p USING (product_id) GROUP BY 1, 2""",
    "unit_prices": _BASE + "SELECT offer_id, CAST(unit_price AS DOUBLE) AS unit_price, safe FROM rich",
    "quote_reasons": QUOTED
    + f"""SELECT item_id, CASE
    WHEN status='COVERED_BY_STOCK' THEN 'Ya hay ' || warehouse_stock || ' unidades en bodega, suficientes para las ' || requested_quantity || ' solicitadas — no es necesario comprar ni cotizar.'
    WHEN status='NOT_FOUND' THEN 'No hay ninguna oferta de proveedor registrada para este producto.'
    WHEN status='NO_STOCK' THEN 'Ninguna oferta tiene disponibilidad suficiente para la cantidad que falta por comprar.'
    ELSE CASE WHEN pool_size = 1 THEN 'Única oferta elegible: ' ELSE 'Menor costo total entre ' || pool_size || ' ofertas elegibles: ' END
      || supplier_name || ', ' || packages || ' empaque(s) x' || package_size || ' a ' || {_pesos('unit_price', 2)} || ' c/u = ' || {_pesos('total_price', 0)} || '.'
      || CASE WHEN availability = 'UNKNOWN' THEN ' ⚠ Disponibilidad desconocida (no reportada por el proveedor).' ELSE '' END
    END AS reason FROM quoted""",
    "quote_totals": QUOTED
    + """SELECT request_id, count(*) AS lines, CAST(sum(CASE WHEN status='SELECTED' THEN total_price ELSE 0 END) AS DOUBLE) AS total,
       CAST(sum(CASE WHEN status='SELECTED' THEN savings ELSE 0 END) AS DOUBLE) AS savings FROM quoted GROUP BY 1""",
}
