"""Registered queries over a catalogue of milliequivalent strengths: families of equal rates, containers, laboratories."""

from __future__ import annotations

from pyspark.sql import functions as F

from procura.functions import text as T
from procura.operators import browse, orders
from procura.operators import match as M
from procura.operators import pricing as P
from procura.plans import bridge as B
from procura.plans.oracle_views import CHOSEN, CURRENT, ENRICHED, LATEST, OFFERS, PRICE_ROWS, PRODUCTS, views
from procura.plans.pricing_queries import QUOTED, money, net_items, quotes_of, rich_offers
from procura.session import cut_lineage

c = F.col


def electrolytes(spark, sf):
    """`part` as solutions in milliequivalents, one rate written in three ways; every eleventh product is inactive.

    Sealed forms, volumes, weights and counted units are all sold.
    """
    number, rate = c("p_partkey"), 1 + c("p_size") % 4
    s = lambda x: x.cast("string")
    words = F.array_join(F.array_sort(F.split("p_name", " ")), " ")
    strength = (
        F.when(number % 3 == 0, s(rate))
        .when(number % 3 == 1, F.concat(s(rate * 10), F.lit("/10")))
        .otherwise(F.concat(s(rate * 5), F.lit("/5")))
    )
    unit = F.when(number % 3 == 0, "MEQ").otherwise("MEQ/ML")
    form = F.when(F.length("p_name") % 2 == 0, "Inyectable").otherwise("Polvo")
    sold = F.when(number % 5 == 0, "ml").when(number % 5 == 1, "g").otherwise("sobres")
    return B.table(spark, sf, "part").select(
        number.cast("string").alias("product_id"),
        F.concat_ws(" ", F.upper("p_name"), strength, unit).alias("standard_name"),
        T.generic_key(words, strength, unit, form).alias("generic_key"),
        words.alias("ingredient_key"),
        strength.alias("concentration"),
        unit.alias("concentration_unit"),
        form.alias("dosage_form"),
        (10 * (1 + number % 5)).cast("int").alias("presentation_quantity"),
        sold.alias("presentation_unit"),
        F.upper(F.replace(c("p_brand"), F.lit("#"), F.lit(""))).alias("laboratory_id"),
        F.when(number % 4 == 3, "ASEO").otherwise("MEDICAMENTOS").alias("sector"),
        F.when(number % 11 == 0, "INACTIVE").otherwise("ACTIVE").alias("status"),
    )


def _electrolyte_offers(spark, sf, products):
    """Current offers; every fourth supplier's lists carry unit prices of their own."""
    current = P.current_offers(B.offers(spark, sf), B.files(spark, sf))
    own = F.when(c("supplier_id").cast("long") % 4 == 0, c("price") / 8).cast("decimal(14,4)")
    return P.enriched_offers(current.withColumn("unit_price_as_imported", own), products, B.suppliers(spark, sf))


def _electrolyte_demands(spark, sf, products):
    known = products.select("product_id", "generic_key")
    asked = F.coalesce("requested_presentation_quantity", F.lit(-1))
    lines = B.matched_items(spark, sf).join(known, "product_id")
    return P.distinct_demands(lines.select("generic_key", c("requested_quantity").alias("quantity"), asked.alias("asked_size")))


def family_selection(spark, sf):
    """Cheapest offer of every demand among all spellings of its rate."""
    products = electrolytes(spark, sf)
    offers = cut_lineage(_electrolyte_offers(spark, sf, products))
    demands = cut_lineage(_electrolyte_demands(spark, sf, products))
    selection = P.select_offers(demands, offers, M.rate_equivalents(products))
    long = lambda *names: [c(x).cast("long").alias(x) for x in names]
    return selection.select(
        "generic_key", *long("quantity", "asked_size", "n_offers", "n_eligible", "pool_size"),
        F.coalesce("selected_offer_id", F.lit("")).alias("selected_offer_id"),
        F.coalesce(c("total_price").cast("double"), F.lit(-1.0)).alias("total_price"),
        F.coalesce(c("savings").cast("double"), F.lit(-1.0)).alias("savings"),
    )


def container_prices(spark, sf):
    """Unit prices of sealed forms, volumes, weights and counted units, imported or computed."""
    offers = _electrolyte_offers(spark, sf, electrolytes(spark, sf))
    return offers.select("offer_id", "generic_key", "per_container", money("unit_price"), "safe")


def matched_family(spark, sf):
    """All products a matched text stands for, within its sector or in all of them."""
    products = electrolytes(spark, sf)
    sector = F.when(c("product_id").cast("long") % 2 == 0, F.lit(M.ANY_SECTOR)).otherwise(c("sector"))
    matches = products.select(c("standard_name").alias("text"), sector.alias("sector"), c("generic_key").alias("matched_generic_key")).distinct()
    return M.matched_products(matches, products)


def laboratories(spark, sf):
    """A name for four of five laboratories of `part`."""
    number = F.regexp_extract("laboratory_id", "([0-9]+)$", 1).cast("long")
    known = B.products(spark, sf).select("laboratory_id").distinct().where(number % 5 != 0)
    return known.select("laboratory_id", F.concat(F.lit("Laboratorios "), F.reverse("laboratory_id")).alias("name"))


def order_lines_named(spark, sf):
    """Order lines with laboratory names; some lines name a client of their own."""
    offers = cut_lineage(rich_offers(spark, sf))
    items = net_items(spark, sf)
    selection = P.select_offers(P.distinct_demands(items), offers)
    own = F.when(c("request_id").cast("long") % 4 == 0, F.concat(F.lit("Sede "), "request_id"))
    quotes = quotes_of(items, selection, offers).withColumn("client_name", own)
    lines = orders.supplier_order_lines(quotes, offers, B.requests(spark, sf), laboratories(spark, sf))
    return lines.select("item_id", "client_name", "supplier_name", "product_name", "laboratory_name", money("total_cost"))


BROWSED = "10"
DEEP_PAGE = 4


def browse_deep_page(spark, sf):
    """A later page of one supplier's offers by laboratory name, with positions and the total."""
    current = P.current_offers(B.offers(spark, sf), B.files(spark, sf), strict=True)
    rich = P.enriched_offers(current, B.products(spark, sf), B.suppliers(spark, sf))
    named = laboratories(spark, sf).select("laboratory_id", c("name").alias("laboratory_name"))
    active = B.products(spark, sf).select("product_id", "active_ingredient")
    rows = browse.browse_offers(rich.join(active, "product_id").join(named, "laboratory_id", "left"), BROWSED)
    page, total = browse.ranked_page(rows, "laboratory", descending=True, page=DEEP_PAGE, limit=5)
    return page.select("position", "offer_id", "standard_name", F.coalesce("laboratory_name", F.lit("")).alias("laboratory_name"), F.lit(total).cast("long").alias("total"))


QUERIES = {
    "family_selection": family_selection,
    "container_prices": container_prices,
    "matched_family": matched_family,
    "order_lines_named": order_lines_named,
    "browse_deep_page": browse_deep_page,
}

_KEY = """array_to_string(list_sort(string_split(p_name,' ')),' ')"""
_ELECTROLYTES = f"""
electrolytes AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id, {_KEY} AS ik, 1 + p_size % 4 AS rate,
    upper(p_name) || ' ' || spelled || CASE WHEN p_partkey % 3 = 0 THEN ' MEQ' ELSE ' MEQ/ML' END AS standard_name,
    {_KEY} || ' ' || spelled || CASE WHEN p_partkey % 3 = 0 THEN ' meq ' ELSE ' meq/ml ' END || lower(form) AS generic_key, form,
    10 * (1 + p_partkey % 5) AS size, form = 'Inyectable' OR p_partkey % 5 < 2 AS per_container,
    CASE WHEN p_partkey % 4 = 3 THEN 'ASEO' ELSE 'MEDICAMENTOS' END AS sector, p_partkey % 11 <> 0 AS active, p_partkey
  FROM (SELECT *, CASE WHEN length(p_name) % 2 = 0 THEN 'Inyectable' ELSE 'Polvo' END AS form,
      CASE p_partkey % 3 WHEN 0 THEN CAST(1 + p_size % 4 AS VARCHAR) WHEN 1 THEN CAST(10 * (1 + p_size % 4) AS VARCHAR) || '/10'
        ELSE CAST(5 * (1 + p_size % 4) AS VARCHAR) || '/5' END AS spelled FROM part))"""
_FAMILY = """
spelled AS (SELECT DISTINCT ik, form, rate, generic_key FROM electrolytes WHERE active),
family AS (
  SELECT DISTINCT generic_key, generic_key AS member_key FROM electrolytes
  UNION SELECT a.generic_key, b.generic_key FROM spelled a JOIN spelled b USING (ik, form, rate))"""
_RICH = """
rich AS (
  SELECT o.*, s_name AS supplier_name, e.generic_key AS member_key, e.size AS presentation_quantity, '' AS presentation_unit, per_container,
    e.standard_name, '' AS laboratory_id,
    CAST(CASE WHEN s_suppkey % 4 = 0 THEN (CAST(o.price * 100 AS BIGINT) * 25 + 1) // 2 / 10000.0 WHEN per_container THEN o.price
      ELSE floor(CAST(o.price AS DOUBLE) / e.size * 10000 + 0.5) / 10000.0 END AS DECIMAL(18,4)) AS unit_price,
    CASE WHEN s_suppkey % 10 = 0 THEN coalesce(o.expiration_label LIKE '%SUPERIOR%', false) ELSE true END AS safe
  FROM curr o JOIN electrolytes e USING (product_id) JOIN supplier ON CAST(s_suppkey AS VARCHAR) = o.supplier_id WHERE active)"""
_DEMANDS = """
demands AS (
  SELECT DISTINCT e.generic_key, quantity, asked_size FROM (
    SELECT l_partkey, CAST(max(l_quantity) AS INTEGER) AS quantity, CASE WHEN l_linenumber % 2 = 1 THEN 10 * (1 + l_partkey % 5) ELSE -1 END AS asked_size
    FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey) JOIN electrolytes e ON p_partkey = l_partkey WHERE quantity > 0)"""
_OPTIONS = """
opts AS (
  SELECT d.generic_key, d.quantity, d.asked_size, r.*,
    CASE WHEN per_container THEN CAST(d.quantity AS BIGINT)
      ELSE CAST(ceil(d.quantity * CASE WHEN asked_size < 0 THEN 1.0 ELSE asked_size END / presentation_quantity::DOUBLE) AS BIGINT) END AS packages
  FROM demands d JOIN family USING (generic_key) JOIN rich r USING (member_key))"""
_LABORATORY = """CASE WHEN CAST(regexp_extract(laboratory_id, '([0-9]+)$', 1) AS BIGINT) % 5 <> 0 THEN 'Laboratorios ' || reverse(laboratory_id) ELSE '' END AS laboratory_name"""
_OFFERED = (_ELECTROLYTES, PRICE_ROWS, OFFERS, LATEST, CURRENT)

ORACLES = {
    "family_selection": views(*_OFFERED, _FAMILY, _RICH, _DEMANDS, _OPTIONS, CHOSEN)
    + """SELECT generic_key, CAST(quantity AS BIGINT) AS quantity, CAST(asked_size AS BIGINT) AS asked_size, n_offers, n_eligible, pool_size,
  coalesce(selected_offer_id, '') AS selected_offer_id, coalesce(CAST(total_price AS DOUBLE), -1.0::DOUBLE) AS total_price,
  coalesce(CAST(savings AS DOUBLE), -1.0::DOUBLE) AS savings FROM chosen""",
    "container_prices": views(*_OFFERED, _RICH)
    + "SELECT offer_id, member_key AS generic_key, per_container, CAST(unit_price AS DOUBLE) AS unit_price, safe FROM rich",
    "matched_family": views(_ELECTROLYTES, _FAMILY)
    + """SELECT DISTINCT m.text, m.sector, e.product_id FROM (
  SELECT standard_name AS text, CASE WHEN p_partkey % 2 = 0 THEN '*' ELSE sector END AS sector, generic_key FROM electrolytes) m
JOIN family USING (generic_key) JOIN electrolytes e ON e.generic_key = member_key AND e.active AND m.sector IN ('*', e.sector)""",
    "order_lines_named": QUOTED
    + f"""SELECT item_id, CASE WHEN CAST(q.request_id AS BIGINT) % 4 = 0 THEN 'Sede ' || q.request_id ELSE c_name END AS client_name, supplier_name,
  standard_name AS product_name, {_LABORATORY}, CAST(total_price AS DOUBLE) AS total_cost
FROM quoted q JOIN orders ON CAST(o_orderkey AS VARCHAR) = q.request_id JOIN customer ON c_custkey = o_custkey WHERE status = 'SELECTED'""",
    "browse_deep_page": views(PRODUCTS, PRICE_ROWS, OFFERS, LATEST, CURRENT, ENRICHED)
    + f"""SELECT row_number() OVER (ORDER BY lower(laboratory_name) DESC, offer_id) AS position, offer_id, standard_name, laboratory_name, count(*) OVER () AS total
FROM (SELECT *, {_LABORATORY} FROM rich WHERE supplier_id = '{BROWSED}') QUALIFY position BETWEEN {5 * DEEP_PAGE - 4} AND {5 * DEEP_PAGE}""",
}
