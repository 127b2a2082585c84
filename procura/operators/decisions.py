"""Decisions people take afterwards, laid over matches and quotes.

`log` tables are append-only; the last entry per item counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procura.functions.text import money_text
from procura.operators.pricing import DEMAND, TOTAL

c = F.col
NONE_NOTE = (
    "El usuario confirmó que ninguna de las opciones sugeridas corresponde; requiere búsqueda manual."
)


def _last(log: DataFrame, *fields: str) -> DataFrame:
    return log.groupBy("item_id").agg(F.max_by(F.struct(*fields), F.struct("decided_at", *fields)).alias("l")).select("item_id", "l.*")


def apply_match_decisions(items: DataFrame, log: DataFrame, products: DataFrame) -> DataFrame:
    """`log(item_id, action, product_id, decided_at)`: confirm a product or refuse all.

    Run before pricing: a confirmed product is priced again, a refusal leaves nothing to
    price.
    """
    known = products.select("product_id", c("generic_key").alias("l_generic"), c("standard_name").alias("l_name"))
    # only valid entries compete to be the last one
    valid = log.join(known, "product_id", "left").where((c("action") == "none") | c("l_generic").isNotNull())
    last = _last(valid, "action", "product_id", "l_generic", "l_name").withColumnRenamed("product_id", "l_product")
    d = items.join(last, "item_id", "left")
    confirmed, refused = c("action") == "confirm", c("action") == "none"
    pick = lambda yes, no, old: F.when(confirmed, yes).when(refused, no).otherwise(c(old)).alias(old)
    note = F.when(confirmed, F.concat(F.lit("Confirmado manualmente: "), c("l_name"), F.lit("."))).when(refused, F.lit(NONE_NOTE))
    replaced = {
        "match_status": pick(F.lit("MATCH"), F.lit("NO_MATCH"), "match_status"),
        "match_confidence": pick(F.lit(1.0), F.lit(0.0), "match_confidence"),
        "matched_product_id": pick(c("l_product"), F.lit(None), "matched_product_id"),
        "generic_key": pick(c("l_generic"), F.lit(None), "generic_key"),
    }
    return d.select(*[replaced.get(x, c(x)) for x in items.columns], note.alias("match_note"))


def apply_offer_decisions(quotes: DataFrame, log: DataFrame, options: DataFrame) -> DataFrame:
    """`log(item_id, action, offer_id, decided_at)`: choose a compared offer or exclude the item.

    Savings of a manual choice are measured against every option not out of stock.
    """
    # only the demands somebody decided on are looked up among the options
    decided = quotes.select("item_id", *DEMAND, "requested_quantity").join(log, "item_id")
    compared = decided.select(*DEMAND).distinct().join(options, DEMAND)
    most = compared.groupBy(*DEMAND).agg(
        F.max(F.when(c("availability") != "OUT_OF_STOCK", c("total_cost"))).alias("most"), F.count(F.lit(1)).alias("n_options")
    )
    facts = compared.select(
        *DEMAND,
        "offer_id",
        c("supplier_id").alias("m_supplier_id"),
        c("supplier_name").alias("m_supplier_name"),
        c("product_id").alias("m_product_id"),
        c("presentation_quantity").alias("m_size"),
        c("presentation_unit").alias("m_unit"),
        c("packages").alias("m_packages"),
        c("price").alias("m_price"),
        c("unit_price").alias("m_unit_price"),
        c("total_cost").alias("m_total"),
    )
    made = decided.join(most, DEMAND, "left").join(facts, DEMAND + ["offer_id"], "left")
    # only valid entries compete to be the last one
    valid = made.where(
        ((c("action") == "choose") & c("m_total").isNotNull() & (c("quantity") > 0))
        | ((c("action") == "exclude") & (c("n_options") > 0))
    )
    made = _last(valid, "action", "offer_id", "most", *[x for x in facts.columns if x.startswith("m_")])
    made = made.withColumnsRenamed({"action": "d_action", "offer_id": "d_offer"})
    d = quotes.join(made, "item_id", "left")
    chosen, excluded = c("d_action") == "choose", c("d_action") == "exclude"
    text = F.concat(
        F.lit("Selección manual: "), c("m_supplier_name"), F.lit(", "), c("m_packages").cast("string"),
        F.lit(" empaque(s) x"), c("m_size").cast("string"), F.lit(" "), c("m_unit"), F.lit(" a "),
        money_text(c("m_unit_price"), 2), F.lit(" c/u = "), money_text(c("m_total"), 0), F.lit("."),
    )
    gone = F.lit("Excluido manualmente: no se incluirá en el pedido a proveedores.")
    over = {
        "status": (F.lit("SELECTED"), F.lit("EXCLUDED")),
        "selected_offer_id": (c("d_offer"), F.lit(None)),
        "supplier_id": (c("m_supplier_id"), F.lit(None)),
        "supplier_name": (c("m_supplier_name"), F.lit(None)),
        "selected_product_id": (c("m_product_id"), F.lit(None)),
        "package_size": (c("m_size"), F.lit(None)),
        "presentation_unit": (c("m_unit"), F.lit(None)),
        "packages": (c("m_packages"), F.lit(None)),
        "package_price": (c("m_price"), F.lit(None)),
        "unit_price": (c("m_unit_price"), F.lit(None)),
        "total_price": (c("m_total"), F.lit(0).cast(TOTAL)),
        "savings": ((F.coalesce("most", "m_total") - c("m_total")).cast(TOTAL), F.lit(None)),
        "reason": (text, gone),
    }
    cols = [
        F.when(chosen, over[x][0]).when(excluded, over[x][1]).otherwise(c(x)).alias(x) if x in over else c(x)
        for x in quotes.columns
    ]
    return d.select(*cols, F.coalesce(excluded, F.lit(False)).alias("excluded"))
