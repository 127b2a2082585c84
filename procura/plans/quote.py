"""Customer requests -> matches, quotes and the comparison table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procura.operators import decisions, match, pricing, warehouse
from procura.operators.skew import hot_keys, skew_join
from procura.session import cut_lineage

c = F.col


@dataclass
class QuoteInputs:
    products: DataFrame
    offers: DataFrame
    files: DataFrame
    suppliers: DataFrame
    stock: DataFrame
    synonyms: DataFrame
    suggestions: DataFrame | None = None
    verdicts: DataFrame | None = None
    match_log: DataFrame | None = None
    offer_log: DataFrame | None = None


@dataclass
class QuoteOutputs:
    matches: DataFrame
    candidates: DataFrame
    quotes: DataFrame
    options: DataFrame


def current_rich_offers(t: QuoteInputs) -> DataFrame:
    """Current offers with product and supplier facts, written once for all later reads."""
    active = t.offers.where(c("status") == "ACTIVE")
    by_supplier, by_product = hot_keys(active.select("supplier_id"), ["supplier_id"]), hot_keys(active.select("product_id"), ["product_id"])
    current = pricing.current_offers(t.offers, t.files, hot_suppliers=by_supplier)
    return cut_lineage(pricing.enriched_offers(current, t.products, t.suppliers, by_product, by_supplier))


def quote_requests(items: DataFrame, t: QuoteInputs, rules: pricing.PricingRules = pricing.PricingRules()) -> QuoteOutputs:
    """`items`: (item_id, request_id, original_text, requested_quantity, sector, ..).

    Work is done on distinct texts, distinct generics and distinct demands; the item table
    itself is joined three times, each time with its hot keys split.
    """
    texts = items.select(c("original_text").alias("text"), "sector").distinct()
    m = match.match_texts(texts, t.products, t.synonyms, t.offers, t.suggestions, t.verdicts)
    resolved = match.resolve_items(items, m.matches, hot_keys(items, ["original_text", "sector"]))
    if t.match_log is not None:
        resolved = decisions.apply_match_decisions(resolved, t.match_log, t.products)
    else:
        resolved = resolved.withColumn("match_note", F.lit(None).cast("string"))
    resolved = cut_lineage(resolved)

    generics = t.products.groupBy("generic_key").agg(
        *[F.min_by(x, "product_id").alias(x) for x in ("active_ingredient", "concentration", "concentration_unit", "dosage_form")]
    )
    wanted = resolved.select("generic_key").where(c("generic_key").isNotNull()).distinct()
    stock = warehouse.warehouse_lookup(generics.join(wanted, "generic_key", "left_semi"), t.stock, t.synonyms)
    stocked = skew_join(resolved, stock, ["generic_key"], ["item_id"], "left", hot_keys(resolved.select("generic_key"), ["generic_key"]))
    net = cut_lineage(pricing.net_quantities(stocked))

    offers = current_rich_offers(t)
    family = cut_lineage(match.rate_equivalents(t.products))
    demands = cut_lineage(pricing.distinct_demands(net))
    selection = cut_lineage(pricing.select_offers(demands, offers, family, rules))
    quotes = pricing.quote_items(net, selection, offers, hot_keys(net.select(*pricing.DEMAND), pricing.DEMAND))
    options = pricing.compare_offers(demands, offers, family, hot_keys(offers.select("generic_key"), ["generic_key"]))
    options = pricing.mark_selected(options, selection)
    if t.offer_log is not None:
        quotes = decisions.apply_offer_decisions(quotes, t.offer_log, options)
    return QuoteOutputs(m.matches, m.candidates, quotes, options)
