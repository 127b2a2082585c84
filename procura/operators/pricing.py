"""Offer comparison and selection.

Items are first reduced to distinct *demands* (generic, quantity to buy, asked pack
size); the best offer of a demand is found with running aggregates over stock levels,
so no item x offer pairs are built unless the full comparison table is asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procura.functions import vocab as V
from procura.functions.text import is_safe_expiration, money_text
from procura.operators.skew import skew_join

MONEY = "decimal(14,2)"
TOTAL = "decimal(24,2)"
UNIT_PRICE = "decimal(18,4)"
NO_LIMIT = 9_223_372_036_854_775_807
DEMAND = ["generic_key", "quantity", "asked_size"]
TOP_ALTERNATIVES = 20


@dataclass(frozen=True)
class PricingRules:
    preferred_supplier_id: str | None = None
    preferred_supplier_tolerance: float = 0.02


# --- column rules -----------------------------------------------------------------


def is_sealed(form: Column) -> Column:
    return form.isin(*V.SEALED_FORMS)


def is_measured(unit: Column) -> Column:
    return unit.isin(*V.MEASURE_UNITS)


def priced_per_container(form: Column, unit: Column) -> Column:
    return is_sealed(form) | is_measured(unit)


def packages_needed(quantity: Column, asked_size: Column, size: Column, per_container: Column) -> Column:
    """Packages to buy; `asked_size` null means that single units were asked for."""
    units = quantity.cast("double") * F.coalesce(asked_size.cast("double"), F.lit(1.0))
    return F.when(per_container, quantity.cast("long")).otherwise(F.ceil(F.try_divide(units, size.cast("double"))))


def total_cost(price: Column, packages: Column) -> Column:
    return (price.cast(MONEY) * packages.cast("decimal(18,0)")).cast(TOTAL)


def unit_price(price: Column, size: Column, per_container: Column, imported: Column) -> Column:
    """Price of one unit: as imported, else the container price, else rounded to 4 places."""
    per_unit = F.floor(F.try_divide(price.cast("double"), size.cast("double")) * 10000 + F.lit(0.5)) / F.lit(10000.0)
    return F.coalesce(
        imported.cast(UNIT_PRICE), F.when(per_container, price.cast(UNIT_PRICE)).otherwise(per_unit.cast(UNIT_PRICE))
    )


def availability_check(availability: Column, stock: Column, packages: Column) -> Column:
    """Struct(eligible, reason) of one offer for a number of packages."""
    short = stock.isNotNull() & (stock < packages)
    eligible = F.when(availability == "OUT_OF_STOCK", False).when(availability == "UNKNOWN", True).otherwise(~short)
    reason = (
        F.when(availability == "OUT_OF_STOCK", F.lit("Sin existencias."))
        .when(availability == "UNKNOWN", F.lit("Disponibilidad desconocida (no reportada por el proveedor)."))
        .when(
            short,
            F.concat(
                F.lit("Existencia insuficiente: "),
                stock.cast("string"),
                F.lit(" disponibles, se solicitan "),
                packages.cast("string"),
                F.lit("."),
            ),
        )
    )
    return F.struct(eligible.alias("eligible"), reason.alias("reason"))


def availability_label(availability: Column, stock: Column) -> Column:
    return (
        F.when(availability == "OUT_OF_STOCK", F.lit("Sin existencias"))
        .when(availability == "UNKNOWN", F.lit("Disponibilidad no confirmada"))
        .when(stock.isNotNull(), F.concat(F.lit("Disponible: "), stock.cast("string"), F.lit(" unidades")))
        .otherwise(F.lit("Disponible"))
    )


def has_safe_expiration(reports_expiry: Column, label: Column) -> Column:
    """Only suppliers that report expiry are judged by it."""
    return ~F.coalesce(reports_expiry, F.lit(False)) | is_safe_expiration(label)


# --- current offers ---------------------------------------------------------------


def latest_files(files: DataFrame) -> DataFrame:
    """Newest processed file of every supplier; a plain aggregate, so no hot partition."""
    picked = F.struct(
        F.col("file_id").alias("latest_file_id"),
        F.col("original_name").alias("latest_file_name"),
        F.col("processed_at").alias("latest_processed_at"),
    )
    newest = F.min_by(picked, F.struct(-F.unix_micros("processed_at"), F.col("file_id")))
    return (
        files.where((F.col("status") == "PROCESSED") & F.col("processed_at").isNotNull())
        .groupBy("supplier_id")
        .agg(newest.alias("f"))
        .select("supplier_id", "f.*")
    )


def current_offers(
    offers: DataFrame, files: DataFrame, strict: bool = False, hot_suppliers: DataFrame | None = None
) -> DataFrame:
    """Active offers of each supplier's newest list, plus those without a list.

    With no processed list all offers of the supplier count, or (`strict`, as on the
    browse page) only those without a source file.
    """
    joined = skew_join(
        offers.where(F.col("status") == "ACTIVE"), latest_files(files), ["supplier_id"], ["offer_id"], "left", hot_suppliers
    )
    source, latest = F.col("source_file_id"), F.col("latest_file_id")
    fallback = F.lit(False) if strict else latest.isNull()
    return joined.where(source.isNull() | fallback | F.coalesce(source == latest, F.lit(False))).select(*offers.columns)


PRODUCT_FACTS = [
    "product_id",
    "generic_key",
    "standard_name",
    "dosage_form",
    "presentation_quantity",
    "presentation_unit",
    "laboratory_id",
]


def enriched_offers(
    offers: DataFrame,
    products: DataFrame,
    suppliers: DataFrame,
    hot_products: DataFrame | None = None,
    hot_suppliers: DataFrame | None = None,
) -> DataFrame:
    """Offers with the product and supplier facts that pricing needs.

    `suppliers` carries `supplier_name` and `reports_expiry`.
    """
    facts = products.where(F.col("status") == "ACTIVE").select(*PRODUCT_FACTS)
    named = suppliers.select("supplier_id", "supplier_name", "reports_expiry")
    with_product = skew_join(offers, facts, ["product_id"], ["offer_id"], hot=hot_products)
    d = skew_join(with_product, named, ["supplier_id"], ["offer_id"], hot=hot_suppliers)
    d = d.withColumn("per_container", priced_per_container(F.col("dosage_form"), F.col("presentation_unit")))
    return d.withColumns(
        {
            "unit_price": unit_price(
                F.col("price"), F.col("presentation_quantity"), F.col("per_container"), F.col("unit_price_as_imported")
            ),
            "safe": has_safe_expiration(F.col("reports_expiry"), F.col("expiration_label")),
        }
    )


# --- demands and their family -----------------------------------------------------


def distinct_demands(items: DataFrame) -> DataFrame:
    """What has to be bought, once per (generic, quantity, asked size); -1 = no size asked."""
    return items.where(F.col("quantity") > 0).select(*DEMAND).distinct()


def asked_or_none(asked: Column) -> Column:
    return F.nullif(asked, F.lit(-1))


def with_family(demands: DataFrame, family: DataFrame | None) -> DataFrame:
    """Every demand with the generic keys whose offers it may use (`member_key`).

    `family` maps generic_key -> member_key for rate-equivalent spellings only; the
    demand's own key is always a member.
    """
    own = demands.withColumn("member_key", F.col("generic_key"))
    if family is None:
        return own
    return own.unionByName(demands.join(family.select("generic_key", "member_key").distinct(), "generic_key"))


# --- selection without pairs ------------------------------------------------------

_CLASS = ["member_key", "per_container", "size"]


def _classes(offers: DataFrame) -> DataFrame:
    """Offers whose package count is the same function of the demand."""
    return offers.select(
        F.col("generic_key").alias("member_key"),
        "per_container",
        F.when(F.col("per_container"), 0).otherwise(F.col("presentation_quantity")).alias("size"),
        "offer_id",
        "supplier_id",
        "price",
        "availability",
        "stock_quantity",
        "safe",
    )


def select_offers(
    demands: DataFrame, offers: DataFrame, family: DataFrame | None = None, rules: PricingRules = PricingRules()
) -> DataFrame:
    """Cheapest eligible offer per demand, with pool size and savings.

    Per class of equally packed offers the eligible offers of a demand are those with
    stock >= packages, i.e. a prefix when sorted by stock downwards. Offers are first
    aggregated to one row per stock level, then running minima, maxima and counts are
    read off at each needed package count. Work grows with offers + demands, never with
    their product, and a window holds one row per distinct level only.
    """
    pref = rules.preferred_supplier_id
    classed = _classes(offers)
    in_stock = F.when(F.col("availability") == "UNKNOWN", F.lit(NO_LIMIT)).otherwise(
        F.coalesce(F.col("stock_quantity").cast("long"), F.lit(NO_LIMIT))
    )
    ranked = F.struct(F.col("price").cast(MONEY).alias("price"), F.col("offer_id"))
    preferred = F.col("supplier_id") == (pref if pref is not None else "")
    measures = {
        "n_all": F.count(F.lit(1)),
        "n_safe": F.count_if("safe"),
        "best_all": F.min(ranked),
        "best_safe": F.min(F.when(F.col("safe"), ranked)),
        "top_all": F.max("price"),
        "top_safe": F.max(F.when(F.col("safe"), F.col("price"))),
    }
    if pref is not None:
        measures["pref_all"] = F.min(F.when(preferred, ranked))
        measures["pref_safe"] = F.min(F.when(preferred & F.col("safe"), ranked))
    levels = (
        classed.where(F.col("availability") != "OUT_OF_STOCK")
        .withColumn("level", in_stock)
        .groupBy(*_CLASS, "level")
        .agg(*[m.alias(k) for k, m in measures.items()])
    )
    totals = classed.groupBy(*_CLASS).agg(F.count(F.lit(1)).alias("n_offers"))
    cells = (
        with_family(demands, family)
        .join(totals, "member_key")
        .withColumn(
            "packages",
            packages_needed(F.col("quantity"), asked_or_none(F.col("asked_size")), F.col("size"), F.col("per_container")),
        )
    )
    points = cells.where("packages is not null").select(*_CLASS, F.col("packages").alias("level")).distinct()
    stream = levels.withColumn("is_point", F.lit(0)).unionByName(
        points.withColumn("is_point", F.lit(1)), allowMissingColumns=True
    )
    w = (
        Window.partitionBy(*_CLASS)
        .orderBy(F.col("level").desc(), F.col("is_point"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = {k: (F.sum(k) if k.startswith("n_") else F.max(k) if k.startswith("top_") else F.min(k)) for k in measures}
    read = (
        stream.select(*_CLASS, "level", "is_point", *[r.over(w).alias(k) for k, r in running.items()])
        .where("is_point = 1")
        .drop("is_point")
        .withColumnRenamed("level", "packages")
    )
    packs = F.col("packages")

    def costed(best: str) -> Column:
        b = F.col(best)
        return F.min(F.when(b.isNotNull(), F.struct(total_cost(b["price"], packs).alias("total"), b["offer_id"].alias("offer_id"))))

    aggs = {
        "n_offers": F.sum("n_offers"),
        "n_all": F.coalesce(F.sum("n_all"), F.lit(0)),
        "n_safe": F.coalesce(F.sum("n_safe"), F.lit(0)),
        "best_all": costed("best_all"),
        "best_safe": costed("best_safe"),
        "most_all": F.max(total_cost(F.col("top_all"), packs)),
        "most_safe": F.max(total_cost(F.col("top_safe"), packs)),
    }
    if pref is not None:
        aggs["pref_all"] = costed("pref_all")
        aggs["pref_safe"] = costed("pref_safe")
    per_demand = (
        cells.join(read, _CLASS + ["packages"], "left").groupBy(*DEMAND).agg(*[a.alias(k) for k, a in aggs.items()])
    )
    safe_pool = F.col("n_safe") > 0
    pick = lambda stem: F.when(safe_pool, F.col(f"{stem}_safe")).otherwise(F.col(f"{stem}_all"))
    best = pick("best")
    if pref is not None:
        close = (pick("pref")["total"] - best["total"]).cast("double") / best["total"].cast("double")
        best = F.when(close <= rules.preferred_supplier_tolerance, pick("pref")).otherwise(best)
    return per_demand.select(
        *DEMAND,
        "n_offers",
        F.col("n_all").alias("n_eligible"),
        pick("n").alias("pool_size"),
        best["offer_id"].alias("selected_offer_id"),
        best["total"].alias("total_price"),
        (pick("most") - best["total"]).cast(TOTAL).alias("savings"),
    )


def quote_items(
    items: DataFrame, selection: DataFrame, offers: DataFrame, hot_demands: DataFrame | None = None
) -> DataFrame:
    """Status, chosen offer and texts of every item.

    `items` carries match_status, generic_key (null unless matched), requested_quantity,
    warehouse_stock, quantity and asked_size.
    """
    detail = offers.select(
        F.col("offer_id").alias("selected_offer_id"),
        "supplier_id",
        "supplier_name",
        F.col("product_id").alias("selected_product_id"),
        "presentation_quantity",
        "presentation_unit",
        "per_container",
        F.col("price").alias("package_price"),
        "unit_price",
        "availability",
        "stock_quantity",
    )
    chosen = selection.join(detail, "selected_offer_id", "left")
    q = skew_join(items, chosen, DEMAND, ["item_id"], "left", hot_demands)
    bought = F.col("quantity") > 0
    matched = (F.col("match_status") == "MATCH") & F.col("generic_key").isNotNull()
    q = q.withColumn(
        "packages",
        packages_needed(
            F.col("quantity"), asked_or_none(F.col("asked_size")), F.col("presentation_quantity"), F.col("per_container")
        ),
    )
    status = (
        F.when(F.col("match_status") == "NO_MATCH", "NOT_FOUND")
        .when(~matched, "REVIEW")
        .when(~bought, "COVERED_BY_STOCK")
        .when(F.col("n_offers").isNull(), "NOT_FOUND")
        .when(F.col("n_eligible") == 0, "NO_STOCK")
        .otherwise("SELECTED")
    )
    q = q.withColumn("status", status)
    selected = F.col("status") == "SELECTED"
    warning = availability_check(F.col("availability"), F.col("stock_quantity"), F.col("packages"))["reason"]
    chosen_text = F.concat(
        F.col("supplier_name"),
        F.lit(", "),
        F.col("packages").cast("string"),
        F.lit(" empaque(s) x"),
        F.col("presentation_quantity").cast("string"),
        F.lit(" a "),
        money_text(F.col("unit_price"), 2),
        F.lit(" c/u = "),
        money_text(F.col("total_price"), 0),
        F.lit("."),
        F.coalesce(F.concat(F.lit(" ⚠ "), warning), F.lit("")),
    )
    reason = (
        F.when(F.col("match_status") == "NO_MATCH", F.lit("Producto no encontrado en el catálogo."))
        .when(~matched, F.lit("El producto requiere revisión de homologación antes de poder cotizarse."))
        .when(
            ~bought,
            F.concat(
                F.lit("Ya hay "),
                F.col("warehouse_stock").cast("string"),
                F.lit(" unidades en bodega, suficientes para las "),
                F.col("requested_quantity").cast("string"),
                F.lit(" solicitadas — no es necesario comprar ni cotizar."),
            ),
        )
        .when(F.col("n_offers").isNull(), F.lit("No hay ninguna oferta de proveedor registrada para este producto."))
        .when(
            F.col("n_eligible") == 0,
            F.lit("Ninguna oferta tiene disponibilidad suficiente para la cantidad que falta por comprar."),
        )
        .when(F.col("pool_size") == 1, F.concat(F.lit("Única oferta elegible: "), chosen_text))
        .otherwise(
            F.concat(
                F.lit("Menor costo total entre "),
                F.col("pool_size").cast("string"),
                F.lit(" ofertas elegibles: "),
                chosen_text,
            )
        )
    )
    return q.select(
        *items.columns,
        "status",
        *[F.when(selected, F.col(c)).alias(c) for c in ("selected_offer_id", "supplier_id", "supplier_name")],
        "selected_product_id",
        F.col("presentation_quantity").alias("package_size"),
        "presentation_unit",
        "packages",
        "package_price",
        "unit_price",
        F.when(F.col("status") == "COVERED_BY_STOCK", F.lit(0).cast(TOTAL))
        .when(selected, F.col("total_price"))
        .alias("total_price"),
        F.when(selected, F.col("savings")).alias("savings"),
        "pool_size",
        reason.alias("reason"),
    )


def net_quantities(items: DataFrame) -> DataFrame:
    """Own stock covers first: quantity = max(0, requested - stock) for matched items."""
    matched = (F.col("match_status") == "MATCH") & F.col("generic_key").isNotNull()
    stock = F.coalesce(F.col("warehouse_stock"), F.lit(0))
    return items.withColumns(
        {
            "warehouse_stock": F.when(matched, stock),
            "quantity": F.when(matched, F.greatest(F.lit(0), F.col("requested_quantity") - stock)),
            "asked_size": F.coalesce(F.col("requested_presentation_quantity"), F.lit(-1)),
        }
    )


# --- full comparison --------------------------------------------------------------


def compare_offers(
    demands: DataFrame,
    offers: DataFrame,
    family: DataFrame | None = None,
    hot_generics: DataFrame | None = None,
) -> DataFrame:
    """One row per (demand, current offer): the stored comparison table.

    Built per distinct demand, not per item; a hot generic's offers are salted.
    """
    wanted = with_family(demands, family).withColumnRenamed("generic_key", "demand_key")
    wanted = wanted.withColumnRenamed("member_key", "generic_key")
    pairs = skew_join(offers, wanted, ["generic_key"], ["offer_id"], hot=hot_generics)
    pairs = pairs.withColumn(
        "packages",
        packages_needed(
            F.col("quantity"), asked_or_none(F.col("asked_size")), F.col("presentation_quantity"), F.col("per_container")
        ),
    )
    check = availability_check(F.col("availability"), F.col("stock_quantity"), F.col("packages"))
    return (
        pairs.withColumns(
            {
                "total_cost": total_cost(F.col("price"), F.col("packages")),
                "eligible": F.coalesce(check["eligible"], F.lit(False)),
                "discard_reason": check["reason"],
            }
        )
        .withColumnsRenamed({"generic_key": "offer_generic_key"})
        .withColumnsRenamed({"demand_key": "generic_key"})
    )


def mark_selected(options: DataFrame, selection: DataFrame) -> DataFrame:
    """Comparison rows with their `selected` flag (at most one per demand)."""
    chosen = selection.select(*DEMAND, "selected_offer_id")
    return (
        options.join(chosen, DEMAND, "left")
        .withColumn("selected", F.coalesce(F.col("offer_id") == F.col("selected_offer_id"), F.lit(False)))
        .drop("selected_offer_id")
    )


def top_alternatives(
    selection: DataFrame, offers: DataFrame, family: DataFrame | None = None, limit: int = TOP_ALTERNATIVES
) -> DataFrame:
    """The `limit` offers with the lowest unit price per demand, plus the chosen one.

    Unit prices do not depend on the demand, so the ranking runs once per generic (the
    group limit is applied before the shuffle) and only its first rows meet the demands.
    """
    keyed = offers.withColumn("family_key", F.col("generic_key"))
    if family is not None:
        members = family.select(F.col("generic_key").alias("family_key"), F.col("member_key").alias("generic_key"))
        keyed = keyed.unionByName(offers.join(members.distinct(), "generic_key"))
    w = Window.partitionBy("family_key").orderBy("unit_price", "offer_id")
    cheap = keyed.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)
    shown = selection.select(*DEMAND, "selected_offer_id").join(
        cheap.withColumnsRenamed({"generic_key": "offer_generic_key", "family_key": "generic_key"}), "generic_key"
    )
    shown = shown.withColumn("selected", F.coalesce(F.col("offer_id") == F.col("selected_offer_id"), F.lit(False)))
    kept = shown.where("selected").select(*DEMAND)
    missing = (
        selection.where("selected_offer_id is not null")
        .select(*DEMAND, "selected_offer_id")
        .join(kept, DEMAND, "left_anti")
        .join(offers.withColumnRenamed("generic_key", "offer_generic_key"), F.col("selected_offer_id") == F.col("offer_id"))
        .withColumns({"position": F.lit(limit + 1), "selected": F.lit(True)})
    )
    both = shown.unionByName(missing).drop("selected_offer_id")
    both = both.withColumn(
        "packages",
        packages_needed(
            F.col("quantity"), asked_or_none(F.col("asked_size")), F.col("presentation_quantity"), F.col("per_container")
        ),
    )
    check = availability_check(F.col("availability"), F.col("stock_quantity"), F.col("packages"))
    return both.withColumns(
        {
            "total_cost": total_cost(F.col("price"), F.col("packages")),
            "eligible": F.coalesce(check["eligible"], F.lit(False)),
            "discard_reason": check["reason"],
        }
    )


def request_totals(quotes: DataFrame) -> DataFrame:
    """Total to pay and total savings per request."""
    zero = F.lit(0).cast(TOTAL)
    return quotes.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.coalesce("total_price", zero)).alias("total"),
        F.sum(F.coalesce("savings", zero)).alias("savings"),
    )
