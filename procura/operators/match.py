"""Request texts -> catalogue products, for all distinct texts at once.

The cascade (exact generic, ingredient and synonyms, word subsets, typos, brands, outside
suggestions) runs on distinct names against distinct catalogue keys; each later tier sees
only what the earlier ones left. Candidates are catalogue *variants* (one row per generic
and sector with its first product), so a popular ingredient does not multiply rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procura.functions import vocab as V
from procura.functions.once import spread
from procura.functions.text import (
    brand_of,
    generic_key_aliases,
    ingredient_key,
    ingredient_typo_limit,
    normalize_text,
    strip_accents,
    trim_text,
)
from procura.operators.compare import decide, rate_of, same_concentration, score
from procura.operators.extract import add_ingredient_guess, extract_attributes
from procura.operators.similarity import subset_pairs, typo_pairs
from procura.operators.skew import skew_join
from procura.session import cut_lineage

c = F.col
ANY_SECTOR = "*"
MAX_CANDIDATES = 8
VIA = ["via_synonym", "via_subset", "via_fuzzy", "via_brand"]
VARIANT = ["sector", "ingredient_key", "generic_key", "concentration", "concentration_unit", "dosage_form"]
NO_STOCK_NOTE = (
    "Ninguna de las opciones encontradas tiene existencia confirmada con algún proveedor por ahora; "
    "verifícalo antes de cotizar."
)


def _active(products: DataFrame) -> DataFrame:
    return products.where(c("status") == "ACTIVE")


def catalog_variants(products: DataFrame, *extra: str) -> DataFrame:
    """One row per generic and sector, represented by its first product."""
    first = F.min(F.struct("product_id", "standard_name", "presentation_quantity", "presentation_unit")).alias("p")
    return _active(products).groupBy(*VARIANT, *extra).agg(first).select(*VARIANT, *extra, "p.*")


def _in_sector(wanted: str, found: str = "sector") -> Column:
    return (c(wanted) == ANY_SECTOR) | (c(wanted) == c(found))


def _long_query(n: Column) -> Column:
    return F.floor((n + 1) * 7 / 6).cast("int") + 1


def expand_synonyms(names: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(raw, own_key, query_key, key): every spelling a name may stand for.

    `query_key` belongs to the canonical term and drives the looser tiers.
    """
    base = names.select("raw", normalize_text(c("raw")).alias("norm"))
    known = synonyms.select(c("term").alias("norm"), "canonical_term")
    base = base.join(known, "norm", "left").withColumn("canonical", F.coalesce("canonical_term", "norm"))
    siblings = synonyms.select(c("canonical_term").alias("canonical"), c("term").alias("sibling"))
    own = base.select("raw", "norm", "canonical", F.explode(F.array("canonical", "norm")).alias("term"))
    more = base.join(siblings, "canonical").select("raw", "norm", "canonical", c("sibling").alias("term"))
    return (
        own.unionByName(more)
        .select(
            "raw",
            ingredient_key(c("norm")).alias("own_key"),
            ingredient_key(c("canonical")).alias("query_key"),
            ingredient_key(c("term")).alias("key"),
        )
        .distinct()
    )


def search_names(searches: DataFrame, products: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Catalogue variants for distinct (raw name, sector) searches, with tier and flags.

    Exact and subset hits come together; typos are tried only where both are empty, brands
    only where typos are too.
    """
    names = searches.select("raw").distinct()
    spelled = cut_lineage(expand_synonyms(names, synonyms))
    variants = catalog_variants(products)
    catalog_keys = variants.where(c("ingredient_key") != "").select(c("ingredient_key").alias("key")).distinct()
    asked = searches.select("raw", c("sector").alias("asked_sector")).distinct()

    def hits(keys: DataFrame, found: DataFrame, on: str, among: DataFrame, tier: int, flag: str | None) -> DataFrame:
        joined = among.join(keys, "raw").join(found, on).where(_in_sector("asked_sector"))
        flags = [
            (c("ingredient_key") != c("own_key") if v == "via_synonym" and flag is None else F.lit(v == flag)).alias(v)
            for v in VIA
        ]
        return joined.select(
            "raw", "asked_sector", *variants.columns, F.lit(tier).alias("tier"), *flags
        )

    exact_keys = spelled.select("raw", "own_key", c("key").alias("ingredient_key")).distinct()
    query_keys = spelled.select("raw", "query_key").distinct()
    pairs = subset_pairs(query_keys.select(c("query_key").alias("key")).distinct(), catalog_keys)
    subset_keys = (
        query_keys.join(pairs.withColumnRenamed("query", "query_key"), "query_key")
        .select("raw", c("candidate").alias("ingredient_key"))
        .distinct()
        .join(exact_keys.select("raw", "ingredient_key"), ["raw", "ingredient_key"], "left_anti")
    )
    first = cut_lineage(
        hits(exact_keys, variants, "ingredient_key", asked, 1, None).unionByName(
            hits(subset_keys, variants, "ingredient_key", asked, 1, "via_subset")
        )
    )
    left = asked.join(first.select("raw", "asked_sector").distinct(), ["raw", "asked_sector"], "left_anti")
    left = cut_lineage(left)

    wanted = left.select("raw").distinct().join(query_keys, "raw").where(c("query_key") != "")
    typos = typo_pairs(
        wanted.select(c("query_key").alias("key")).distinct(), catalog_keys, ingredient_typo_limit, _long_query
    )
    fuzzy_keys = wanted.join(typos.withColumnRenamed("query", "query_key"), "query_key").select(
        "raw", c("candidate").alias("ingredient_key")
    )
    second = cut_lineage(hits(fuzzy_keys.distinct(), variants, "ingredient_key", left, 2, "via_fuzzy"))

    rest = left.join(second.select("raw", "asked_sector").distinct(), ["raw", "asked_sector"], "left_anti")
    branded = products.withColumn("brand", brand_of(c("standard_name"))).where(c("brand").isNotNull())
    brands = catalog_variants(branded, "brand")
    asked_brand = rest.select("raw", trim_text(F.upper(strip_accents(c("raw")))).alias("name")).distinct()
    asked_brand = asked_brand.where(F.length("name") >= 3)
    near = typo_pairs(
        asked_brand.select(c("name").alias("key")).distinct(),
        brands.select(c("brand").alias("key")).distinct(),
        ingredient_typo_limit,
        _long_query,
    )
    brand_keys = asked_brand.join(near.withColumnRenamed("query", "name"), "name").select("raw", c("candidate").alias("brand"))
    third = hits(brand_keys.distinct(), brands, "brand", rest, 3, "via_brand")
    return first.unionByName(second).unionByName(third)


def exact_matches(parsed: DataFrame, products: DataFrame) -> DataFrame:
    """First product of the same generic (any mass unit), the asked pack size first.

    The result keeps the first product's own generic key; the offer family is later built
    from that key, not from the aliases.
    """
    packs = (
        _active(products)
        .groupBy("sector", "generic_key", "presentation_quantity")
        .agg(F.min("product_id").alias("product_id"))
        .withColumnRenamed("sector", "found_sector")
    )
    a = c("attrs")
    keys = F.concat(
        F.array(a["generic_key"]),
        generic_key_aliases(a["ingredient_key"], a["concentration"], a["concentration_unit"], a["dosage_form"]),
    )
    asked = parsed.where(a.isNotNull()).select(
        "text", "sector", "asked_size", F.explode(keys).alias("generic_key")
    )
    found = asked.join(packs, "generic_key").where(_in_sector("sector", "found_sector"))
    other_size = F.coalesce((c("presentation_quantity") != c("asked_size")).cast("int"), F.lit(0))
    first = F.min(F.struct(other_size.alias("other"), "product_id", "generic_key"))
    return (
        found.groupBy("text", "sector")
        .agg(first.alias("m"))
        .select("text", "sector", c("m.product_id").alias("product_id"), c("m.generic_key").alias("generic_key"))
    )


def rate_equivalents(products: DataFrame) -> DataFrame:
    """generic_key -> member_key for equal milliequivalent rates written differently."""
    rated = (
        _active(products)
        .select("ingredient_key", "dosage_form", "generic_key", rate_of(c("concentration"), c("concentration_unit")).alias("rate"))
        .where(c("rate").isNotNull())
        .distinct()
    )
    # neighbouring cells of width 0.001 hold every rate within the tolerance
    cell = F.floor(c("rate") / 0.001)
    left = rated.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    right = rated.select(
        "ingredient_key", "dosage_form", c("generic_key").alias("member_key"), c("rate").alias("member_rate"), cell.alias("cell")
    )
    return (
        left.join(right, ["ingredient_key", "dosage_form", "cell"])
        .where((c("generic_key") != c("member_key")) & (F.abs(c("rate") - c("member_rate")) < 0.001))
        .select("generic_key", "member_key")
        .distinct()
    )


@dataclass
class MatchOutput:
    """`matches`: one row per (text, sector); `candidates`: up to 8 rows for each."""

    matches: DataFrame
    candidates: DataFrame


def _quoted(prefix: str, value: Column, rest: str) -> Column:
    return F.concat(F.lit(prefix + '"'), value, F.lit('"' + rest))


def _with_suggestions(open_texts: DataFrame, hits: DataFrame, suggestions: DataFrame | None, products, synonyms) -> DataFrame:
    """(text, sector, hit columns, via_ai): own hits, else those of the best outside guess."""
    own = open_texts.select("text", "sector", "raw").join(
        hits.withColumnRenamed("sector", "found_sector").withColumnRenamed("asked_sector", "sector"), ["raw", "sector"]
    )
    own = own.withColumn("via_ai", F.lit(False))
    if suggestions is None:
        return own
    empty = open_texts.select("text", "sector").join(own.select("text", "sector").distinct(), ["text", "sector"], "left_anti")
    guesses = empty.join(
        suggestions.where(trim_text(c("guess")) != "").select(
            "text", "rank", F.replace(c("guess"), F.lit("/"), F.lit(" ")).alias("raw")
        ),
        "text",
    )
    guesses = cut_lineage(guesses)
    found = search_names(guesses.select("raw", "sector").distinct(), products, synonyms)
    found = found.withColumnRenamed("sector", "found_sector").withColumnRenamed("asked_sector", "sector")
    reached = guesses.join(found, ["raw", "sector"])
    best = reached.groupBy("text", "sector").agg(F.min("rank").alias("rank"))
    extra = reached.join(best, ["text", "sector", "rank"]).drop("rank").withColumn("via_ai", F.lit(True))
    return own.unionByName(extra)


def match_texts(
    texts: DataFrame,
    products: DataFrame,
    synonyms: DataFrame,
    offers: DataFrame,
    suggestions: DataFrame | None = None,
    verdicts: DataFrame | None = None,
) -> MatchOutput:
    """Resolve distinct (text, sector) pairs; sector `*` searches all sectors.

    `suggestions(text, rank, guess)` and `verdicts(text, decision, confidence,
    candidate_id, reasons)` are optional outside tables; they widen or settle open cases
    and are checked against the catalogue.
    """
    distinct = spread(texts.select("text").distinct())
    parsed = add_ingredient_guess(extract_attributes(distinct, "text", False), "text", "guess")
    asked = F.when(c("attrs")["presentation_specified"], c("attrs")["presentation_quantity"])
    parsed = parsed.withColumn("asked_size", asked)
    parsed = cut_lineage(texts.select("text", "sector").distinct().join(parsed, "text"))
    exact = cut_lineage(exact_matches(parsed, products))

    open_texts = parsed.join(exact.select("text", "sector"), ["text", "sector"], "left_anti")
    open_texts = open_texts.withColumn("raw", F.coalesce(c("attrs")["active_ingredient"], c("guess")))
    searchable = open_texts.where(c("raw").isNotNull())
    hits = search_names(searchable.select("raw", "sector").distinct(), products, synonyms)
    found = _with_suggestions(open_texts, hits, suggestions, products, synonyms)
    found = found.join(open_texts.select("text", "sector", "attrs"), ["text", "sector"])

    a = c("attrs")
    plain = ~(c("via_synonym") | c("via_fuzzy") | c("via_subset") | c("via_brand") | c("via_ai"))
    scored = found.withColumns(
        {
            "same_strength": F.coalesce(
                same_concentration(
                    a["concentration"], a["concentration_unit"], c("concentration"), c("concentration_unit"), c("dosage_form")
                ),
                F.lit(False),
            ),
            "same_form": F.coalesce(a["dosage_form"] == c("dosage_form"), F.lit(False)),
            "same_pack": F.coalesce(
                (a["presentation_quantity"] == c("presentation_quantity")) & (a["presentation_unit"] == c("presentation_unit")),
                F.lit(False),
            ),
            "exact_ingredient": plain,
        }
    )
    points = score(c("same_strength"), c("same_form"), c("exact_ingredient"))
    scored = cut_lineage(scored.withColumn("score", F.when(a.isNull(), F.lit(0.0)).otherwise(points)).drop("attrs"))

    order = F.struct(-c("score"), c("product_id"))
    shown = F.struct("product_id", "generic_key", "standard_name", "score", "same_strength", "same_form", "same_pack")
    strong = c("same_strength")
    summary = scored.groupBy("text", "sector").agg(
        F.min_by(shown, order).alias("best"),
        F.min_by(F.when(strong, shown), F.when(strong, order)).alias("strong"),
        F.array_sort(F.collect_set(F.when(strong, c("dosage_form")))).alias("forms"),
        F.min(F.when(strong, c("exact_ingredient"))).alias("all_exact"),
        F.array_sort(F.collect_set(F.concat("concentration", "concentration_unit"))).alias("strengths"),
        *[F.max(v).alias(v) for v in ("via_fuzzy", "via_subset", "via_brand", "via_ai")],
    )
    d = open_texts.select("text", "sector", "attrs", "guess", "asked_size").join(summary, ["text", "sector"], "left")
    no_form = a["dosage_form"] == V.UNKNOWN_FORM
    n_forms = F.size("forms")
    plain_decision = decide(c("best")["score"], c("best")["same_strength"])
    branch = (
        F.when(a.isNull() & c("best").isNull(), "no_dose_nothing")
        .when(a.isNull(), "no_dose")
        .when(c("best").isNull(), "nothing")
        .when(no_form & (n_forms == 1) & c("all_exact"), "one_form")
        .when(no_form & (n_forms >= 1), "open_form")
        .when(plain_decision == "MATCH", "match")
        .when(plain_decision == "NO_MATCH", "no_match")
        .otherwise("review")
    )
    d = cut_lineage(d.withColumn("branch", branch))

    # candidate lists: best row per generic, score order, at most eight
    restricted = c("branch").isin("one_form", "open_form")
    listed = scored.join(d.select("text", "sector", "branch"), ["text", "sector"])
    per_generic = (
        listed.where(~restricted | strong)
        .groupBy("text", "sector", "branch", "generic_key")
        .agg(F.min_by(F.struct("product_id", "standard_name", "score", "same_strength", *VIA, "via_ai"), order).alias("x"))
        .select("text", "sector", "branch", "generic_key", "x.*")
    )
    w = Window.partitionBy("text", "sector").orderBy(c("score").desc(), "product_id")
    top = per_generic.withColumn("position", F.row_number().over(w)).where(c("position") <= MAX_CANDIDATES)
    top = cut_lineage(top)

    if verdicts is not None:
        judged = d.where(c("branch").isin("open_form", "review")).select("text", "sector").join(verdicts, "text")
        eligible = (
            listed.where(strong)
            .groupBy("text", "sector", "generic_key")
            .agg(F.min_by(F.struct("product_id", "score"), order).alias("x"))
            .select("text", "sector", c("x.product_id").alias("product_id"), c("x.score").alias("score"), "generic_key")
            .withColumn("position", F.row_number().over(w))
            .where(c("position") <= MAX_CANDIDATES)
        )
        some = eligible.select("text", "sector").distinct()
        listed_id = eligible.select("text", "sector", c("product_id").alias("candidate_id"), c("generic_key").alias("v_generic"))
        judged = (
            judged.join(some, ["text", "sector"])
            .join(listed_id, ["text", "sector", "candidate_id"], "left")
            .where(c("candidate_id").isNull() | c("v_generic").isNotNull())
            .select(
                "text",
                "sector",
                c("decision").alias("v_decision"),
                c("confidence").alias("v_confidence"),
                c("candidate_id").alias("v_product"),
                "v_generic",
                c("reasons").alias("v_reasons"),
            )
        )
        # one admitted verdict a text: the surest, so that repeated ones do not repeat the text
        told = F.struct("v_decision", "v_confidence", "v_product", "v_generic", "v_reasons")
        surest = F.struct(F.coalesce("v_confidence", F.lit(-1.0)), "v_decision", F.coalesce("v_product", F.lit("")))
        judged = judged.groupBy("text", "sector").agg(F.max_by(told, surest).alias("v")).select("text", "sector", "v.*")
        d = d.join(judged, ["text", "sector"], "left")
    else:
        for name, kind in (
            ("v_decision", "string"), ("v_confidence", "double"), ("v_product", "string"),
            ("v_generic", "string"), ("v_reasons", "array<string>"),
        ):
            d = d.withColumn(name, F.lit(None).cast(kind))

    judged_match = (c("v_decision") == "MATCH") & c("v_generic").isNotNull()
    judged_no = (c("branch") == "review") & (c("v_decision") == "NO_MATCH")
    d = d.withColumns(
        {
            "by_verdict": F.coalesce(judged_match, F.lit(False)),
            "against": F.coalesce(judged_no, F.lit(False)),
            "judged": c("v_decision").isNotNull(),
        }
    )
    decision = (
        F.when(c("branch").isin("match", "one_form") | c("by_verdict"), "MATCH")
        .when(c("against") | c("branch").isin("no_match", "nothing", "no_dose_nothing"), "NO_MATCH")
        .otherwise("REVIEW")
    )
    picked = F.when(c("branch") == "one_form", c("strong")).when(c("branch") == "match", c("best"))
    confidence = (
        F.when(c("by_verdict") | c("against"), c("v_confidence"))
        .when(c("branch") == "one_form", 1.0)
        .when(c("branch") == "open_form", c("strong")["score"])
        .when(c("branch").isin("match", "no_match", "review"), c("best")["score"])
        .otherwise(0.0)
    )
    source = (
        F.when(c("judged"), "ai")
        .when(c("branch") == "no_dose_nothing", "none")
        .when((c("branch") == "no_dose") & c("via_ai"), "ai")
        .otherwise("deterministic")
    )
    opened = d.select(
        "text",
        "sector",
        "asked_size",
        "branch",
        decision.alias("decision"),
        confidence.alias("confidence"),
        F.when(c("by_verdict"), c("v_product")).otherwise(picked["product_id"]).alias("matched_product_id"),
        F.when(c("by_verdict"), c("v_generic")).otherwise(picked["generic_key"]).alias("matched_generic_key"),
        source.alias("source"),
        _reasons().alias("reasons"),
    )
    closed = parsed.join(exact, ["text", "sector"]).select(
        "text",
        "sector",
        "asked_size",
        F.lit("exact").alias("branch"),
        F.lit("MATCH").alias("decision"),
        F.lit(1.0).alias("confidence"),
        c("product_id").alias("matched_product_id"),
        c("generic_key").alias("matched_generic_key"),
        F.lit("deterministic").alias("source"),
        F.array(F.lit("Coincidencia exacta de ingrediente activo, concentración y forma farmacéutica.")).alias("reasons"),
    )
    return _prefer_stocked(closed.unionByName(opened), top, offers)


def _reasons() -> Column:
    """Explanation lines of the open branches."""
    name = c("attrs")["active_ingredient"]
    best = c("best")
    described = F.concat(
        F.lit("Mejor candidato: "),
        best["standard_name"],
        F.lit(" ("),
        F.when(best["same_strength"], "misma concentración").otherwise("concentración distinta"),
        F.lit(", "),
        F.when(best["same_form"], "misma forma farmacéutica").otherwise("forma farmacéutica distinta"),
        F.lit(", "),
        F.when(best["same_pack"], "misma presentación").otherwise("presentación distinta"),
        F.lit(")."),
    )
    missing = " tal cual en el catálogo; se muestran "
    notes = [
        F.when(c("via_fuzzy"), _quoted("No se encontró ", name, missing + "principios activos con escritura parecida por si hubo un error de tipeo — confírmalo antes de cotizar.")),
        F.when(c("via_subset"), _quoted("No se encontró ", name, missing + "combinados que lo incluyen junto con otros principios activos adicionales — confírmalo antes de cotizar.")),
        F.when(c("via_brand"), _quoted("", name, " no coincide con ningún principio activo; se muestran productos cuyo nombre comercial se le parece — confírmalo antes de cotizar.")),
        F.when(c("via_ai"), _quoted("No se encontró ", name, " con las reglas normales; la IA sugirió un principio activo posible y estas opciones sí existen en el catálogo — confírmalo antes de cotizar.")),
    ]
    lines = lambda *xs: F.array_compact(F.array(*xs))
    one_form = F.get(c("forms"), F.lit(0))
    open_form = F.when(
        F.size("forms") > 1,
        F.concat(
            F.lit("El cliente no especificó la forma farmacéutica y hay varias disponibles ("),
            F.array_join("forms", ", "),
            F.lit("); requiere revisión."),
        ),
    ).otherwise(
        F.concat(
            F.lit("Se encontró una única forma farmacéutica ("),
            one_form,
            F.lit("), pero el ingrediente no es una coincidencia exacta; requiere revisión."),
        )
    )
    no_dose = (
        F.when(c("via_ai"), _quoted("No se encontró ", c("text"), " con las reglas normales; la IA sugirió un principio activo posible y estas opciones sí existen en el catálogo — confírmalo antes de cotizar."))
        .when(c("via_brand"), _quoted("", c("guess"), " no coincide con ningún principio activo, pero sí con el nombre comercial de estas opciones — confírmalo antes de cotizar."))
        .otherwise(
            F.concat(
                F.lit('No se especificó la concentración de "'), c("guess"),
                F.lit('". Concentraciones disponibles: '), F.array_join("strengths", ", "), F.lit(". Elige la opción correcta."),
            )
        )
    )
    judged = c("v_reasons")
    return (
        F.when(c("by_verdict"), judged)
        .when(c("against"), F.concat(judged, lines(*notes)))
        .when(
            c("branch") == "no_dose",
            lines(
                no_dose,
                F.when(c("via_fuzzy"), _quoted("Se muestran principios activos con escritura parecida a ", c("guess"), " por si hubo un error de tipeo — confírmalo antes de cotizar.")),
                F.when(c("via_subset"), _quoted("Se muestran combinados que incluyen ", c("guess"), " junto con otros principios activos adicionales — confírmalo antes de cotizar.")),
            ),
        )
        .when(c("branch") == "no_dose_nothing", lines(_quoted("No se pudo determinar la concentración de ", c("text"), ".")))
        .when(c("branch") == "nothing", lines(F.lit("No se encontró ningún producto con el mismo principio activo, ni con un sinónimo controlado conocido.")))
        .when(c("branch") == "one_form", lines(F.concat(F.lit("Única forma farmacéutica disponible para este principio activo y concentración: "), one_form, F.lit("."))))
        .when((c("branch") == "open_form") & c("judged"), F.concat(judged, lines(*notes)))
        .when(c("branch") == "open_form", lines(open_form, *notes))
        .when(c("branch") == "match", lines(described))
        .when(c("branch") == "no_match", lines(described, *notes))
        .when(c("judged"), judged)
        .otherwise(lines(described, F.lit("Requiere revisión humana."), *notes))
    )


def _prefer_stocked(matches: DataFrame, candidates: DataFrame, offers: DataFrame) -> MatchOutput:
    """Open cases list stocked products only, unless none is stocked (then a note is added)."""
    stocked = (
        offers.where((c("status") == "ACTIVE") & (c("availability") == "AVAILABLE"))
        .select("product_id")
        .distinct()
        .withColumn("in_stock", F.lit(True))
    )
    marked = candidates.join(matches.select("text", "sector", "decision"), ["text", "sector"]).join(stocked, "product_id", "left")
    marked = marked.withColumn("in_stock", F.coalesce("in_stock", F.lit(False)))
    any_stock = marked.groupBy("text", "sector").agg(F.max("in_stock").alias("any_stock"))
    kept = marked.join(any_stock, ["text", "sector"]).where(
        (c("decision") == "MATCH") | c("in_stock") | ~c("any_stock")
    )
    noted = matches.join(any_stock, ["text", "sector"], "left")
    note = (c("decision") != "MATCH") & ~F.coalesce(c("any_stock"), F.lit(True))
    noted = noted.withColumn(
        "reasons", F.when(note, F.concat("reasons", F.array(F.lit(NO_STOCK_NOTE)))).otherwise(c("reasons"))
    )
    return MatchOutput(noted.drop("any_stock"), kept.drop("decision", "branch", "any_stock"))


def matched_products(matches: DataFrame, products: DataFrame) -> DataFrame:
    """All products a match stands for: its generic and the rate equivalents."""
    known = _active(products).select("generic_key", "product_id", c("sector").alias("found_sector"))
    own = matches.where(c("matched_generic_key").isNotNull()).select("text", "sector", "matched_generic_key")
    family = rate_equivalents(products).withColumnRenamed("generic_key", "matched_generic_key")
    keys = own.withColumn("generic_key", c("matched_generic_key")).unionByName(
        own.join(family, "matched_generic_key").withColumnRenamed("member_key", "generic_key")
    )
    # the catalogue is shuffled, not broadcast, and repeated rows go in as many tasks as there are
    found = keys.join(known.hint("merge"), "generic_key").where(_in_sector("sector", "found_sector"))
    return spread(found.select("text", "sector", "product_id"), "product_id").distinct()


def resolve_items(items: DataFrame, matches: DataFrame, hot_texts: DataFrame | None = None) -> DataFrame:
    """Carry match results to the request lines; a text asked for by everyone is salted."""
    found = matches.select(
        c("text").alias("original_text"),
        "sector",
        c("decision").alias("match_status"),
        c("confidence").alias("match_confidence"),
        "matched_product_id",
        c("matched_generic_key").alias("generic_key"),
        c("asked_size").alias("requested_presentation_quantity"),
    )
    return skew_join(items, found, ["original_text", "sector"], ["item_id"], "left", hot_texts)
