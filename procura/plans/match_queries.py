"""Registered text and matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from procura.functions import text as T
from procura.functions.once import spread
from procura.operators import match as M
from procura.operators.extract import extract_attributes
from procura.plans import bridge as B
from procura.plans.oracle_views import OFFERS, PRICE_ROWS, PRODUCTS, views

c = F.col


def _spark_form():
    return F.when(c("p_type").isin("STANDARD", "SMALL", "ECONOMY"), "TAB").otherwise("CAPS")


def _strength():
    return (50 * (1 + c("p_size") % 5)).cast("string")


def described_parts(spark, sf):
    """Every product written in one of seven supplier styles."""
    n = c("p_partkey") % 7
    ing, w = F.upper("p_name"), F.split(F.upper("p_name"), " ")
    s = lambda x: x.cast("string")
    pack, strength = s(10 * (1 + c("p_partkey") % 5)), _strength()
    style = (
        F.when(n == 0, F.concat(ing, F.lit(" TAB "), strength, F.lit("MG X"), pack))
        .when(n == 1, F.concat(F.lit("Eps-"), F.col("p_name"), F.lit(" "), strength, F.lit(" mg cápsula caja X "), pack))
        .when(n == 2, F.concat(ing, F.lit(" "), strength, F.lit("MG/5ML SUSPENSION ORAL FRASCO X 120ML")))
        .when(n == 3, F.concat(ing, F.lit(" SODICO "), strength, F.lit("MG/2ML SOLUCION INYECTABLE CAJA X "), pack))
        .when(n == 4, F.concat(w[1], F.lit(" + "), w[0], F.lit(" "), strength, F.lit("MG+5MG TAB C*"), pack))
        .when(n == 5, F.concat(ing, F.lit(" 0,5% CREMA TUBO X 30G")))
        .otherwise(F.concat(ing, F.lit(" 1.000MCG TABLETA X "), pack))
    )
    return B.table(spark, sf, "part").select(c("p_partkey").alias("id"), style.alias("text"))


def extract_attribute_rows(spark, sf):
    a = c("attrs")
    return extract_attributes(spread(described_parts(spark, sf)), "text", True).select(
        "id",
        *[a[f].alias(f) for f in ("active_ingredient", "concentration", "concentration_unit", "dosage_form")],
        *[a[f].alias(f) for f in ("presentation_type", "presentation_unit", "generic_key")],
        a["presentation_quantity"].cast("long").alias("presentation_quantity"),
    )


def written_doses(spark, sf):
    """Every product with its dose written in one of eight ways: folded and implied units, mixed masses, slashed names, small and large volumes."""
    n, ing, w = c("p_partkey") % 8, F.upper("p_name"), F.split(F.upper("p_name"), " ")
    pair, strength, pack = F.concat(w[1], F.lit(" + "), w[0]), _strength(), (10 * (1 + c("p_partkey") % 5)).cast("string")
    text = (
        F.when(n == 0, F.concat(ing, F.lit(" 1GR TAB X"), pack))
        .when(n == 1, F.concat(ing, F.lit(" 2EMQ/ML SOLUCION INYECTABLE CAJA X "), pack))
        .when(n == 2, F.concat(ing, F.lit(" "), strength, F.lit("/0.4 AMPOLLAS SOLUCION INYECTABLE CAJA X "), pack))
        .when(n == 3, F.concat(pair, F.lit(" 2.5G+20MG TAB X"), pack))
        .when(n == 4, F.concat(w[1], F.lit("/"), w[0], F.lit(" "), strength, F.lit("MG TAB X"), pack))
        .when(n == 5, F.concat(ing, F.lit(" "), strength, F.lit("MG/1.750ML SUSPENSION INYECTABLE JERPREX1.750ML CX1")))
        .when(n == 6, F.concat(pair, F.lit(" "), strength, F.lit("+25MG TAB X"), pack))
        .otherwise(F.concat(ing, F.lit(" 0,9% SOLUCION INYECTABLE FRASCO X 1.000ML")))
    )
    a, d = c("attrs"), B.table(spark, sf, "part").select(c("p_partkey").alias("id"), text.alias("text"))
    return extract_attributes(spread(d), "text", True).select(
        "id",
        *[a[f].alias(f) for f in ("active_ingredient", "concentration", "concentration_unit", "dosage_form", "presentation_unit", "generic_key")],
        a["presentation_quantity"].cast("long").alias("presentation_quantity"),
    )


def normalized_documents(spark, sf):
    d = B.table(spark, sf, "documents")
    norm = T.normalize_text(c("text"))
    return d.select("doc_id", F.sha2(norm, 256).alias("digest"), F.length(norm).cast("long").alias("n_chars"))


def document_words(spark, sf):
    d = B.table(spark, sf, "documents").select(F.explode(T.word_tokens(c("text"))).alias("word"))
    return d.groupBy("word").agg(F.count(F.lit(1)).cast("long").alias("n"))


def ingredient_keys(spark, sf):
    raw = F.concat(F.upper("p_name"), F.lit(" de 12 "), F.lower("p_brand"))
    d = B.table(spark, sf, "part").select(raw.alias("raw"))
    return d.groupBy(T.ingredient_key(c("raw")).alias("ingredient_key")).agg(F.count(F.lit(1)).cast("long").alias("n"))


def generic_keys(spark, sf):
    p = B.products(spark, sf)
    key = T.generic_key(c("active_ingredient"), c("concentration"), c("concentration_unit"), c("dosage_form"))
    return p.select("product_id", key.alias("generic_key"))


def key_aliases(spark, sf):
    p = B.products(spark, sf)
    keys = T.generic_key_aliases(c("ingredient_key"), c("concentration"), F.lit("MG"), c("dosage_form"))
    return p.select("product_id", F.explode(keys).alias("alias"))


def normalized_names(spark, sf):
    p = B.products(spark, sf)
    lab = T.normalize_text(F.regexp_replace("laboratory_id", "(BRAND)", "$1#"))
    return p.select("product_id", T.normalized_name(c("generic_key"), c("presentation_quantity"), lab).alias("normalized_name"))


def parsed_prices(spark, sf):
    cents = F.floor(c("l_extendedprice") * 100 + 0.5).cast("long")
    whole, rest = F.floor(cents / 100).cast("long"), F.lpad((cents % 100).cast("string"), 2, "0")
    grouped = F.call_function("format_number", whole, F.lit("#,##0"))
    text = F.concat(F.lit("$ "), F.translate(grouped, ",", "."), F.lit(","), rest, F.lit(" COP"))
    d = B.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", text.alias("text"))
    price = T.parse_price(c("text"), F.lit("."), F.lit(","))
    return d.groupBy("l_orderkey", "l_partkey", "l_linenumber").agg(F.max(price).alias("price"))


def availability_words(spark, sf):
    words = F.array(*[F.lit(x) for x in ("Sí", "Agotado", "50", "0", "???", "EN  STOCK", "1,5")])
    d = B.table(spark, sf, "lineitem").select(F.get(words, (c("l_orderkey") % 7).cast("int")).alias("cell"))
    d = d.withColumn("norm", T.normalize_text(c("cell")))
    a = T.availability_of(c("cell"), c("norm"))
    return d.groupBy("cell", a["availability"].alias("availability"), F.coalesce(a["stock"], F.lit(-1.0)).alias("stock")).agg(
        F.count(F.lit(1)).cast("long").alias("n")
    )


# --- matching ---------------------------------------------------------------------


def synonyms(spark, sf):
    d = B.table(spark, sf, "part").where(c("p_name").startswith("cold ")).select("p_name").distinct()
    return d.select(F.replace("p_name", F.lit("cold "), F.lit("frio ")).alias("term"), c("p_name").alias("canonical_term"))


def _searches(spark, sf, raw):
    return B.table(spark, sf, "part").select(raw.alias("raw"), F.lit(M.ANY_SECTOR).alias("sector")).distinct()


def _hits(spark, sf, raw, products=None):
    found = M.search_names(_searches(spark, sf, raw), products or B.products(spark, sf), synonyms(spark, sf))
    return found.groupBy("raw", "ingredient_key").agg(
        F.count_distinct("generic_key").cast("long").alias("generics"),
        F.min("tier").cast("long").alias("tier"),
        F.max("via_synonym").alias("via_synonym"),
    )


def synonym_match(spark, sf):
    return _hits(spark, sf, F.replace("p_name", F.lit("cold "), F.lit("frio ")))


def subset_match(spark, sf):
    lengthened = F.concat("p_name", F.lit(" forte"))
    return _hits(spark, sf, F.when(c("p_partkey") % 2 == 0, lengthened).otherwise(F.split("p_name", " ")[1]))


def fuzzy_match(spark, sf):
    return _hits(spark, sf, F.concat(F.substring("p_name", 1, 2), F.substring("p_name", 4, 100)))


def _branded(spark, sf):
    brand = F.concat(F.lit(" (Zyqua"), F.lower(F.regexp_replace("laboratory_id", "[0-9]", "")), F.substring("laboratory_id", 6, 2), F.lit(")"))
    return B.products(spark, sf).withColumn("standard_name", F.concat("standard_name", brand))


def sector_match(spark, sf):
    """Names searched in one sector of a catalogue with inactive products, most of them mistyped: one found in another sector only is not found."""
    number, name = c("p_partkey"), c("p_name")
    raw = F.when(number % 4 == 0, name).when(number % 4 == 1, F.split(name, " ")[1]).otherwise(F.concat(F.substring(name, 1, 2), F.substring(name, 4, 100)))
    sector = F.when(number % 3 == 0, "ASEO").when(number % 3 == 1, "MEDICAMENTOS").otherwise(M.ANY_SECTOR)
    searches = B.table(spark, sf, "part").select(raw.alias("raw"), sector.alias("sector")).distinct()
    first = F.substring(c("ingredient_key"), 1, 1)
    listed = B.products(spark, sf).withColumns(
        {"sector": F.when(first < "g", "ASEO").otherwise(c("sector")), "status": F.when(c("product_id").cast("long") % 5 < 3, "ACTIVE").otherwise("INACTIVE")}
    )
    found = M.search_names(searches, listed, synonyms(spark, sf))
    return found.groupBy("raw", c("asked_sector").alias("sector"), "ingredient_key").agg(
        F.count_distinct("generic_key").cast("long").alias("generics"), F.min("tier").cast("long").alias("tier")
    )


def brand_match(spark, sf):
    raw = F.concat(F.lit("zyquabrnd"), F.regexp_replace("p_brand", "[^0-9]", ""))
    return _hits(spark, sf, raw, _branded(spark, sf))


def exact_match(spark, sf):
    p = B.products(spark, sf)
    other = F.concat_ws(" ", "active_ingredient", F.concat(c("concentration"), F.lit("000MCG")), "dosage_form")
    text = F.when(c("product_id").cast("long") % 3 == 0, other).otherwise(c("standard_name"))
    texts = p.select(text.alias("text"), F.lit(M.ANY_SECTOR).alias("sector")).distinct()
    parsed = extract_attributes(spread(texts), "text", False)
    asked = F.when(c("attrs")["presentation_specified"], c("attrs")["presentation_quantity"])
    return M.exact_matches(parsed.withColumn("asked_size", asked), p).select("text", "product_id", "generic_key")


def rate_equivalent_keys(spark, sf):
    """Milliequivalent strengths written per ml or as a ratio."""
    k, n = 1 + c("p_size") % 4, c("p_partkey") % 3
    s = lambda x: x.cast("string")
    strength = F.when(n == 0, s(k)).when(n == 1, F.concat(s(k * 10), F.lit("/10"))).otherwise(F.concat(s(k * 5), F.lit("/5")))
    unit = F.when(n == 0, "MEQ").otherwise("MEQ/ML")
    p = B.table(spark, sf, "part").select(
        c("p_name").alias("ingredient_key"),
        F.lit("Inyectable").alias("dosage_form"),
        strength.alias("concentration"),
        unit.alias("concentration_unit"),
        T.generic_key(c("p_name"), strength, unit, F.lit("Inyectable")).alias("generic_key"),
        F.lit("ACTIVE").alias("status"),
    )
    return M.rate_equivalents(p)


def _request_texts(spark, sf):
    """Requests written exactly, without form, with a wrong dose, mistyped, by name only."""
    n, ing = c("p_partkey") % 5, F.upper("p_name")
    s = lambda x: x.cast("string")
    pack = s(10 * (1 + c("p_partkey") % 5))
    typo = F.concat(F.substring(ing, 1, 2), F.substring(ing, 4, 100))
    text = (
        F.when(n == 0, F.concat_ws(" ", ing, _spark_form(), F.concat(_strength(), F.lit("MG X"), pack)))
        .when(n == 1, F.concat(ing, F.lit(" "), _strength(), F.lit("MG")))
        .when(n == 2, F.concat_ws(" ", ing, _spark_form(), F.lit("999MG X10")))
        .when(n == 3, F.concat_ws(" ", typo, _spark_form(), F.concat(_strength(), F.lit("MG"))))
        .otherwise(ing)
    )
    return B.table(spark, sf, "part").select(text.alias("text"), F.lit(M.ANY_SECTOR).alias("sector")).distinct()


def _matched(spark, sf):
    return M.match_texts(_request_texts(spark, sf), B.products(spark, sf), synonyms(spark, sf), B.offers(spark, sf))


def match_decisions(spark, sf):
    return _matched(spark, sf).matches.select(
        "text", "decision", "confidence", F.coalesce("matched_product_id", F.lit("")).alias("product_id"),
        F.coalesce(c("asked_size"), F.lit(-1)).cast("long").alias("asked_size"),
    )


def candidate_top8(spark, sf):
    """Listed candidates after the stock preference."""
    return _matched(spark, sf).candidates.select(
        "text", c("position").cast("long").alias("position"), "product_id", "generic_key", "score", "in_stock"
    )


def match_notes(spark, sf):
    """What the best candidate of every open or refused text has in common with it: strength, form, package."""
    best = F.get(F.filter("reasons", lambda x: x.startswith("Mejor candidato: ")), F.lit(0))
    return _matched(spark, sf).matches.select("text", "decision", best.alias("note")).where("note is not null")


QUERIES = {
    "extract_attributes": extract_attribute_rows,
    "written_doses": written_doses,
    "normalize_text": normalized_documents,
    "word_tokens": document_words,
    "ingredient_key": ingredient_keys,
    "generic_key": generic_keys,
    "key_aliases": key_aliases,
    "normalized_name": normalized_names,
    "parse_price": parsed_prices,
    "availability_words": availability_words,
    "synonym_match": synonym_match,
    "subset_match": subset_match,
    "fuzzy_match": fuzzy_match,
    "brand_match": brand_match,
    "sector_match": sector_match,
    "exact_match": exact_match,
    "rate_equivalents": rate_equivalent_keys,
    "match_decisions": match_decisions,
    "candidate_top8": candidate_top8,
    "match_notes": match_notes,
}

_KEYS = "ckeys AS (SELECT ingredient_key AS k, count(DISTINCT generic_key) AS generics FROM products GROUP BY 1)"


def _search_oracle(raw: str) -> str:
    """Brute-force cascade over all names and all catalogue keys."""
    return views(
        PRODUCTS,
        _KEYS,
        f"raws AS (SELECT DISTINCT {raw} AS raw FROM part)",
        """syn AS (SELECT DISTINCT replace(p_name,'cold ','frio ') AS term, p_name AS canon FROM part WHERE p_name LIKE 'cold %')""",
        """q AS (SELECT raw, array_to_string(list_sort(string_split(raw,' ')),' ') AS own,
             array_to_string(list_sort(string_split(coalesce(canon, raw),' ')),' ') AS qk FROM raws LEFT JOIN syn ON term = raw)""",
        "ex AS (SELECT raw, k, own <> k AS via_synonym FROM q JOIN ckeys ON k IN (own, qk))",
        """su AS (SELECT raw, k FROM q JOIN ckeys ON k <> own AND k <> qk
             AND abs(len(string_split(k,' ')) - len(string_split(qk,' '))) BETWEEN 1 AND 2
             AND (list_has_all(string_split(k,' '), string_split(qk,' ')) OR list_has_all(string_split(qk,' '), string_split(k,' '))))""",
        "t1 AS (SELECT raw FROM ex UNION SELECT raw FROM su)",
        """fz AS (SELECT raw, k FROM q JOIN ckeys ON levenshtein(qk, k) <= greatest(1, length(qk)//7)
             WHERE raw NOT IN (SELECT raw FROM t1))""",
        """allhits AS (SELECT raw, k, 1 AS tier, via_synonym FROM ex UNION ALL SELECT raw, k, 1, false FROM su
             UNION ALL SELECT raw, k, 2, false FROM fz)""",
    )


_SEARCH_OUT = """SELECT raw, k AS ingredient_key, generics, CAST(min(tier) AS BIGINT) AS tier, bool_or(via_synonym) AS via_synonym
FROM allhits JOIN ckeys USING (k) GROUP BY 1, 2, 3"""

#: views of the matching, in the order in which they build on each other
CATALOGUE = (
    PRODUCTS, PRICE_ROWS, OFFERS,
    """vars AS (SELECT ingredient_key, generic_key, concentration, dosage_form, min(product_id) AS product_id FROM products GROUP BY ALL)""",
)
_ASKED = (
    """rq AS (SELECT DISTINCT CASE p_partkey % 5
        WHEN 0 THEN upper(p_name) || ' ' || CASE WHEN p_type IN ('STANDARD','SMALL','ECONOMY') THEN 'TAB' ELSE 'CAPS' END || ' ' || CAST(50*(1+p_size%5) AS VARCHAR) || 'MG X' || CAST(10*(1+p_partkey%5) AS VARCHAR)
        WHEN 1 THEN upper(p_name) || ' ' || CAST(50*(1+p_size%5) AS VARCHAR) || 'MG'
        WHEN 2 THEN upper(p_name) || ' ' || CASE WHEN p_type IN ('STANDARD','SMALL','ECONOMY') THEN 'TAB' ELSE 'CAPS' END || ' 999MG X10'
        WHEN 3 THEN upper(p_name[1:2] || p_name[4:]) || ' ' || CASE WHEN p_type IN ('STANDARD','SMALL','ECONOMY') THEN 'TAB' ELSE 'CAPS' END || ' ' || CAST(50*(1+p_size%5) AS VARCHAR) || 'MG'
        ELSE upper(p_name) END AS text,
        CASE WHEN p_partkey % 5 = 3 THEN p_name[1:2] || p_name[4:] ELSE p_name END AS name,
        CASE p_partkey % 5 WHEN 2 THEN '999' WHEN 4 THEN NULL ELSE CAST(50*(1+p_size%5) AS VARCHAR) END AS dose,
        CASE WHEN p_partkey % 5 IN (1,4) THEN 'No especificada' WHEN p_type IN ('STANDARD','SMALL','ECONOMY') THEN 'Tableta' ELSE 'Cápsula' END AS form,
        CASE p_partkey % 5 WHEN 0 THEN 10*(1+p_partkey%5) WHEN 2 THEN 10 ELSE -1 END AS asked
      FROM part)""",
)
EXACT = (
    """r AS (SELECT *, array_to_string(list_sort(string_split(name,' ')),' ') AS qk FROM rq)""",
    """exact AS (SELECT text, arg_min(p.product_id, (CASE WHEN asked > 0 AND p.presentation_quantity <> asked THEN 1 ELSE 0 END, p.product_id)) AS product_id
      FROM r JOIN products p ON p.ingredient_key = qk AND p.concentration = dose AND p.dosage_form = form GROUP BY 1)""",
    """keys AS (SELECT DISTINCT ingredient_key AS k FROM products)""",
)
FITS = (
    """fits AS (SELECT DISTINCT qk, k, qk = k AS same FROM (SELECT DISTINCT qk FROM r) JOIN keys ON k = qk
        OR (qk NOT IN (SELECT k FROM keys) AND levenshtein(qk, k) <= greatest(1, length(qk)//7)))""",
)
DECIDED = (
    """sc AS (SELECT r.text, r.dose, r.form, v.*, same,
        coalesce(v.concentration = r.dose, false) AS strong,
        CASE WHEN r.dose IS NULL THEN 0.0::DOUBLE ELSE
          ((CASE WHEN v.concentration = r.dose THEN 50 ELSE 0 END) + (CASE WHEN v.dosage_form = r.form THEN 30 ELSE 0 END) + (CASE WHEN same THEN 20 ELSE 0 END)) / 100.0::DOUBLE END AS score
      FROM r JOIN fits USING (qk) JOIN vars v ON v.ingredient_key = fits.k WHERE text NOT IN (SELECT text FROM exact))""",
    """agg AS (SELECT text, any_value(dose) AS dose, any_value(form) AS form, arg_min(product_id, (-score, product_id)) AS best, max(score) AS best_score,
        count(DISTINCT dosage_form) FILTER (strong) AS nforms, bool_and(same) FILTER (strong) AS all_same,
        arg_min(product_id, (-score, product_id)) FILTER (strong) AS strong_best, max(score) FILTER (strong) AS strong_score FROM sc GROUP BY 1)""",
    """dec AS (SELECT r.text, r.asked,
        CASE WHEN e.product_id IS NOT NULL THEN 'exact' WHEN a.text IS NULL THEN 'none' WHEN a.dose IS NULL THEN 'nodose'
             WHEN r.form = 'No especificada' AND nforms = 1 AND all_same THEN 'one' WHEN r.form = 'No especificada' AND nforms >= 1 THEN 'open'
             WHEN strong_score IS NOT NULL AND strong_score = best_score AND best_score >= 0.8 THEN 'review' ELSE 'no' END AS br,
        e.product_id AS exact_id, best_score, strong_best, strong_score
      FROM r LEFT JOIN exact e USING (text) LEFT JOIN agg a USING (text))""",
)
_MATCH = views(*CATALOGUE, *_ASKED, *EXACT, *FITS, *DECIDED)

ORACLES = {
    "extract_attributes": """
WITH p AS (SELECT p_partkey AS id, p_partkey % 7 AS n, upper(p_name) AS ing, string_split(p_name,' ') AS w, CAST(50*(1+p_size%5) AS INTEGER) AS s, 10*(1+p_partkey%5) AS pk FROM part),
x AS (SELECT id, n,
  CASE WHEN n = 4 THEN upper(array_to_string(list_sort(w), ' + ')) ELSE ing END AS active_ingredient,
  CASE n WHEN 2 THEN CAST(s//5 AS VARCHAR) WHEN 3 THEN CAST(s AS VARCHAR) || '/2'
    WHEN 4 THEN CASE WHEN w[2] < w[1] THEN CAST(s AS VARCHAR) || '/5' ELSE '5/' || CAST(s AS VARCHAR) END WHEN 5 THEN '0.5' WHEN 6 THEN '1000' ELSE CAST(s AS VARCHAR) END AS concentration,
  CASE n WHEN 2 THEN 'MG/ML' WHEN 3 THEN 'MG/ML' WHEN 5 THEN '%' WHEN 6 THEN 'MCG' ELSE 'MG' END AS concentration_unit,
  CASE n WHEN 1 THEN 'Cápsula' WHEN 2 THEN 'Suspensión' WHEN 3 THEN 'Inyectable' WHEN 5 THEN 'Crema' ELSE 'Tableta' END AS dosage_form,
  CASE n WHEN 2 THEN 'Frasco' WHEN 5 THEN 'Tubo' ELSE 'Caja' END AS presentation_type,
  CASE n WHEN 1 THEN 'cápsulas' WHEN 2 THEN 'ml' WHEN 3 THEN 'ampollas' WHEN 5 THEN 'g' ELSE 'tabletas' END AS presentation_unit,
  CAST(CASE n WHEN 2 THEN 120 WHEN 5 THEN 30 ELSE pk END AS BIGINT) AS presentation_quantity,
  array_to_string(list_sort(w),' ') AS ik FROM p)
SELECT id, active_ingredient, concentration, concentration_unit, dosage_form, presentation_type, presentation_unit,
  ik || ' ' || concentration || ' ' || lower(concentration_unit) || ' ' || lower(strip_accents(dosage_form)) AS generic_key, presentation_quantity FROM x""",
    "normalize_text": """SELECT doc_id, sha256(n) AS digest, CAST(length(n) AS BIGINT) AS n_chars FROM (
  SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{3000}\\x{FEFF}]+', ' ', 'g')) AS n FROM documents)""",
    "word_tokens": """SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(strip_accents(text)), '[^a-z0-9]+')) AS word FROM documents) WHERE word <> '' GROUP BY 1""",
    "ingredient_key": """SELECT array_to_string(list_sort(list_append(string_split(p_name,' '), lower(p_brand))),' ') AS ingredient_key, count(*) AS n FROM part GROUP BY 1""",
    "generic_key": views(PRODUCTS) + "SELECT product_id, generic_key FROM products",
    "key_aliases": views(PRODUCTS)
    + """SELECT product_id, ingredient_key || ' ' || v || ' ' || lower(strip_accents(dosage_form)) AS alias FROM products,
      LATERAL (SELECT unnest([concentration || '000 mcg', CAST(CAST(concentration AS INTEGER)/1000.0 AS VARCHAR) || ' g']) AS v)""",
    "normalized_name": views(PRODUCTS)
    + "SELECT product_id, generic_key || ' x' || presentation_quantity || ' ' || brand_text AS normalized_name FROM products",
    "parse_price": "SELECT l_orderkey, l_partkey, l_linenumber, max(floor(l_extendedprice*100+0.5)/100) AS price FROM lineitem GROUP BY ALL",
    "availability_words": """WITH x AS (SELECT (['Sí','Agotado','50','0','???','EN  STOCK','1,5'])[l_orderkey % 7 + 1] AS cell FROM lineitem)
SELECT cell, CASE WHEN cell IN ('Sí','EN  STOCK','50','1,5') THEN 'AVAILABLE' WHEN cell IN ('Agotado','0') THEN 'OUT_OF_STOCK' ELSE 'UNKNOWN' END AS availability,
  CASE cell WHEN '50' THEN 50.0::DOUBLE WHEN '1,5' THEN 1.5::DOUBLE WHEN '0' THEN 0.0::DOUBLE WHEN 'Agotado' THEN 0.0::DOUBLE ELSE -1.0::DOUBLE END AS stock, count(*) AS n FROM x GROUP BY ALL""",
    "synonym_match": _search_oracle("replace(p_name,'cold ','frio ')") + _SEARCH_OUT,
    "subset_match": _search_oracle("CASE WHEN p_partkey % 2 = 0 THEN p_name || ' forte' ELSE string_split(p_name,' ')[2] END") + _SEARCH_OUT,
    "fuzzy_match": _search_oracle("p_name[1:2] || p_name[4:]") + _SEARCH_OUT,
    "brand_match": views(PRODUCTS)
    + """, b AS (SELECT DISTINCT 'ZYQUABRAND' || substr(laboratory_id, 6, 2) AS brand, ingredient_key, generic_key FROM products),
q AS (SELECT DISTINCT 'zyquabrnd' || regexp_replace(p_brand,'[^0-9]','','g') AS raw FROM part)
SELECT raw, ingredient_key, count(DISTINCT generic_key) AS generics, 3::BIGINT AS tier, false AS via_synonym
FROM q JOIN b ON levenshtein(upper(raw), brand) <= greatest(1, length(raw)//7) GROUP BY 1, 2""",
    "exact_match": views(PRODUCTS)
    + """, t AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN active_ingredient || ' ' || concentration || '000MCG ' || dosage_form ELSE standard_name END AS text,
  generic_key, CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE presentation_quantity END AS asked FROM products)
SELECT text, arg_min(p.product_id, (CASE WHEN asked > 0 AND asked <> p.presentation_quantity THEN 1 ELSE 0 END, p.product_id)) AS product_id, generic_key
FROM t JOIN products p USING (generic_key) GROUP BY text, generic_key""",
    "rate_equivalents": """WITH p AS (SELECT DISTINCT p_name, 1+p_size%4 AS k, p_partkey%3 AS n FROM part),
g AS (SELECT *, array_to_string(list_sort(string_split(p_name,' ')),' ') || ' ' || CASE n WHEN 0 THEN CAST(k AS VARCHAR) || ' meq' WHEN 1 THEN CAST(k*10 AS VARCHAR) || '/10 meq/ml' ELSE CAST(k*5 AS VARCHAR) || '/5 meq/ml' END || ' inyectable' AS generic_key FROM p)
SELECT a.generic_key, b.generic_key AS member_key FROM g a JOIN g b ON a.p_name = b.p_name AND a.k = b.k AND a.n <> b.n""",
    "match_decisions": _MATCH
    + """SELECT text, CASE WHEN br IN ('exact','one') THEN 'MATCH' WHEN br IN ('nodose','open','review') THEN 'REVIEW' ELSE 'NO_MATCH' END AS decision,
  CASE br WHEN 'exact' THEN 1.0::DOUBLE WHEN 'one' THEN 1.0::DOUBLE WHEN 'nodose' THEN 0.0::DOUBLE WHEN 'none' THEN 0.0::DOUBLE WHEN 'open' THEN strong_score ELSE best_score END AS confidence,
  CASE br WHEN 'exact' THEN exact_id WHEN 'one' THEN strong_best ELSE '' END AS product_id, CAST(asked AS BIGINT) AS asked_size FROM dec""",
    "candidate_top8": _MATCH
    + """, pg AS (SELECT text, generic_key, br, min((-score, product_id)) AS o FROM sc JOIN dec USING (text) WHERE br NOT IN ('one','open') OR strong GROUP BY ALL),
top AS (SELECT text, generic_key, br, o[2] AS product_id, -o[1] AS score, row_number() OVER (PARTITION BY text ORDER BY o) AS position FROM pg QUALIFY position <= 8),
st AS (SELECT *, product_id IN (SELECT product_id FROM offers WHERE availability = 'AVAILABLE') AS in_stock FROM top),
ms AS (SELECT *, bool_or(in_stock) OVER (PARTITION BY text) AS any_stock FROM st)
SELECT text, position, product_id, generic_key, score, in_stock FROM ms WHERE br = 'one' OR in_stock OR NOT any_stock""",
    "written_doses": """
WITH p AS (SELECT p_partkey AS id, p_partkey % 8 AS n, upper(p_name) AS ing, string_split(p_name,' ') AS w, CAST(50*(1+p_size%5) AS VARCHAR) AS s, CAST(10*(1+p_partkey%5) AS BIGINT) AS pk FROM part),
x AS (SELECT id, n, array_to_string(list_sort(w), ' ') AS ik,
  CASE WHEN n IN (3, 6) THEN upper(array_to_string(list_sort(w), ' + ')) WHEN n = 4 THEN upper(w[2] || ' + ' || w[1]) ELSE ing END AS active_ingredient,
  CASE n WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN s || '/0.4' WHEN 3 THEN CASE WHEN w[2] <= w[1] THEN '2.5/0.02' ELSE '0.02/2.5' END WHEN 4 THEN s
    WHEN 5 THEN s || '/1.75' WHEN 6 THEN CASE WHEN w[2] <= w[1] THEN s || '/25' ELSE '25/' || s END ELSE '0.9' END AS concentration,
  CASE n WHEN 0 THEN 'G' WHEN 1 THEN 'MEQ' WHEN 2 THEN 'MG/ML' WHEN 3 THEN 'G' WHEN 5 THEN 'MG/ML' WHEN 7 THEN '%' ELSE 'MG' END AS concentration_unit,
  CASE WHEN n IN (1, 2, 5, 7) THEN 'Inyectable' ELSE 'Tableta' END AS dosage_form,
  CASE WHEN n IN (1, 2) THEN 'ampollas' WHEN n IN (5, 7) THEN 'ml' ELSE 'tabletas' END AS presentation_unit,
  CAST(CASE n WHEN 5 THEN 2 WHEN 7 THEN 1000 ELSE pk END AS BIGINT) AS presentation_quantity FROM p)
SELECT id, active_ingredient, concentration, concentration_unit, dosage_form, presentation_unit,
  ik || ' ' || concentration || ' ' || lower(concentration_unit) || ' ' || lower(dosage_form) AS generic_key, presentation_quantity FROM x""",
    "sector_match": views(
        PRODUCTS,
        "act AS (SELECT * REPLACE (CASE WHEN ingredient_key[1] < 'g' THEN 'ASEO' ELSE sector END AS sector) FROM products WHERE p_partkey % 5 < 3)",
        "sectors AS (SELECT unnest(['ASEO', 'MEDICAMENTOS', '*']) AS sec)",
        """ckeys AS (SELECT ingredient_key AS k, sec, count(DISTINCT generic_key) AS generics FROM act JOIN sectors ON sec = '*' OR sec = sector GROUP BY ALL)""",
        """raws AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN string_split(p_name,' ')[2] ELSE p_name[1:2] || p_name[4:] END AS raw,
          CASE p_partkey % 3 WHEN 0 THEN 'ASEO' WHEN 1 THEN 'MEDICAMENTOS' ELSE '*' END AS sec FROM part)""",
        "q AS (SELECT *, array_to_string(list_sort(string_split(raw,' ')),' ') AS qk FROM raws)",
        """t1 AS (SELECT raw, sec, k, generics FROM q JOIN ckeys USING (sec) WHERE k = qk OR (abs(len(string_split(k,' ')) - len(string_split(qk,' '))) BETWEEN 1 AND 2
             AND (list_has_all(string_split(k,' '), string_split(qk,' ')) OR list_has_all(string_split(qk,' '), string_split(k,' ')))))""",
        """t2 AS (SELECT raw, sec, k, generics FROM q JOIN ckeys USING (sec) WHERE levenshtein(qk, k) <= greatest(1, length(qk)//7)
             AND (raw, sec) NOT IN (SELECT (raw, sec) FROM t1))""",
    )
    + """SELECT raw, sec AS sector, k AS ingredient_key, generics, 1::BIGINT AS tier FROM t1 UNION ALL SELECT raw, sec, k, generics, 2::BIGINT FROM t2""",
    "match_notes": _MATCH
    + """SELECT d.text, CASE br WHEN 'review' THEN 'REVIEW' ELSE 'NO_MATCH' END AS decision, 'Mejor candidato: ' || p.standard_name || ' ('
  || CASE WHEN coalesce(p.concentration = r.dose, false) THEN 'misma concentración' ELSE 'concentración distinta' END || ', '
  || CASE WHEN p.dosage_form = r.form THEN 'misma forma farmacéutica' ELSE 'forma farmacéutica distinta' END || ', '
  || CASE WHEN p.presentation_quantity = r.asked AND p.dosage_form = r.form THEN 'misma presentación' ELSE 'presentación distinta' END || ').' AS note
FROM dec d JOIN r ON r.text = d.text JOIN agg ON agg.text = d.text JOIN products p ON p.product_id = agg.best WHERE br IN ('review', 'no')""",
}
