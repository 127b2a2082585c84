"""Matching widened by outside suggestions and settled by outside verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from procura.operators import match as M
from procura.plans import bridge as B
from procura.plans.match_queries import CATALOGUE, DECIDED, EXACT, synonyms
from procura.plans.oracle_views import views

c = F.col


def _asked_parts(spark, sf):
    """Texts by product: without form, mistyped, and under names that nobody knows, with and without form."""
    number, name = c("p_partkey") % 4, F.upper("p_name")
    dose = F.concat((50 * (1 + c("p_size") % 5)).cast("string"), F.lit("MG"))
    form = F.when(c("p_type").isin("STANDARD", "SMALL", "ECONOMY"), "TAB").otherwise("CAPS")
    mistyped = F.concat(F.substring(name, 1, 2), F.substring(name, 4, 100))
    unknown = F.translate(name, "AEIOU", "ZZZZZ")
    text = (
        F.when(number == 0, F.concat_ws(" ", name, dose))
        .when(number == 1, F.concat_ws(" ", mistyped, form, dose))
        .when(number == 2, F.concat_ws(" ", unknown, form, dose))
        .otherwise(F.concat_ws(" ", unknown, dose))
    )
    return B.table(spark, sf, "part").withColumn("text", text)


def _suggestions(parts):
    """Guesses by rank: an unknown name, then the right one for every other name's length, at last the right one or a single word."""
    even, name = F.length("p_name") % 2 == 0, c("p_name")
    guesses = F.array(
        F.translate(name, "aeiou", "xxxxx"),
        F.when(even, name).otherwise(F.translate(name, "aeiou", "yyyyy")),
        F.when(even, F.split(name, " ")[0]).otherwise(name),
    )
    return parts.select("text", F.posexplode(guesses).alias("rank", "guess")).distinct()


def _verdicts(parts):
    """Verdicts by product: its own id, none of the candidates, an id nobody listed, undecided, or silence."""
    kind = c("p_partkey") % 5
    told = parts.where(kind < 4)
    return told.select(
        "text",
        F.when(kind.isin(0, 2), "MATCH").when(kind == 1, "NO_MATCH").otherwise("REVIEW").alias("decision"),
        F.when(kind == 0, 0.9).when(kind == 1, 0.7).when(kind == 2, 0.95).otherwise(0.6).alias("confidence"),
        F.when(kind == 0, c("p_partkey").cast("string")).when(kind == 2, "none such").alias("candidate_id"),
        F.array(F.lit("leído")).alias("reasons"),
    )


def verdict_overlay(spark, sf):
    """Decisions after suggestions and verdicts; many texts have several verdicts."""
    parts = _asked_parts(spark, sf)
    texts = parts.select("text", F.lit(M.ANY_SECTOR).alias("sector"))
    out = M.match_texts(texts, B.products(spark, sf), synonyms(spark, sf), B.offers(spark, sf), _suggestions(parts), _verdicts(parts))
    return out.matches.select("text", "decision", "confidence", F.coalesce("matched_product_id", F.lit("")).alias("product_id"), "source")


QUERIES = {"verdict_overlay": verdict_overlay}

_FORM = "CASE WHEN p_type IN ('STANDARD','SMALL','ECONOMY') THEN 'TAB' ELSE 'CAPS' END"
_VIEWS = views(
    *CATALOGUE,
    f"""asked AS (SELECT *, CASE n WHEN 1 THEN p_name[1:2] || p_name[4:] WHEN 0 THEN p_name ELSE translate(p_name, 'aeiou', 'zzzzz') END AS name,
        CASE WHEN n IN (0, 3) THEN 'No especificada' WHEN {_FORM} = 'TAB' THEN 'Tableta' ELSE 'Cápsula' END AS form
      FROM (SELECT p_partkey, p_name, p_type, p_partkey % 4 AS n, CAST(50 * (1 + p_size % 5) AS VARCHAR) AS dose FROM part))""",
    f"""told AS (SELECT *, upper(name) || CASE WHEN n IN (0, 3) THEN ' ' ELSE ' ' || {_FORM} || ' ' END || dose || 'MG' AS text FROM asked)""",
    "rq AS (SELECT DISTINCT text, name, dose, form, -1 AS asked FROM told)",
    *EXACT,
    """own AS (SELECT DISTINCT qk, k, qk = k AS same FROM (SELECT DISTINCT qk FROM r) JOIN keys ON k = qk
        OR (qk NOT IN (SELECT k FROM keys) AND levenshtein(qk, k) <= greatest(1, length(qk)//7)))""",
    """fits AS (SELECT * FROM own UNION SELECT r.qk, array_to_string(list_sort(string_split(p_name,' ')),' '), false
        FROM r JOIN told USING (text) WHERE n > 1 AND r.qk NOT IN (SELECT qk FROM own))""",
    *DECIDED,
    """elig AS (SELECT text, generic_key, o[2] AS product_id FROM (SELECT text, generic_key, min((-score, product_id)) AS o
        FROM sc JOIN dec USING (text) WHERE strong AND br IN ('open', 'review') GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY text ORDER BY o) <= 8)""",
    """said AS (SELECT text, p_partkey % 5 AS kind, CASE p_partkey % 5 WHEN 0 THEN 0.9 WHEN 1 THEN 0.7 ELSE 0.6 END::DOUBLE AS sure,
        CASE p_partkey % 5 WHEN 0 THEN CAST(p_partkey AS VARCHAR) END AS candidate FROM told WHERE p_partkey % 5 IN (0, 1, 3))""",
    """admitted AS (SELECT text, arg_max(kind, (sure, candidate)) AS kind, max(sure) AS sure, max(candidate) AS candidate FROM said
        WHERE text IN (SELECT text FROM elig) AND (candidate IS NULL OR (text, candidate) IN (SELECT (text, product_id) FROM elig)) GROUP BY 1)""",
)
ORACLES = {
    "verdict_overlay": _VIEWS
    + """SELECT text, CASE WHEN br IN ('exact', 'one') OR kind = 0 THEN 'MATCH' WHEN br IN ('no', 'none') OR (br = 'review' AND kind = 1) THEN 'NO_MATCH' ELSE 'REVIEW' END AS decision,
  CASE WHEN kind = 0 OR (br = 'review' AND kind = 1) THEN sure WHEN br IN ('exact', 'one') THEN 1.0::DOUBLE WHEN br = 'none' THEN 0.0::DOUBLE
    WHEN br = 'open' THEN strong_score ELSE best_score END AS confidence,
  CASE WHEN kind = 0 THEN candidate WHEN br = 'exact' THEN exact_id WHEN br = 'one' THEN strong_best ELSE '' END AS product_id,
  CASE WHEN kind IS NOT NULL THEN 'ai' ELSE 'deterministic' END AS source FROM dec LEFT JOIN admitted USING (text)""",
}
