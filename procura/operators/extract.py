"""Free-text product description -> structured attributes, in native expressions.

Every stage adds a few helper columns; the final struct is produced through a one-row
generator (`add_once`) so that filters on it never re-run the regexes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procura.functions import vocab as V
from procura.functions.once import add_once, spread
from procura.functions.patterns import (
    first_word_of,
    fold_unit,
    local_number,
    local_volume,
    lookup,
    mark_matches,
    marked_matches,
    offset_of,
)
from procura.functions.text import (
    WIDE_SPACE,
    generic_key_from,
    half_up,
    ingredient_key,
    leading_number,
    number_text,
    strip_accents,
    trim_text,
)

DOSE_UNIT = r"(?:MG\b|MCG\b|UI\b|MEQ\b|EMQ\b|MQ\b|GR\b|G\b|ML\b|%)"
COMBO_UNIT = r"(?:MG|MCG|UI|MEQ|GR|G|ML|%)"
CHAIN_UNIT = r"(?:MG|MCG|UI|MEQ|EMQ|MQ|GR|G|ML|%)"
DOSE = rf"({V.NUM}(?:\s*/\s*{V.NUM})?)\s*({DOSE_UNIT})"
SHARED_DOSE = rf"({V.NUM}(?:\s*\+\s*{V.NUM}){{1,3}})\s*({COMBO_UNIT})\b"
NEXT_DOSE = rf"\s*\+\s*({V.NUM})\s*({CHAIN_UNIT})\b"
PACK = rf"[X*]\s*({V.NUM})\s*(ML|L|G)?\b"
MEASURE = rf"({V.NUM})\s*(ML|L|G)\b"
RATIO = rf"^\s*/\s*({V.NUM})?\s*(ML|L|G)\b"
NAMES = r"[A-Z]+(?:\s+[A-Z]+)*?"
NAMED_PAIR = rf"^({NAMES})\s+({V.NUM})\s*({COMBO_UNIT})\s*\+\s*({NAMES})\s+({V.NUM})\s*({COMBO_UNIT})\b"
NAMED_THIRD = rf"^\s*\+\s*{NAMES}\s+{V.NUM}\s*{COMBO_UNIT}\b"
PACKAGING_END = r"(?:" + "|".join(V.WORD_TO_PACKAGING) + r")\s*$"

ATTRIBUTE_FIELDS = (
    "active_ingredient",
    "concentration",
    "concentration_unit",
    "dosage_form",
    "presentation_type",
    "presentation_quantity",
    "presentation_unit",
)


def first_only(text: Column, pattern: str, replacement: str) -> Column:
    """Replace the leftmost match only (groups of `pattern` start at 2)."""
    return F.regexp_replace(text, rf"(?s)^(.*?){pattern}", "$1" + replacement)


def _add_cleaned(df: DataFrame, text: Column, out: str) -> DataFrame:
    """Upper case without accents, sales-channel prefix and salt words."""
    t = F.col(out)
    steps = (
        F.regexp_replace(text, WIDE_SPACE, " "),
        F.upper(strip_accents(t)),
        F.regexp_replace(t, V.CHANNEL_PREFIX, ""),
        F.when(t.contains("EPINEFRINA"), first_only(t, V.WITHOUT_EPINEPHRINE, "")).otherwise(t),
        F.regexp_replace(t, V.SALT_WORDS, ""),
    )
    for step in steps:
        df = df.withColumn(out, step)
    return df


def _with_implied_units(upper: Column) -> Column:
    """`40/0.4 AMP` means milligrams in millilitres."""
    ratio = rf"({V.NUM})\s*/\s*({V.NUM})(\s*(?:{V.PREFILLED_SYRINGE}|AMPOLLAS?|AMP)\b)"
    return first_only(upper, ratio, "$2MG/$3ML$4")


def _form_phrase(text: Column) -> Column:
    first = F.when(text.contains(V.PHRASE_TO_FORM[0][0]), V.PHRASE_TO_FORM[0][0])
    return reduce(lambda acc, p: acc.when(text.contains(p[0]), p[0]), V.PHRASE_TO_FORM[1:], first)


def _add_form(df: DataFrame, text: str, form: str, offset: str) -> DataFrame:
    """Dosage form and its place (-1 if none) in cleaned upper-case text."""
    t = F.col(text)
    phrase, word = F.col("_phrase"), F.col("_form_word")
    df = df.withColumns({"_phrase": _form_phrase(t), "_form_word": first_word_of(t, V.WORD_TO_FORM)})
    powder = offset_of(t, F.lit("POLVO"))
    reconstituted = t.contains("RECONSTITUIR") & ~t.contains("ORAL")
    return df.withColumns(
        {
            form: F.when(phrase.isNotNull(), lookup(phrase, dict(V.PHRASE_TO_FORM)))
            .when(reconstituted, "Inyectable")
            .when(word != "", lookup(word, V.WORD_TO_FORM)),
            offset: F.when(phrase.isNotNull(), offset_of(t, phrase))
            .when(reconstituted, F.when(powder >= 0, powder).otherwise(offset_of(t, F.lit("RECONSTITUIR"))))
            .when(word != "", offset_of(t, word))
            .otherwise(-1),
        }
    )


def add_dosage_form(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Controlled dosage form of a column that holds just the form; null if unknown."""
    d = df.withColumn("_f", F.upper(strip_accents(F.col(text_col))))
    return _add_form(d, "_f", out, "_form_at").select(*[c for c in df.columns if c != out], out)


def _is_pack_size(text: Column, match: Column) -> Column:
    """A volume after X/* or after a packaging word (of a named combination) is no dose."""
    before = F.substring(text, F.lit(1), match["start"])
    combos = F.regexp_extract_all(before, F.lit(r"[A-Z]+\s*\+\s*[A-Z]+"), F.lit(0))
    named_combo = F.exists(combos, lambda m: m.rlike(r"^[A-Z]{4,}\s*\+\s*[A-Z]{4,}$"))
    return (match["g2"] == "ML") & (before.rlike(r"[X*]\s*$") | (before.rlike(PACKAGING_END) & named_combo))


def _dose(value: Column, unit: Column) -> Column:
    return F.struct(local_number(value).alias("value"), fold_unit(unit).alias("unit"))


def _mass_in_mcg(unit: Column) -> Column:
    return F.when(unit == "MCG", 1.0).when(unit == "MG", 1e3).when(unit == "G", 1e6)


def _harmonized(parts: Column) -> Column:
    """Mixed mass units are brought to the largest one present."""
    units = F.array_distinct(F.transform(parts, lambda p: p["unit"]))
    mixed = (F.size(units) >= 2) & F.forall(units, lambda u: u.isin("MCG", "MG", "G"))
    target = F.when(F.array_contains(units, "G"), "G").when(F.array_contains(units, "MG"), "MG").otherwise("MCG")

    def convert(p):
        scaled = leading_number(p["value"]) * _mass_in_mcg(p["unit"]) / _mass_in_mcg(target)
        return F.struct(number_text(half_up(scaled, 6)).alias("value"), target.alias("unit"))

    return F.when(mixed, F.transform(parts, convert)).otherwise(parts)


def _joined_names(name: Column) -> Column:
    """`A/B` between real names reads as a combination; short pieces keep the slash."""
    parts = F.transform(F.split(name, "/"), lambda p: F.trim(p))
    letters = lambda w: F.length(F.regexp_replace(w, "[^A-Z]", ""))
    every_real = F.forall(
        F.sequence(F.lit(0), F.size(parts) - 2),
        lambda i: (letters(F.regexp_extract(F.get(parts, i), r"(\S*)$", 1)) >= 3)
        & (letters(F.regexp_extract(F.get(parts, i + 1), r"^(\S*)", 1)) >= 3),
    )
    return F.when(name.contains("/"), F.when(every_real, F.array_join(parts, " + ")).otherwise(name)).otherwise(name)


def _sorted_pairs(names: Column, parts: Column) -> Column:
    """Names with their doses in ingredient-key order."""
    tagged = F.transform(
        names,
        lambda n, i: F.struct(
            ingredient_key(n).alias("key"),
            i.alias("i"),
            n.alias("name"),
            F.get(parts, i)["value"].alias("value"),
            F.get(parts, i)["unit"].alias("unit"),
        ),
    )
    return F.array_sort(tagged)


def _identity(pairs: Column) -> Column:
    return F.struct(
        F.array_join(F.transform(pairs, lambda p: p["name"]), " + ").alias("ingredient"),
        F.array_join(F.transform(pairs, lambda p: p["value"]), "/").alias("concentration"),
        F.get(pairs, F.lit(0))["unit"].alias("unit"),
    )


def _single(ingredient: Column, concentration: Column, unit: Column) -> Column:
    return F.struct(ingredient.alias("ingredient"), concentration.alias("concentration"), unit.alias("unit"))


def extract_attributes(
    df: DataFrame,
    text_col: str,
    require_presentation: bool | Column = True,
    out: str = "attrs",
) -> DataFrame:
    """Add struct column `out`, null where no dose (or no required pack size) is found.

    Fields: the seven attributes, `generic_key`, `ingredient_key`, `warnings` and
    `presentation_specified`.
    """
    required = F.lit(require_presentation) if isinstance(require_presentation, bool) else require_presentation
    c = F.col
    d = _add_cleaned(df, c(text_col), "_t").withColumn("_t", _with_implied_units(c("_t")))

    # dose
    d = d.withColumns(
        {
            "_shared_at": F.regexp_instr(c("_t"), F.lit(SHARED_DOSE)) - 1,
            "_dose_marks": mark_matches(c("_t"), DOSE),
            "_pack_marks": mark_matches(c("_t"), PACK),
            "_measure_marks": mark_matches(c("_t"), MEASURE),
        }
    )
    d = d.withColumn("_doses", marked_matches(c("_dose_marks")))
    shared = c("_shared_at") >= 0
    d = d.withColumns(
        {
            "_shared": F.when(shared, F.regexp_extract(c("_t"), SHARED_DOSE, 0)),
            "_shared_values": F.when(shared, F.regexp_extract(c("_t"), SHARED_DOSE, 1)),
            "_shared_unit": F.when(shared, F.regexp_extract(c("_t"), SHARED_DOSE, 2)),
            "_dose": F.when(~shared, F.get(F.filter(c("_doses"), lambda m: ~_is_pack_size(c("_t"), m)), F.lit(0))),
        }
    )
    d = d.withColumn(
        "_chain",
        F.when(
            c("_dose").isNotNull(),
            F.regexp_extract(F.substring(c("_t"), c("_dose")["end"] + 1, F.length("_t")), f"^(?:{NEXT_DOSE})+", 0),
        ),
    )
    chain = F.regexp_extract_all(c("_chain"), F.lit(NEXT_DOSE), F.lit(1))
    chain_units = F.regexp_extract_all(c("_chain"), F.lit(NEXT_DOSE), F.lit(2))
    d = d.withColumns(
        {
            "_dose_start": F.when(shared, c("_shared_at")).otherwise(c("_dose")["start"]),
            "_dose_end": F.when(shared, c("_shared_at") + F.length("_shared")).otherwise(
                c("_dose")["end"] + F.length("_chain")
            ),
            "_parts": F.when(
                shared,
                F.transform(F.split("_shared_values", r"\+"), lambda n: _dose(F.trim(n), c("_shared_unit"))),
            ).when(
                c("_dose").isNotNull(),
                F.concat(
                    F.array(_dose(c("_dose")["g1"], c("_dose")["g2"])),
                    F.transform(chain, lambda n, i: _dose(n, F.get(chain_units, i))),
                ),
            ),
        }
    )

    # pack size
    d = d.withColumns(
        {
            "_ratio": F.regexp_extract(F.substring(c("_t"), c("_dose_end") + 1, F.length("_t")), RATIO, 0),
            "_packs": F.filter(
                marked_matches(c("_pack_marks")),
                lambda m: (m["g2"] != "") | (m["end"] <= c("_dose_start")) | (m["start"] >= c("_dose_end")),
            ),
        }
    )
    d = d.withColumns(
        {
            "_ratio_size": F.regexp_extract("_ratio", RATIO, 1),
            "_ratio_unit": F.regexp_extract("_ratio", RATIO, 2),
            "_measures": F.when(
                ~F.exists("_packs", lambda m: m["g2"] != ""),
                F.filter(
                    marked_matches(c("_measure_marks")),
                    lambda m: ~F.exists(
                        c("_parts"), lambda p: (p["value"] == local_number(m["g1"])) & (p["unit"] == m["g2"])
                    )
                    & ((m["end"] <= c("_dose_start")) | (m["start"] >= c("_dose_end") + F.length("_ratio"))),
                ),
            ),
        }
    )
    d = d.withColumn("_sizes", F.when(c("_measures").isNull(), c("_packs")).otherwise(F.concat("_packs", "_measures")))
    largest = F.array_max(
        F.transform(
            "_sizes",
            lambda m, i: F.struct(
                leading_number(local_number(m["g1"])).alias("qty"), (-i).alias("rank"), m.alias("match")
            ),
        )
    )["match"]
    d = d.withColumn("_size", F.coalesce(F.get(F.filter("_sizes", lambda m: m["g2"] != ""), F.lit(0)), largest))
    d = d.withColumns(
        {
            "_single": F.when(c("_size").isNull(), F.regexp_extract("_t", V.SINGLE_CONTAINER, 1)).otherwise(""),
            "_pack_word": first_word_of(c("_t"), V.WORD_TO_PACKAGING),
        }
    )
    d = _add_form(d, "_t", "_form", "_form_at")

    # ingredient: text before form, dose and packaging
    pack_at = F.when(c("_pack_word") != "", offset_of(c("_t"), c("_pack_word")))
    cut = F.least(F.when(c("_form_at") >= 0, c("_form_at")), c("_dose_start"), pack_at)
    name = trim_text(F.substring(c("_t"), F.lit(1), cut))
    for pattern, repl in ((r"\s+", " "), (r"[+(),./\-]+$", ""), (r"\s[X*]$", "")):
        name = F.regexp_replace(name, pattern, repl)
    d = d.withColumn("_name", F.trim(name))
    unbalanced = F.length(F.regexp_replace("_name", r"[^(]", "")) > F.length(F.regexp_replace("_name", r"[^)]", ""))
    d = d.withColumn(
        "_name", F.when(unbalanced, F.trim(F.regexp_replace("_name", r"\([^(]*$", ""))).otherwise(c("_name"))
    )
    d = d.withColumns(
        {
            "_ingredient": _joined_names(c("_name")),
            "_dosage_form": F.coalesce(c("_form"), F.lit(V.UNKNOWN_FORM)),
            "_ok": F.coalesce(
                c("_parts").isNotNull()
                & (c("_name") != "")
                & (c("_size").isNotNull() | (c("_single") != "") | ~required),
                F.lit(False),
            ),
        }
    )

    # combinations: pair names with doses
    d = d.withColumns(
        {
            "_first": F.get(c("_parts"), F.lit(0)),
            "_names": F.filter(
                F.transform(F.split("_ingredient", r"\s*\+\s*"), lambda p: F.trim(p)), lambda p: p != ""
            ),
            "_percent": F.when(
                F.size("_parts") == 1, F.get(F.filter("_doses", lambda m: m["g2"] == "%"), F.lit(0))["g1"]
            ),
            "_pair_text": F.when(
                (F.size("_parts") == 1) & c("_t").contains("+"), F.regexp_extract("_t", NAMED_PAIR, 0)
            ).otherwise(""),
            "_ratio_volume": leading_number(local_volume(c("_ratio_size"), c("_t"))),
        }
    )
    first = c("_first")
    group = lambda i: F.regexp_extract("_pair_text", NAMED_PAIR, i)
    third = F.substring(c("_t"), F.length("_pair_text") + 1, F.length("_t")).rlike(NAMED_THIRD)
    sealed = c("_dosage_form").isin(*V.SEALED_FORMS)
    has_ratio = c("_ratio") != ""
    volume = F.when(c("_ratio_size") == "", F.lit(1.0)).otherwise(c("_ratio_volume"))
    dose_value = leading_number(first["value"])
    ratio_unit = F.concat(first["unit"], F.lit("/"), c("_ratio_unit"))
    plain = _single(c("_ingredient"), first["value"], first["unit"])
    d = d.withColumn(
        "_pairs",
        F.when(
            (F.size("_parts") > 1) & (F.size("_names") == F.size("_parts")),
            _sorted_pairs(c("_names"), _harmonized(c("_parts"))),
        ).when(
            (c("_pair_text") != "") & ~third,
            _sorted_pairs(
                F.array(F.trim(group(1)), F.trim(group(4))),
                F.array(_dose(group(2), group(3)), _dose(group(5), group(6))),
            ),
        ),
    )
    identity = (
        F.when(
            F.size("_parts") > 1, F.when(c("_pairs").isNotNull(), _identity(c("_pairs"))).otherwise(plain)
        )
        .when(c("_percent").isNotNull(), _single(c("_ingredient"), local_number(c("_percent")), F.lit("%")))
        .when(
            has_ratio & ~sealed,
            F.when(
                (volume > 0) & dose_value.isNotNull(),
                _single(c("_ingredient"), number_text(half_up(dose_value / volume, 4), 4), ratio_unit),
            ).otherwise(plain),
        )
        .when(
            has_ratio & sealed & (c("_ratio_size") != ""),
            F.when(
                volume != 1,
                _single(
                    c("_ingredient"),
                    F.concat(first["value"], F.lit("/"), number_text(half_up(volume, 4), 4)),
                    ratio_unit,
                ),
            ).otherwise(plain),
        )
        .when(c("_pairs").isNotNull(), _identity(c("_pairs")))
        .otherwise(plain)
    )
    d = d.withColumn("_id", F.when(c("_ok"), identity))
    d = d.withColumn("_ikey", ingredient_key(c("_id")["ingredient"]))

    # quantity and unit of the pack
    size_unit = c("_size")["g2"]
    raw_size = leading_number(local_volume(c("_size")["g1"], c("_t")))
    unit_by_form = F.coalesce(lookup(c("_dosage_form"), V.FORM_TO_UNIT), F.lit("unidades"))
    quantity = F.when(c("_size").isNull(), 1.0).when(size_unit == "L", half_up(raw_size * 1000, 0)).otherwise(
        half_up(raw_size, 0)
    )
    pack_unit = F.when(size_unit.isin("L", "ML"), "ml").when(size_unit == "G", "g").otherwise(unit_by_form)
    packaging = lookup(c("_pack_word"), V.WORD_TO_PACKAGING)
    warnings = F.array_compact(
        F.array(
            F.when(
                c("_single") != "",
                F.concat(
                    F.lit('No se encontró una cantidad explícita de presentación; se asumió 1 (envase "'),
                    c("_single"),
                    F.lit('").'),
                ),
            ).when(
                c("_size").isNull() & ~required,
                F.lit("No se especificó presentación; no afecta la homologación (se compara por unidad)."),
            ),
            F.when(
                c("_form").isNull(),
                F.lit("No se pudo determinar la forma farmacéutica; se dejó 'No especificada'."),
            ),
            F.when(packaging.isNull(), F.lit("No se pudo determinar el tipo de empaque; se asumió 'Caja'.")),
        )
    )
    ident = c("_id")
    fields = [
        ident["ingredient"].alias("active_ingredient"),
        ident["concentration"].alias("concentration"),
        ident["unit"].alias("concentration_unit"),
        c("_dosage_form").alias("dosage_form"),
        F.coalesce(packaging, F.lit("Caja")).alias("presentation_type"),
        quantity.try_cast("int").alias("presentation_quantity"),
        pack_unit.alias("presentation_unit"),
    ]
    fields += [
        generic_key_from(c("_ikey"), ident["concentration"], ident["unit"], c("_dosage_form")).alias("generic_key"),
        c("_ikey").alias("ingredient_key"),
        warnings.alias("warnings"),
        c("_size").isNotNull().alias("presentation_specified"),
    ]
    d = add_once(d, out, F.when(c("_ok"), F.struct(*fields)))
    return d.select(*[x for x in df.columns if x != out], out)


def extract_distinct(df: DataFrame, text_col: str, required_col: str, out: str = "attrs") -> DataFrame:
    """As `extract_attributes`, parsing each distinct (text, required) once.

    Lists repeat the same descriptions, and a parse costs far more than a shuffled row.
    """
    keyed = df.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))
    texts = spread(keyed.select(text_col, required_col).distinct())
    return keyed.join(extract_attributes(texts, text_col, F.col(required_col), out), [text_col, required_col], "left")


def add_ingredient_guess(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Name alone, for texts without a dose; null if any digit is left after pack sizes."""
    packaging = "|".join(V.WORD_TO_PACKAGING)
    g = F.col("_g")
    d = _add_cleaned(df, F.col(text_col), "_g")
    d = d.withColumn("_g", F.regexp_replace(trim_text(g), PACK, " "))
    d = d.withColumn("_g", trim_text(first_only(g, rf"({packaging})\s+{V.NUM}\s*(?:ML|L|G)\b", "$2")))
    d = _add_form(d, "_g", "_g_form", "_g_form_at").withColumn("_g_word", first_word_of(g, V.WORD_TO_PACKAGING))
    cut = F.least(
        F.when(F.col("_g_form_at") >= 0, F.col("_g_form_at")),
        F.when(F.col("_g_word") != "", offset_of(g, F.col("_g_word"))),
        F.length(g),
    )
    name = trim_text(F.substring(g, F.lit(1), cut))
    d = add_once(d, out, F.when(~g.rlike(r"\d"), F.nullif(name, F.lit(""))))
    return d.select(*[c for c in df.columns if c != out], out)
