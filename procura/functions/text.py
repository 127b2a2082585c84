"""Column builders for text normalisation, identity keys and display formats."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as a browser regex sees it; Java's \s knows the ASCII part only.
SPACE = r"[\s\u000B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
WIDE_SPACE = r"[\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
NUMBER_PREFIX = r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"
CONNECTORS = ("de", "del")


def _accent_table() -> tuple[str, str]:
    """Every BMP letter whose decomposition is one base letter plus U+0300-036F marks."""
    src, dst = [], []
    for code in range(0xC0, 0xD7FF):
        if 0xAC00 <= code <= 0xD7A3:
            continue
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        base = "".join(p for p in parts if not 0x300 <= ord(p) <= 0x36F)
        if base != parts and len(base) == 1 and char != base:
            src.append(char)
            dst.append(base)
    marks = "".join(chr(c) for c in range(0x300, 0x370) if chr(c) not in src)
    return "".join(src) + marks, "".join(dst)


_ACCENTED, _PLAIN = _accent_table()


# The same characters one by one, for functions that take sets of them.
SPACES = " \t\n\u000B\f\r\u00A0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202F\u205F\u3000\uFEFF"


def strip_accents(c: Column) -> Column:
    # a text without a character of several bytes has no accents
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.translate(c, _ACCENTED, _PLAIN))


def collapse_spaces(c: Column) -> Column:
    blank = F.translate(c, SPACES, " " * len(SPACES))
    return F.trim(F.when(blank.contains("  "), F.regexp_replace(blank, "  +", " ")).otherwise(blank))


def trim_text(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def normalize_text(c: Column) -> Column:
    return collapse_spaces(F.lower(strip_accents(c)))


def normalize_header(c: Column) -> Column:
    """Header spelling for fixed supplier layouts: `_ . -` count as spaces."""
    return collapse_spaces(F.regexp_replace(F.lower(strip_accents(c)), r"[_.\-]+", " "))


def _key_words(normalized: Column) -> Column:
    return F.filter(
        F.split(normalized, " "),
        lambda w: w.rlike("[a-z]") & ~w.isin(*CONNECTORS),
    )


def ingredient_key(c: Column) -> Column:
    """Order-free spelling of an ingredient; repeated words stay repeated."""
    return F.array_join(F.array_sort(_key_words(normalize_text(c))), " ")


def generic_key(ingredient: Column, concentration: Column, unit: Column, form: Column) -> Column:
    """Identity shared by all laboratories and pack sizes of one medicine."""
    return generic_key_from(ingredient_key(ingredient), concentration, unit, form)


def generic_key_from(key: Column, concentration: Column, unit: Column, form: Column) -> Column:
    """Generic key when the ingredient key (already normalised) is at hand."""
    return F.trim(F.concat_ws(" ", key, normalize_text(F.concat_ws(" ", concentration, unit, form))))


def leading_number(c: Column) -> Column:
    """Double at the start of the text, null when there is none."""
    return F.nullif(F.regexp_extract(c, NUMBER_PREFIX, 1), F.lit("")).cast("double")


def half_up(c: Column, digits: int) -> Column:
    """Round a double by adding one half and flooring, the rule the results must follow."""
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def number_text(c: Column, digits: int = 6) -> Column:
    """Shortest decimal spelling of an already rounded double: 10.0 -> 10, 0.50 -> 0.5."""
    return F.regexp_replace(c.try_cast(f"decimal(30,{digits})").cast("string"), r"\.?0+$", "") if digits else c.try_cast("decimal(30,0)").cast("string")


# Steps between mass units: (unit, other unit, factor).
_MASS_STEPS = {
    "MCG": (("MG", 1e-3), ("G", 1e-6)),
    "MG": (("MCG", 1e3), ("G", 1e-3)),
    "G": (("MG", 1e3), ("MCG", 1e6)),
}


def generic_key_aliases(key: Column, concentration: Column, unit: Column, form: Column) -> Column:
    """The same generic written in the other mass units (array, may be empty)."""
    value = leading_number(concentration)
    own = generic_key_from(key, concentration, unit, form)

    def spelled(steps):
        keys = []
        for other, factor in steps:
            scaled = value * F.lit(factor) if factor > 1 else value / F.lit(round(1 / factor) * 1.0)
            keys.append(generic_key_from(key, number_text(half_up(scaled, 6)), F.lit(other), form))
        return F.array_except(F.array_distinct(F.array(*keys)), F.array(own))

    usable = ~concentration.contains("/") & value.isNotNull()
    ladder = F.when(~usable, F.array().cast("array<string>"))
    for mass_unit, steps in _MASS_STEPS.items():
        ladder = ladder.when(F.upper(unit) == mass_unit, spelled(steps))
    return ladder.otherwise(F.array().cast("array<string>"))


def normalized_name(generic: Column, quantity: Column, laboratory_normalized: Column) -> Column:
    """Catalogue identity: generic, pack size and laboratory."""
    return normalize_text(
        F.concat_ws(
            " ",
            generic,
            F.concat(F.lit("x"), quantity.cast("string")),
            F.coalesce(laboratory_normalized, F.lit("sin-laboratorio")),
        )
    )


def brand_of(standard_name: Column) -> Column:
    """Trade name in the last parenthesis, if it holds three letters in a row."""
    groups = F.regexp_extract_all(standard_name, F.lit(r"\(([^()]+)\)"), F.lit(1))
    last = trim_text(F.try_element_at(groups, F.lit(-1)))
    return F.when(last.rlike("[A-Za-z]{3,}"), F.upper(strip_accents(last)))


def word_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(strip_accents(c)), "[^a-z0-9]+"), lambda w: F.length(w) > 0)


def ingredient_typo_limit(length: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(length / 7).cast("int"))


def search_typo_limit(length: Column) -> Column:
    return F.greatest(F.lit(2), F.ceil(length / 3).cast("int"))


def money_text(c: Column, decimals: int) -> Column:
    """Pesos as written in Colombia: `$ 10.500` or `$ 33,33`."""
    pattern = "#,##0" + ("." + "0" * decimals if decimals else "")
    # cents first, so that halves go up as in the displayed totals
    value = F.floor(c.cast("decimal(30,6)") * (10**decimals) + F.lit(0.5).cast("decimal(2,1)")) / (10**decimals)
    return F.concat(F.lit("$\u00a0"), F.translate(F.call_function("format_number", value.cast(f"decimal(30,{decimals})"), F.lit(pattern)), ",.", ".,"))


# Answers a price list gives in its stock column.
AVAILABLE_WORDS = ("si", "s", "disponible", "disp", "true", "yes", "x", "en stock")
UNAVAILABLE_WORDS = ("no", "n", "no disponible", "agotado", "sin stock", "false", "0")


def availability_of(text: Column, norm: Column, number: Column | None = None) -> Column:
    """Struct(availability, stock) of a stock cell.

    `norm` is its normalised text, stored as a column by the caller because it is read
    several times; `number` is set for numeric cells.
    """
    typed = number if number is not None else F.lit(None).cast("double")
    counted = F.coalesce(
        typed, F.when(norm.rlike(r"^\d+([.,]\d+)?$"), F.replace(norm, F.lit(","), F.lit(".")).cast("double"))
    )
    refused = (text != "") & norm.isin(*UNAVAILABLE_WORDS)
    outcome = (
        F.when(counted > 0, F.struct(F.lit("AVAILABLE"), counted))
        .when(counted.isNotNull() | refused, F.struct(F.lit("OUT_OF_STOCK"), F.lit(0.0)))
        .when(norm.isin(*AVAILABLE_WORDS), F.struct(F.lit("AVAILABLE"), F.lit(None).cast("double")))
        .otherwise(F.struct(F.lit("UNKNOWN"), F.lit(None).cast("double")))
    )
    return outcome.cast("struct<availability:string,stock:double>")


def parse_price(text: Column, thousands: Column, decimal: Column, number: Column | None = None) -> Column:
    """Price cell to a double with two decimals; formats are columns because files differ."""
    kept = F.regexp_replace(text, r"[^0-9.,\-]", "")
    ungrouped = F.replace(kept, F.when(thousands == "none", " ").otherwise(thousands), F.lit(""))
    # only the first decimal sign becomes a point
    pointed = F.regexp_replace(ungrouped, F.when(decimal == ",", r"^([^,]*),").otherwise(r"^([^.]*)\."), F.lit("$1."))
    value = F.nullif(F.regexp_extract(pointed, r"^(-?(?:\d+\.?\d*|\.\d+))", 1), F.lit("")).cast("double")
    parsed = half_up(value, 2)
    return parsed if number is None else F.coalesce(half_up(number, 2), parsed)


def expiration_label(text: Column) -> Column:
    return F.nullif(trim_text(text), F.lit(""))


def is_safe_expiration(label: Column) -> Column:
    low = F.lower(strip_accents(label))
    return F.coalesce(low.contains("superior") & low.contains("12"), F.lit(False))
