"""Regex helpers that keep match positions, and number spellings in descriptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from procura.functions.vocab import PREFILLED_SYRINGE


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Label of a word: one branch per distinct label keeps the expression flat."""
    by_label: dict[str, list[str]] = {}
    for word, label in table.items():
        by_label.setdefault(label, []).append(word)
    pairs = list(by_label.items())
    first = F.when(key.isin(*pairs[0][1]), F.lit(pairs[0][0]))
    return reduce(lambda acc, p: acc.when(key.isin(*p[1]), F.lit(p[0])), pairs[1:], first)


def first_word_of(text: Column, words) -> Column:
    """First whole word (run of A-Z) that is in `words`, '' if none."""
    return F.regexp_extract(text, r"(?<![A-Z])(" + "|".join(words) + r")(?![A-Z])", 1)


def offset_of(text: Column, piece: Column) -> Column:
    """Zero-based place of `piece` in `text`, -1 if absent."""
    return F.instr(text, piece) - 1


# Separators that no description holds: between pieces, and between the fields of a match.
_CUT, _FIELD = "\u0001", "\u0002"


def mark_matches(text: Column, pattern: str) -> Column:
    """Pieces of the text, with every match of a two-group pattern as its own piece.

    One regex pass: odd places hold `match, group 1, group 2`. Store this as a column
    before calling `marked_matches`, which reads it several times.
    """
    return F.split(F.regexp_replace(text, pattern, f"{_CUT}$0{_FIELD}$1{_FIELD}$2{_CUT}"), _CUT)


def marked_matches(pieces: Column) -> Column:
    """array<struct<start,end,g1,g2>> with zero-based, end-exclusive offsets."""
    none = F.array().cast("array<struct<start:int,end:int,g1:string,g2:string>>")

    def step(acc, piece):
        fields = F.split(piece, _FIELD)
        end = acc["pos"] + F.length(F.get(fields, F.lit(0)))
        match = F.struct(
            acc["pos"].alias("start"),
            end.alias("end"),
            F.get(fields, F.lit(1)).alias("g1"),
            F.get(fields, F.lit(2)).alias("g2"),
        )
        return F.struct(
            end.alias("pos"),
            F.when(piece.contains(_FIELD), F.concat(acc["out"], F.array(match))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("pos"), none.alias("out"))
    return F.when(F.size(pieces) == 1, none).otherwise(F.aggregate(pieces, start, step)["out"])


def local_number(raw: Column) -> Column:
    """Number text with a point as decimal sign: 1.000 -> 1000, 1.000,5 -> 1000.5."""
    return (
        F.when(raw.contains(","), F.regexp_replace(F.replace(raw, F.lit("."), F.lit("")), r"^([^,]*),", "$1."))
        .when(raw.rlike(r"^[1-9]\d{0,2}\.\d{3}$"), F.replace(raw, F.lit("."), F.lit("")))
        .otherwise(raw)
    )


def local_volume(raw: Column, text: Column) -> Column:
    """As `local_number`, but a prefilled syringe is never filled with litres."""
    return F.when(~raw.contains(",") & text.rlike(PREFILLED_SYRINGE), raw).otherwise(local_number(raw))


def fold_unit(unit: Column) -> Column:
    return F.when(unit == "GR", "G").when(unit.isin("EMQ", "MQ"), "MEQ").otherwise(unit)
