"""Attribute comparison and scoring of catalogue candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from procura.functions import vocab as V
from procura.functions.text import leading_number


def _parts(value: Column) -> Column:
    return F.transform(F.split(value, "/"), leading_number)


def rate_of(value: Column, unit: Column) -> Column:
    """Milliequivalents per unit or per ml; null for every other unit."""
    parts = _parts(value)
    first = F.get(parts, F.lit(0))
    second = F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(F.lit(1.0))
    return F.when(F.upper(unit) == "MEQ", leading_number(value)).when(
        F.upper(unit) == "MEQ/ML", F.try_divide(first, F.nullif(second, F.lit(0.0)))
    )


def _mg_per_ml(value: Column, unit: Column) -> Column:
    parts = _parts(value)
    ratio = F.try_divide(F.get(parts, F.lit(0)), F.nullif(F.get(parts, F.lit(1)), F.lit(0.0)))
    number = F.when(value.contains("/"), ratio).otherwise(leading_number(value))
    return F.when(unit.isin("MG", "MG/ML"), number).when(unit == "%", number * 10)


def same_concentration(value: Column, unit: Column, other: Column, other_unit: Column, other_form: Column) -> Column:
    """Same strength, also when written as a sum, in parts, as a rate or as a percentage."""
    u, v = F.upper(unit), F.upper(other_unit)
    near = lambda a, b, eps: F.coalesce(F.abs(a - b) < eps, F.lit(False))
    split, other_split = value.contains("/"), other.contains("/")
    mine, theirs = _parts(value), _parts(other)
    pair_sum = lambda p: F.when(F.size(p) == 2, F.get(p, F.lit(0)) + F.get(p, F.lit(1)))
    by_sum = (split & ~other_split & near(pair_sum(mine), leading_number(other), 0.01)) | (
        ~split & other_split & near(pair_sum(theirs), leading_number(value), 0.01)
    )
    by_part = (
        split
        & other_split
        & (F.size(mine) == F.size(theirs))
        & F.forall(F.zip_with(mine, theirs, lambda a, b: near(a, b, 0.01)), lambda x: x)
    )
    rate, other_rate = rate_of(value, unit), rate_of(other, other_unit)
    return (
        F.when((value == other) & (u == v), True)
        .when((u == v) & ~u.contains("/") & (by_sum | by_part), True)
        .when(rate.isNotNull() & other_rate.isNotNull(), near(rate, other_rate, 0.001))
        .when(~other_form.isin(*V.PERCENT_FORMS), False)
        .otherwise(near(_mg_per_ml(value, u), _mg_per_ml(other, v), 0.001))
    )


def score(same_strength: Column, same_form: Column, exact_ingredient: Column) -> Column:
    points = lambda flag, weight: F.when(flag, F.lit(weight)).otherwise(F.lit(0))
    return ((points(same_strength, 50) + points(same_form, 30) + points(exact_ingredient, 20)) / F.lit(100.0)).cast("double")


def decide(points: Column, same_strength: Column) -> Column:
    """MATCH needs the same strength and 0.95; from 0.8 a person has to look."""
    return (
        F.when(~same_strength, F.when(points >= 0.8, "REVIEW").otherwise("NO_MATCH"))
        .when(points >= 0.95, "MATCH")
        .when(points >= 0.8, "REVIEW")
        .otherwise("NO_MATCH")
    )
