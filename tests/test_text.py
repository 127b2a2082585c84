from pyspark.sql import functions as F

from procura.functions import text as T


def values(spark, *columns):
    return tuple(spark.range(1).select(*[col.alias(f"c{i}") for i, col in enumerate(columns)]).first())


def test_keys_and_normalisation(spark):
    got = values(
        spark,
        T.normalize_text(F.lit("  ÁCIDO  Fólico  Ñame ")),
        T.ingredient_key(F.lit("CLORURO DE SODIO")),
        T.ingredient_key(F.lit("Sodio 12 del cloruro cloruro")),
        T.generic_key(F.lit("VALPROICO ACIDO"), F.lit("250"), F.lit("MG"), F.lit("Cápsula")),
        T.normalized_name(F.lit("a 1 mg tableta"), F.lit(30), F.lit(None).cast("string")),
        T.brand_of(F.lit("LOSARTAN (AS) 50MG (Cozáar)")),
        T.brand_of(F.lit("LOSARTAN 50MG (5%)")),
    )
    assert got == (
        "acido folico name", "cloruro sodio", "cloruro cloruro sodio", "acido valproico 250 mg capsula",
        "a 1 mg tableta x30 sin-laboratorio", "COZAAR", None,
    )


def test_aliases_follow_the_mass_scale_only(spark):
    key = lambda conc, unit: T.generic_key_aliases(F.lit("x"), F.lit(conc), F.lit(unit), F.lit("Tableta"))
    got = values(spark, key("0.25", "MG"), key("1", "G"), key("500", "MCG"), key("1/0.5", "G"), key("5", "%"))
    assert got[0] == ["x 250 mcg tableta", "x 0.00025 g tableta"]
    assert got[1] == ["x 1000 mg tableta", "x 1000000 mcg tableta"]
    assert got[2] == ["x 0.5 mg tableta", "x 0.0005 g tableta"]
    assert got[3] == [] and got[4] == []


def test_prices(spark):
    p = lambda s, t, d: T.parse_price(F.lit(s), F.lit(t), F.lit(d))
    got = values(
        spark, p("$ 10.500,00", ".", ","), p("10,500.50", ",", "."), p("N/A", ".", ","), p("8.200", ".", ","),
        p("10-5", ".", ","), p("85.50", "none", "."), T.parse_price(F.lit("x"), F.lit("."), F.lit(","), F.lit(10.005)),
        p("-5", ".", ","), p("1,2,3", "none", ","),
    )
    assert got == (10500.0, 10500.5, None, 8200.0, 10.0, 85.5, 10.01, -5.0, 1.2)


def test_availability(spark):
    rows = spark.createDataFrame([("Sí",), ("Agotado",), ("50",), ("0",), ("???",), ("",), (None,)], "t string")
    rows = rows.withColumn("n", T.normalize_text(F.col("t")))
    got = [tuple(r[0]) for r in rows.select(T.availability_of(F.col("t"), F.col("n"))).collect()]
    assert got == [
        ("AVAILABLE", None), ("OUT_OF_STOCK", 0.0), ("AVAILABLE", 50.0), ("OUT_OF_STOCK", 0.0),
        ("UNKNOWN", None), ("UNKNOWN", None), ("UNKNOWN", None),
    ]
    typed = values(spark, T.availability_of(F.lit("7"), F.lit("7"), F.lit(7.0)), T.availability_of(F.lit("-1"), F.lit("-1"), F.lit(-1.0)))
    assert tuple(typed[0]) == ("AVAILABLE", 7.0) and tuple(typed[1]) == ("OUT_OF_STOCK", 0.0)


def test_money_expiry_and_limits(spark):
    got = values(
        spark, T.money_text(F.lit(1234567.5), 0), T.money_text(F.lit(33.3333), 2), T.is_safe_expiration(F.lit("Superior a 12 meses")),
        T.is_safe_expiration(F.lit("6 meses")), T.is_safe_expiration(F.lit(None).cast("string")),
        T.ingredient_typo_limit(F.lit(6)), T.ingredient_typo_limit(F.lit(21)), T.search_typo_limit(F.lit(10)), T.half_up(F.lit(1.005), 2),
    )
    assert got == ("$ 1.234.568", "$ 33,33", True, False, False, 1, 3, 4, 1.0)


def test_spaces_of_every_kind_are_trimmed_and_collapsed(spark):
    kinds = list(" \t\n\u000b\f\r\u00a0\u1680\u2000\u2003\u200a\u2028\u2029\u202f\u205f\u3000\ufeff")
    rows = [(s, f"{s}{s}a{s} b{s}") for s in kinds] + [(" ", "a  b"), ("", "áÑ"), (None, None)]
    d = spark.createDataFrame(rows, "s string, t string")
    got = d.select("s", "t", T.trim_text(F.col("t")).alias("x"), T.normalize_text(F.col("t")).alias("y")).collect()
    for r in got:
        if r.t is None:
            assert r.x is None and r.y is None
        elif r.t == "áÑ":
            assert (r.x, r.y) == ("áÑ", "an")
        else:
            assert (r.x, r.y) == (r.t.strip("".join(kinds)), "a b")
