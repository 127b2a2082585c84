from pyspark.sql import functions as F

from procura.operators.compare import decide, same_concentration, score

# value, unit, other value, other unit, other form, same strength?
CASES = [
    ("1.5", "G", "1/0.5", "G", "Inyectable", True),
    ("1/0.5", "G", "1.5", "G", "Inyectable", True),
    ("2", "G", "1/0.5", "G", "Inyectable", False),
    ("30", "MG/ML", "10/20", "MG/ML", "Inyectable", False),
    ("0.5/0.25", "MG", "0.50/0.25", "MG", "Solución inhalada", True),
    ("0.5/0.25", "MG", "1/0.25", "MG", "Solución inhalada", False),
    ("3", "MG/ML", "0.3", "%", "Solución", True),
    ("15", "%", "600/4", "MG/ML", "Inyectable", True),
    ("15", "%", "100/4", "MG/ML", "Inyectable", False),
    ("2", "MEQ", "20/10", "MEQ/ML", "Inyectable", True),
    ("2", "MEQ", "10/10", "MEQ/ML", "Inyectable", False),
    ("1200", "UI", "1200/1", "UI/ML", "Inyectable", False),
    ("10", "MG", "10", "mg", "Tableta", True),
    ("5", "%", "50", "MG", "Tableta", False),
]


def test_concentrations(spark):
    df = spark.createDataFrame(CASES, "a string, u string, b string, v string, f string, want boolean")
    c = F.col
    bad = df.withColumn("got", same_concentration(c("a"), c("u"), c("b"), c("v"), c("f"))).where("got is null or got <> want")
    assert bad.collect() == []


def test_score_and_decision(spark):
    flags = [(a, b, x) for a in (True, False) for b in (True, False) for x in (True, False)]
    df = spark.createDataFrame(flags, "a boolean, b boolean, x boolean")
    c = F.col
    d = df.withColumn("s", score(c("a"), c("b"), c("x"))).withColumn("d", decide(c("s"), c("a")))
    got = {(r.a, r.b, r.x): (r.s, r.d) for r in d.collect()}
    assert got[True, True, True] == (1.0, "MATCH")
    assert got[True, True, False] == (0.8, "REVIEW")
    assert got[True, False, True] == (0.7, "NO_MATCH")
    assert got[False, True, True] == (0.5, "NO_MATCH")
