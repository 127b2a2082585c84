"""Catalogue search against a scan of all names."""

import random

from procura.operators import browse
from procura.operators import search as S

PRODUCT = "product_id string, standard_name string, status string, sector string"
WORDS = "tab acetaminofen ibuprofeno losartan 500mg 50mg caja x10 jarabe suero".split()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def scan(products, query, sector, limit):
    q = query.strip()
    out = []
    for pid, name, status, own in products:
        if status != "ACTIVE" or (sector not in (None, "*") and own != sector):
            continue
        name = name or ""
        if q.lower() in name.lower():
            out.append((0, 0, name, pid))
            continue
        words = name.lower().split()
        best = [min((distance(w, x) for x in words), default=99) for w in q.lower().split()]
        if all(b <= max(2, -(-len(w) // 3)) for b, w in zip(best, q.lower().split())):
            out.append((1, sum(best), name, pid))
    return [(pid, tier == 0, d) for tier, d, _, pid in sorted(out)[:limit]]


def test_search_equals_a_scan(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 4)
    rng = random.Random(3)
    products = [
        (f"p{i}", " ".join(["TAB", *(w.upper() for w in rng.sample(WORDS[1:], 3))]), "ACTIVE" if i % 11 else "INACTIVE", ("A", "B", None)[i % 3])
        for i in range(400)
    ] + [("e1", "", "ACTIVE", "A"), ("e2", None, "ACTIVE", "A"), ("e3", "T", "ACTIVE", "A"), ("e4", "ÑANDÚ TAB", "ACTIVE", "B")]
    queries = [(q, s) for q in ("tab", "tab 500mg", "acetaminofn 500mg", "TAB LOSARTAN", "ibuprofno jarbe", "zzzzzzzzzzzz", "x", " suero tab ", "tb losartn x10", "b l") for s in (None, "A", "*")]
    queries += [("tab", "A"), (None, "A"), ("", None), ("tab", "none such")]
    asked = spark.createDataFrame(queries, "query string, sector string")
    listed = spark.createDataFrame(products, PRODUCT)
    for budget in (8, 100000):
        got = {}
        for r in sorted(S.search_products(listed, asked, first_budget=budget).collect(), key=lambda r: r["rank"]):
            got.setdefault((r.query, r.asked_sector), []).append((r.product_id, r.exact, r.distance))
        expected = {}
        for q, s in queries:
            if q and len(q.strip()) >= 2:
                rows = scan(products, q, s, 8)
                if rows:
                    expected[(q.strip(), s or "*")] = rows
        assert got == expected


def test_search_in_an_empty_catalogue_and_for_nothing(spark):
    none, some = spark.createDataFrame([], PRODUCT), spark.createDataFrame([("1", "TAB X", "ACTIVE", "A")], PRODUCT)
    asked = spark.createDataFrame([("tab",)], "query string")
    assert S.search_products(none, asked).count() == 0
    assert S.search_products(some, asked.limit(0)).count() == 0
    assert [r.product_id for r in S.search_products(some, asked).collect()] == ["1"]


def test_equal_names_beyond_the_list_are_left_out(spark):
    rows = [(f"p{i:03}", "TAB LOSARTAN" if i < 50 else "TAB SUERO", "ACTIVE", "A" if i % 2 else "B") for i in range(60)]
    listed = spark.createDataFrame(rows, PRODUCT)
    assert browse.firsts_of_names(listed, 8, "sector", "standard_name").count() == 26
    asked = spark.createDataFrame([("losartan",), ("tab",), ("losrtan",)], "query string")
    for query in ("losartan", "tab", "losrtan"):
        want = [pid for pid, *_ in scan(rows, query, None, 8)]
        for found in (S.search_products(listed, asked), browse.search_products(listed, asked)):
            assert [r.product_id for r in found.where(f"query = '{query}'").orderBy("rank").collect()] == want


def test_the_catalogue_is_never_broadcast(spark):
    listed = spark.createDataFrame([("p1", "TAB LOSARTAN", "ACTIVE", "A")], PRODUCT)
    found = browse.substring_hits(listed, spark.createDataFrame([("tab",)], "query string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=merge)" in plan
