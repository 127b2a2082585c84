"""Selection against a plain per-item reference on random offers; skewed joins; maths."""

import random
from decimal import Decimal as D

from pyspark.sql import functions as F

from procura.operators import pricing as P
from procura.operators.skew import hot_keys, skew_join

OFFERS = (
    "offer_id string, supplier_id string, product_id string, generic_key string, presentation_quantity int, presentation_unit string, "
    "per_container boolean, price decimal(14,2), unit_price decimal(18,4), availability string, stock_quantity int, safe boolean, supplier_name string"
)


def random_offers(rng, n):
    rows = []
    for i in range(n):
        per = rng.random() < 0.2
        size, price = rng.choice([1, 10, 30, 300]), D(rng.randint(100, 4000)) / 10
        state = rng.choice(["AVAILABLE", "AVAILABLE", "UNKNOWN", "OUT_OF_STOCK", "PARTIAL"])
        stock = rng.choice([None, 0, 1, 3, 7, 20, 80])
        s = str(rng.randint(1, 6))
        rows.append((f"o{i:03}", s, f"p{i}", rng.choice("AAAB"), size, "ml" if per else "tabletas", per, price, price, state, stock, rng.random() < 0.4, "S" + s))
    return rows


def packages(q, asked, size, per):
    return q if per else -(-(q * (1 if asked == -1 else asked)) // size)


def expected(rows, demand, preferred=None, tol=0.02):
    key, q, asked = demand
    pool = []
    for r in rows:
        if r[3] != key:
            continue
        n = packages(q, asked, r[4], r[6])
        ok = r[9] == "UNKNOWN" or (r[9] != "OUT_OF_STOCK" and not (r[10] is not None and r[10] < n))
        if ok:
            pool.append((r[7] * n, r[0], r[11], r[1]))
    safe = [x for x in pool if x[2]]
    n_all, pool = len(pool), safe or pool
    if not pool:
        return (0, 0, None, None, None)
    best = min(pool)[:2]
    mine = [x[:2] for x in pool if x[3] == preferred]
    if mine and float(min(mine)[0] - best[0]) / float(best[0]) <= tol:
        best = min(mine)
    return (n_all, len(pool), best[1], best[0], max(x[0] for x in pool) - best[0])


def test_selection_matches_item_by_item_choice(spark):
    rng = random.Random(3)
    rows = random_offers(rng, 60)
    offers = spark.createDataFrame(rows, OFFERS)
    demands = sorted({(rng.choice("AB"), rng.randint(1, 400), rng.choice([-1, 10, 30])) for _ in range(60)})
    wanted = spark.createDataFrame(demands, "generic_key string, quantity int, asked_size int")
    for rules in (P.PricingRules(), P.PricingRules("3", 0.5)):
        got = {
            (r.generic_key, r.quantity, r.asked_size): (r.n_eligible, r.pool_size, r.selected_offer_id, r.total_price, r.savings)
            for r in P.select_offers(wanted, offers, rules=rules).collect()
        }
        assert got == {d: expected(rows, d, rules.preferred_supplier_id, rules.preferred_supplier_tolerance) for d in demands}
    # the stored comparison agrees: at most one selected, always eligible
    options = P.mark_selected(P.compare_offers(wanted, offers), P.select_offers(wanted, offers))
    assert options.where("selected and not eligible").count() == 0
    assert options.groupBy(*P.DEMAND).agg(F.count_if("selected").alias("n")).where("n > 1").count() == 0
    shown = P.top_alternatives(P.select_offers(wanted, offers), offers, limit=5)
    sizes = shown.groupBy(*P.DEMAND).agg(F.count(F.lit(1)).alias("n"), F.count_if("selected").alias("s"))
    assert sizes.where("n > 6 or s > 1").count() == 0


def test_family_members_are_compared_together(spark):
    rows = [
        ("a", "1", "p1", "kcl 2 meq", 10, "ampollas", True, D(50), D(50), "AVAILABLE", 9, True, "S"),
        ("b", "1", "p2", "kcl 20/10 meq/ml", 10, "ampollas", True, D(40), D(40), "AVAILABLE", 9, True, "S"),
    ]
    offers = spark.createDataFrame(rows, OFFERS)
    family = spark.createDataFrame([("kcl 2 meq", "kcl 20/10 meq/ml")], "generic_key string, member_key string")
    wanted = spark.createDataFrame([("kcl 2 meq", 5, -1)], "generic_key string, quantity int, asked_size int")
    best = P.select_offers(wanted, offers, family).first()
    assert (best.selected_offer_id, best.n_eligible) == ("b", 2)


def test_skew_join_splits_hot_keys_and_keeps_results(spark):
    spark.conf.set("procura.hot.rows", "40")
    try:
        big = spark.range(300).select(F.col("id").cast("string").alias("item_id"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"))
        small = spark.createDataFrame([(-1, "hot"), (3, "three"), (-1, "twice")], "k long, v string")
        hot = hot_keys(big, ["k"])
        assert [r.asDict() for r in hot.collect()] == [{"k": -1, "_salts": 5}]
        for how in ("inner", "left"):
            plain = sorted(map(tuple, big.join(small, "k", how).collect()), key=str)
            salted = sorted(map(tuple, skew_join(big, small, ["k"], ["item_id"], how, hot).collect()), key=str)
            assert plain == salted
        assert hot_keys(big.limit(10), ["k"]) is None
    finally:
        spark.conf.unset("procura.hot.rows")


def test_price_maths(spark):
    pk = lambda q, a, s, per=False: P.packages_needed(F.lit(q), F.lit(a).cast("int"), F.lit(s), F.lit(per))
    up = lambda p, s, per=False, imp=None: P.unit_price(F.lit(p), F.lit(s), F.lit(per), F.lit(imp))
    row = spark.range(1).select(
        pk(91, None, 30), pk(3, 30, 100), pk(9000, None, 300), pk(4, 120, 120, True),
        up(100, 3), up(141384, 24, True), up(100, 3, False, 1.5), P.total_cost(F.lit(D("10.01")), F.lit(3)),
        P.availability_label(F.lit("AVAILABLE"), F.lit(7)), P.availability_check(F.lit("PARTIAL"), F.lit(2), F.lit(3))["reason"],
    ).first()
    assert tuple(row) == (
        4, 1, 30, 4, D("33.3333"), D("141384.0000"), D("1.5000"), D("30.03"), "Disponible: 7 unidades",
        "Existencia insuficiente: 2 disponibles, se solicitan 3.",
    )
