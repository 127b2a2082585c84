"""Comparisons stored by batch."""

from decimal import Decimal

from procura.operators import comparisons as CMP
from procura.sources.store import TableStore

QUOTE = "request_id string, item_id string, generic_key string, quantity int, asked_size int, match_confidence double, selected_offer_id string"
OPTION = "generic_key string, quantity int, asked_size int, offer_id string, product_id string, supplier_id string, price decimal(14,2), availability string, discard_reason string"


def options(spark, price, *demands):
    rows = [(*d, f"o{i}", f"p{i}", f"s{i}", Decimal(price + i), "AVAILABLE", None) for d in demands for i in range(2)]
    return spark.createDataFrame(rows, OPTION)


def shown(store):
    return {(r.item_id, r.offer_id): (float(r.price), r.selected) for r in CMP.stored_comparisons(store).collect()}


def test_batches_replace_their_lines_only(spark, tmp_path):
    store = TableStore(spark, f"{tmp_path}/s")
    assert shown(store) == {}
    a, b = ("a", 1, -1), ("b", 2, 10)
    # r1 and r2 ask alike; one line is covered, one has no match
    first = [("r1", "i1", *a, 1.0, "o0"), ("r2", "i2", *a, 0.9, "o0"), ("r2", "i3", "a", 0, -1, 1.0, None), ("r3", "i4", None, None, -1, None, None)]
    CMP.store_comparisons(store, spark.createDataFrame(first, QUOTE), options(spark, 10, a, b), "one")
    assert shown(store) == {(i, o): (p, o == "o0") for i in ("i1", "i2") for o, p in (("o0", 10.0), ("o1", 11.0))}
    assert store.read("comparison_options", "x int").count() == 2  # nobody asked for b
    before = store.manifest("comparison_items")

    second = [("r2", "i2", *b, 0.9, "o1"), ("r2", "i3", *a, 1.0, None)]
    for _ in range(2):  # a batch counts once
        CMP.store_comparisons(store, spark.createDataFrame(second, QUOTE), options(spark, 20, a, b), "two")
    after = store.manifest("comparison_items")
    assert sum(before[k] != after[k] for k in before) == 1
    held = shown(store)
    assert held[("i1", "o0")] == (10.0, True)  # as it was when quoted
    assert held[("i2", "o1")] == (21.0, True) and held[("i2", "o0")] == (20.0, False) and held[("i3", "o0")] == (20.0, False)
    assert len(held) == 6

    empty = spark.createDataFrame([], QUOTE)
    CMP.store_comparisons(store, empty, options(spark, 30, a), "three")
    assert shown(store) == held
    third = [("r1", "i1", None, None, -1, 0.0, None)]
    CMP.store_comparisons(store, spark.createDataFrame(third, QUOTE), options(spark, 30, a), "four")
    CMP.compact_comparisons(store)
    assert shown(store) == {k: v for k, v in held.items() if k[0] != "i1"}
    assert {r.batch for r in store.read("comparison_options", "x int").select("batch").distinct().collect()} == {"two"}


def test_decisions_on_stored_lines(spark, tmp_path):
    store = TableStore(spark, f"{tmp_path}/s")
    a = ("a", 1, -1)
    lines = [(f"r{i}", f"i{i}", *a, 1.0, "o0") for i in range(5)]
    CMP.store_comparisons(store, spark.createDataFrame(lines, QUOTE), options(spark, 10, a), "one")
    log = [("r0", "i0", "choose", "o1"), ("r1", "i1", "exclude", None), ("r2", "i2", "none", None), ("r3", "i3", "choose", "o9"), ("r4", "i4", "sell", "o1"), ("r9", "i9", "none", None)]
    CMP.decide_stored(store, spark.createDataFrame(log, "request_id string, item_id string, action string, offer_id string"), "said")
    chosen = {i: {o for (j, o), (_, s) in shown(store).items() if j == i and s} for i in ("i0", "i1", "i3", "i4")}
    assert chosen == {"i0": {"o1"}, "i1": set(), "i3": {"o0"}, "i4": {"o0"}}
    assert {i for i, _ in shown(store)} == set(chosen)
