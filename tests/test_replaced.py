"""Stored rows replaced in their buckets, first options of lines, and what the last entry of an offer carries."""

import datetime
from decimal import Decimal

from procura.operators import comparisons as CMP
from procura.plans import bridge
from procura.sources.store import TableStore

SCHEMA = "request_id string, item_id string, n int"
QUOTE = "request_id string, item_id string, generic_key string, quantity int, asked_size int, match_confidence double, selected_offer_id string"
OPTION = "generic_key string, quantity int, asked_size int, offer_id string, product_id string, supplier_id string, price decimal(14,2), availability string, discard_reason string"


def put(spark, store, rows, batch):
    new = spark.createDataFrame(rows, SCHEMA)
    merged = store.replaced("t", SCHEMA, new, ["request_id", "item_id"], "request_id")
    store.commit({}, batch, None, {"t": (merged, ["request_id"])})
    return merged


def held(store):
    return sorted(((r.request_id, r.item_id, r.n) for r in store.read("t", SCHEMA).collect()), key=repr)


def test_new_rows_take_the_place_of_old_ones_in_one_shuffle(spark, tmp_path):
    store = TableStore(spark, f"{tmp_path}/s")
    put(spark, store, [(f"r{i}", f"i{k}", 0) for i in range(40) for k in range(3)], "one")
    before = store.manifest("t")
    merged = put(spark, store, [("r1", "i1", 1), ("r2", "new", 1)], "two")
    expected = {(f"r{i}", f"i{k}"): 0 for i in range(40) for k in range(3)} | {("r1", "i1"): 1, ("r2", "new"): 1}
    assert held(store) == sorted((*k, n) for k, n in expected.items())
    after = store.manifest("t")
    assert 1 <= sum(before[k] != after[k] for k in before) <= 2
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    put(spark, store, [], "three")
    assert held(store) == sorted((*k, n) for k, n in expected.items())


def test_an_unknown_identity_replaces_nothing(spark, tmp_path):
    store = TableStore(spark, f"{tmp_path}/s")
    put(spark, store, [("r1", None, 0), (None, "i", 0)], "one")
    put(spark, store, [("r1", None, 1), ("r1", "i", 1)], "two")
    assert held(store) == sorted([("r1", None, 0), (None, "i", 0), ("r1", None, 1), ("r1", "i", 1)], key=repr)


def test_first_options_are_those_of_the_whole_comparison(spark, tmp_path):
    store = TableStore(spark, f"{tmp_path}/s")
    demands = [("a", 1, -1), ("b", 2, 10)]
    options = [(*d, f"o{(7 * i) % 10}", "p", "s", Decimal(i), "AVAILABLE", None) for d in demands for i in range(5 + d[1])]
    lines = [(f"r{i}", f"i{i}", *demands[i % 2], 1.0, f"o{i}") for i in range(6)]
    CMP.store_comparisons(store, spark.createDataFrame(lines, QUOTE), spark.createDataFrame(options, OPTION), "one")
    least = {}
    for r in CMP.stored_comparisons(store).collect():
        least[r.item_id] = min(least.get(r.item_id, ("~", False)), (r.offer_id, r.selected))
    first = CMP.stored_comparisons(store, first_only=True).collect()
    assert len(first) == 6 and {r.item_id: (r.offer_id, r.selected) for r in first} == least


def test_last_state_of_an_offer_names_its_file(spark, tmp_path):
    day = datetime.date
    rows = [
        (1, 1, 5, 2, 4.0, 40.0, "A", "F", day(1995, 1, 1)),
        (2, 1, 5, 2, 4.0, 80.0, "N", "F", day(1996, 1, 1)),
        (3, 3, 5, 2, 4.0, 60.0, "A", "O", day(1996, 1, 1)),
        (4, 1, 6, 10, 4.0, 60.0, "R", "O", None),
    ]
    spark.createDataFrame(
        rows,
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double,"
        " l_returnflag string, l_linestatus string, l_shipdate date",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {r.offer_id: (float(r.price), r.availability, r.stock_quantity, r.source_file_id) for r in bridge.offers(spark, str(tmp_path)).collect()}
    assert found == {"2|5|": (15.0, "AVAILABLE", 30, "2-1996"), "10|6|ENTRE 6 Y 12 MESES": (15.0, "OUT_OF_STOCK", 0, "10")}
