"""Buckets, appended tables and their commits."""

from procura.session import cut_lineage
from procura.sources.store import TableStore

ROWS = "key string, value int"


def test_a_load_rewrites_the_buckets_it_touches(spark, tmp_path):
    store = TableStore(spark, f"{tmp_path}/s")
    first = spark.createDataFrame([(f"k{i}", i) for i in range(300)], ROWS)
    assert store.read("t", ROWS).count() == 0 and store.manifest("t") == {}
    store.commit({}, merged={"t": (first, ["key"])})
    before = store.manifest("t")
    assert len(before) > 100 and store.read("t", ROWS).count() == 300
    new = spark.createDataFrame([("k7", 70), ("new", 1)], ROWS)
    touched = store.read_touched("t", ROWS, new, "key")
    assert 0 < touched.count() < 20 and "k7" in {r.key for r in touched.collect()}
    store.commit({}, "b", merged={"t": (touched.join(new, "key", "left_anti").unionByName(new), ["key"])})
    after = store.manifest("t")
    assert 1 <= sum(before.get(b) != after[b] for b in after) <= 2
    got = {r.key: r.value for r in store.read("t", ROWS).collect()}
    assert got == {**{f"k{i}": i for i in range(300)}, "k7": 70, "new": 1} and store.committed("b") and not store.committed("c")


def test_appended_tables_grow_and_are_compacted(spark, tmp_path):
    store = TableStore(spark, f"{tmp_path}/s")
    rows = lambda *xs: spark.createDataFrame([(str(x), x) for x in xs], ROWS)
    store.append({"a": rows(1, 2)})
    store.append({"a": rows(2)}, "x")
    assert sorted(r.value for r in store.read("a", ROWS).collect()) == [1, 2, 2] and len(store.manifest("a")[None]) == 2
    store.compact("a", ROWS)
    assert sorted(r.value for r in store.read("a", ROWS).collect()) == [1, 2, 2] and len(store.manifest("a")[None]) == 1
    store.append({"a": rows(5)})
    store.commit({"a": rows(9)})
    assert [r.value for r in store.read("a", ROWS).collect()] == [9]
    store.commit({}, "nothing", merged={"empty": (rows(1).limit(0), ["key"])})
    assert store.committed("nothing") and store.read("empty", ROWS).count() == 0


def test_cut_points_are_stored_by_column(spark):
    rows = spark.createDataFrame([(1, [("a", None)]), (2, None)], "id int, cells array<struct<s:string,n:double>>")
    cut = cut_lineage(rows.where("id > 0"))
    assert all(f.endswith(".parquet") for f in cut.inputFiles()) and cut.inputFiles()
    assert cut.schema == rows.schema and sorted(cut.collect()) == sorted(rows.collect())
