"""How the mapping of sheets runs: which sides are sent to all tasks, and whether its code is compiled."""

from procura import session
from procura.plans import ingest_queries as Q
from procura.sources import sheets

SF = "/root/testdata/sf0.001"
LIMIT = "spark.sql.codegen.hugeMethodLimit"


def test_file_rows_are_never_broadcast(spark, monkeypatch):
    cuts = []

    def seen(df):
        cuts.append(df._jdf.queryExecution().optimizedPlan().toString())
        return session.cut_lineage(df)

    grid = session.cut_lineage(Q.grid(spark, SF))
    monkeypatch.setattr(sheets, "cut_lineage", seen)
    analysis = sheets.analyze_sheets(grid, Q.list_files(spark, SF))
    # one row a file: samples with their file, and the three joins of what samples tell
    assert cuts[-1].count("strategy=shuffle_hash") == 1
    assert analysis._jdf.queryExecution().optimizedPlan().toString().count("strategy=shuffle_hash") == 4


def test_prices_are_sampled_below_a_late_header(spark):
    cell = lambda *xs: [(x, None) if x else None for x in xs]
    rows = [("f", i, cell("x", None, None)) for i in range(9)] + [("f", 9, cell("Producto", "Precio", "Laboratorio"))]
    rows += [("f", 10 + i, cell("P", "1.234,50" if i == 29 else "12", "L")) for i in range(30)]
    rows += [("f", 40, cell("P", "1,234.50", "L"))]
    grid = spark.createDataFrame(rows, f"file_id string, row_no int, cells array<{sheets.CELL}>")
    files = spark.createDataFrame([("f", "1", "Proveedor 1")], "file_id string, supplier_id string, supplier_name string")
    (got,) = sheets.analyze_sheets(grid, files).collect()
    assert (got.header_row, got.thousands, got.decimal) == (9, ".", ",")


def test_cut_points_run_compiled_methods(spark):
    # a session without limits of its own, as others bring it
    before = spark.conf.get(LIMIT)
    spark.conf.set(LIMIT, 65535)
    try:
        seen = []
        with session.compiled_methods(spark):
            seen.append(int(spark.conf.get(LIMIT)))
        assert session.cut_lineage(spark.range(3)).count() == 3
        assert seen == [session.COMPILED_BYTES] and spark.conf.get(LIMIT) == "65535"
        spark.conf.set(LIMIT, 100)
        with session.compiled_methods(spark):
            assert spark.conf.get(LIMIT) == "100"
    finally:
        spark.conf.set(LIMIT, before)


def test_parts_join_lists_once(spark):
    plan = Q._list_lines(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1
