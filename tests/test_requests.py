"""Columns of request lists against a plain reference on random sheets; whole requests; pages at any depth; replaced stock."""

import random
from fractions import Fraction

from pyspark.sql import functions as F

from procura.functions.vocab import CLIENT_HEADERS
from procura.operators.browse import offers_page, ranked_page, warehouse_list
from procura.operators import warehouse as WH
from procura.sources import requests as R
from procura.sources import sheets as S
from procura.sources.store import TableStore

WORDS = ["Cliente", "Producto", "", "  ", None, "12", "5", "ACETAMINOFEN 500", "ibuprofeno tab", "Norte", "Norte", "3.5", "x"]


def random_sheets(rng, files):
    rows = []
    for f in range(files):
        width, count, skipped = rng.randint(0, 5), rng.choice([0, 1, 2, 3, 12, 45]), rng.choice([0, 0, 3, 11])
        for r in range(count):
            words = WORDS if rng.random() < 0.6 else WORDS[7:]
            rows.append((f"f{f}", r + skipped, [rng.choice(words) for _ in range(rng.choice([width, width, max(0, width - 1)]))]))
    return rows


def expected(sheet):
    """(header_row, product, quantity, client) of one sheet's rows, or None."""
    top = [(n, cells) for n, cells in sheet if n < 10]
    if not top:
        return None
    filled = lambda cells: [x for x in cells if x is not None and x.strip()]
    quantity = lambda x: x is not None and x.strip().isdigit()
    data = min((n for n, cells in top if any(map(quantity, cells))), default=99)
    header = max((n for n, cells in top if len(filled(cells)) >= 2 and n < data), default=None)
    start = -1 if header is None else header
    rows = [cells for n, cells in sheet if start < n <= start + 30]
    title = next((cells for n, cells in sheet if n == header), [])
    columns = {}
    for col in range(max(map(len, rows), default=0)):
        values = [r[col] for r in rows if col < len(r) and r[col] is not None]
        if values:
            texts = [v.strip() for v in values if v.strip()]
            columns[col] = (Fraction(sum(map(quantity, values)), len(values)), Fraction(sum(map(len, texts)), len(rows)), texts)
    best = lambda scores: max(scores, key=lambda k: (scores[k], -k), default=None)
    number = best({k: v[0] for k, v in columns.items() if v[0] > Fraction(1, 2)})
    rest = {k: v for k, v in columns.items() if k != number}
    product = best({k: v[1] for k, v in rest.items()})
    rest.pop(product, None)
    named = [k for k in rest if k < len(title) and title[k] and any(w in title[k].strip().lower() for w in CLIENT_HEADERS)]
    repeats = {}
    for k, (_, _, texts) in rest.items():
        share = 1 - Fraction(len({t.lower() for t in texts}), len(texts)) if len(texts) >= 2 else 0
        if share > Fraction(3, 10) and sum(map(len, texts)) <= 40 * len(texts):
            repeats[k] = share
    return header, product or 0, number, min(named) if named else best(repeats)


def test_columns_of_random_sheets(spark):
    rows = random_sheets(random.Random(5), 400)
    grid = spark.createDataFrame(rows, "file_id string, row_no int, t array<string>")
    found = R.request_columns(grid.select("file_id", "row_no", F.transform("t", S.text_cell).alias("cells")))
    got = {r.file_id: (r.header_row, r.product_column, r.quantity_column, r.client_column) for r in found.collect()}
    sheets = {}
    for f, n, cells in rows:
        sheets.setdefault(f, []).append((n, cells))
    wanted = {f: expected(sheet) for f, sheet in sheets.items()}
    assert got == {f: w for f, w in wanted.items() if w is not None}
    assert {w is not None and w[3] is not None for w in wanted.values()} == {True, False}
    assert R.request_columns(grid.limit(0).select("file_id", "row_no", F.transform("t", S.text_cell).alias("cells"))).count() == 0


def test_one_shuffle_finds_the_columns(spark):
    grid = spark.createDataFrame([("f", 0, ["a"])], "file_id string, row_no int, t array<string>").repartition(3)
    found = R.request_columns(grid.select("file_id", "row_no", F.transform("t", S.text_cell).alias("cells")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_pages_at_any_depth(spark):
    rng = random.Random(2)
    names = ["Ácido", "acido", "Beta", "ñandú", "nandu", None, "Zinc", ""]
    rows = [(f"o{i:04}", rng.choice(names), rng.choice(names), float(rng.randint(1, 9)), rng.choice(["A", "B"])) for i in range(333)]
    offers = spark.createDataFrame(rows, "offer_id string, standard_name string, laboratory_name string, unit_price double, availability string")
    for sort, descending, page in (("laboratory", True, 1), ("product", False, 4), ("unitPrice", True, 7), ("availability", False, 2), ("none such", False, 99)):
        wanted = [r.offer_id for r in offers_page(offers, sort, descending, page, 50).collect()]
        found, total = ranked_page(offers, sort, descending, page, 50)
        got = sorted((r.position, r.offer_id) for r in found.collect())
        assert total == len(rows) and [o for _, o in got] == wanted
        assert [n for n, _ in got] == list(range(50 * (page - 1) + 1, 50 * (page - 1) + 1 + len(wanted)))
    found, total = ranked_page(offers.limit(0))
    assert total == 0 and found.count() == 0


def test_one_bad_line_rejects_the_request(spark):
    good = ("Hospital", "ASEO", "x", 2, None)
    rows = [("a", 1, *good), ("a", 2, *good), ("b", 1, *good), ("b", 3, "Hospital", "ASEO", "", 2, None), ("b", 2, "Hospital", "ASEO", "x", 0, None)]
    rows += [(None, 1, *good), (None, None, "", "ASEO", "x", 2, None), ("c", 1, "Hospital", "ASEO", "x", 2, ""), ("d", 1, None, None, None, None, None)]
    items = spark.createDataFrame(
        rows, "request_id string, line_no int, customer_name string, sector string, original_text string, requested_quantity int, client_name string"
    )
    accepted, rejected = R.validate_whole_requests(items)
    assert sorted((r.request_id, r.line_no) for r in accepted.collect()) == [("a", 1), ("a", 2)] and accepted.columns == items.columns
    got = {r.request_id: (r.rejected_for, r.bad_lines) for r in rejected.collect()}
    assert got == {"b": ("quantity", 2), None: ("customer", 1), "c": ("client", 1), "d": ("customer", 1)}
    plain, none = R.validate_whole_requests(items.drop("client_name").where("request_id in ('a', 'c')"))
    assert plain.count() == 3 and none.count() == 0


def test_a_snapshot_replaces_the_stored_stock(spark, tmp_path):
    store = TableStore(spark, f"{tmp_path}/s")
    assert warehouse_list(WH.stored_stock(store)).count() == 0
    lines = lambda *rows: spark.createDataFrame(rows, "text string, row_no long, quantity double")
    WH.store_snapshot(store, lines(("cosa rara", 1, 3.0), ("otra", 2, 0.0), (None, 3, 1.0)), F.lit("2024-01-01 00:00:00"))
    WH.store_snapshot(store, lines(("Guantes", 1, 2.4), ("guantes", 2, None), ("Gasas", 3, 5.0), ("  ", 4, 9.0)), F.lit("2024-02-01 00:00:00"))
    found = [(r.generic_key, r.quantity, r.product_name, str(r.updated_at)) for r in warehouse_list(WH.stored_stock(store)).collect()]
    assert found == [("gasas", 5, "Gasas", "2024-02-01 00:00:00"), ("guantes", 2, "guantes", "2024-02-01 00:00:00")]
    assert [r.generic_key for r in warehouse_list(WH.stored_stock(store), "GUA").collect()] == ["guantes"]


def test_request_columns_group_by_file_once(spark):
    grid = spark.createDataFrame([("a", 0, ["x", "1"])], "file_id string, row_no int, t array<string>")
    found = R.request_columns(grid.select("file_id", "row_no", F.transform("t", S.text_cell).alias("cells")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and "Generate" not in plan
