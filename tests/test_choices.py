"""Invalid later decisions, cells too large for their columns, repeated verdicts."""

from decimal import Decimal as D

from procura.operators import decisions, ingest
from procura.operators.pricing import DEMAND
from procura.sources import sheets


def test_a_later_invalid_choice_leaves_the_valid_one(spark):
    quote = "item_id string, generic_key string, quantity int, asked_size int, requested_quantity int, status string, selected_offer_id string, supplier_id string, supplier_name string, selected_product_id string, package_size int, presentation_unit string, packages int, package_price decimal(14,2), unit_price decimal(14,4), total_price decimal(24,2), savings decimal(24,2), reason string"
    rows = [(i, "g", 5, -1, 5, "SELECTED", "o1", "1", "A", "p1", 1, "u", 5, D(1), D(1), D(5), D(0), "r") for i in ("valid", "excluded", "unknown")]
    option = "generic_key string, quantity int, asked_size int, offer_id string, supplier_id string, supplier_name string, product_id string, presentation_quantity int, presentation_unit string, packages int, price decimal(14,2), unit_price decimal(14,4), total_cost decimal(24,2), availability string"
    options = [("g", 5, -1, o, s, s, "p", 1, "u", 5, D(n), D(n), D(5 * n), "AVAILABLE") for o, s, n in (("o1", "1", 1), ("o2", "2", 2))]
    log = [("valid", "choose", "o2", 1), ("valid", "choose", "gone", 2), ("excluded", "exclude", None, 1), ("excluded", "choose", None, 2), ("unknown", "choose", "gone", 1)]
    assert set(DEMAND) <= {"generic_key", "quantity", "asked_size"}
    out = decisions.apply_offer_decisions(
        spark.createDataFrame(rows, quote), spark.createDataFrame(log, "item_id string, action string, offer_id string, decided_at int"), spark.createDataFrame(options, option)
    )
    got = {r.item_id: (r.status, r.selected_offer_id, r.excluded) for r in out.collect()}
    assert got == {"valid": ("SELECTED", "o2", False), "excluded": ("EXCLUDED", None, True), "unknown": ("SELECTED", "o1", False)}


def test_numbers_too_large_are_told(spark):
    text = (
        "CODIGO,DESCRIPCION,LABORATORIO,PRECIO,EXISTENCIA,IVA\n"
        "T1,IBUPROFENO TAB 400MG X30,MK,100,99999999999,1\nT2,LORATADINA TAB 10MG X10,MK,100,5,99999999999999\nT3,ACETAMINOFEN TAB 500MG X100,MK,100,5,19\n"
    )
    files = spark.createDataFrame([("f", "1", "Uno", text)], "file_id string, supplier_id string, supplier_name string, value string")
    grid = sheets.csv_grid(files)
    mapped = ingest.map_rows(sheets.data_rows(grid, sheets.analyze_sheets(grid, files)))
    told = {r.supplier_product_code: (r.stock_quantity, [w for w in r.warnings if "grande" in w]) for r in mapped.collect()}
    assert told["T1"] == (None, ["Existencia demasiado grande; se omitió."]) and told["T3"] == (5, [])
    assert told["T2"] == (5, ["Impuesto demasiado grande; se omitió."])
