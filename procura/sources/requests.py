"""Customer request lists: sheets, pasted text and validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procura.functions.vocab import CLIENT_HEADERS, SECTORS
from procura.functions.text import trim_text
from procura.sources.sheets import cell_text

c = F.col
PACK_WORDS = (
    r"unid(?:ades)?|und?|u\.?|tubos?|frascos?|cajas?|ampollas?|viales?|sobres?|bl[ií]ster(?:es)?|"
    r"bolsas?|tabletas?|c[aá]psulas?"
)
LEADING = r"(?i)^(\d+)\s*x?\s+(.+)$"
TRAILING = rf"(?i)^(.+?)[\s.,:\-–(]+(\d+)\s*(?:{PACK_WORDS})?\)?\s*$"


def is_quantity(cell: Column) -> Column:
    number = cell["n"]
    whole = (number == F.floor(number)) & (number >= 0) & (number < 100000)
    return F.coalesce(F.when(number.isNotNull(), whole).otherwise(trim_text(cell["s"]).rlike(r"^\d+$")), F.lit(False))


def request_columns(grid: DataFrame, scan: int = 10, sample: int = 30) -> DataFrame:
    """Per file: header_row (null if none), product, quantity and client columns.

    Only a file's first `scan` + `sample` rows can count; they meet in one grouping by file,
    whose rows hold all that is needed to judge their columns.
    """
    row = F.struct("row_no", "cells")
    leading = grid.where(c("row_no") < scan + sample).groupBy("file_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    text_of = lambda x: trim_text(cell_text(x))
    filled = lambda r: F.size(F.filter(r["cells"], lambda x: x.isNotNull() & (text_of(x) != "")))
    has_qty = lambda r: F.exists(r["cells"], lambda x: x.isNotNull() & is_quantity(x))
    top = F.filter("rows", lambda r: r["row_no"] < scan)
    first_data = F.array_min(F.transform(F.filter("top", has_qty), lambda r: r["row_no"]))
    titles = F.filter("top", lambda r: (filled(r) >= 2) & (c("first_data").isNull() | (r["row_no"] < c("first_data"))))
    header = F.element_at(F.filter("rows", lambda r: r["row_no"] == c("header_row")), 1)["cells"]
    start = F.coalesce(c("header_row"), F.lit(-1))
    heads = (
        leading.withColumn("top", top)
        .where(F.size("top") > 0)
        .withColumn("first_data", first_data)
        .withColumn("header_row", F.array_max(F.transform(titles, lambda r: r["row_no"])))
        .withColumn("header", F.when(c("header_row").isNotNull(), header))
        .withColumn("rows", F.filter("rows", lambda r: (r["row_no"] > start) & (r["row_no"] <= start + sample)))
        .withColumn("n_rows", F.size("rows"))
    )
    # columns are judged within their file's row: no grouping beside the one above
    name = lambda i: F.lower(F.coalesce(text_of(F.get("header", i)), F.lit("")))
    named = lambda i: reduce(lambda a, b: a | b, (name(i).contains(word) for word in CLIENT_HEADERS))
    width = F.coalesce(F.array_max(F.transform("rows", lambda r: F.size(r["cells"]))), F.lit(0))
    numbers = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))
    cells = lambda i: F.filter(F.transform("rows", lambda r: F.get(r["cells"], i)), lambda x: x.isNotNull())
    columns = F.transform(numbers, lambda i: F.struct(i.alias("col"), named(i).alias("named"), cells(i).alias("cells")))
    texts = lambda x: F.filter(F.transform(x["cells"], text_of), lambda t: t.isNotNull())
    quantities = lambda x: F.size(F.filter(x["cells"], is_quantity)) / F.size(x["cells"])
    read = lambda x: F.struct(x["col"], x["named"], quantities(x).alias("qty_share"), texts(x).alias("texts"))
    stated = lambda x: F.filter(x["texts"], lambda t: t != "")
    with_stated = lambda x: F.struct(x["col"], x["named"], x["qty_share"], x["texts"], stated(x).alias("stated"))
    total = lambda x: F.when(F.size(x["texts"]) > 0, F.aggregate(x["texts"], F.lit(0).cast("long"), lambda n, t: n + F.length(t)))
    distinct = lambda x: F.size(F.array_distinct(F.transform(x["stated"], F.lower)))
    counted = lambda x: F.struct(
        x["col"], x["named"], x["qty_share"], total(x).alias("chars"), F.size(x["stated"]).alias("n_text"),
        F.try_divide(total(x), F.size(x["stated"])).alias("mean_chars"), distinct(x).alias("n_distinct"),
    )
    files = (
        heads.withColumn("columns", F.filter(columns, lambda x: F.size(x["cells"]) > 0))
        .withColumn("columns", F.transform("columns", read))
        .withColumn("columns", F.transform("columns", with_stated))
        .select("file_id", "header_row", "n_rows", F.transform("columns", counted).alias("columns"))
    )

    def best(columns: Column, *by) -> Column:
        """Number of the column with the largest values, of equal ones the first."""
        return -F.array_max(F.transform(columns, lambda x: F.struct(*[f(x).alias(f"by{i}") for i, f in enumerate(by)], (-x["col"]).alias("col"))))["col"]

    other = lambda name: F.filter("columns", lambda x: ~x["col"].eqNullSafe(c(name)))
    repeat = lambda x: 1 - F.try_divide(x["n_distinct"], x["n_text"])
    repeated = lambda x: (x["n_text"] >= 2) & (x["mean_chars"] <= 40) & (repeat(x) > 0.3)
    by_header = F.array_min(F.transform(F.filter("columns", lambda x: x["named"]), lambda x: x["col"]))
    by_repeat = best(F.filter("columns", repeated), repeat)
    return (
        files.withColumn("quantity_column", best(F.filter("columns", lambda x: x["qty_share"] > 0.5), lambda x: x["qty_share"]))
        .withColumn("columns", other("quantity_column"))
        .withColumn("product_column", best(c("columns"), lambda x: x["chars"] / c("n_rows")))
        .withColumn("columns", other("product_column"))
        .select(
            "file_id",
            "header_row",
            F.coalesce("product_column", F.lit(0)).alias("product_column"),
            "quantity_column",
            F.coalesce(by_header, by_repeat).alias("client_column"),
        )
    )


def request_lines(grid: DataFrame, columns: DataFrame, default_quantity: int = 1) -> DataFrame:
    """(file_id, row_no, text, quantity, client_name); rows without text are dropped.

    Use default_quantity 0 for warehouse lists, where nothing stated means no stock.
    """
    d = grid.join(columns, "file_id").where(c("row_no") > F.coalesce("header_row", F.lit(-1)))
    qty = F.get(c("cells"), c("quantity_column"))
    number = F.coalesce(qty["n"], F.trim(qty["s"]).try_cast("double"))
    rounded = F.floor(number + 0.5).try_cast("int")
    at_least = F.lit(default_quantity)
    client = F.nullif(trim_text(cell_text(F.get(c("cells"), c("client_column")))), F.lit(""))
    return d.select(
        "file_id",
        "row_no",
        F.coalesce(trim_text(cell_text(F.get(c("cells"), c("product_column")))), F.lit("")).alias("text"),
        F.greatest(at_least, F.coalesce(rounded, at_least)).alias("quantity"),
        client.alias("client_name"),
    ).where(c("text") != "")


def parse_pasted(lines: Column) -> Column:
    """Struct(text, quantity) of one trimmed line of a pasted list."""
    parts = F.filter(F.transform(F.split(lines, "\t"), trim_text), lambda p: p != "")
    number = F.get(F.filter(parts, lambda p: p.rlike(r"^\d+$")), F.lit(0))
    tab_text = F.array_join(F.filter(parts, lambda p: p != number), " ")
    by_tab = lines.contains("\t") & number.isNotNull() & (tab_text != "")
    leading, trailing = lines.rlike(LEADING), lines.rlike(TRAILING)
    text = (
        F.when(by_tab, tab_text)
        .when(leading, trim_text(F.regexp_extract(lines, LEADING, 2)))
        .when(trailing, trim_text(F.regexp_extract(lines, TRAILING, 1)))
        .otherwise(lines)
    )
    quantity = (
        F.when(by_tab, number)
        .when(leading, F.regexp_extract(lines, LEADING, 1))
        .when(trailing, F.regexp_extract(lines, TRAILING, 2))
        .otherwise(F.lit("1"))
    )
    return F.struct(text.alias("text"), quantity.try_cast("decimal(38,0)").alias("quantity"))


def pasted_lines(df: DataFrame, text_col: str) -> DataFrame:
    """Explode pasted lists into (.., line_no, text, quantity)."""
    lines = F.filter(F.transform(F.split(c(text_col), r"\r?\n"), trim_text), lambda x: x != "")
    keep = [x for x in df.columns if x != text_col]
    d = df.select(*keep, F.posexplode(lines).alias("line_no", "line"))
    return d.withColumn("p", parse_pasted(c("line"))).select(*keep, "line_no", "p.text", "p.quantity")


def validate_requests(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) request lines: text, positive quantity, customer, known sector."""
    reason = (
        F.when(F.coalesce(F.length("customer_name"), F.lit(0)) < 1, "customer")
        .when(F.coalesce(~c("sector").isin(*SECTORS), F.lit(True)), "sector")
        .when(F.coalesce(F.length("original_text"), F.lit(0)) < 1, "text")
        .when(F.coalesce(c("requested_quantity"), F.lit(0)) <= 0, "quantity")
    )
    judged = items.withColumn("rejected_for", reason)
    return judged.where(c("rejected_for").isNull()).drop("rejected_for"), judged.where(c("rejected_for").isNotNull())


def validate_whole_requests(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines of accepted requests, rejected requests): one bad line rejects all lines of its request.

    A rejected request has the reason of its first bad line (by line_no) and their number;
    lines without a request id count as one request. A client name of its own must not be empty.
    """
    accepted, wrong = validate_requests(items)
    if "client_name" in items.columns:
        nameless = F.coalesce(c("client_name") == "", F.lit(False))
        wrong = wrong.unionByName(accepted.where(nameless).withColumn("rejected_for", F.lit("client")))
        accepted = accepted.where(~nameless)
    rejected = wrong.groupBy("request_id").agg(
        F.min_by("rejected_for", F.struct("line_no", "rejected_for")).alias("rejected_for"), F.count(F.lit(1)).alias("bad_lines")
    )
    known = rejected.select(c("request_id").alias("_rejected"))
    return accepted.join(known, c("request_id").eqNullSafe(c("_rejected")), "left_anti"), rejected
