"""Stored price comparisons: what every quoted line was compared with.

Two tables of a `TableStore`. `comparison_items` holds one row per quoted line, in buckets of
its request: the demand it came to, how sure its match is, the chosen offer and the batch that
quoted it. `comparison_options` holds the options of each batch once per distinct demand, as
they were when it was quoted. A line's comparison is the join of both, so storing grows with
lines + demands x options instead of lines x options, and a batch rewrites only the buckets
its requests fall into.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procura import schema as S
from procura.operators.pricing import DEMAND
from procura.operators.skew import hot_keys, skew_join
from procura.session import cut_lineage
from procura.sources.store import TableStore

c = F.col
_ITEM = ["request_id", "item_id"]
_STATE = ["batch", *DEMAND, "match_confidence", "selected_offer_id"]


def _items(store: TableStore) -> DataFrame:
    return store.read("comparison_items", S.COMPARISON_ITEM)


def _options(store: TableStore) -> DataFrame:
    return store.read("comparison_options", S.COMPARISON_OPTION)


def _replace(store: TableStore, rows: DataFrame, batch: str, options: DataFrame | None = None) -> None:
    """Put `rows`, at most one a line, in place of what their lines held; lines are never removed, so no bucket empties."""
    merged = store.replaced("comparison_items", S.COMPARISON_ITEM, rows, _ITEM, "request_id")
    store.commit({}, batch, {"comparison_options": options} if options is not None else None, {"comparison_items": (merged, ["request_id"])})


def store_comparisons(store: TableStore, quotes: DataFrame, options: DataFrame, batch: str) -> None:
    """Replace the comparison of every line in `quotes`, leaving all other lines as stored.

    `quotes` has one row per line with its demand, match_confidence and selected_offer_id;
    `options` is the full comparison of the demands. A line that buys nothing or has no match
    loses its old options and gets none. A batch already stored is left alone.
    """
    if store.committed(batch):
        return
    bought = c("generic_key").isNotNull() & (c("quantity") > 0)
    state = {
        **{k: F.when(bought, c(k)) for k in DEMAND},
        "batch": F.when(bought, F.lit(batch)),
        "match_confidence": F.coalesce("match_confidence", F.lit(0.0)),
        "selected_offer_id": F.when(bought, c("selected_offer_id")),
    }
    rows = cut_lineage(quotes.select(*_ITEM, *[state[k].alias(k) for k in _STATE]))
    # of options whose demand nobody in the batch has, none is kept
    wanted = rows.where("batch is not null").select(*DEMAND).distinct()
    facts = options.join(wanted, DEMAND, "left_semi").select(
        F.lit(batch).alias("batch"), *DEMAND, "offer_id", "product_id", "supplier_id", "price", "availability", "discard_reason"
    )
    _replace(store, rows, batch, facts)


def stored_comparisons(store: TableStore, first_only: bool = False) -> DataFrame:
    """One row per line and option, with the line's confidence and the `selected` flag.

    With `first_only`, one row per line: the smallest offer_id it was compared with, without
    product, supplier, price and reasons. It is found once per demand, before lines join.
    """
    lines, options = _items(store).where("batch is not null"), _options(store)
    on = ["batch", *DEMAND]
    if first_only:
        options = options.groupBy(*on).agg(F.min("offer_id").alias("offer_id"))
    pairs = skew_join(lines, options, on, ["item_id"], "inner", hot_keys(lines.select(*on), on))
    selected = F.coalesce(c("offer_id") == c("selected_offer_id"), F.lit(False)).alias("selected")
    if first_only:
        return pairs.select(*_ITEM, "offer_id", "match_confidence", selected)
    return pairs.select(
        *_ITEM, "product_id", "supplier_id", "offer_id", "price", "availability", "match_confidence", selected, "discard_reason"
    )


def decide_stored(store: TableStore, decisions: DataFrame, batch: str) -> None:
    """Apply buyers' decisions (request_id, item_id, action, offer_id), one a line, to stored lines.

    `choose` selects one of the line's stored options, `exclude` takes the selection back,
    `none` drops the comparison. Unknown lines, other actions and offers that were not
    compared change nothing.
    """
    if store.committed(batch):
        return
    # read for its buckets and for its rows
    asked = cut_lineage(
        decisions.where(c("action").isin("choose", "exclude", "none")).select(*_ITEM, "action", c("offer_id").alias("wanted"))
    )
    held = store.read_touched("comparison_items", S.COMPARISON_ITEM, asked, "request_id")
    lines = cut_lineage(held.where("batch is not null").join(asked, _ITEM))
    offered = _options(store).select("batch", *DEMAND, c("offer_id").alias("wanted"))
    chosen = lines.where("action = 'choose'").join(offered, ["batch", *DEMAND, "wanted"], "left_semi")
    valid = chosen.unionByName(lines.where("action <> 'choose'").select(*chosen.columns))
    dropped = c("action") == "none"
    new = {k: F.when(~dropped, c(k)) for k in ("batch", *DEMAND)}
    new["match_confidence"] = c("match_confidence")
    new["selected_offer_id"] = F.when(c("action") == "choose", c("wanted"))
    _replace(store, cut_lineage(valid.select(*_ITEM, *[new[k].alias(k) for k in _STATE])), batch)


def compact_comparisons(store: TableStore) -> None:
    """Write anew the options that a line still points to, in one folder; older batches' others go."""
    on = ["batch", *DEMAND]
    used = _items(store).where("batch is not null").select(*on).distinct()
    store.commit({"comparison_options": _options(store).join(used, on, "left_semi")})
