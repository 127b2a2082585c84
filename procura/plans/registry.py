"""All registered queries and their SQL counterparts."""

from procura.plans import (
    arrival_queries,
    comparison_queries,
    family_queries,
    ingest_queries,
    match_queries,
    order_queries,
    pricing_queries,
    stock_queries,
    verdict_queries,
)

_GROUPS = (pricing_queries, match_queries, ingest_queries, order_queries, arrival_queries, family_queries, verdict_queries, stock_queries, comparison_queries)

QUERIES = {name: fn for group in _GROUPS for name, fn in group.QUERIES.items()}
ORACLES = {name: sql for group in _GROUPS for name, sql in group.ORACLES.items()}
