"""The overlay compares offers for the demands that somebody decides on."""

from pyspark.sql import functions as F

from procura.operators import pricing as P
from procura.plans import order_queries as Q
from procura.plans.pricing_queries import net_items

SF = "/root/testdata/sf0.001"


def test_overlay_compares_decided_demands_only(spark, monkeypatch):
    asked = []
    compare = P.compare_offers
    monkeypatch.setattr(P, "compare_offers", lambda demands, *a, **k: asked.append(demands) or compare(demands, *a, **k))
    rows = Q.manual_overlay(spark, SF)
    assert len(asked) == 1
    items = net_items(spark, SF).where("quantity > 0")
    decided = items.where(F.split("item_id", "-")[0].cast("long") % 10 < 2).select(*P.DEMAND).distinct()
    assert sorted(asked[0].collect()) == sorted(decided.collect())
    assert decided.count() < items.select(*P.DEMAND).distinct().count()
    assert {r.status for r in rows.select("status").distinct().collect()} >= {"SELECTED", "EXCLUDED"}
