"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard levels. At each level every child draws
ln(u) / weight, u being a hash of the key and the child's name, and the largest draw wins;
a child's weight is the sum of the shards below it. A draw depends on its own child only,
so changing a weight moves keys only into or out of the subtrees whose weights changed.
Growth by one shard opens a region of its own: all other subtrees keep their weights, and
rows move only into the new shard. A shard added inside a rack moves rows only into that
rack's region and rack, where they are drawn among its shards.

Slots are gapless per shard without bringing a shard together: rows are dealt into ranges,
counted by range and shard, and numbered inside their range behind the rows of the ranges
before.

Defined cases: a null doc_id is the key of the empty text; null text has size 1 and a null
checksum; repeated rows share a shard and take a slot each; a tree without positive weights
is an error. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from procura.llm.common import written

SHARDS = 8
RACK = 2
REGION = 4

Tree = dict[str, dict[str, dict[int, float]]]


def regular_tree(shards: int) -> Tree:
    """Equal shards in racks of RACK and regions of REGION."""
    tree: Tree = {}
    for s in range(shards):
        region, rack = f"region{s // REGION}", f"rack{s // RACK}"
        tree.setdefault(region, {}).setdefault(rack, {})[s] = 1.0
    return tree


def with_new_region(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    return {**tree, f"region-of-{shard}": {f"rack-of-{shard}": {shard: weight}}}


def _weight(node) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else float(node)


def _draw(key: Column, name: str, weight: float) -> Column:
    digest = F.substring(F.md5(F.concat(key, F.lit(f"/{name}"))), 1, 13)
    u = (F.conv(digest, 16, 10).cast("double") + 0.5) / float(2**52)
    return F.ln(u) / F.lit(weight)


def descend(key: Column, tree: dict) -> Column:
    """The shard of a string key."""
    children = {str(name): (node, _weight(node)) for name, node in tree.items() if _weight(node) > 0}
    if not children:
        raise ValueError("a tree needs a shard of positive weight")
    if len(children) == 1:
        chosen = F.lit(next(iter(children)))
    else:
        draws = [F.struct(_draw(key, name, w).alias("draw"), F.lit(name).alias("name")) for name, (_, w) in children.items()]
        chosen = F.array_max(F.array(*draws))["name"]
    out = None
    for name, (node, _) in children.items():
        below = descend(key, node) if isinstance(node, dict) else F.lit(int(name))
        out = F.when(chosen == name, below) if out is None else out.when(chosen == name, below)
    return out


def shard(docs: DataFrame, tree: Tree | None = None, grown: Tree | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of `docs` (doc_id, text).

    Slots follow doc_id (nulls first), size and checksum.
    """
    tree = tree or regular_tree(SHARDS)
    grown = grown or with_new_region(tree, 1 + max(s for racks in tree.values() for r in racks.values() for s in r))
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    placed = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32("text").alias("text_crc32"),
            descend(key, tree).cast("int").alias("shard"),
            descend(key, grown).cast("int").alias("grown_shard"),
            F.monotonically_increasing_id().alias("row"),  # splits equal rows between ranges
        )
    )
    order = ["shard", "doc_id", "size", "text_crc32", "row"]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(placed.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()))
    counts = dealt.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("shard", "range").orderBy(*order[1:])
    return (
        dealt.withColumn("place", F.row_number().over(inside))
        .join(offsets, ["shard", "range"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("before") + F.col("place") - 1).cast("long").alias("slot"),
            "grown_shard",
        )
    )
