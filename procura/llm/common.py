"""Reading tables, cutting lineage and connected components for the operators here."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procura.session import _ensure_checkpoint_dir


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the session's checkpoint folder, which all executors share.

    Cuts lineage like a checkpoint; later readers prune columns and filter row groups. Whole
    texts pass through here, so pages are packed with zstd, which took 0.7 times the room of
    snappy on documents. The tables go with the checkpoint folder of the application.
    """
    spark = df.sparkSession
    _ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> Iterator[None]:
    """Arrow batches of at most `rows` rows and about `size` bytes for the actions within; the session's are put back.

    A batch is held several times over, by its task and by its Python worker, so whole texts
    in batches of the usual size take most of an executor's memory outside the heap.
    """
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def free_name(name: str, columns: list[str]) -> str:
    """`name`, with underscores added until no column has it (Spark compares names without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def masked(docs: DataFrame, *used: str) -> DataFrame:
    """`docs` with every column but `used` under a plain number, so that no name clashes with one made on the way."""
    return docs.select(*(F.col(f"`{c}`").alias(c if c in used else f"_{i}") for i, c in enumerate(docs.columns)))


def unmasked(found: DataFrame, columns: list[str], *used: str) -> DataFrame:
    """The columns that `masked` renamed, under their names and in their order."""
    return found.select(*(F.col(c if c in used else f"_{i}").alias(c) for i, c in enumerate(columns)))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected links (a, b) as (node, root): root is the smallest node.

    Alternating large-star and small-star steps until every node has one link, to a node
    that has none. Every step is a grouped minimum and a join over the links, written to the
    checkpoint folder, so no component has to fit anywhere. Roots are not listed themselves.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    links = written(links.distinct())
    while not _all_stars(links):
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # no more rows than links; repeated ones go at the end of the small step
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        nearest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(nearest, "hi").select(F.explode(F.array("hi", "lo")).alias("hi"), F.col("m").alias("lo"))
        links = written(small.where("hi <> lo").distinct())
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def _all_stars(links: DataFrame) -> bool:
    """Whether each `hi` has one link only and is no other node's `lo`."""
    ends = links.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionAll(
        links.select(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root"))
    )
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return nodes.where("up + root > 1").isEmpty()
