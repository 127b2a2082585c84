"""Evaluate an expensive row expression exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add `value` as a column that later filters cannot copy below it.

    A filter on a computed column is otherwise pushed through the projection and the
    expression runs twice; a one-row generator stops that.
    """
    kept = [F.col(c) for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(value)).alias(name))


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Keep full parallelism for a CPU-heavy stage over few bytes; with a `key`, equal ones lie together.

    Adaptive execution merges partitions by size; parsing costs far more per byte than it
    assumes, so the number of tasks is fixed here.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *key)
