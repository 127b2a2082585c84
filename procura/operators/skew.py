"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_HOT_KEYS = 4096
HOT_ROWS = 2_000_000


def hot_keys(df: DataFrame, on: Sequence[str], least: int | None = None) -> DataFrame | None:
    """Keys with more than max(`least`, total / MAX_HOT_KEYS) rows, with their salt count.

    Fewer than MAX_HOT_KEYS keys can exceed that share whatever the input size, so the
    result may be collected and broadcast; the salts of all keys add up to less than
    twice that number. One narrow scan with map-side counts; call it on a stored table.
    None when no key is hot. `least` is HOT_ROWS or `procura.hot.rows` of the session
    unless given: below it a key's rows fit one task and salting only costs.
    """
    spark = df.sparkSession
    floor_rows = int(spark.conf.get("procura.hot.rows", str(HOT_ROWS))) if least is None else least
    total = df.count()
    if total <= floor_rows:
        return None
    limit = max(floor_rows, total // MAX_HOT_KEYS)
    counted = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    salted = counted.select(*on, F.ceil(F.col("_n") / limit).cast("int").alias("_salts"))
    rows = salted.collect()
    return spark.createDataFrame(rows, salted.schema) if rows else None


def skew_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    hot: DataFrame | None = None,
) -> DataFrame:
    """Equi-join `big` (left) with `small`, splitting only the hot keys of `big`.

    `hot` comes from `hot_keys`; a hot key's rows are spread over several salts by a hash
    of `spread` (a unique id, so that a retried task gives the same salt) and the matching
    rows of `small` are repeated once per salt. Without `hot` the join is left to adaptive
    execution, which splits oversized partitions. Keys must be non-null where they should
    match.
    """
    on = list(on)
    if hot is None:
        return big.join(small, on, how)
    marks = F.broadcast(hot)
    left = (
        big.join(marks, on, "left")
        .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_salts")).cast("int"), F.lit(0)))
        .drop("_salts")
    )
    right = (
        small.join(marks, on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_salts")
    )
    return left.join(right, on + ["_salt"], how).drop("_salt")
