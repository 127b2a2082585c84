"""Session defaults and the one place that decides where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: bytes of a method beyond which the JVM never compiles it
COMPILED_BYTES = 8000


def build_session(app: str = "procura", cores: str | int = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """Local session for tests and benches; a cluster passes its own session in."""
    parts = shuffle_partitions or (os.cpu_count() or 8 if cores == "*" else int(cores))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("PROCURA_DRIVER_MEMORY", "8g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        # larger generated methods are not JIT-compiled by the JVM
        .config("spark.sql.codegen.hugeMethodLimit", str(COMPILED_BYTES))
        .getOrCreate()
    )


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")
        shared = tempfile.mkdtemp(prefix="procura-checkpoint-")
    sc.setCheckpointDir(shared)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared checkpoint folder."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _with_conf(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def listed_in_few_tasks(spark: SparkSession) -> Iterator[None]:
    """Within, paths are listed by a few tasks a core, each many paths, instead of by a task a path."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    few = 4 * spark.sparkContext.defaultParallelism
    with _with_conf(spark, key, str(min(int(spark.conf.get(key)), few))):
        yield


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """Within, a stage whose generated method the JVM would only interpret runs by operators; the session's limit is put back.

    Typing the cells of a sheet is one method of 19 kB otherwise, which took more than twice as long.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    with _with_conf(spark, key, str(min(int(spark.conf.get(key)), COMPILED_BYTES))):
        yield


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` once as Parquet below the shared checkpoint folder and read it back.

    Used where several later branches start from one costly result: a lost executor
    then re-reads files instead of replaying the branches. Columns are compressed and
    later readers read only those they use, which a checkpoint of rows cannot do. Pages are
    packed with zstd, as ids and texts take most of them. The tables go with the checkpoint
    folder.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, "table")
    with compiled_methods(spark):
        df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)
