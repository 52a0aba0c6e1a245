"""Session helpers: the shared folder, lineage cuts, size-checked broadcasts and salted joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the context's, or in local mode a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if configured:
        if current.isEmpty():
            context.setCheckpointDir(configured)
        return configured
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = "file://" + tempfile.mkdtemp(prefix="tessera-")
    context.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise a frame in the shared folder, so that later steps neither recompute it nor depend on one executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_broadcast(df: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """The frame with a broadcast hint if it has at most ``max_rows`` rows, else the frame for a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def salted_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], spread: Sequence[str | Column], how: str = "inner", salts: int = 16
) -> DataFrame:
    """Join a large, possibly skewed ``left`` with a ``right`` that has few rows for each key.

    A key that holds a third of ``left`` goes to ``salts`` tasks instead of one: the left side gets a salt from
    ``spread``, the right side is repeated once for each salt. ``how`` is inner or left (also left_semi, left_anti).
    """
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    many = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("__salt", salt).join(many, [*on, "__salt"], how).drop("__salt")


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Repartition by keys (or evenly) into a fixed number of tasks, for small rows that cost much CPU each.

    The number is given, so adaptive execution doesn't merge the partitions by their size in bytes. Rows go by a hash of
    the keys rather than by the keys: an exchange by the same keys below would else be taken for this one and merged.
    """
    spark = df.sparkSession
    count = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(count, F.xxhash64(*keys)) if keys else df.repartition(count)


def widen(df: DataFrame) -> DataFrame:
    """Spread rows evenly where a scan has fewer partitions than there are cores; a large scan stays as it is, unshuffled.

    For steps that cost much CPU for each row: a few compressed row groups can hold hours of work.
    """
    wanted = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
