"""Writers: appended checkpoints, atomic rewrites with numbered backups, manifests, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def append_checkpoint(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Appends rows with the canonical columns in their order; missing ones are null."""
    present = set(rows.columns)
    rows.select(*[F.col(c) if c in present else F.lit(None).cast("string").alias(c) for c in columns]).write.mode("append").parquet(path)


def rewrite(rows: DataFrame, path: str, backup: bool = False) -> None:
    """Replaces a folder only after the new one is whole; the old one can stay as a numbered backup.

    The old folder is renamed, the new one takes its place, and only then the old one goes; a failure in between leaves
    both, the old one under its backup name or with the ending ``.old``.
    """
    spark = rows.sparkSession
    fresh = f"{path}.{uuid.uuid4().hex}.tmp"
    rows.write.parquet(fresh)
    target, fs = _fs(spark, path)
    source, _ = _fs(spark, fresh)
    kept = None
    if fs.exists(target):
        kept = _fs(spark, f"{path}.{uuid.uuid4().hex}.old")[0]
        if backup:
            number = 0
            while fs.exists(kept := _fs(spark, f"{path}.bak{number or ''}")[0]):
                number += 1
        if not fs.rename(target, kept):
            raise OSError(f"cannot set aside {path}")
    if not fs.rename(source, target):
        if kept is not None:
            fs.rename(kept, target)
        raise OSError(f"cannot put the new rows at {path}")
    if kept is not None and not backup:
        fs.delete(kept, True)


def write_manifests(staged: DataFrame, path: str) -> None:
    """One folder for each set; writing the same sets again gives the same files."""
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("set_name").parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A small report as one CSV file and, beside it, one JSON file."""
    single = rows.coalesce(1)
    single.write.mode("overwrite").option("header", "true").csv(f"{path}/csv")
    single.write.mode("overwrite").json(f"{path}/json")


def markdown(rows: DataFrame, most: int = 200) -> str:
    """A small report as a Markdown table; nulls show as ``-``."""
    cells = rows.limit(most).collect()
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join("-" if v is None else str(v) for v in row) + " |" for row in cells])
