"""What must be there before a run, finding its inputs, and copying files into a working set."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def _listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths of a glob, on whatever file system it is."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in found or ())


def require(spark: SparkSession, **paths: str) -> None:
    """Fails at once with the names of all inputs that are missing."""
    missing = [f"{name} ({path})" for name, path in paths.items() if not _listed(spark, path)]
    if missing:
        raise FileNotFoundError("missing: " + ", ".join(missing))


def discover(spark: SparkSession, folders: Sequence[str], pattern: str) -> str:
    """The one file of a pattern in several folders; none or more than one is an error that names them."""
    found = [path for folder in folders for path in _listed(spark, f"{folder.rstrip('/')}/{pattern}")]
    if len(found) != 1:
        raise FileNotFoundError(f"no {pattern} in {', '.join(folders)}" if not found else f"several {pattern}: {', '.join(found)}")
    return found[0]


def prompt_sections(template: str) -> dict[str, str]:
    """A prompt template's text by its second-level headings; text before the first one is under the empty name."""
    parts = re.split(r"(?m)^##\s+(.+?)\s*$", template)
    return {"": parts[0].strip()} | {name: text.strip() for name, text in zip(parts[1::2], parts[2::2])}


def overlapping(source: str, target: str) -> bool:
    """Whether one root lies in the other, so that a copy would feed on itself."""
    a, b = (re.sub(r"^file:/+", "/", p).rstrip("/") + "/" for p in (source, target))
    return a.startswith(b) or b.startswith(a)


def stage_files(files: DataFrame, source: str, target: str) -> DataFrame:
    """(rel_path, copied) after copying files between two mounted roots; one of the same size is not copied again.

    ``files`` has rel_path. Copies run on the executors, under a temporary name until they are whole, so that a task
    that is run again does no harm. Run it once, by writing or collecting the result.
    """
    if overlapping(source, target):
        raise ValueError(f"{source} and {target} overlap")
    here, there = (re.sub(r"^file:/+", "/", p).rstrip("/") for p in (source, target))

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import shutil
        import uuid

        for batch in batches:
            done = []
            for name in batch["rel_path"]:
                a, b = f"{here}/{name}", f"{there}/{name}"
                if os.path.isfile(b) and os.path.isfile(a) and os.path.getsize(a) == os.path.getsize(b) or not os.path.isfile(a):
                    done.append(False)
                    continue
                os.makedirs(os.path.dirname(b), exist_ok=True)
                fresh = f"{b}.{uuid.uuid4().hex}.tmp"
                shutil.copy2(a, fresh)
                os.replace(fresh, b)
                done.append(True)
            yield pd.DataFrame({"rel_path": batch["rel_path"], "copied": pd.Series(done, dtype=bool)})

    return files.filter("rel_path is not null").select("rel_path").distinct().mapInPandas(copy, "rel_path string, copied boolean")
