"""Readers: corpus files by volume, checkpoints, coder files, logs, ragged caches and the category scheme."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.incremental import first_for_each_id, read_ragged
from tessera.sources import pdf


def corpus_files(spark: SparkSession, root: str, recursive: bool = False, content: bool = False) -> DataFrame:
    """(path, volume, id, length[, content]) of the PDF files: one folder level for each volume, or all levels."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf")
    found = reader.option("recursiveFileLookup", "true").load(root) if recursive else reader.load(f"{root}/*")
    relative = F.regexp_replace(F.col("path"), "^.*?" + root.removeprefix("file://").rstrip("/") + "/", "")
    named = found.withColumn("id", F.regexp_replace(relative, r"\.pdf$", "")).withColumn("volume", F.split(relative, "/")[0])
    return named.select("path", "volume", "id", "length", *(["content"] if content else []))


def checkpoints(spark: SparkSession, pattern: str) -> DataFrame:
    """Union of the CSV checkpoints of a glob, deduplicated by id in file order; the file's place is the order.

    Files may lack columns that others have, cells may hold line breaks and doubled quotes. Short rows have nulls at their
    end, and cells beyond the header's are dropped, but no row is.
    """
    folder = spark.read.format("binaryFile").load(pattern).select("path").orderBy("path").collect()
    parts = [_csv(spark, r["path"]) for r in folder]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return first_for_each_id(rows, ["__file", "__at"]).drop("__file", "__at")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    return rows.withColumn("__file", F.lit(path)).withColumn("__at", F.monotonically_increasing_id())


def coder_files(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of ``coding_<name>.csv`` with the coder's name; files with a dot in the name are backups and left out."""
    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(f"{folder}/coding_*.csv")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"coding_([^/]*)\.csv$", 1)
    return rows.withColumn("file_coder", name).filter(~F.col("file_coder").contains("."))


def log_lines(spark: SparkSession, path: str, separator: str = "\n", encoding: str = "UTF-8") -> DataFrame:
    """(value, at) of the lines of a log; progress bars separate theirs by carriage returns."""
    lines = spark.read.option("lineSep", separator).option("encoding", encoding).text(path)
    return lines.withColumn("at", F.monotonically_increasing_id())


def pdf_texts(spark: SparkSession, root: str, min_pages: int | None = None) -> DataFrame:
    """(id, volume, pages, text, warnings) of the PDF files below a folder."""
    files = corpus_files(spark, root, content=True)
    return pdf.extract(files, min_pages).join(files.select("id", "volume"), "id")


def score_cache(spark: SparkSession, path: str) -> DataFrame:
    return read_ragged(spark.read.text(path))


def newest(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, modified): the file of a glob that was written last."""
    files = spark.read.format("binaryFile").load(pattern).select("path", F.col("modificationTime").alias("modified"))
    return files.orderBy(F.desc("modified"), "path").limit(1)


def scheme(spark: SparkSession, path: str) -> DataFrame:
    """The category scheme of a YAML file as one row for each category (needs a YAML library on the driver)."""
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading a YAML scheme needs PyYAML") from missing
    with open(path, encoding="utf-8") as source:
        tree = yaml.safe_load(source)
    rows = [
        (dimension, bool(spec.get("multi")), section, entry.get("key"), entry.get("description"), entry.get("source"), bool(entry.get("deprecated")), entry.get("move_to"))
        for dimension, spec in tree["dimensions"].items() for section in ("active", "rejected", "candidates") for entry in spec.get(section) or []
    ]
    return spark.createDataFrame(rows, "dimension string, multi boolean, section string, category_key string, description string, source string, deprecated boolean, move_to string")
