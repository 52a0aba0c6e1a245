"""Problem 5: how often every distinct term occurs and in how many records.

Radix spilling: occurrence records are written to the shared folder in partitions by the leading bits of the term's
hash; a partition with too many rows is read again and split by the next bits, and where the term's bits no longer split
it (one term holds most of it) by bits of the counted key, whose sets are disjoint, so that partial counts add up. Each
leaf is aggregated out of core by DuckDB in one task. A last grouped sum joins the parts of a term that was split.

DuckDB spills into the shared folder where executors see it as a directory. Where it is an object store it cannot; then
the size of the leaves bounds its memory, and only a leaf of one key repeated more often than a leaf may hold is larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import cut, remove_path, scratch_path

#: Words that stand for no value.
NULL_WORDS = ("", "nan", "none", "null")

#: Bits of a split of an oversized partition; the first split has as many as the number of rows asks for, up to FIRST_BITS.
RADIX_BITS = 4
FIRST_BITS = 12
LEAF_ROWS = 1_000_000
#: Bits of a term's hash that are used up before those of the counted key's, and all that are used.
TERM_BITS, KEY_BITS = 20, 32
SALTS = 8
DUCKDB_MEMORY = "400MB"


def term_key(value: Column) -> Column:
    """Lower case; runs of white space, hyphens and underscores become one underscore; outer ones go; null words are null."""
    text = F.lower(value)
    text = F.regexp_replace(text, r"(?U)[\s_-]+", "_")
    text = F.regexp_replace(text, r"^_+|_+$", "")
    return F.when(~text.isin(*NULL_WORDS), text)


def occurrence_records(suggestions: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row for each counted key of a term: kind ``o`` counts ``weight`` once per key, kind ``p`` counts papers."""
    first = suggestions.select(
        "dimension", term_key(F.col("new_suggestion")).alias("term"), F.concat(F.lit("s"), F.col("suggestion_id")).alias("row"),
        F.lit(1).cast("long").alias("weight"), F.col("id").alias("paper"),
    )
    second = candidates.select(
        "dimension", term_key(F.col("candidate_key")).alias("term"), F.concat(F.lit("c"), F.col("candidate_id")).alias("row"),
        F.greatest(F.coalesce(F.col("frequency"), F.lit(0)), F.lit(0)).cast("long").alias("weight"), F.lit(None).cast("string").alias("paper"),
    )
    both = first.unionByName(second).filter("term is not null and dimension is not null")
    kinds = F.array(
        F.struct(F.lit("o").alias("kind"), F.col("row").alias("key"), F.col("weight").alias("weight")),
        F.struct(F.lit("p").alias("kind"), F.col("paper").alias("key"), F.lit(1).cast("long").alias("weight")),
    )
    return both.select("dimension", "term", F.inline(F.filter(kinds, lambda k: k["key"].isNotNull())))


def _radix(term_bits: int, key_bits: int, bits: int) -> Column:
    """The next bits of the term's hash or, when those are used up, of the counted key's."""
    hashed, used = (F.xxhash64("dimension", "term"), term_bits) if term_bits < TERM_BITS else (F.xxhash64("kind", "key"), key_bits)
    return F.shiftrightunsigned(hashed, 64 - used - bits).bitwiseAND((1 << bits) - 1).cast("int")


def _leaf_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import os
    import tempfile

    import duckdb
    import pyarrow.dataset as ds
    from pyarrow.fs import FileSystem

    for batch in batches:
        for uri, spill in ((u, s) for uris, s in zip(batch["paths"], batch["spill"]) for u in uris):
            system, path = FileSystem.from_uri(uri)
            rows = ds.dataset(path, filesystem=system, format="parquet")
            base = spill.removeprefix("file://")
            folder = tempfile.mkdtemp(dir=base) if os.path.isdir(base) else ""
            with duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": folder, "preserve_insertion_order": False}) as db:
                db.register("records", rows)
                counted = db.sql(
                    """select dimension, term, kind, sum(weight)::bigint as n from
                       (select dimension, term, kind, key, max(weight) as weight from records group by all) group by all"""
                ).arrow()
                reader = counted if hasattr(counted, "read_next_batch") else counted.to_reader()
                for part in reader:
                    yield part.to_pandas()
            if folder:
                import shutil

                shutil.rmtree(folder, ignore_errors=True)


def first_bits(rows: int, leaf_rows: int, bits: int) -> int:
    """Bits of the first split: so many that leaves of evenly spread terms hold half of what they may."""
    return min(FIRST_BITS, max(bits, (2 * rows // leaf_rows).bit_length()))


def _tasks(leaves: list[tuple[str, int]], leaf_rows: int, least: int) -> list[list[str]]:
    """Leaves grouped into tasks: small ones share a task up to the rows of a leaf, but at least so many tasks are used."""
    room = min(leaf_rows, max(1, -(-sum(n for _, n in leaves) // least)))
    tasks: list[list[str]] = []
    held = 0
    for path, rows in sorted(leaves, key=lambda x: -x[1]):
        if not tasks or held + rows > room:
            tasks.append([])
            held = 0
        tasks[-1].append(path)
        held += rows
    return tasks


def radix_counts(records: DataFrame, rows: int, bits: int = RADIX_BITS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(dimension, term, kind, n) with n the summed weight over distinct keys, by recursive radix spilling.

    ``rows`` is about the number of records, from which the first split is chosen. An empty input gives an empty result.
    Repeated records count once; of differing weights for a key the largest holds. The spill is removed before the call
    returns.
    """
    spark = records.sparkSession
    root = scratch_path(spark, "radix")
    try:
        leaves: list[tuple[str, int]] = []
        pending: list[str] = []
        term_bits = key_bits = level = 0
        while not level or pending:
            if not level:
                source, parent, now = records, [], first_bits(rows, leaf_rows, bits)
            else:
                source, parent, now = spark.read.parquet(*pending).withColumn("parent", F.regexp_extract(F.input_file_name(), r"radix-[^?#]*/(l\d.*)/[^/]*$", 1)), ["parent"], bits
            out = f"{root}/l{level}"
            keyed = source.withColumn("leaf", F.concat_ws("-", *[F.translate(p, "/=", "__") for p in parent], _radix(term_bits, key_bits, now)))
            # a leaf is written by few tasks, a hot one by SALTS of them, so that files don't multiply with tasks and leaves
            gathered = keyed.drop(*parent).withColumn("salt", F.pmod(F.xxhash64("key"), SALTS))
            gathered.repartition("leaf", "salt").drop("salt").write.partitionBy("leaf").parquet(out)
            if term_bits < TERM_BITS:
                term_bits += now
            else:
                key_bits += now
            sizes = spark.read.parquet(out).groupBy("leaf").count().collect() if _any_leaf(spark, out) else []
            pending = []
            for row in sizes:
                path = f"{out}/leaf={row['leaf']}"
                if row["count"] > leaf_rows and key_bits + bits <= KEY_BITS:
                    pending.append(path)
                else:
                    leaves.append((path, row["count"]))
            level += 1
        if not leaves:
            return spark.createDataFrame([], "dimension string, term string, kind string, n long")
        tasks = _tasks(leaves, leaf_rows, 2 * spark.sparkContext.defaultParallelism)
        plan = spark.createDataFrame(spark.sparkContext.parallelize([(t, root) for t in tasks], len(tasks)), "paths array<string>, spill string")
        parts = plan.mapInPandas(_leaf_counts, "dimension string, term string, kind string, n long")
        return cut(parts.groupBy("dimension", "term", "kind").agg(F.sum("n").alias("n")))
    finally:
        remove_path(spark, root)


def _any_leaf(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return any(s.isDirectory() for s in target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target))


def count_terms(
    suggestions: DataFrame, candidates: DataFrame, rare_at_most: int = 2, common_papers: int = 5, common_share: float = 0.01,
    bits: int = RADIX_BITS, leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """(dimension, term, occurrences, papers, mark) of every term; ``mark`` is rare, common or null.

    Rows without dimension or term are not counted; a null id counts as no paper; other columns are ignored.
    """
    records = occurrence_records(suggestions, candidates)
    counts = radix_counts(records, 2 * suggestions.count() + candidates.count(), bits, leaf_rows)
    terms = counts.groupBy("dimension", "term").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "o", F.col("n"))), F.lit(0)).alias("occurrences"),
        F.coalesce(F.sum(F.when(F.col("kind") == "p", F.col("n"))), F.lit(0)).alias("papers"),
    )
    totals = (
        suggestions.filter(term_key(F.col("new_suggestion")).isNotNull() & F.col("id").isNotNull())
        .select("dimension", "id").distinct().groupBy("dimension").agg(F.count("*").alias("all_papers"))
    )
    mark = F.when(F.col("occurrences") <= rare_at_most, "rare").when(
        (F.col("papers") >= common_papers) & (F.col("papers") > common_share * F.coalesce(F.col("all_papers"), F.lit(0))), "common"
    )
    return terms.join(totals, "dimension", "left").select("dimension", "term", "occurrences", "papers", mark.alias("mark"))
