"""Coders' rows as current decisions, and views on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import labels

GATE = "label_research_software"
DIMENSIONS = ("research_position", "software_lifecycle", "software_type", "techstack", "evaluation")


def latest(codings: DataFrame) -> DataFrame:
    """(coder, id, dimension, value, is_new, model_category, model_certainty): the last row of each coder, id and dimension."""
    named = codings.withColumn("coder", labels.coder_name(F.col("coder"))).filter("coder is not null and id is not null and dimension is not null")
    content = F.struct(F.col("final_category").alias("value"), "is_new", "model_category", "model_certainty")
    last = named.groupBy("coder", "id", "dimension").agg(F.max_by(content, F.struct("coded_at", "coding_id")).alias("c"))
    return last.select("coder", "id", "dimension", "c.*")


def gates(decisions: DataFrame) -> DataFrame:
    """(coder, id, gate): the gate row's answer; papers with dimensions but no gate row count as accepted."""
    own = decisions.groupBy("coder", "id").agg(
        F.max(F.when(F.col("dimension") == GATE, labels.coded_gate(labels.clean_cell(F.col("value"))))).alias("gate"),
        F.max(F.when(F.col("dimension") == GATE, 1)).alias("has"),
    )
    return own.select("coder", "id", F.when(F.col("has") == 1, F.col("gate")).otherwise(1).alias("gate"))


def reference_coder(decisions: DataFrame) -> DataFrame:
    """One row: the coder with most decided papers, ties by name; backups with a dot in the name do not count."""
    counted = decisions.filter(~F.col("coder").contains(".")).groupBy("coder").agg(F.countDistinct("id").alias("decided"))
    return counted.orderBy(F.desc("decided"), "coder").limit(1)


def most_decided(decisions: DataFrame, n: int) -> DataFrame:
    """(coder, seat): the n coders with most decided papers, the first in seat 0."""
    counted = decisions.filter(~F.col("coder").contains(".")).groupBy("coder").agg(F.countDistinct("id").alias("decided"))
    best = counted.orderBy(F.desc("decided"), "coder").limit(n)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("decided")).alias("d"), "coder")))
    return best.agg(ranked.alias("r")).select(F.posexplode("r").alias("seat", "c")).select("seat", "c.coder")


def rejected_only(gate: DataFrame) -> DataFrame:
    """Papers some coder rejected and none accepted."""
    return gate.groupBy("id").agg(F.max("gate").alias("most")).filter("most = 0").select("id")


def tally(gate: DataFrame) -> DataFrame:
    return gate.groupBy("coder").agg(F.count_if(F.col("gate") == 1).alias("accepted"), F.count_if(F.col("gate") == 0).alias("rejected"), F.count("*").alias("decided"))


def saved(decisions: DataFrame) -> DataFrame:
    """The rows a save keeps: all of accepted papers, of rejected ones only the gate (the rest goes with the rejection)."""
    joined = decisions.join(gates(decisions), ["coder", "id"])
    return joined.filter((F.col("gate") == 1) | (F.col("dimension") == GATE)).drop("gate")


def missing_dimensions(decisions: DataFrame) -> DataFrame:
    """(coder, id, missing): dimensions an accepted paper still lacks, in order."""
    have = decisions.groupBy("coder", "id").agg(F.collect_set(F.when(~labels.is_blank(F.col("value")), F.col("dimension"))).alias("have"))
    wanted = F.array(*[F.lit(d) for d in DIMENSIONS])
    return have.join(gates(decisions).filter("gate = 1"), ["coder", "id"]).select("coder", "id", F.array_join(F.array_except(wanted, "have"), ";").alias("missing")).filter("missing <> ''")


def wide(decisions: DataFrame) -> DataFrame:
    """One row for each coder and accepted paper, a column for each dimension."""
    accepted = decisions.join(gates(decisions).filter("gate = 1").drop("gate"), ["coder", "id"])
    return accepted.groupBy("coder", "id").pivot("dimension", list(DIMENSIONS)).agg(F.first("value"))
