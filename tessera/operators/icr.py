"""Agreement of two coders: raw, Krippendorff's alpha, Cohen's kappa, gate agreement and disagreements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import labels
from tessera.operators.decisions import DIMENSIONS


def of_pair(decisions: DataFrame, first: str, second: str) -> tuple[DataFrame, DataFrame]:
    named = lambda c: decisions.filter(F.col("coder") == c).drop("coder")
    return named(first), named(second)


def gate_status(gates: DataFrame, first: str, second: str) -> DataFrame:
    """(id, a, b, status): papers both decided; confirmed if both accept, vetoed if one rejects."""
    a = gates.filter(F.col("coder") == first).select("id", F.col("gate").alias("a"))
    b = gates.filter(F.col("coder") == second).select("id", F.col("gate").alias("b"))
    status = F.when((F.col("a") == 1) & (F.col("b") == 1), "confirmed").when(F.col("a") != F.col("b"), "vetoed").otherwise("rejected")
    return a.join(b, "id").select("id", "a", "b", status.alias("status"))


def agreement(decisions: DataFrame, gates: DataFrame, first: str, second: str) -> DataFrame:
    """(dimension, n_shared, raw_agreement, krippendorff_alpha, cohen_kappa) over confirmed papers, 3 places.

    A cell without a value is the label ``nan``. Alpha of a single value is 1 at full agreement. Kappa is null where
    chance agreement is full.
    """
    confirmed = gate_status(gates, first, second).filter("status = 'confirmed'").select("id")
    a, b = of_pair(decisions.filter(F.col("dimension").isin(*DIMENSIONS)), first, second)
    pairs = (
        a.select("id", "dimension", labels.icr_label(F.col("value")).alias("x")).join(b.select("id", "dimension", labels.icr_label(F.col("value")).alias("y")), ["id", "dimension"])
        .join(confirmed, "id", "left_semi")
    )
    sides = pairs.select("dimension", F.explode(F.array(F.struct(F.col("x").alias("label"), F.lit(1).alias("a"), F.lit(0).alias("b")), F.struct(F.col("y").alias("label"), F.lit(0).alias("a"), F.lit(1).alias("b")))).alias("s")).select("dimension", "s.*")
    counts = sides.groupBy("dimension", "label").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    spread = counts.groupBy("dimension").agg(F.sum((F.col("na") + F.col("nb")) * (F.col("na") + F.col("nb"))).alias("squares"), F.sum(F.col("na") * F.col("nb")).alias("products"))
    base = pairs.groupBy("dimension").agg(F.count("*").alias("n"), F.count_if(F.col("x") == F.col("y")).alias("same"))
    n, same = F.col("n").cast("double"), F.col("same").cast("double")
    expected = 4 * n * n - F.col("squares")
    alpha = F.when(expected == 0, 1.0).otherwise(1 - (2 * n - 1) * (2 * (n - same)) / expected)
    chance = F.col("products") / (n * n)
    kappa = F.try_divide(same / n - chance, 1 - chance)
    return base.join(spread, "dimension").select("dimension", F.col("n").alias("n_shared"), F.round(same / n, 3).alias("raw_agreement"), F.round(alpha, 3).alias("krippendorff_alpha"), F.round(kappa, 3).alias("cohen_kappa"))


def gate_agreement(gates: DataFrame, first: str, second: str) -> DataFrame:
    status = gate_status(gates, first, second)
    return status.agg(
        F.count("*").alias("both"), F.count_if(F.col("a") == F.col("b")).alias("same"), F.count_if(F.col("status") == "confirmed").alias("confirmed"),
        F.count_if(F.col("status") == "vetoed").alias("vetoed"), F.round(labels.ratio(F.count_if(F.col("a") == F.col("b")), F.count("*")), 3).alias("agreement"),
    )


def disagreements(decisions: DataFrame, gates: DataFrame, first: str, second: str, critical: int = 3) -> DataFrame:
    """(id, n_disagree, gate_differs, critical, dimensions): papers whose gate or shared dimensions differ."""
    status = gate_status(gates, first, second)
    a, b = of_pair(decisions.filter(F.col("dimension").isin(*DIMENSIONS)), first, second)
    cells = (
        a.select("id", "dimension", labels.coder_set(F.col("value")).alias("x")).join(b.select("id", "dimension", labels.coder_set(F.col("value")).alias("y")), ["id", "dimension"])
        .filter(F.array_join("x", ";") != F.array_join("y", ";"))
    )
    differing = cells.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("dimension")), ";").alias("dims"), F.count("*").alias("n"))
    judged = status.join(differing, "id", "left")
    gate = F.col("status") == "vetoed"
    counted = F.when(F.col("status") == "confirmed", F.coalesce("n", F.lit(0))).otherwise(0) + gate.cast("int")
    listed = F.when(F.col("status") == "confirmed", F.coalesce("dims", F.lit(""))).otherwise("")
    return judged.select("id", counted.alias("n_disagree"), gate.alias("gate_differs"), (gate | (counted >= critical)).alias("critical"), listed.alias("dimensions")).filter("n_disagree > 0")


def key_differences(decisions: DataFrame, first: str, second: str) -> DataFrame:
    """(dimension, key, only_first, only_second, both): how often each coder alone gave a key."""
    a, b = of_pair(decisions.filter(F.col("dimension").isin(*DIMENSIONS)), first, second)
    shared = a.select("id", "dimension").join(b.select("id", "dimension"), ["id", "dimension"])
    keys = lambda x, n: x.join(shared, ["id", "dimension"], "left_semi").select("id", "dimension", F.explode(labels.coder_set(F.col("value"))).alias("key")).withColumn(n, F.lit(1))
    both = keys(a, "x").join(keys(b, "y"), ["id", "dimension", "key"], "full")
    return both.groupBy("dimension", "key").agg(F.count_if(F.col("y").isNull()).alias("only_first"), F.count_if(F.col("x").isNull()).alias("only_second"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("both"))
