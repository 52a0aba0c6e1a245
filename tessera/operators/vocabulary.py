"""What a category scheme says to models and coders, categories that coders coin, and names of result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import labels
from tessera.runtime import bounded_broadcast


def guidance(scheme: DataFrame) -> DataFrame:
    """(dimension, list, key, explanation, described): active keys with their description, rejected ones with reason and replacement."""
    text = lambda c: labels.strip(F.coalesce(F.col(c), F.lit("")))
    reason, instead = text("reason"), F.concat(F.lit("stattdessen `"), text("move_to"), F.lit("` verwenden"))
    moved = F.when(text("move_to") == "", reason).when(reason == "", instead).otherwise(F.concat(reason, F.lit(" ("), instead, F.lit(")")))
    active = F.col("section") == "active"
    rows = scheme.filter(F.col("section").isin("active", "rejected") & (text("category_key") != ""))
    return rows.select(
        "dimension", F.when(active, "whitelist").otherwise("blacklist").alias("list"), text("category_key").alias("key"),
        F.when(active, text("description")).otherwise(moved).alias("explanation"), (~active | (text("description") != "")).alias("described"),
    )


def is_reserved(value: Column) -> Column:
    """The answer that is real but names no category; it is never taken for a new one."""
    return F.coalesce(labels.strip(value) == labels.SENTINEL, F.lit(False))


def new_categories(decisions: DataFrame, known: DataFrame) -> DataFrame:
    """(coder, id, dimension, is_new): whether a decision names a key that neither the scheme nor another coder has; ``known`` is (dimension, key)."""
    tokens = decisions.select("coder", "id", "dimension", F.explode_outer(labels.coder_set(F.col("value"))).alias("key"))
    held = bounded_broadcast(known.select("dimension", "key").distinct().withColumn("__known", F.lit(True)), 100_000)
    fresh = F.col("key").isNotNull() & F.col("__known").isNull() & ~is_reserved(F.col("key"))
    return tokens.join(held, ["dimension", "key"], "left").groupBy("coder", "id", "dimension").agg(F.max(fresh).alias("is_new"))


def sidecar_descriptions(rows: DataFrame, order: list[str]) -> DataFrame:
    """(dimension, key, description) over all coders' sidecars in order: the first description that is not blank, else an empty one."""
    text = lambda c: labels.strip(F.coalesce(F.col(c), F.lit("")))
    kept = rows.select(text("dimension").alias("dimension"), text("key").alias("key"), text("description").alias("description"), *order).filter("dimension <> '' and key <> ''")
    first = F.min_by("description", F.when(F.col("description") != "", F.struct(*order)))
    return kept.groupBy("dimension", "key").agg(F.coalesce(first, F.lit("")).alias("description"))


def with_coined(sidecar: DataFrame, decisions: DataFrame, known: DataFrame, coder: str) -> DataFrame:
    """The coder's sidecar with a row for each new key of the coder's decisions; keys that are in it already stay as they are."""
    tokens = decisions.filter(F.col("coder") == coder).select("dimension", F.explode(labels.coder_set(F.col("value"))).alias("key")).distinct()
    fresh = tokens.filter(~is_reserved(F.col("key"))).join(known, ["dimension", "key"], "left_anti").join(sidecar, ["dimension", "key"], "left_anti")
    return sidecar.unionByName(fresh.select("dimension", "key", F.lit("").alias("description"), F.lit(coder).alias("coder")))


def renamed(name: Column, ids: list[str]) -> Column:
    """The name with every known model id replaced by its family, longer ids first."""
    for model in sorted(ids, key=lambda m: (-len(m), m)):
        name = F.replace(name, F.lit(model), labels.model_family(F.lit(model)))
    return name


def rename_plan(names: DataFrame, models: DataFrame, most: int = 10_000) -> DataFrame:
    """(name, renamed, clash) of the files whose name holds a full model id: ``models`` says which there are.

    A target that is there already, or that two files would get, is a clash.
    """
    full = models.filter((labels.strip(F.col("model")) != "") & (F.col("model") != labels.model_family(F.col("model")))).select("model").distinct()
    ids = [r["model"] for r in full.limit(most + 1).collect()]
    if len(ids) > most:
        raise ValueError(f"more than {most} models")
    moves = names.select("name", renamed(F.col("name"), ids).alias("renamed")).filter("name <> renamed")
    twice = moves.groupBy("renamed").agg((F.count("*") > 1).alias("__twice"))
    there = names.select(F.col("name").alias("renamed"), F.lit(True).alias("__there")).distinct()
    return moves.join(twice, "renamed").join(there, "renamed", "left").select("name", "renamed", (F.col("__twice") | F.coalesce("__there", F.lit(False))).alias("clash"))
