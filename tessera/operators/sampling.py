"""Allocation to strata and reproducible draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordering import first_of_groups, global_rank, hash_key
from tessera.runtime import bounded_broadcast


def allocate(sizes: DataFrame, n: int, group: str = "volume", size: str = "size") -> DataFrame:
    """Adds ``alloc``: shares of ``n`` by largest remainder, in integers; ``n`` is at most the total.

    Left-over units go by remainder, then size, then name. The frame has one row for each stratum. Only strata that come
    first in one of 64 slices meet in one task: at most 64 times the left-over units, which are fewer than ``n``.
    """
    total = sizes.agg(F.coalesce(F.sum(size), F.lit(0)).alias("__total"))
    wanted = F.least(F.lit(n).cast("long"), F.col("__total"))
    shared = sizes.crossJoin(F.broadcast(total)).withColumn("__n", wanted).withColumn("__base", F.expr(f"if(__total = 0, 0L, (__n * {size}) div __total)"))
    rest = shared.withColumn("__rem", F.expr(f"if(__total = 0, 0L, (__n * {size}) % __total)"))
    left = rest.agg(F.coalesce(F.max("__n") - F.sum("__base"), F.lit(0)).alias("__left"))  # fewer than there are strata, and at most n
    placed = Window.partitionBy("__slice").orderBy(F.desc("__rem"), F.desc(size), group)
    few = rest.crossJoin(F.broadcast(left)).filter("__rem > 0").withColumn("__slice", F.pmod(F.xxhash64(group), 64)).withColumn("__at", F.row_number().over(placed)).filter("__at <= __left")
    extra = few.withColumn("__at", F.row_number().over(Window.orderBy(F.desc("__rem"), F.desc(size), group))).filter("__at <= __left").select(group, F.lit(1).alias("__extra"))
    return rest.join(extra, group, "left").withColumn("alloc", F.col("__base") + F.coalesce("__extra", F.lit(0))).drop("__total", "__n", "__base", "__rem", "__extra")


def stratified_sample(items: DataFrame, n: int, seed: int = 42, group: str = "volume", item: str = "id") -> DataFrame:
    """The first rows of each stratum in a seeded hash order, as many as are allocated to it."""
    sizes = items.groupBy(group).agg(F.count("*").alias("size"))
    keyed = items.withColumn("__k", hash_key(seed, group, item))
    quotas = bounded_broadcast(allocate(sizes, n, group).select(group, "alloc"), 100_000)
    return first_of_groups(keyed.join(quotas, group), group, ["__k", item], "alloc").drop("__k", "alloc")


def folder_weighted_order(items: DataFrame, seed: int = 42, item: str = "id") -> DataFrame:
    """Adds ``position``: a uniform random permutation, which is what drawing folders by remaining size amounts to."""
    return global_rank(items.withColumn("__k", hash_key(seed, item)), "__k", [item]).drop("__k")


def gate_limit(items: DataFrame, limit: int, seed: int = 20260805, gate: str = "gate", item: str = "id") -> DataFrame:
    """At most ``limit`` items, each class with its rounded share (half to even) but at least one; then the first by id."""
    sizes = items.groupBy(gate).agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size").alias("total"))  # one row
    shares = sizes.crossJoin(F.broadcast(total)).select(gate, F.greatest(F.lit(1), F.bround(F.lit(limit) * F.col("size") / F.col("total"))).cast("int").alias("quota"))
    keyed = items.withColumn("__k", hash_key(seed, item)).join(bounded_broadcast(shares), gate)
    return first_of_groups(keyed, gate, ["__k", item], "quota").drop("__k", "quota").orderBy(item).limit(limit)
