"""Global orders and running values that stay distributed: ranks inside hash buckets plus the buckets' offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_key(seed: str | int, *parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def bucket_of(key: str) -> Column:
    """256 ranges of a hex key; their order is the keys' order."""
    return F.substring(key, 1, 2)


def running(df: DataFrame, order: str, ties: Sequence[str], values: dict[str, Column], keep: str = "sum", last: int = 0) -> DataFrame:
    """Adds running sums (or maxima) of ``values`` over the whole frame in the order of a hex key.

    ``last`` 0 includes the row, -1 ends before it (then the first row has 0 or, of maxima, null).

    Two steps instead of one window over everything: a window inside each of 256 key ranges, and the ranges' totals,
    of which there are at most 256, joined back as offsets.
    """
    bucketed = df.withColumn("__b", bucket_of(order))
    within = Window.partitionBy("__b").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, last)
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    fold = F.sum if keep == "sum" else F.max
    totals = bucketed.groupBy("__b").agg(*[fold(v).alias(f"__{n}") for n, v in values.items()])
    offsets = totals.select("__b", *[fold(f"__{n}").over(before).alias(f"__{n}") for n in values])
    inside = bucketed.withColumns({n: fold(v).over(within) for n, v in values.items()}).join(F.broadcast(offsets), "__b")
    if keep == "sum":
        whole = {n: F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"__{n}"), F.lit(0)) for n in values}
    else:
        whole = {n: F.greatest(F.col(n), F.col(f"__{n}")) for n in values}
    return inside.withColumns(whole).drop("__b", *[f"__{n}" for n in values])


def first_of_groups(df: DataFrame, group: str, order: Sequence[Column | str], quota: str, slices: int = 64) -> DataFrame:
    """The first rows of each group in an order, as many as the group's ``quota`` column says.

    Each of the group's slices keeps at most its quota before the group's rows meet, so a group that holds a third of
    all rows is not sorted in one task; what meets is at most the quota times the slices.
    """
    sliced = df.withColumn("__s", F.pmod(F.xxhash64(*order), slices))
    inner = Window.partitionBy(group, "__s").orderBy(*order)
    few = sliced.withColumn("__r", F.row_number().over(inner)).filter(F.col("__r") <= F.col(quota))
    whole = Window.partitionBy(group).orderBy(*order)
    return few.withColumn("__r", F.row_number().over(whole)).filter(F.col("__r") <= F.col(quota)).drop("__s", "__r")


def global_rank(df: DataFrame, order: str, ties: Sequence[str], name: str = "position") -> DataFrame:
    return running(df, order, ties, {name: F.lit(1)})
