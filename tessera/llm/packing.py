"""Problem 7: fill containers of fixed capacity with documents, splitting only what exceeds a container.

Linear grouping: large lengths are sorted, cut into groups of equal cardinality and rounded up to their group's largest;
the cutting-stock problem of the few sizes is solved by column generation; actual documents take the slots of their
group by rank; small documents then go best-fit, in blocks of bounded size, into the room that is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tokens import VOCABULARY, token_count
from tessera.runtime import bounded_broadcast, cut, widen

CAPACITY = 2048
LARGE = 0.125
GROUPS = 32
BLOCK_ITEMS = 50_000
RANK_SLICE = 100_000


def pieces_of(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, part, parts, tokens): a document is one piece unless it exceeds the capacity. Without tokens there is no piece."""
    counted = widen(documents.select("doc_id", "text")).select("doc_id", token_count("text", vocabulary).alias("all"))
    parts = F.ceil(F.col("all") / capacity).cast("int")
    rows = counted.filter("all > 0").withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts"))))
    return rows.select("doc_id", "part", "parts", F.when(F.col("part") < F.col("parts"), capacity).otherwise(F.col("all") - (F.col("parts") - 1) * capacity).cast("int").alias("tokens"))


def group_sizes(lengths: np.ndarray, counts: np.ndarray, groups: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(cardinality of a group, rounded size of each group, items of each group); lengths in falling order."""
    total = int(counts.sum())
    each = -(-total // groups)
    ends = np.cumsum(counts)
    starts = np.arange(0, total, each)
    sizes = lengths[np.searchsorted(ends, starts, side="right")]
    return each, sizes, np.minimum(each, total - starts)


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Column generation for the cutting-stock problem of few sizes: (items of each size, containers), demand covered.

    After ``rounds`` columns the plan found so far is taken; it covers the demand, but may take more containers than the
    best one. ``fill_report`` sets the containers against the fewest there could be.
    """
    n = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.linalg.inv(basis)
    for _ in range(rounds):
        prices = inverse.sum(0)
        best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(1, capacity + 1):
            best[room] = best[room - 1]
            fits = np.flatnonzero(sizes <= room)
            if len(fits):
                gains = best[room - sizes[fits]] + prices[fits]
                top = int(gains.argmax())
                if gains[top] > best[room] + 1e-12:
                    best[room], choice[room] = gains[top], fits[top]
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(n), capacity
        while room > 0:
            if choice[room] < 0:
                room -= 1
                continue
            column[choice[room]] += 1
            room -= sizes[choice[room]]
        change, amount = inverse @ column, inverse @ demand
        usable = change > 1e-9
        if not usable.any():
            break
        leaving = np.flatnonzero(usable)[(amount[usable] / change[usable]).argmin()]
        basis[:, leaving] = column
        inverse = np.linalg.inv(basis)
    amount = np.maximum(np.floor(inverse @ demand + 1e-7), 0).astype(int)
    plan = [(basis[:, j].astype(int), int(amount[j])) for j in range(n) if amount[j] > 0]
    left = demand.astype(int) - sum((c * m for c, m in plan), np.zeros(n, dtype=int))
    left = np.maximum(left, 0)
    while left.any():  # what rounding down left over: first-fit by falling size, at most a container for each size
        column, room = np.zeros(n, dtype=int), capacity
        for k in np.argsort(-sizes, kind="stable"):
            take = min(int(left[k]), room // int(sizes[k]))
            column[k], room = take, room - take * int(sizes[k])
        times = max(1, int((left[column > 0] // column[column > 0]).min()))
        plan.append((column, times))
        left = left - column * times
    return plan


def slot_table(plan: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int]]:
    """(group, first slot, end slot, first container, slots of the group in each container)."""
    rows, container = [], 0
    filled: dict[int, int] = {}
    for column, times in plan:
        for group in np.flatnonzero(column):
            start = filled.get(int(group), 0)
            rows.append((int(group), start, start + int(column[group]) * times, container, int(column[group])))
            filled[int(group)] = start + int(column[group]) * times
        container += times
    return rows


def best_fit(capacity: int):
    """Best-fit by falling size of a block's small pieces into its containers' room; new containers where none fits."""

    def run(key: tuple, bins: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        block = int(key[0])
        by_room: list[list[str]] = [[] for _ in range(capacity + 1)]
        mask = 0
        for name, room in zip(bins["container"], bins["room"]):
            if room > 0:
                by_room[room].append(name)
                mask |= 1 << int(room)
        items = items.sort_values(["tokens", "doc_id", "part"], ascending=[False, True, True])
        placed, opened = [], 0
        for size in items["tokens"]:
            size = int(size)
            fitting = mask >> size
            if fitting:
                room = size + ((fitting & -fitting).bit_length() - 1)
                name = by_room[room].pop()
                if not by_room[room]:
                    mask &= ~(1 << room)
            else:
                name, room, opened = f"b{block}-{opened}", capacity, opened + 1
            placed.append(name)
            if room > size:
                by_room[room - size].append(name)
                mask |= 1 << (room - size)
        return items[["doc_id", "part", "parts", "tokens"]].assign(container=np.array(placed, dtype=object))

    return run


def pack(
    documents: DataFrame, capacity: int = CAPACITY, large: float = LARGE, groups: int = GROUPS, block_items: int = BLOCK_ITEMS, vocabulary: str = VOCABULARY, rank_slice: int = RANK_SLICE
) -> DataFrame:
    """(container, doc_id, part, parts, tokens) of every piece of every document that has tokens.

    Null and empty texts are in no container; repeated rows are pieces of their own; an empty table gives an empty
    result. Pieces of exactly the capacity have a container each.
    """
    spark = documents.sparkSession
    pieces = cut(pieces_of(documents, capacity, vocabulary))
    histogram = pieces.groupBy("tokens").count().collect()  # at most one row for each length up to the capacity
    big = sorted(((r["tokens"], r["count"]) for r in histogram if capacity * large < r["tokens"] < capacity), reverse=True)
    small = sum(r["count"] for r in histogram if r["tokens"] <= capacity * large)
    out = ["doc_id", "part", "parts", "tokens", "container"]
    full = pieces.filter(F.col("tokens") == capacity).withColumn("container", F.concat_ws("-", F.lit("f"), "doc_id", "part")).select(*out)
    placed, opened = None, 0
    if big:
        lengths, counts = np.array([t for t, _ in big]), np.array([c for _, c in big])
        each, sizes, demand = group_sizes(lengths, counts, min(groups, int(counts.sum())))
        merged, owner = np.unique(-sizes, return_inverse=True)
        needs = np.bincount(owner, weights=demand).astype(int)
        plan = configurations(-merged, needs, capacity)
        opened = sum(times for _, times in plan)
        slots = spark.createDataFrame(slot_table(plan), "size_no int, first long, last long, start long, in_each int")
        # groups that round up to the same size share its slots: a group's first slot follows those of the groups before
        before = [int(demand[:g][owner[:g] == owner[g]].sum()) for g in range(len(sizes))]
        group_rows = spark.createDataFrame([(g, int(owner[g]), before[g]) for g in range(len(sizes))], "group_no long, size_no int, before long")
        # a row for each length: the pieces of greater lengths, and the slices that keep a frequent length distributed
        longer = np.concatenate([[0], np.cumsum(counts)[:-1]])
        by_length = spark.createDataFrame([(int(t), int(b), int(c) // rank_slice + 1) for t, b, c in zip(lengths, longer, counts)], "tokens int, longer long, slices long")
        sliced = pieces.join(bounded_broadcast(by_length, capacity), "tokens").withColumn("slice", F.pmod(F.xxhash64("doc_id", "part"), "slices").cast("int"))
        earlier = Window.partitionBy("tokens").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sliced.groupBy("tokens", "slice").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
        within = Window.partitionBy("tokens", "slice").orderBy("doc_id", "part")
        ranked = sliced.withColumn("row", F.row_number().over(within) - 1).join(bounded_broadcast(offsets, 200_000), ["tokens", "slice"])
        ranked = ranked.withColumn("rank", F.col("row") + F.col("offset") + F.col("longer")).withColumn("group_no", F.expr(f"rank div {each}"))
        slotted = ranked.join(bounded_broadcast(group_rows), "group_no").withColumn("slot", F.col("rank") - F.col("group_no") * each + F.col("before"))
        slots = bounded_broadcast(slots)
        found = slotted.join(slots, (slotted.size_no == slots.size_no) & (slotted.slot >= slots["first"]) & (slotted.slot < slots["last"])).drop(slots.size_no)
        number = F.col("start") + F.expr("(slot - first) div in_each")
        placed = found.withColumn("container", F.concat(F.lit("g"), number)).select(*out)
    if not small:
        parts = [p for p in (full, placed) if p is not None]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    blocks = max(small, opened) // block_items + 1
    items = pieces.filter(F.col("tokens") <= capacity * large).withColumn("block", F.pmod(F.xxhash64("doc_id", "part"), blocks).cast("int"))
    if placed is None:
        bins = spark.createDataFrame([], "container string, room int, block int")
    else:
        placed = cut(placed)
        room = (F.lit(capacity) - F.sum("tokens")).cast("int")
        bins = placed.groupBy("container").agg(room.alias("room")).withColumn("block", F.pmod(F.xxhash64("container"), blocks).cast("int"))
    schema = "doc_id long, part int, parts int, tokens int, container string"
    filled = bins.groupBy("block").cogroup(items.groupBy("block")).applyInPandas(best_fit(capacity), schema)
    result = full.unionByName(filled)
    return result if placed is None else result.unionByName(placed)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, pieces, tokens, the share of capacity that is used, and the fewest containers there could be."""
    tokens = F.coalesce(F.sum("tokens"), F.lit(0))
    each = packed.groupBy("container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    return each.agg(
        F.count("*").alias("containers"), F.coalesce(F.sum("pieces"), F.lit(0)).alias("pieces"), tokens.alias("tokens"),
        F.try_divide(tokens, F.count("*") * capacity).alias("used_share"), F.ceil(tokens / capacity).alias("fewest"),
    )
