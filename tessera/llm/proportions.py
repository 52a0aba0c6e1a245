"""Problem 1: draw from each working set a sample whose shares of every category match given target shares.

Papers are reduced to cell counts (one cell for each combination of categories in a set), which hold every category
moment of every tilt. Newton steps on the exponential-tilting dual of independent draws then find the cells' inclusion
probabilities, scaled so that they add up to the sample's size; the pivotal method draws with them in blocks of bounded
size, which keeps the size, and a last step for each set exchanges drawn papers for others, one for one, until floors
are met and no exchange brings the counts nearer to their targets. A report names the categories a set cannot fill.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import cut, salted_join, spread

BLOCK_ROWS = 20_000
#: Blocks of a set whose papers may be exchanged; of cells with at most RARE_ROWS papers those of every block may.
POOL_BLOCKS = 64
RARE_ROWS = 1_000
EXCHANGES = 500
RIDGE = 1e-3
STEPS = 60
#: Rows by which an expected count may miss its target.
TOLERANCE = 1e-4
UNKNOWN = "unknown"


def plain_key(value: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]", "")


def latest_papers(working_sets: DataFrame) -> DataFrame:
    """One row for each set and paper with the figures of its latest staging; equal times fall to the largest figures."""
    pages = F.when(F.col("pages") >= 1, F.col("pages").cast("double"))
    figures = F.struct("staged_at", plain_key(F.col("volume")).alias("volume"), pages.alias("pages"), F.col("score").alias("score"))
    return (
        working_sets.filter("set_name is not null and id is not null")
        .groupBy("set_name", "id").agg(F.max(figures).alias("f"))
        .select("set_name", "id", "f.volume", "f.pages", "f.score")
    )


def target_specs(targets: DataFrame) -> DataFrame:
    """One row for each set: its categories as an array of structs in a fixed order, and the sample size."""
    wanted = F.greatest(F.floor(F.col("target_share") * F.col("sample_size") + 0.5), F.col("min_rows").cast("long"))
    entry = F.struct(
        "facet", "category", plain_key(F.col("category")).alias("key"), "band_lo", "band_hi", F.col("target_share").alias("share"),
        F.coalesce("min_rows", F.lit(0)).alias("floor"), F.coalesce(wanted, F.lit(0)).alias("wanted"),
    )
    usable = targets.filter("set_name is not null and facet is not null and category is not null")
    return usable.groupBy("set_name").agg(F.array_sort(F.collect_set(entry)).alias("spec"), F.max("sample_size").alias("size"))


def with_categories(papers: DataFrame, specs: DataFrame) -> DataFrame:
    """Adds ``cats``, the positions in the set's spec of the categories a paper falls in."""
    joined = salted_join(papers, specs, ["set_name"], ["id"])
    paper = {"pages": F.col("pages"), "score": F.col("score")}

    def falls(s: Column) -> Column:
        by_volume = (s["facet"] == "volume") & (s["key"] == F.col("volume"))
        by_unknown = (s["facet"] == "pages") & (s["category"] == UNKNOWN) & F.col("pages").isNull()
        bands = by_volume | by_unknown
        for facet, value in paper.items():
            banded = s["band_lo"].isNotNull() | s["band_hi"].isNotNull()
            inside = (value >= F.coalesce(s["band_lo"], value)) & (s["band_hi"].isNull() | (value < s["band_hi"]))
            bands = bands | ((s["facet"] == facet) & banded & value.isNotNull() & inside)
        return F.coalesce(bands, F.lit(False))

    marked = F.transform("spec", lambda s, i: F.when(falls(s), i))
    return joined.select("set_name", "id", F.filter(marked, lambda i: i.isNotNull()).alias("cats"))


def reachable_targets(shares: np.ndarray, floors: np.ndarray, facets: list[str], available: np.ndarray, size: float) -> np.ndarray:
    """Targets between floor and what is available; what a facet's categories miss or need goes to or comes from its other ones."""
    target = np.zeros(len(shares))
    for facet in set(facets):
        own = np.array([f == facet for f in facets])
        share, most = shares[own], available[own].astype(float)
        least = np.minimum(floors[own], most)
        wish = max(min(share.sum() * size, most.sum()), least.sum())
        got = np.clip(share * size, least, most)
        for _ in range(50):
            missing = wish - got.sum()
            if abs(missing) < 1e-6:
                break
            room = most - got > 1e-9 if missing > 0 else got - least > 1e-9
            if not room.any():
                break
            pull = np.where(room, np.maximum(share, 1e-6), 0) if missing > 0 else np.where(room, got - least, 0)
            got = np.clip(got + missing * pull / pull.sum(), least, most)
        target[own] = got
    return target


def size_for_floors(size: int, floors: np.ndarray, facets: list[str], available: np.ndarray, total: int) -> int:
    """The sample size, or the least one at which the floors of every facet fit."""
    least = np.minimum(floors, available)
    needed = max((int(least[[f == facet for f in facets]].sum()) for facet in set(facets)), default=0)
    return min(max(size, needed), total)


def tilt(cells: np.ndarray, counts: np.ndarray, target: np.ndarray, size: float) -> np.ndarray:
    """Inclusion probability of each cell: Newton on the ridged dual  l't - sum n log(1 + exp(base + x l)) - r l'l / 2.

    The probabilities are shifted on the logit scale until they add up to the size.
    """
    total = counts.sum()
    if total <= size:
        return np.ones(len(counts))
    if size <= 0:
        return np.zeros(len(counts))
    share = min(max(size / total, 1e-9), 1 - 1e-9)
    base = np.log(share / (1 - share))

    def dual(multipliers: np.ndarray) -> float:
        return float(multipliers @ target - counts @ np.logaddexp(0, base + cells @ multipliers) - RIDGE / 2 * multipliers @ multipliers)

    multipliers = np.zeros(cells.shape[1])
    value = dual(multipliers)
    for _ in range(STEPS):
        chance = 1 / (1 + np.exp(-np.clip(base + cells @ multipliers, -40, 40)))
        gradient = target - cells.T @ (counts * chance) - RIDGE * multipliers
        if np.abs(gradient).max() < TOLERANCE:
            break
        hessian = (cells * (counts * chance * (1 - chance))[:, None]).T @ cells + RIDGE * np.eye(len(target))
        step, length = np.linalg.solve(hessian, gradient), 1.0
        while length > 1e-6 and dual(multipliers + length * step) < value - 1e-12:
            length /= 2
        multipliers = multipliers + length * step
        value = dual(multipliers)
    place = np.clip(base + cells @ multipliers, -40, 40)
    low, high = -80.0, 80.0
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if counts @ (1 / (1 + np.exp(-(place + middle)))) < size else (low, middle)
    return 1 / (1 + np.exp(-(place + high)))


PLAN = "set_name string, total long, size int, floors array<int>, targets array<double>, cells array<struct<cats: array<int>, cell: int, n: long, chance: double>>"


def _calibrate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for name, spec, size, cells in zip(batch["set_name"], batch["spec"], batch["size"], batch["cells"]):
            keys = sorted(tuple(c["cats"]) for c in cells)
            held = {tuple(c["cats"]): c["n"] for c in cells}
            counts = np.array([held[k] for k in keys], dtype=float)
            facets = [s["facet"] for s in spec]
            names = sorted(set(facets))
            shares, floors = np.array([s["share"] or 0.0 for s in spec]), np.array([s["floor"] for s in spec], dtype=float)
            design = np.zeros((len(keys), len(spec) + len(names)))
            for row, key in enumerate(keys):
                design[row, list(key)] = 1
                inside = {facets[k] for k in key}
                for j, facet in enumerate(names):  # a paper outside all bands of a facet counts against a target of none
                    design[row, len(spec) + j] = facet not in inside
            available, total = design.T @ counts, int(counts.sum())
            asked = 0 if size is None or np.isnan(size) else max(int(size), 0)
            wished = size_for_floors(asked, floors, facets, available[: len(spec)], total)
            target = reachable_targets(shares, floors, facets, available[: len(spec)], wished)
            outside = [max(0.0, wished - target[[f == facet for f in facets]].sum()) for facet in names]
            chance = np.clip(tilt(design, counts, np.concatenate([target, outside]), wished), 0, 1)
            made = [{"cats": list(k), "cell": i, "n": int(n), "chance": float(p)} for i, (k, n, p) in enumerate(zip(keys, counts, chance))]
            out.append((name, total, wished, np.minimum(floors, available[: len(spec)]).astype(int).tolist(), target.tolist(), made))
        if out:
            yield pd.DataFrame(out, columns=["set_name", "total", "size", "floors", "targets", "cells"])


def pivotal(chance: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, int]:
    """Sequential pivotal method. Probabilities become 0 or 1, but for at most one unit, whose index comes back (or -1)."""
    p = chance.astype(float).tolist()
    random = draw.random(len(p)).tolist()
    held = -1
    for unit, u in enumerate(random):
        b = p[unit]
        if b < 1e-9 or b > 1 - 1e-9:
            p[unit] = float(round(b))
            continue
        if held < 0:
            held = unit
            continue
        a = p[held]
        both = a + b
        if both < 1:
            if u < b / both:
                p[held], p[unit] = 0.0, both
                held = unit
            else:
                p[held], p[unit] = both, 0.0
        elif u < (1 - b) / (2 - both):
            p[held], p[unit] = 1.0, both - 1
            held = unit
        else:
            p[held], p[unit] = both - 1, 1.0
        if p[held] < 1e-9 or p[held] > 1 - 1e-9:
            p[held] = float(round(p[held]))
            held = -1
    return np.array(p), held


def _seed(*parts: object) -> np.random.Generator:
    import hashlib

    return np.random.default_rng(int.from_bytes(hashlib.md5("\x1f".join(map(str, parts)).encode()).digest()[:8], "big"))


def each_group(keys: Sequence[str], work: Callable[[tuple, pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Runs ``work`` on every group of partitions sorted by the keys; many small groups share one batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last: tuple | None = None
        for batch in batches:
            if not len(batch):
                continue
            columns = [batch[k].to_numpy() for k in keys]
            changed = np.zeros(len(batch) - 1, dtype=bool)
            for column in columns:
                changed |= column[1:] != column[:-1]
            starts = [0, *(np.flatnonzero(changed) + 1), len(batch)]
            out = []
            for a, b in zip(starts, starts[1:]):
                key = tuple(column[a] for column in columns)
                if last is not None and key != last:
                    out.append(work(last, held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)))
                    held = []
                held.append(batch.iloc[a:b])
                last = key
            if out:
                yield pd.concat(out, ignore_index=True)
        if held:
            yield work(last, held[0] if len(held) == 1 else pd.concat(held, ignore_index=True))

    return run


DRAWN = "set_name string, id string, cats array<int>, state string, chance double"


def draw_block(seed: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Draws in one block. States: in, swap (drawn, may be given back), open (undecided), spare (may be added).

    A cell passes on as many drawn and as many other papers as its largest floor asks for, and at least four of each.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        draw = _seed(seed, *key)
        cell, ids = rows["cell"].to_numpy(), rows["id"].to_numpy(dtype=object)
        by_id = np.argsort(ids, kind="stable")
        mixed = by_id[draw.permutation(len(rows))]
        order = mixed[np.argsort(cell[mixed], kind="stable")]
        cell, ids = cell[order], ids[order]
        cats = rows["cats"].to_numpy()[order]
        p, held = pivotal(rows["chance"].to_numpy()[order], draw)
        state = np.where(p == 1, "in", "out").astype(object)
        pool, limit = rows["pool"].to_numpy()[order], rows["limit"].to_numpy()[order]
        for drawn, name in ((1, "swap"), (0, "spare")):
            at = np.flatnonzero((p == drawn) & pool)
            if len(at):
                starts = np.flatnonzero(np.r_[True, cell[at][1:] != cell[at][:-1]])
                place = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
                state[at[place < limit[at]]] = name
        if held >= 0:
            state[held] = "open"
        keep = state != "out"
        return pd.DataFrame({"set_name": key[0], "id": ids[keep], "cats": pd.Series([list(c) for c in cats[keep]], dtype=object), "state": state[keep], "chance": p[keep]})

    return run


def exchange(counts: np.ndarray, floors: np.ndarray, targets: np.ndarray, drawn: dict[tuple, list], spare: dict[tuple, list]) -> list[tuple[object, object]]:
    """Best exchanges of a drawn unit for a spare one, until none brings counts nearer to floors first and targets second.

    ``drawn`` and ``spare`` hold the units of each cell and are changed, as are ``counts``. Pairs of (given back, added) come back.
    """

    def distance(c: np.ndarray) -> np.ndarray:
        return np.abs(c - targets).sum(-1) + 1000 * np.maximum(floors - c, 0).sum(-1)

    def held(cells: list[tuple]) -> np.ndarray:
        table = np.zeros((len(cells), len(counts)))
        for row, key in enumerate(cells):
            table[row, list(key)] = 1
        return table

    done = []
    for _ in range(EXCHANGES):
        outs, ins = [k for k, v in drawn.items() if v], [k for k, v in spare.items() if v]
        if not outs or not ins:
            break
        now, added, given = float(distance(counts)), held(ins), held(outs)
        best, pick = now - 1e-6, None
        step = max(1, 2_000_000 // max(1, len(ins) * len(counts)))
        for begin in range(0, len(outs), step):
            values = distance(counts + added[None] - given[begin : begin + step, None])
            at = np.unravel_index(values.argmin(), values.shape)
            if values[at] < best:
                best, pick = float(values[at]), (begin + int(at[0]), int(at[1]))
        if pick is None:
            break
        out, new = outs[pick[0]], ins[pick[1]]
        done.append((drawn[out].pop(), spare[new].pop()))
        counts += added[pick[1]] - given[pick[0]]
        drawn.setdefault(new, []).append(done[-1][1])
        spare.setdefault(out, []).append(done[-1][0])
    return done


def settle(seed: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Decides a set's open units and exchanges units; emits only the units of its rows that are drawn."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        plan = rows[rows["state"] == "plan"]
        empty = pd.DataFrame({"set_name": pd.Series([], dtype=object), "id": pd.Series([], dtype=object), "cats": pd.Series([], dtype=object)})
        if not len(plan):
            return empty
        floors, targets = np.array(plan["floors"].iloc[0], dtype=float), np.array(plan["targets"].iloc[0], dtype=float)
        counts = np.zeros(len(floors))
        for cats, n in zip(rows["cats"][rows["state"] == "count"], rows["chance"][rows["state"] == "count"]):
            counts[list(cats)] += n
        units = rows[rows["state"].isin(["swap", "spare", "open"])].sort_values("id")
        ids, state, cats = units["id"].to_numpy(dtype=object), units["state"].to_numpy(dtype=object), [tuple(map(int, c)) for c in units["cats"]]
        draw = _seed(seed, "settle", *key)
        still = np.flatnonzero(state == "open")
        p, held = pivotal(units["chance"].to_numpy()[still], draw)
        if held >= 0:  # the chances of a set add up to its size, so this one is 0 or 1 but for rounding
            p[held] = float(round(p[held]))
        state[still] = np.where(p == 1, "swap", "spare")
        drawn: dict[tuple, list] = {}
        spare: dict[tuple, list] = {}
        for i in draw.permutation(len(state)):
            (drawn if state[i] == "swap" else spare).setdefault(cats[i], []).append(i)
            if state[i] == "swap":
                counts[list(cats[i])] += 1
        exchange(counts, floors, targets, drawn, spare)
        for k in np.argsort(floors, kind="stable"):  # floors that no exchange can meet together make the sample larger
            for cell in list(spare):
                while k in cell and counts[k] < floors[k] and spare[cell]:
                    drawn.setdefault(cell, []).append(spare[cell].pop())
                    counts[list(cell)] += 1
        kept = sorted(i for own in drawn.values() for i in own)
        if not kept:
            return empty
        return pd.DataFrame({"set_name": key[0], "id": ids[kept], "cats": pd.Series([list(cats[i]) for i in kept], dtype=object)})

    return run


def draw_samples(working_sets: DataFrame, targets: DataFrame, seed: int = 7, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(sample, report). sample: set_name, id. report: set_name, facet, category, wanted, available, drawn, gap, short, sample_size, drawn_size, fit.

    Rows without set or id are ignored; sets without targets are not drawn from; a set with fewer papers than its sample
    size is taken whole; an empty table gives empty results. ``fit`` says that the floors of all facets were met within
    the sample size; where they were not, the sample is as much larger. ``gap`` is what a category has less than wanted, and
    ``short`` says that it has less because fewer papers than wanted are there.
    """
    specs = cut(target_specs(targets))
    papers = cut(with_categories(latest_papers(working_sets), specs))
    cells = papers.groupBy("set_name", "cats").agg(F.count("*").alias("n"))
    by_set = cells.groupBy("set_name").agg(F.collect_list(F.struct("cats", "n")).alias("cells")).join(specs, "set_name")
    plans = cut(spread(by_set.select("set_name", "spec", "size", "cells"), "set_name").mapInPandas(_calibrate, PLAN))
    floor = F.array_max(F.transform("c.cats", lambda k: F.get("floors", k)))
    chances = plans.select("set_name", "total", "floors", F.explode("cells").alias("c")).select(
        "set_name", "total", "c.cats", "c.cell", "c.chance", "c.n", F.greatest(F.lit(4), F.coalesce(floor, F.lit(0))).alias("limit")
    )
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("total") / block_rows)).cast("int")
    ready = salted_join(papers, chances, ["set_name", "cats"], ["id"], salts=4).withColumn("block", block)
    ready = ready.select("set_name", "block", "id", "cats", "cell", "chance", "limit", ((F.col("block") < POOL_BLOCKS) | (F.col("n") <= RARE_ROWS)).alias("pool"))
    drawn = cut(spread(ready, "set_name", "block").sortWithinPartitions("set_name", "block").mapInPandas(each_group(["set_name", "block"], draw_block(seed)), DRAWN))
    passed = drawn.filter("state = 'in'")
    none = [F.lit(None).cast("array<int>").alias("floors"), F.lit(None).cast("array<double>").alias("targets")]
    counted = passed.groupBy("set_name", "cats").agg(F.count("*").cast("double").alias("chance"))
    rest = (
        drawn.filter("state <> 'in'").select("set_name", "id", "cats", "state", "chance", *none)
        .unionByName(counted.select("set_name", F.lit("").alias("id"), "cats", F.lit("count").alias("state"), "chance", *none))
        .unionByName(plans.select("set_name", F.lit("").alias("id"), F.array().cast("array<int>").alias("cats"), F.lit("plan").alias("state"), F.lit(0.0).alias("chance"), "floors", "targets"))
    )
    settled = spread(rest, "set_name").sortWithinPartitions("set_name").mapInPandas(each_group(["set_name"], settle(seed)), "set_name string, id string, cats array<int>")
    sample = passed.select("set_name", "id", "cats").unionByName(settled)
    drawn_cells = cut(sample).groupBy("set_name", "cats").agg(F.count("*").alias("n"))

    def per_category(frame: DataFrame, name: str) -> DataFrame:
        return frame.select("set_name", F.explode("cats").alias("k"), "n").groupBy("set_name", "k").agg(F.sum("n").alias(name))

    sizes = drawn_cells.groupBy("set_name").agg(F.sum("n").alias("drawn_size"))
    have = plans.select("set_name", F.inline("cells")).select("set_name", "cats", "n")
    rows = specs.select("set_name", "size", F.posexplode("spec").alias("k", "s"))
    available, got = F.coalesce("available", F.lit(0)), F.coalesce("drawn", F.lit(0))
    report = (
        rows.join(per_category(have, "available"), ["set_name", "k"], "left").join(per_category(drawn_cells, "drawn"), ["set_name", "k"], "left")
        .join(sizes, "set_name", "left")
        .select(
            "set_name", "s.facet", "s.category", "s.wanted", available.alias("available"), got.alias("drawn"),
            F.greatest(F.col("s.wanted") - got, F.lit(0)).alias("gap"), ((got < F.col("s.wanted")) & (available < F.col("s.wanted"))).alias("short"),
            F.col("size").alias("sample_size"), F.coalesce("drawn_size", F.lit(0)).alias("drawn_size"), (F.coalesce("drawn_size", F.lit(0)) <= F.col("size")).alias("fit"),
        )
    )
    return sample.select("set_name", "id"), report
