"""Problem 6: consensus labels, agreement and coder reliability by the triplet moment method.

Votes of an item lie in one row (at most one vote for each coder), so a task sums how often each pair of coders met and
agreed into one small table; no pair rows of single items leave it. Chance-corrected agreement of two coders is the
product of their skills; each triplet of a coder with two partners gives one estimate of its skill, their weighted median
is taken, over all triplets that the pairs close. Coders go to tasks in blocks, each with the pairs among its partners, so
no triplet leaves a task. Votes are combined with log-odds weights and the labels' shares as prior. Everything about
coders and labels is joined, nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.canonical import map_values, strip_white
from tessera.runtime import bounded_broadcast, cut, salted_join

GATE = "label_research_software"
POSITION = "research_position"
#: Spellings of the two gate answers.
YES = ("1", "1.0", "true", "yes", "ja")
NO = ("0", "0.0", "false", "no", "nein")
NULL_WORDS = ("", "nan", "none", "null")
MIN_SHARED = 3
PRIOR_SKILL = 0.5
PRIOR_WEIGHT = 4.0
PAIRS_HELD = 500_000
#: Pairs for which one more block of coders is made, beyond two for each core.
BLOCK_PAIRS = 500_000


def coder_key(name: Column) -> Column:
    """Trimmed, in lower case, blanks as underscores."""
    return F.regexp_replace(F.lower(strip_white(name)), r"(?U)\s", "_")


def latest_votes(codings: DataFrame, reference: DataFrame) -> DataFrame:
    """(dimension, id, coder, label, weight): each coder's latest non-blank value; label is null if it stands for nothing.

    A cell that names several labels is one vote, split evenly among them.
    """
    value = strip_white(F.col("final_category"))
    rows = codings.filter(F.col("dimension").isin(GATE, POSITION)).filter("id is not null and coder is not null")
    rows = rows.select("dimension", "id", coder_key(F.col("coder")).alias("coder"), value.alias("value"), "coded_at", "coding_id")
    rows = rows.filter(F.col("value").isNotNull() & ~F.lower("value").isin(*NULL_WORDS) & (F.col("coder") != ""))
    last = rows.groupBy("dimension", "id", "coder").agg(F.max(F.struct("coded_at", "coding_id", "value")).alias("last")).select("dimension", "id", "coder", "last.value")
    last = cut(last)
    keys = reference.filter(F.col("dimension") == POSITION).filter("section = 'active' and category_key is not null").select("dimension", "category_key").distinct()
    typed = last.filter(F.col("dimension") == POSITION).select("dimension", "id", "coder", F.explode(F.split("value", "[;,]")).alias("value")).withColumn("value", strip_white(F.col("value")))
    literal = keys.withColumn("value", F.col("category_key"))
    free = typed.select("dimension", "value").join(bounded_broadcast(literal), ["dimension", "value"], "left_anti")
    mapped = map_values(free, reference).select("dimension", "value", "category_key").filter("category_key is not null")
    whole = mapped.unionByName(literal.select("dimension", "value", "category_key"))
    positions = salted_join(typed, whole, ["dimension", "value"], ["id", "coder"], "left", salts=8)
    positions = positions.groupBy("dimension", "id", "coder").agg(F.array_sort(F.collect_set("category_key")).alias("labels"))
    positions = positions.select("dimension", "id", "coder", F.explode_outer("labels").alias("label"), (1.0 / F.greatest(F.size("labels"), F.lit(1))).alias("weight"))
    answer = F.lower("value")
    gates = last.filter(F.col("dimension") == GATE).select("dimension", "id", "coder", F.when(answer.isin(*YES), "1").when(answer.isin(*NO), "0").alias("label"), F.lit(1.0).alias("weight"))
    return gates.unionByName(positions)


def _pair_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    totals: dict[tuple[str, str, str], list[float]] = {}

    def table() -> pd.DataFrame:
        keys = list(totals)
        made = {"dimension": [k[0] for k in keys], "a": [k[1] for k in keys], "b": [k[2] for k in keys], "met": [totals[k][0] for k in keys], "agreed": [totals[k][1] for k in keys]}
        return pd.DataFrame(made).astype({"dimension": object, "a": object, "b": object, "met": "float64", "agreed": "float64"})

    for batch in batches:
        for dimension, votes in zip(batch["dimension"], batch["votes"]):
            cast: dict[str, dict[str, float]] = {}
            for v in votes:
                cast.setdefault(v["coder"], {})[v["label"]] = v["weight"]
            coders = sorted(cast)
            for i, a in enumerate(coders):
                mine = cast[a]
                for b in coders[i + 1 :]:
                    theirs = cast[b]
                    entry = totals.setdefault((dimension, a, b), [0.0, 0.0])
                    entry[0] += 1
                    entry[1] += sum(w * theirs.get(label, 0.0) for label, w in mine.items())
                if len(totals) > PAIRS_HELD:
                    yield table()
                    totals.clear()
    if totals:
        yield table()


def pair_rates(votes: DataFrame) -> DataFrame:
    """(dimension, a, b, met, kappa) in both directions of every pair of coders with ``MIN_SHARED`` items or more; a's and b's label shares give chance."""
    cast = votes.filter("label is not null")
    items = cast.groupBy("dimension", "id").agg(F.collect_list(F.struct("coder", "label", "weight")).alias("votes")).filter(F.size("votes") > 1)
    sums = items.select("dimension", "votes").mapInPandas(_pair_sums, "dimension string, a string, b string, met double, agreed double")
    pairs = sums.groupBy("dimension", "a", "b").agg(F.sum("met").alias("met"), F.sum("agreed").alias("agreed")).filter(F.col("met") >= MIN_SHARED)
    by_label = cast.groupBy("dimension", "coder", "label").agg(F.sum("weight").alias("n"))
    own = by_label.groupBy("dimension", "coder").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("n"), F.sum("n").alias("all"))
    own = own.select("dimension", "coder", F.transform_values("n", lambda _, n: n / F.col("all")).alias("share"))
    sided = pairs.join(own.select("dimension", F.col("coder").alias("a"), F.col("share").alias("sa")), ["dimension", "a"]).join(own.select("dimension", F.col("coder").alias("b"), F.col("share").alias("sb")), ["dimension", "b"])
    chance = F.aggregate(F.map_entries("sa"), F.lit(0.0), lambda total, e: total + e["value"] * F.coalesce(F.element_at("sb", e["key"]), F.lit(0.0)))
    kappa = F.greatest(F.lit(-0.999), F.least(F.lit(0.999), F.coalesce(F.try_divide(F.col("agreed") / F.col("met") - chance, 1 - chance), F.lit(0.0))))
    rates = sided.select("dimension", "a", "b", "met", kappa.alias("kappa"))
    return rates.unionByName(rates.select("dimension", F.col("b").alias("a"), F.col("a").alias("b"), "met", "kappa"))


def median_skill(own_j: np.ndarray, own_k: np.ndarray, other: np.ndarray, met_j: np.ndarray, met_k: np.ndarray, met: np.ndarray) -> float | None:
    """Skill without sign from a coder's triplets: the weighted median of squares, each own agreement times own over the partners'."""
    good = np.abs(other) > 0.05
    if not good.any():
        return None
    square = own_j[good] * own_k[good] / other[good]
    weight = 1 / (1 / met_j[good] + 1 / met_k[good] + 1 / met[good]) * other[good] ** 2
    order = np.argsort(square)
    below = np.cumsum(weight[order])
    place = np.searchsorted(below, below[-1] / 2)
    return float(np.sqrt(np.clip(square[order][min(place, len(order) - 1)], 0, 0.98)))


def _block_skills(rows: pd.DataFrame) -> pd.DataFrame:
    """(number, value): skills without sign of a block's coders.

    Rows are the coders' own pairs and, once for each pair, those among their partners.
    """
    own, among = rows[rows["own"]].sort_values("a"), rows[~rows["own"]].sort_values("a")
    nodes, coded = np.unique(np.concatenate([own["b"], among["a"], among["b"]]), return_inverse=True)
    partner, first, second = np.split(coded, [len(own), len(own) + len(among)])
    kappa, met, other, other_met = (part[name].to_numpy() for part in (own, among) for name in ("kappa", "met"))
    start = np.searchsorted(first, np.arange(len(nodes) + 1))
    coders, begin = np.unique(own["a"], return_index=True)
    place = np.full(len(nodes), -1)
    out = []
    for coder, lo, hi in zip(coders, begin, [*begin[1:], len(own)]):
        mine, k, m = partner[lo:hi], kappa[lo:hi], met[lo:hi]
        place[mine] = np.arange(hi - lo)
        counts = start[mine + 1] - start[mine]
        at = np.repeat(start[mine] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        right = place[second[at]]
        closed = right >= 0
        left, right, at = np.repeat(np.arange(hi - lo), counts)[closed], right[closed], at[closed]
        place[mine] = -1
        value = median_skill(k[left], k[right], other[at], m[left], m[right], other_met[at])
        if value is not None:
            out.append((coder, value))
    return pd.DataFrame(out, columns=["number", "value"]).astype({"number": "int64", "value": "float64"})


def triplet_skills(rates: DataFrame) -> DataFrame:
    """(dimension, coder, support, lean, value): met items, met-weighted agreement and the median over all triplets of a coder, null without any.

    A pair goes to the blocks that hold a partner of both its coders, and is kept at the coder with fewer partners, where
    at most the root of twice the number of pairs meet; a coder that met everybody is no hot key.
    """
    count = max(2 * rates.sparkSession.sparkContext.defaultParallelism, -(-rates.count() // BLOCK_PAIRS))
    block = lambda name: F.pmod(F.xxhash64("dimension", name), F.lit(count)).cast("int")
    coders = rates.groupBy("dimension", F.col("a").alias("coder")).agg(
        F.sum("met").alias("support"), F.sum(F.col("kappa") * F.col("met")).alias("lean"), F.count("*").alias("partners"), F.collect_set(block("b")).alias("blocks")
    )
    coders = cut(coders.withColumn("number", F.monotonically_increasing_id()))
    known = bounded_broadcast(coders.select("dimension", "coder", "number", "partners", "blocks"))
    side = lambda name: known.select("dimension", F.col("coder").alias(name), F.struct("partners", "number").alias(f"{name}_rank"), F.col("blocks").alias(f"{name}_blocks"))
    sided = rates.join(side("a"), ["dimension", "a"]).join(side("b"), ["dimension", "b"])
    own = F.array(F.struct(block("a").alias("block"), F.lit(True).alias("own")))
    among = F.transform(F.array_intersect("a_blocks", "b_blocks"), lambda x: F.struct(x.alias("block"), F.lit(False).alias("own")))
    sent = sided.select(F.explode(F.when(F.col("a_rank") < F.col("b_rank"), F.concat(own, among)).otherwise(own)).alias("to"), F.col("a_rank.number").alias("a"), F.col("b_rank.number").alias("b"), "kappa", "met")
    # The number is given, so that adaptive execution doesn't merge the blocks by their size in bytes.
    blocks = sent.select("to.block", "to.own", "a", "b", "kappa", "met").repartition(count, "block")
    values = blocks.groupBy("block").applyInPandas(_block_skills, "number long, value double")
    return coders.join(values, "number", "left").select("dimension", "coder", "support", "lean", "value")


def coder_reliability(votes: DataFrame) -> DataFrame:
    """(dimension, coder, accuracy, shared): estimated share of right votes, and votes shared with other coders.

    Skill is 1 for always right, 0 for chance, below 0 for worse; few shared items pull towards a prior. A skill is the
    part of votes that is knowledge; the rest hits the right label as often as chance does.
    """
    rates = cut(pair_rates(votes))
    everyone = votes.filter("label is not null").select("dimension", "coder").distinct()
    known = everyone.join(triplet_skills(rates), ["dimension", "coder"], "left").fillna(0.0, ["support", "lean"])
    sign = F.when(F.col("lean") < 0, -1.0).otherwise(1.0)
    skill = F.coalesce(sign * (F.col("value") * F.col("support") + PRIOR_SKILL * PRIOR_WEIGHT) / (F.col("support") + PRIOR_WEIGHT), F.lit(PRIOR_SKILL))
    skills = known.select("dimension", "coder", skill.alias("skill"), F.col("support").cast("long").alias("shared"))
    labels = votes.filter("label is not null").groupBy("dimension", "label").agg(F.sum("weight").alias("n"))
    luck = labels.groupBy("dimension").agg((F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), 2)).alias("luck"))
    accuracy = F.greatest(F.lit(0.02), F.least(F.lit(0.98), F.col("skill") + (1 - F.col("skill")) * F.col("luck")))
    return skills.join(bounded_broadcast(luck), "dimension").select("dimension", "coder", accuracy.alias("accuracy"), "shared")


def combined(votes: DataFrame, coders: DataFrame) -> DataFrame:
    """Labels of all items: log-odds of their votes, with the accuracy-weighted shares of labels as prior."""
    own = coders.select("dimension", "coder", "accuracy")
    known = bounded_broadcast(own, 100_000)
    if known is own:
        rated = salted_join(votes, own, ["dimension", "coder"], ["id"], "left")
    else:
        rated = votes.join(known, ["dimension", "coder"], "left")
    rated = rated.withColumn("p", F.coalesce("accuracy", F.lit(0.5)))
    shares = cut(rated.filter("label is not null").groupBy("dimension", "label").agg(F.sum(F.col("weight") * F.greatest(F.col("p"), F.lit(0.02))).alias("n")))
    whole = Window.partitionBy("dimension")
    prior = shares.withColumn("prior", F.greatest(F.col("n") / F.sum("n").over(whole), F.lit(1e-6)))
    ranked = F.array_sort(F.collect_list(F.struct((-F.log("prior")).alias("less"), "label")))
    labels = prior.groupBy("dimension").agg(ranked.alias("prior"), F.greatest(F.count("*"), F.lit(2)).alias("labels"))
    odds = F.log(F.col("p") * (F.col("labels") - 1) / (1 - F.col("p")))
    weighed = rated.join(bounded_broadcast(labels.select("dimension", "labels")), "dimension", "left")
    by_label = weighed.groupBy("dimension", "id", "label").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * odds).alias("s"), F.sum(F.col("weight") * F.col("weight")).alias("q"))
    held = F.filter(F.collect_list(F.struct("label", "w", "s", "q")), lambda v: v["label"].isNotNull())
    items = by_label.groupBy("dimension", "id").agg(F.round(F.sum("w")).cast("int").alias("votes"), held.alias("cast")).join(bounded_broadcast(labels.select("dimension", "prior")), "dimension", "left")
    score = F.transform("prior", lambda x: F.struct(
        (F.aggregate(F.filter("cast", lambda v: v["label"] == x["label"]), F.lit(0.0), lambda t, v: t + v["s"]) - x["less"]).alias("s"), x["label"].alias("label")
    ))
    top = F.reduce("scores", F.struct(F.lit(float("-inf")).alias("s"), F.lit(None).cast("string").alias("label")), lambda best, x: F.when((x["s"] > best["s"]) | ((x["s"] == best["s"]) & (x["label"] < best["label"])), x).otherwise(best))
    total = lambda name: F.aggregate("cast", F.lit(0.0), lambda t, v: t + v[name])
    squares = F.aggregate("cast", F.lit(0.0), lambda t, v: t + v["w"] * v["w"])
    n = F.round(total("w"))
    agreement = F.when(n > 1, (squares - total("q")) / (n * (n - 1)))
    decided = items.withColumn("scores", F.coalesce(score, F.array().cast("array<struct<s: double, label: string>>"))).withColumn("top", top)
    sure = 1 / F.aggregate("scores", F.lit(0.0), lambda t, x: t + F.exp(x["s"] - F.col("top.s")))
    voted = F.size("cast") > 0
    return decided.select("id", "dimension", F.when(voted, F.col("top.label")).alias("final_category"), "votes", F.when(voted, agreement).alias("agreement"), F.when(voted, sure).alias("confidence"))


def consensus(codings: DataFrame, reference: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, coders). labels: id, dimension, final_category, votes, agreement, confidence. coders: dimension, coder, accuracy, shared.

    Rows without id or coder and blank values are no votes. A value that stands for nothing counts among the votes but
    not for a label; an item with only such votes gets a null label. A cell with several labels is a vote split among
    them. Equal scores fall to the smaller label. An empty table gives empty results.
    """
    votes = cut(latest_votes(codings, reference))
    coders = cut(coder_reliability(votes))
    return combined(votes, coders), coders
