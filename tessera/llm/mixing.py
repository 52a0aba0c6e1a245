"""Problem 8: mix sources to target weights, with capped repetition.

Time-varying curriculum: each source has a weight schedule over training time whose integral is its target share. The
cumulative token demand of a source is inverted at each document's cumulative tokens, which gives the document's
position, and the mix is range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tokens import VOCABULARY, token_count
from tessera.runtime import bounded_broadcast, cut, widen

RAMP = 0.5
#: Texts of a source that one task orders.
SLICE_TEXTS = 100_000


def counted_documents(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, text_key, tokens); rows without source, text or tokens cannot be drawn and are left out."""
    rows = widen(documents.filter("source is not null and text is not null").select("doc_id", "source", "text")).select("doc_id", "source", F.md5("text").alias("text_key"), token_count("text", vocabulary).alias("tokens"))
    return rows.filter("tokens > 0")


def one_for_each_text(counted: DataFrame, uses: DataFrame) -> DataFrame:
    """(mix_id, text_key, doc_id, source, tokens): in each mix, the copy with the smallest id among the mix's own sources stands for all copies of a text.

    ``uses`` has (mix_id, source) of the sources that a mix draws from.
    """
    texts = counted.groupBy("text_key", "source").agg(F.min(F.struct("doc_id", "tokens")).alias("d"))
    own = texts.join(bounded_broadcast(uses, 100_000), "source")
    return own.groupBy("mix_id", "text_key").agg(F.min(F.struct("d.doc_id", "source", "d.tokens")).alias("d")).select("mix_id", "text_key", "d.*")


def with_start(texts: DataFrame, seed: int) -> DataFrame:
    """Adds ``start``, the tokens of the mix's source before the text in a random order; ``slices`` keep a large source distributed."""
    order = F.xxhash64("text_key", F.lit(seed))
    cut_up = texts.withColumn("order", order).withColumn("slice", F.pmod(F.shiftrightunsigned(order, 20), "slices").cast("int")).drop("slices")
    sums = cut_up.groupBy("mix_id", "source", "slice").agg(F.sum("tokens").alias("n"))
    earlier = Window.partitionBy("mix_id", "source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    before = Window.partitionBy("mix_id", "source", "slice").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = cut_up.withColumn("inside", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    return inside.join(bounded_broadcast(offsets, 200_000), ["mix_id", "source", "slice"]).withColumn("start", F.col("inside") + F.col("offset")).drop("inside", "offset", "order", "slice", "text_key")


def mix_sources(
    documents: DataFrame, targets: DataFrame, ramp: float = RAMP, seed: int = 11, vocabulary: str = VOCABULARY, slices: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(mix, report). mix: mix_id, position, doc_id, source, repeat, tokens, range-sorted. report: one row for each target.

    A source's schedule is share * (1 + r * (2 t - 1)) over time t in [0, 1]; r runs from ``-ramp`` for the source with
    the shortest texts of its mix to ``ramp`` for the longest, so short texts come earlier. A source that cannot fill its share is spread over the whole time. A text is used at most
    ``max_repeats`` times in a mix, its copies in the mix's sources included. ``short`` says that the source was drawn
    below its share and all its documents, repeated so often, have fewer tokens. What a short source misses goes to no
    other one, as each fills its share of the budget: ``fill`` is the part of its share that was drawn, ``mix_fill`` that
    of the budget, ``actual_share`` its part of what was drawn. Null or negative repeats and weights count as 0.
    """
    counted = cut(counted_documents(documents, vocabulary))
    all_tokens = counted.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.avg("tokens").alias("mean_tokens"))
    wish = targets.filter("mix_id is not null and source is not null").select(
        "mix_id", "source", F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0)).alias("target_weight"),
        F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"), F.coalesce("budget_tokens", F.lit(0)).alias("budget_tokens"),
    )
    uses = wish.filter("target_weight * budget_tokens > 0 and max_repeats > 0").select("mix_id", "source").distinct()
    texts = cut(one_for_each_text(counted, uses))
    distinct = texts.groupBy("mix_id", "source").agg(F.sum("tokens").alias("distinct_tokens"), F.count("*").alias("texts"))
    by_length = Window.partitionBy("mix_id").orderBy("mean_tokens", "source")
    place = F.when(F.col("sources") > 1, (F.col("at") - 1) / (F.col("sources") - 1) * 2 - 1).otherwise(F.lit(0.0))
    plan = (
        wish.join(all_tokens, "source", "left").join(distinct, ["mix_id", "source"], "left")
        .fillna(0, ["source_tokens", "distinct_tokens", "texts"]).fillna(0.0, ["mean_tokens"])
        .withColumn("at", F.row_number().over(by_length)).withColumn("sources", F.count("*").over(Window.partitionBy("mix_id")))
        .withColumn("ramp", place * ramp).withColumn("share_tokens", F.col("target_weight") * F.col("budget_tokens"))
        .withColumn("fill_tokens", F.least("share_tokens", F.col("distinct_tokens") * F.col("max_repeats")))
    )
    plan = cut(plan)
    rounds = F.least(F.col("max_repeats").cast("long"), F.ceil(F.try_divide(F.col("fill_tokens"), F.col("distinct_tokens"))))
    wanted = plan.withColumn("rounds", F.coalesce(rounds, F.lit(0))).filter("rounds > 0").select(
        "mix_id", "source", "ramp", "fill_tokens", "distinct_tokens", "rounds", (F.lit(slices) if slices else F.ceil(F.col("texts") / SLICE_TEXTS)).cast("long").alias("slices")
    )
    placed = with_start(texts.join(bounded_broadcast(wanted, 100_000), ["mix_id", "source"]), seed)
    drawn = placed.withColumn("repeat", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rounds") - 1)))
    drawn = drawn.withColumn("reached", F.col("start") + F.col("repeat") * F.col("distinct_tokens")).filter("reached < fill_tokens")
    # demand up to t is the tokens to fill * (t + r (t t - t)); solved for t at the tokens that come before the document
    part = F.col("reached") / F.col("fill_tokens")
    root = F.sqrt(F.pow(1 - F.col("ramp"), 2) + 4 * F.col("ramp") * part)
    position = F.when(F.abs("ramp") < 1e-9, part).otherwise((root - (1 - F.col("ramp"))) / (2 * F.col("ramp"))) + 0.0
    rows = drawn.select("mix_id", position.alias("position"), "doc_id", "source", F.col("repeat").cast("int").alias("repeat"), "tokens")
    got = rows.groupBy("mix_id", "source").agg(F.sum("tokens").alias("drawn_tokens"))
    whole = Window.partitionBy("mix_id")
    drawn_tokens = F.coalesce("drawn_tokens", F.lit(0))
    few = F.col("source_tokens") * F.col("max_repeats") < F.col("share_tokens")
    report = (
        plan.join(got, ["mix_id", "source"], "left").withColumn("drawn_tokens", drawn_tokens)
        .withColumn("actual_share", F.coalesce(F.try_divide(F.col("drawn_tokens"), F.sum("drawn_tokens").over(whole)), F.lit(0.0)))
        .select(
            "mix_id", "source", "target_weight", "max_repeats", "budget_tokens", "source_tokens", "distinct_tokens", "drawn_tokens", "actual_share",
            F.try_divide(F.col("drawn_tokens"), F.col("share_tokens")).alias("fill"), F.try_divide(F.sum("drawn_tokens").over(whole), F.col("budget_tokens")).alias("mix_fill"),
            (few & (F.col("drawn_tokens") < F.col("share_tokens"))).alias("short"),
        )
    )
    return rows.repartitionByRange("mix_id", "position").sortWithinPartitions("mix_id", "position", "doc_id"), report
