"""Predictions against a human reference: gate, dimensions, categories, comparison rows and the ranking of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import labels
from tessera.operators.decisions import DIMENSIONS, GATE
from tessera.runtime import bounded_broadcast

SINGLE = ("research_position",)
GATE_WEIGHT, PANEL, FLOOR, NARROW = 0.5, 3, 0.9, 0.02
MODELS = 10_000


def gate_pairs(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(model, id, human, answer): every reference paper for every model; answer is null without a readable prediction.

    Models are few: each paper carries the list of all of them, at most ``MODELS``.
    """
    models = predicted.select("model").distinct().limit(MODELS + 1).agg(F.array_sort(F.collect_set("model")).alias("models"))
    checked = F.when(F.size("models") > MODELS, F.raise_error(F.lit(f"more than {MODELS} models")).cast("array<string>")).otherwise(F.col("models"))
    answers = predicted.filter(F.col("dimension") == GATE).groupBy("model", "id").agg(F.max(labels.gate_value(F.col("value"))).alias("answer"))
    return gold.crossJoin(F.broadcast(models)).withColumn("model", F.explode(checked)).join(answers, ["model", "id"], "left").select("model", "id", F.col("gate").alias("human"), "answer")


def gate_scores(pairs: DataFrame) -> DataFrame:
    """(model, n, accuracy, f1_yes, f1_no, macro_f1) over the answered papers, 4 places."""
    seen = pairs.filter("answer is not null")
    counted = seen.groupBy("model").agg(
        F.count("*").alias("n"), F.count_if((F.col("human") == 1) & (F.col("answer") == 1)).alias("tp"), F.count_if((F.col("human") == 0) & (F.col("answer") == 1)).alias("fp"),
        F.count_if((F.col("human") == 1) & (F.col("answer") == 0)).alias("fn"), F.count_if((F.col("human") == 0) & (F.col("answer") == 0)).alias("tn"),
    )
    yes = labels.f1(F.col("tp"), F.col("fp"), F.col("fn"))
    no = labels.f1(F.col("tn"), F.col("fn"), F.col("fp"))
    return counted.select("model", "n", F.round(labels.ratio(F.col("tp") + F.col("tn"), F.col("n")), 4).alias("accuracy"), F.round(yes, 4).alias("f1_yes"), F.round(no, 4).alias("f1_no"), F.round((yes + no) / 2, 4).alias("macro_f1"))


def dimension_pairs(gold: DataFrame, human: DataFrame, predicted: DataFrame) -> DataFrame:
    """(model, id, dimension, human, answer) as label sets: answered papers the reference accepts and has coded."""
    accepted = gold.filter("gate = 1").select("id")
    coded = human.filter(F.col("dimension").isin(*DIMENSIONS)).select("id", "dimension", labels.bench_set(F.col("value")).alias("human")).filter(F.size("human") > 0).join(accepted, "id", "left_semi")
    answered = predicted.filter((F.col("dimension") == GATE) & labels.gate_value(F.col("value")).isNotNull()).select("model", "id").distinct()
    given = predicted.select("model", "id", "dimension", labels.bench_set(F.col("value")).alias("answer"))
    empty = F.array().cast("array<string>")
    return coded.join(answered, "id").join(given, ["model", "id", "dimension"], "left").withColumn("answer", F.coalesce("answer", empty)).select("model", "id", "dimension", "human", "answer")


def dimension_scores(pairs: DataFrame) -> DataFrame:
    """(model, dimension, n, score, jaccard): accuracy of single-valued dimensions, micro F1 of the others, 4 places."""
    hit = F.size(F.array_intersect("human", "answer"))
    either = F.size(F.array_union("human", "answer"))
    same = ((F.array_join("human", ";") == F.array_join("answer", ";")) & (F.size("human") > 0)).cast("double")
    sums = pairs.groupBy("model", "dimension").agg(
        F.count("*").alias("n"), F.sum(hit).alias("tp"), F.sum(F.size("answer") - hit).alias("fp"), F.sum(F.size("human") - hit).alias("fn"),
        F.avg(F.coalesce(F.try_divide(hit, either), F.lit(1.0))).alias("jaccard"), F.avg(same).alias("accuracy"),
    )
    score = F.when(F.col("dimension").isin(*SINGLE), F.col("accuracy")).otherwise(labels.f1(F.col("tp"), F.col("fp"), F.col("fn")))
    return sums.select("model", "dimension", "n", F.round(score, 4).alias("score"), F.round("jaccard", 4).alias("jaccard"))


def overall_scores(gate: DataFrame, dimensions: DataFrame, pairs: DataFrame) -> DataFrame:
    """(model, gate_score, typology, overall, n_scored, n_missing, coverage); without typology the gate stands alone."""
    typology = dimensions.groupBy("model").agg(F.avg("score").alias("typology"))
    reach = pairs.groupBy("model").agg(F.count_if(F.col("answer").isNotNull()).alias("n_scored"), F.count_if(F.col("answer").isNull()).alias("n_missing"))
    joined = reach.join(gate.select("model", F.col("macro_f1").alias("gate_score")), "model", "left").join(typology, "model", "left")
    overall = F.when(F.col("typology").isNull(), F.col("gate_score")).otherwise(GATE_WEIGHT * F.col("gate_score") + (1 - GATE_WEIGHT) * F.col("typology"))
    coverage = labels.ratio(F.col("n_scored"), F.col("n_scored") + F.col("n_missing"))
    return joined.select("model", "gate_score", F.round("typology", 4).alias("typology"), F.round(overall, 4).alias("overall"), "n_scored", "n_missing", F.round(coverage, 4).alias("coverage"))


def rank_models(overall: DataFrame, size: int = PANEL, floor: float = FLOOR) -> DataFrame:
    """(place, model, overall, margin, narrow): models above the coverage floor, best first, ties by name; the panel is the first ones."""
    eligible = overall.filter((F.col("coverage") >= floor) & F.col("overall").isNotNull())
    order = Window.orderBy(F.desc("overall"), "model")  # one row for each model
    ranked = eligible.select(F.row_number().over(order).alias("place"), "model", "overall", F.round(F.col("overall") - F.lead("overall").over(order), 4).alias("margin"))
    return ranked.withColumn("narrow", F.coalesce(F.col("margin") < NARROW, F.lit(False))).filter(F.col("place") <= size)


def panel_choice(overall: DataFrame, size: int = PANEL, floor: float = FLOOR, pin: str | None = None) -> DataFrame:
    """(place, model, overall, margin, reason): the panel; equal scores fall to the pinned model, then by name.

    ``reason`` is on every row: ``short of n`` where fewer models reach the floor, which with two models adds that both
    must agree; ``narrow`` where the last seat is less than two hundredths above the next model; else empty. Models are
    few, so one ordered window holds them all.
    """
    eligible = overall.filter((F.col("coverage") >= floor) & F.col("overall").isNotNull())
    pinned = (F.col("model") == pin).cast("int") if pin is not None else F.lit(0)
    order = Window.orderBy(F.desc(F.round("overall", 4)), F.desc("__pinned"), "model")
    ranked = eligible.withColumn("__pinned", pinned).select(F.row_number().over(order).alias("place"), "model", "overall", F.round(F.col("overall") - F.lead("overall").over(order), 4).alias("margin"))
    chosen = ranked.filter(F.col("place") <= size)
    whole = Window.partitionBy()
    seats, last = F.count("*").over(whole), F.max(F.when(F.col("place") == size, F.col("margin"))).over(whole)
    reason = F.when(seats == 2, f"short of {size}, both must agree").when(seats < size, f"short of {size}").when(last < NARROW, "narrow").otherwise("")
    return chosen.select("*", reason.alias("reason"))


def category_scores(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """(model, dimension, category, tp, fp, fn, precision, recall, f1, in_schema) of every category met."""
    human = pairs.select("model", "dimension", "id", F.explode("human").alias("category")).withColumn("h", F.lit(1))
    answer = pairs.select("model", "dimension", "id", F.explode("answer").alias("category")).withColumn("a", F.lit(1))
    both = human.join(answer, ["model", "dimension", "id", "category"], "full")
    sums = both.groupBy("model", "dimension", "category").agg(
        F.count_if(F.col("h").isNotNull() & F.col("a").isNotNull()).alias("tp"), F.count_if(F.col("h").isNull()).alias("fp"), F.count_if(F.col("a").isNull()).alias("fn"),
    )
    known = keys.select("dimension", F.col("category_key").alias("category"), F.lit(True).alias("in_schema")).distinct()
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.join(bounded_broadcast(known), ["dimension", "category"], "left").select(
        "model", "dimension", "category", "tp", "fp", "fn", F.round(labels.ratio(tp, tp + fp), 4).alias("precision"), F.round(labels.ratio(tp, tp + fn), 4).alias("recall"),
        F.round(labels.f1(tp, fp, fn), 4).alias("f1"), F.coalesce("in_schema", F.lit(False)).alias("in_schema"),
    )


def worst_categories(scores: DataFrame, n: int = 40) -> DataFrame:
    return scores.filter("in_schema").orderBy("f1", F.desc(F.col("tp") + F.col("fn")), "model", "dimension", "category").limit(n)


def comparison_rows(pairs: DataFrame) -> DataFrame:
    """(model, id, dimension, status, missed, extra, jaccard) of every scored cell."""
    same = F.size(F.array_except("human", "answer")) + F.size(F.array_except("answer", "human")) == 0
    status = F.when(same, "agree").when(F.size("answer") == 0, "no_answer").when(F.size(F.array_intersect("human", "answer")) > 0, "partial").otherwise("disagree")
    jaccard = F.size(F.array_intersect("human", "answer")) / F.size(F.array_union("human", "answer"))
    return pairs.select(
        "model", "id", "dimension", status.alias("status"), F.array_join(F.array_except("human", "answer"), ";").alias("missed"),
        F.array_join(F.array_except("answer", "human"), ";").alias("extra"), F.round(jaccard, 4).alias("jaccard"),
    )


def gate_categories(pairs: DataFrame) -> DataFrame:
    """(model, dimension, category, tp, fp, fn): the gate as two classes over the answered papers, for every model."""
    human, answer = F.col("human"), F.col("answer")
    classes = F.explode(F.array(F.struct(F.lit(1).alias("c"), F.lit("research_software").alias("category")), F.struct(F.lit(0).alias("c"), F.lit("not_research_software").alias("category"))))
    each = pairs.select("model", "human", "answer", classes.alias("k")).select("model", "human", "answer", "k.*")
    h, a = human == F.col("c"), answer == F.col("c")
    return each.groupBy("model", F.lit(GATE).alias("dimension"), "category").agg(F.count_if(h & a).alias("tp"), F.count_if(~h & a).alias("fp"), F.count_if(h & ~a).alias("fn"))


def whole_category_scores(categories: DataFrame, pairs: DataFrame) -> DataFrame:
    """``category_scores`` with the gate's classes and how often each side used a category: adds support_human and support_model."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    gate = gate_categories(pairs).select(
        "model", "dimension", "category", "tp", "fp", "fn", F.round(labels.ratio(tp, tp + fp), 4).alias("precision"), F.round(labels.ratio(tp, tp + fn), 4).alias("recall"),
        F.round(labels.f1(tp, fp, fn), 4).alias("f1"), F.lit(True).alias("in_schema"),
    )
    return categories.unionByName(gate).withColumn("support_human", tp + fn).withColumn("support_model", tp + fp)


def gate_comparison(pairs: DataFrame) -> DataFrame:
    """(model, id, dimension, status, missed, extra, jaccard) of the gate, one row for each model and reference paper."""
    status = F.when(F.col("answer").isNull(), "no_answer").when(F.col("human") == F.col("answer"), "agree").otherwise("disagree")
    empty = F.lit("")
    return pairs.select("model", "id", F.lit(GATE).alias("dimension"), status.alias("status"), empty.alias("missed"), empty.alias("extra"), F.lit(None).cast("double").alias("jaccard"))
