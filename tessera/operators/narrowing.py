"""Mining new categories and merging them into the category scheme."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import labels
from tessera.operators.decisions import DIMENSIONS, GATE
from tessera.runtime import bounded_broadcast

EXAMPLES = 5


def scheme_keys(scheme: DataFrame) -> DataFrame:
    """(dimension, key, section): everything a suggestion may already be: active, rejected, and keys that moved."""
    return scheme.filter("category_key is not null").select("dimension", F.col("category_key").alias("key"), "section").distinct()


def selectable(scheme: DataFrame) -> DataFrame:
    """Active described categories that are not deprecated."""
    return scheme.filter("section = 'active' and not coalesce(deprecated, false) and coalesce(description, '') <> ''").select("dimension", F.col("category_key").alias("key"), "description")


def integrity(scheme: DataFrame) -> DataFrame:
    """(dimension, key, problem): blank or repeated active keys, moved keys without a target, unknown dimensions."""
    active = scheme.filter("section = 'active'")
    repeated = active.groupBy("dimension", "category_key").agg(F.count("*").alias("n")).filter("n > 1").select("dimension", F.col("category_key").alias("key"), F.lit("repeated").alias("problem"))
    blank = active.filter(labels.is_blank(F.col("category_key"))).select("dimension", F.col("category_key").alias("key"), F.lit("blank").alias("problem"))
    targets = active.select("dimension", F.col("category_key").alias("move_to")).distinct()
    lost = scheme.filter("move_to is not null").join(targets, ["dimension", "move_to"], "left_anti").select("dimension", F.col("category_key").alias("key"), F.lit("lost target").alias("problem"))
    strange = scheme.filter(~F.col("dimension").isin(*DIMENSIONS)).select("dimension", F.col("category_key").alias("key"), F.lit("unknown dimension").alias("problem"))
    return repeated.unionByName(blank).unionByName(lost).unionByName(strange)


def counts_by_dimension(scheme: DataFrame) -> DataFrame:
    return scheme.groupBy("dimension").agg(
        F.count_if(F.col("section") == "active").alias("active"), F.count_if(F.col("section") == "rejected").alias("rejected"), F.count_if(F.coalesce("deprecated", F.lit(False))).alias("deprecated"),
    )


def candidate_frequencies(suggestions: DataFrame) -> DataFrame:
    """(dimension, key, frequency, example_ids): suggestions by normalised value with the first ids in the log's order.

    Each log row counts once, however often it was replayed. The examples of a key come from the first ones of each of
    its slices, so a frequent key is not gathered in one place.
    """
    rows = suggestions.filter("suggestion_id is not null").groupBy("suggestion_id").agg(F.min(F.struct("dimension", "id", "new_suggestion")).alias("s")).select("suggestion_id", "s.*")
    keyed = rows.select("dimension", labels.norm(F.col("new_suggestion")).alias("key"), "id", "suggestion_id").filter("key <> ''")
    parts = keyed.withColumn("part", F.pmod(F.xxhash64("suggestion_id"), 32))
    ranked = parts.withColumn("r", F.row_number().over(Window.partitionBy("dimension", "key", "part").orderBy("suggestion_id")))
    example = F.when(F.col("r") <= EXAMPLES, F.struct("suggestion_id", "id"))
    outer = ranked.groupBy("dimension", "key").agg(F.count("*").alias("frequency"), F.slice(F.array_sort(F.collect_list(example)), 1, EXAMPLES).alias("e"))
    return outer.select("dimension", "key", "frequency", F.array_join(F.transform("e", lambda x: x["id"]), ";").alias("example_ids"))


def suggested_explanations(suggestions: DataFrame) -> DataFrame:
    """(dimension, key, example_explanations): the first non-blank explanations of each suggestion in the log's order, taken slice by slice as the ids are."""
    content = F.struct("dimension", "id", "new_suggestion", labels.is_blank(F.col("explanation")).alias("blank"), "explanation")
    rows = suggestions.filter("suggestion_id is not null").groupBy("suggestion_id").agg(F.min(content).alias("s")).select("suggestion_id", "s.*").filter("not blank")
    keyed = rows.select("dimension", labels.norm(F.col("new_suggestion")).alias("key"), labels.clean_cell(F.col("explanation")).alias("explanation"), "suggestion_id").filter("key <> ''")
    parts = keyed.withColumn("part", F.pmod(F.xxhash64("suggestion_id"), 32))
    ranked = parts.withColumn("r", F.row_number().over(Window.partitionBy("dimension", "key", "part").orderBy("suggestion_id"))).filter(F.col("r") <= EXAMPLES)
    outer = ranked.groupBy("dimension", "key").agg(F.slice(F.array_sort(F.collect_list(F.struct("suggestion_id", "explanation"))), 1, EXAMPLES).alias("e"))
    return outer.select("dimension", "key", F.array_join(F.transform("e", lambda x: x["explanation"]), " || ").alias("example_explanations"))


def seed_frequencies(decisions: DataFrame, scheme: DataFrame) -> DataFrame:
    """(dimension, key, seed_description, frequency): how often each active described category, deprecated ones too, was chosen as it is written."""
    described = scheme.filter("section = 'active' and category_key is not null and coalesce(description, '') <> ''")
    seeds = described.groupBy("dimension", F.col("category_key").alias("key")).agg(F.min("description").alias("seed_description"))
    tokens = decisions.select("dimension", F.explode(F.split(labels.clean_cell(F.col("value")), ";")).alias("token")).select("dimension", labels.strip(F.col("token")).alias("key"))
    chosen = tokens.groupBy("dimension", "key").agg(F.count("*").alias("frequency"))
    return seeds.join(chosen, ["dimension", "key"], "left").fillna(0, ["frequency"])


def candidate_table(suggestions: DataFrame, decisions: DataFrame, scheme: DataFrame) -> DataFrame:
    """(dimension, key, source, frequency, seed_description, example_ids, example_explanations): seeds by choices and suggestions by occurrences."""
    none = F.lit("")
    seeds = seed_frequencies(decisions, scheme).select("dimension", "key", F.lit("seed").alias("source"), "frequency", "seed_description", none.alias("example_ids"), none.alias("example_explanations"))
    found = candidate_frequencies(suggestions).join(suggested_explanations(suggestions), ["dimension", "key"], "left").select(
        "dimension", "key", F.lit("suggested").alias("source"), "frequency", none.alias("seed_description"), "example_ids", F.coalesce("example_explanations", none).alias("example_explanations"),
    )
    return seeds.unionByName(found)


def new_candidates(frequencies: DataFrame, scheme: DataFrame) -> DataFrame:
    return frequencies.join(bounded_broadcast(scheme_keys(scheme).select("dimension", "key").distinct()), ["dimension", "key"], "left_anti")


def merge_candidates(existing: DataFrame, found: DataFrame, scheme: DataFrame) -> DataFrame:
    """(dimension, key, frequency, status): existing candidates keep and add up; new ones come in; known keys are skipped."""
    own = existing.filter("candidate_id is not null").groupBy("candidate_id").agg(F.max(F.struct("dimension", "candidate_key", "frequency")).alias("c")).select("c.*")
    held = own.select("dimension", labels.norm(F.col("candidate_key")).alias("key"), F.greatest(F.coalesce("frequency", F.lit(0)), F.lit(0)).alias("f")).filter("key <> ''")
    held = held.groupBy("dimension", "key").agg(F.sum("f").alias("old"))
    fresh = new_candidates(found, scheme).select("dimension", "key", F.col("frequency").alias("new"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "kept").otherwise("counted up")
    return held.join(fresh, ["dimension", "key"], "full").select("dimension", "key", (F.coalesce("old", F.lit(0)) + F.coalesce("new", F.lit(0))).cast("long").alias("frequency"), status.alias("status"))


def coder_categories(decisions: DataFrame, scheme: DataFrame) -> DataFrame:
    """(dimension, key, coders, n): keys coders gave that the scheme does not hold; the reserved answer is never one."""
    given = decisions.filter(F.col("dimension") != GATE).select("coder", "dimension", F.explode(labels.coder_set(F.col("value"))).alias("key"))
    fresh = given.filter(F.col("key") != labels.SENTINEL).filter(~F.lower("key").isin(*labels.NULL_WORDS)).join(bounded_broadcast(scheme_keys(scheme).select("dimension", "key").distinct()), ["dimension", "key"], "left_anti")
    return fresh.groupBy("dimension", "key").agg(F.array_join(F.array_sort(F.collect_set("coder")), ",").alias("coders"), F.count("*").alias("n"))


def sync_coder_categories(decisions: DataFrame, scheme: DataFrame, candidates: DataFrame) -> DataFrame:
    """(dimension, key, source) to add to the scheme: coders' keys that are no candidates either."""
    held = candidates.select("dimension", F.col("candidate_key").alias("key")).filter("key is not null").distinct()
    return coder_categories(decisions, scheme).join(held, ["dimension", "key"], "left_anti").select("dimension", "key", F.concat(F.lit("coder:"), "coders").alias("source"))


def three_way_merge(work: DataFrame, base: DataFrame, canonical: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, outcome): changes of ``work`` since ``base`` applied to ``canonical``; in a conflict canonical stays.

    Outcomes: added, updated, deleted, conflict, unchanged. Deleted entries are not in the result's kept rows but named.
    """
    w = work.select(*keys, F.col(value).alias("w"), F.lit(True).alias("in_w"))
    b = base.select(*keys, F.col(value).alias("b"), F.lit(True).alias("in_b"))
    c = canonical.select(*keys, F.col(value).alias("c"), F.lit(True).alias("in_c"))
    rows = w.join(b, keys, "full").join(c, keys, "full")
    has = lambda n: F.coalesce(n, F.lit(False))
    in_w, in_b, in_c = has("in_w"), has("in_b"), has("in_c")
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    outcome = (
        F.when(in_w & ~in_b & ~in_c, "added").when(in_w & ~in_b & in_c & ~same("w", "c"), "conflict")
        .when(~in_w & in_b & in_c & same("b", "c"), "deleted").when(~in_w & in_b & in_c, "conflict")
        .when(in_w & in_b & ~same("w", "b") & in_c & same("b", "c"), "updated")
        .when(in_w & in_b & ~same("w", "b") & in_c & ~same("w", "c"), "conflict").when(in_w & in_b & ~same("w", "b") & ~in_c, "conflict")
        .otherwise("unchanged")
    )
    kept = F.when(outcome.isin("added", "updated"), F.col("w")).otherwise(F.col("c"))
    return rows.select(*keys, kept.alias(value), outcome.alias("outcome")).filter("outcome <> 'unchanged' or " + value + " is not null")


#: Product kinds by software type, as the roll-up rule names them.
ROLLUP = {"klassenbibliothek": "library", "webportal": "application", "tischrechner_anwendung": "application", "mobilanwendung": "application", "stapelskript": "script"}


def archetypes(decisions: DataFrame) -> DataFrame:
    """(archetype, n): accepted papers of each coder rolled up by software type; what no rule covers is ``unresolved``."""
    types = decisions.filter(F.col("dimension") == "software_type").select("coder", "id", labels.bench_set(F.col("value")).alias("keys"))
    rule = F.lit(None).cast("string")
    for key, name in reversed(ROLLUP.items()):
        rule = F.when(F.array_contains("keys", key), name).otherwise(rule)
    return types.groupBy(F.coalesce(rule, F.lit("unresolved")).alias("archetype")).agg(F.count("*").alias("n"))
