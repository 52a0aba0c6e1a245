"""Merging the answers of a panel by majority, with the lead seat deciding ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import labels
from tessera.operators.decisions import DIMENSIONS, GATE
from tessera.runtime import bounded_broadcast

SINGLE = "research_position"
MULTI = tuple(d for d in DIMENSIONS if d != SINGLE)


def panel_votes(decisions: DataFrame, seats: DataFrame) -> DataFrame:
    """(id, seat, dimension, value, certainty, error): the seats' answers; an answer sheet without a readable gate is an error."""
    own = decisions.join(bounded_broadcast(seats), "coder")
    readable = own.groupBy("id", "seat").agg(F.max(F.when(F.col("dimension") == GATE, labels.gate_value(F.col("value")).isNotNull())).alias("ok"))
    return own.join(readable, ["id", "seat"]).select("id", "seat", "dimension", "value", F.col("model_certainty").alias("certainty"), (~F.coalesce("ok", F.lit(False))).alias("error"))


def panel_gate(votes: DataFrame) -> DataFrame:
    """(id, cast, gate, gate_votes, dissent): majority of the cast gates; a tie goes to the lead, null if the lead abstained."""
    gate = F.max(F.when(F.col("dimension") == GATE, labels.gate_value(F.col("value"))))
    sheets = votes.groupBy("id", "seat").agg(gate.alias("label"), F.max("error").alias("error"))
    sheets = sheets.withColumn("label", F.when(~F.col("error"), F.col("label")))
    mark = F.when(F.col("error"), "-").otherwise(F.coalesce(F.col("label").cast("string"), F.lit("?")))
    tallied = sheets.groupBy("id").agg(
        F.count_if(~F.col("error")).alias("cast"), F.count_if(F.col("label") == 1).alias("yes"), F.count_if(F.col("label") == 0).alias("no"),
        F.max(F.when(F.col("seat") == 0, F.col("label"))).alias("lead"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seat", mark.alias("m")))), lambda v: v["m"]), "|").alias("gate_votes"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("error"), F.col("seat")))), lambda s: F.concat(F.lit("seat"), s)), "+").alias("out"),
    )
    tie = F.col("yes") == F.col("no")
    named = (F.col("yes") + F.col("no")) > 0
    dissent = F.when(F.col("cast") == 0, "all_failed").when(tie & named, GATE + ":tie").when((F.col("yes") > 0) & (F.col("no") > 0), GATE).otherwise("")
    decided = F.when(F.col("cast") == 0, None).when(tie, F.col("lead")).when(F.col("yes") > F.col("no"), 1).otherwise(0)
    return tallied.select("id", "cast", decided.alias("gate"), "gate_votes", dissent.alias("dissent"), F.when(F.col("cast") > 0, F.col("out")).otherwise("").alias("abstained"))


def panel_single(votes: DataFrame, dimension: str = "research_position") -> DataFrame:
    """(id, winner, dissent): most named key; a tie goes to the lead's key if it is among them, else to the first by name."""
    cast = votes.filter(~F.col("error")).filter(F.col("dimension") == dimension).select("id", "seat", labels.norm(F.col("value")).alias("key")).filter("key <> ''")
    counts = cast.groupBy("id", "key").agg(F.count("*").alias("n"), F.max((F.col("seat") == 0).cast("int")).alias("lead"))
    best = F.min(F.struct((-F.col("n")).alias("n"), (-F.col("lead")).alias("l"), "key"))
    return counts.groupBy("id").agg(best.alias("b"), F.count("*").alias("kinds")).select("id", F.col("b.key").alias("winner"), (F.col("kinds") > 1).alias("dissent"))


def panel_multi(votes: DataFrame, dimension: str) -> DataFrame:
    """(id, categories, dissent) of one multi-valued dimension."""
    return panel_multis(votes, [dimension]).drop("dimension")


def panel_multis(votes: DataFrame, dimensions: Sequence[str] = MULTI) -> DataFrame:
    """(id, dimension, categories, dissent): keys named by a strict majority of the cast sheets, in the lead's order, then by name.

    Where none has a majority but some are named, the lead's list stands.
    """
    sheets = votes.filter(~F.col("error"))
    needed = sheets.groupBy("id").agg((F.floor(F.countDistinct("seat") / 2) + 1).alias("needed"))
    named = sheets.filter(F.col("dimension").isin(*dimensions)).select("id", "dimension", "seat", F.posexplode(labels.vote_list(F.col("value"))).alias("pos", "key"))
    counts = named.groupBy("id", "dimension", "key").agg(F.countDistinct("seat").alias("n"), F.min(F.when(F.col("seat") == 0, F.col("pos"))).alias("place"))
    judged = counts.join(needed, "id")
    kept = F.array_sort(F.collect_list(F.when(F.col("n") >= F.col("needed"), F.struct(F.coalesce("place", F.lit(1 << 30)).alias("p"), "key"))))
    lead = F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct(F.col("place").alias("p"), "key"))))
    merged = judged.groupBy("id", "dimension").agg(kept.alias("kept"), lead.alias("lead"), F.count_if(F.col("n") < F.col("needed")).alias("below"))
    none = F.size("kept") == 0
    chosen = F.transform(F.when(none, F.col("lead")).otherwise(F.col("kept")), lambda k: k["key"])
    dissent = F.when(none, F.concat("dimension", F.lit(":no_majority"))).when(F.col("below") > 0, F.col("dimension")).otherwise("")
    return merged.select("id", "dimension", F.array_join(chosen, ";").alias("categories"), dissent.alias("dissent"))


def vote_dissent(votes: DataFrame, seats: DataFrame) -> DataFrame:
    """(id, dissent): every field the panel was split on, joined by ;: the gate, the dimensions in their order, who abstained."""
    gate = panel_gate(votes).select("id", "cast", F.col("dissent").alias("gate"))
    single = F.when(F.col("dissent"), F.lit(SINGLE)).otherwise("")
    split = panel_single(votes, SINGLE).select("id", F.lit(SINGLE).alias("dimension"), single.alias("dissent")).unionByName(panel_multis(votes).select("id", "dimension", "dissent"))
    place = F.array_position(F.array(*[F.lit(d) for d in DIMENSIONS]), F.col("dimension"))
    fields = split.filter("dissent <> ''").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), "dissent"))), lambda f: f["dissent"]).alias("fields"))
    missed = votes.filter("error").select("id", "seat").distinct().join(bounded_broadcast(seats), "seat")
    missed = missed.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seat", "coder"))), lambda s: s["coder"]), "+").alias("out"))
    none = F.array().cast("array<string>")
    parts = F.concat(F.array("gate"), F.coalesce("fields", none), F.when(F.col("out").isNotNull() & (F.col("cast") > 0), F.array(F.concat(F.lit("abstained:"), "out"))).otherwise(none))
    joined = gate.join(fields, "id", "left").join(missed, "id", "left")
    return joined.select("id", F.array_join(F.filter(parts, lambda p: p != ""), ";").alias("dissent"))


def panel_labels(votes: DataFrame) -> DataFrame:
    """(id, dimension, categories, dissent, seat, certainty): the merged value of the gate and of every dimension, with the sheet its prose is taken from.

    ``votes`` has a certainty column. A dimension's prose comes from the first cast sheet whose list is the merged one,
    else from the one that shares most keys with it; the gate's from the first that gave the merged gate, else from
    the lead. Papers without a cast sheet have no labels.
    """
    cast = votes.filter(~F.col("error"))
    single = panel_single(votes, SINGLE).select("id", F.lit(SINGLE).alias("dimension"), F.col("winner").alias("categories"), F.when(F.col("dissent"), F.lit(SINGLE)).otherwise("").alias("dissent"))
    merged = panel_multis(votes).unionByName(single)
    sheets = cast.select("id", "seat").distinct()
    cells = sheets.withColumn("dimension", F.explode(F.array(*[F.lit(d) for d in DIMENSIONS])))
    given = cells.join(cast.select("id", "seat", "dimension", "value", "certainty"), ["id", "seat", "dimension"], "left").join(merged, ["id", "dimension"], "left")
    own, want = labels.vote_list(F.col("value")), labels.vote_list(F.col("categories"))
    rank = F.struct((own != want).alias("differs"), (-F.size(F.array_intersect(own, want))).alias("shared"), "seat")
    picked = given.groupBy("id", "dimension").agg(
        F.coalesce(F.first("categories"), F.lit("")).alias("categories"), F.coalesce(F.first("dissent"), F.lit("")).alias("dissent"), F.min_by(F.struct("seat", "certainty"), rank).alias("s"),
    )
    gate = panel_gate(votes).filter("cast > 0").select("id", "gate", "dissent")
    answers = votes.filter(F.col("dimension") == GATE).select("id", "seat", "certainty", "error", labels.gate_value(F.col("value")).alias("label")).join(gate, "id")
    fits = ~F.col("error") & F.col("label").eqNullSafe(F.col("gate"))
    sources = answers.filter(fits | (F.col("seat") == 0)).groupBy("id", "gate", "dissent").agg(F.min_by(F.struct("seat", "certainty"), F.struct((~fits).alias("other"), "seat")).alias("s"))
    judged = gate.join(sources.select("id", "s"), "id", "left").select("id", F.lit(GATE).alias("dimension"), F.coalesce(F.col("gate").cast("string"), F.lit("")).alias("categories"), "dissent", "s")
    return picked.unionByName(judged).select("id", "dimension", "categories", "dissent", "s.seat", "s.certainty")


def merged_row(merged: DataFrame, dissent: DataFrame) -> DataFrame:
    """(id, gate, and for each dimension its label, seat and certainty, dissent): the merged annotation of a paper as one row."""
    fields = [(GATE, "gate"), *((d, d) for d in DIMENSIONS)]
    picked = [F.max(F.when(F.col("dimension") == d, F.col(c))).alias(name if c == "categories" else f"{name}_{c}") for d, name in fields for c in ("categories", "seat", "certainty")]
    return merged.groupBy("id").agg(*picked).join(dissent, "id", "left")
