"""The queries of the training-data operators and, where SQL can state them, their equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import canonical, consensus, languages, mixing, ocr, packing, proportions, residue, termfreq
from tessera.sources.tables import load


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    _, report = proportions.draw_samples(load(spark, folder, "working_sets"), load(spark, folder, "sample_targets"))
    return report.filter("short").select("set_name", "facet", "category")


def p1_availability(spark: SparkSession, folder: str) -> DataFrame:
    _, report = proportions.draw_samples(load(spark, folder, "working_sets"), load(spark, folder, "sample_targets"))
    return report.select("set_name", "facet", "category", "wanted", "available")


def p1_sample(spark: SparkSession, folder: str) -> DataFrame:
    sample, _ = proportions.draw_samples(load(spark, folder, "working_sets"), load(spark, folder, "sample_targets"))
    return sample


def p1_checks(spark: SparkSession, folder: str) -> DataFrame:
    """For each set with papers: the rows drawn, up to those it must have, and the categories left below a floor they could meet."""
    targets = load(spark, folder, "sample_targets")
    _, report = proportions.draw_samples(load(spark, folder, "working_sets"), targets)
    rows = report.join(targets.select("set_name", "facet", "category", "min_rows"), ["set_name", "facet", "category"])
    least = F.least("min_rows", "available")
    facets = rows.groupBy("set_name", "facet").agg(F.sum(least).alias("floors"), F.sum((F.col("drawn") < least).cast("int")).alias("missed"), F.max("sample_size").alias("size"), F.max("drawn_size").alias("drawn"))
    sets = facets.groupBy("set_name").agg(F.greatest(F.max("size"), F.max("floors")).alias("needed"), F.sum("missed").alias("below_floor"), F.max("drawn").alias("drawn"))
    return sets.select("set_name", F.least("drawn", "needed").alias("rows"), "below_floor")


def p2_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every typed value that is no literal key, with the key it stands for or null."""
    typed = canonical.typed_values(*(load(spark, folder, t) for t in ("codings", "suggestions", "candidates")))
    return canonical.mapped_rows(typed, load(spark, folder, "schema_categories"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_rows(spark, folder).filter("category_key is not null").select("src", "row_id", "category_key").distinct()


def p3_segments(spark: SparkSession, folder: str) -> DataFrame:
    found = languages.detect_languages(load(spark, folder, "papers"))
    return found.select("paper_no", "field", F.inline("segments"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return languages.misdeclared(languages.detect_languages(load(spark, folder, "papers")))


def p4_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return ocr.repair_papers(load(spark, folder, "papers")).select("paper_no", "field", "repaired")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return ocr.repair_papers(load(spark, folder, "papers")).select("paper_no", "field", F.inline("changes"))


def p5_terms(spark: SparkSession, folder: str) -> DataFrame:
    return termfreq.count_terms(load(spark, folder, "suggestions"), load(spark, folder, "candidates"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_terms(spark, folder).filter("mark is not null").select("dimension", "term", "mark")


def p6_labels(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.consensus(load(spark, folder, "codings"), load(spark, folder, "schema_categories"))[0]


def p6_coders(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.consensus(load(spark, folder, "codings"), load(spark, folder, "schema_categories"))[1]


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_labels(spark, folder).filter("votes >= 3 and final_category is not null").select("id", "dimension", "final_category")


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(load(spark, folder, "documents"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that lie in several containers."""
    split = p7_containers(spark, folder).filter("parts > 1").groupBy("doc_id").agg(F.count_distinct("container").alias("containers"))
    return split.filter("containers > 1").select("doc_id")


def p7_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose pieces do not follow one another whole, and containers over their capacity."""
    packed = p7_containers(spark, folder)
    each = packed.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("part").alias("parts"), F.max("parts").alias("all"))
    broken = each.agg(F.count_if((F.col("n") != F.col("parts")) | (F.col("n") != F.col("all"))).alias("broken"), F.count("*").alias("documents"))
    over = packed.groupBy("container").agg(F.sum("tokens").alias("t")).agg(F.count_if(F.col("t") > packing.CAPACITY).alias("overfull"))
    return broken.crossJoin(F.broadcast(over)).select("documents", "broken", "overfull")


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p7_containers(spark, folder))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(load(spark, folder, "documents"), load(spark, folder, "mix_targets"))[0]


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(load(spark, folder, "documents"), load(spark, folder, "mix_targets"))[1]


def p8_checks(spark: SparkSession, folder: str) -> DataFrame:
    """For each mix: texts used more often than any of its sources allows, and positions outside the time from 0 to 1."""
    documents, targets = load(spark, folder, "documents"), load(spark, folder, "mix_targets")
    mix = mixing.mix_sources(documents, targets)[0].join(documents.select("doc_id", F.md5("text").alias("text_key")), "doc_id")
    uses = mix.groupBy("mix_id", "text_key").agg(F.count("*").alias("n"), F.max("source").alias("source"), F.sum((~F.col("position").between(0, 1)).cast("int")).alias("outside"))
    allowed = targets.groupBy("mix_id", "source").agg(F.max("max_repeats").alias("most"))
    return uses.join(allowed, ["mix_id", "source"]).groupBy("mix_id").agg(F.sum((F.col("n") > F.col("most")).cast("int")).alias("overused"), F.sum("outside").alias("outside"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_report(spark, folder).filter("short").select("mix_id", "source")


def p9_marked(spark: SparkSession, folder: str) -> DataFrame:
    return residue.mark_residue(load(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_marked(spark, folder).filter("excluded").select("doc_id")


def p9_kept(spark: SparkSession, folder: str) -> DataFrame:
    return p9_marked(spark, folder).filter("not excluded").select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_availability, p1_sample, p1_checks, p2_found, p2_rows, p3_found, p3_segments, p4_found, p4_repaired, p5_found, p5_terms, p6_found, p6_labels, p6_coders, p7_found, p7_containers, p7_checks, p7_report, p8_found, p8_mix, p8_checks, p8_report, p9_found, p9_marked, p9_kept)
}
