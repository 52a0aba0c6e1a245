"""Queries on raw texts: corruption, sections, answers of models. Where positions decide, there is no SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import labels
from tessera.operators import annotate, sections
from tessera.operators.decisions import DIMENSIONS, GATE
from tessera.sources.tables import load


def corruption_flags(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "documents").select("doc_id", sections.corrupted(F.col("text")).alias("corrupted"))


def paper_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of raw papers put together from their parts."""
    papers = load(spark, folder, "papers").filter("text is not null")
    head = F.concat_ws("\n", "title", "authors", F.concat(F.lit("Abstract: "), F.coalesce("abstract", F.lit("-"))), F.lit("1 Introduction"), "text", F.lit("References"), "references_text")
    return sections.extract_sections(papers.select("paper_no", head.alias("text")), key="paper_no")


def annotation_flatten(spark: SparkSession, folder: str) -> DataFrame:
    """Model answers with prose and fences around their JSON, parsed and flattened."""
    rows = load(spark, folder, "codings").filter("model_category is not null and dimension = 'software_type'").select("id", "model_category").groupBy("id").agg(F.max("model_category").alias("value"))

    def client(prompt: str) -> str:
        return 'Here it is: ```json {"' + GATE + '": {"value": 1}, "typology": {"software_type": {"categories": ["' + '", "'.join(prompt.split(";")) + '"]}}} ``` done'

    answered = annotate.annotate(rows, "{row['value']}", client, partitions=8)
    return answered.select("id", GATE, "software_type", "llm_error")


def filled_prompts(spark: SparkSession, folder: str) -> DataFrame:
    papers = load(spark, folder, "papers").select("paper_no", "title", "authors")
    prompt = annotate.fill_prompt_column("Title: {row['title']}\nAuthors: {row['authors']}", ["title", "authors"])
    return papers.select("paper_no", prompt.alias("prompt"), F.round(F.length(prompt) / 4).cast("long").alias("tokens"))


def extraction_report(spark: SparkSession, folder: str) -> DataFrame:
    papers = load(spark, folder, "papers")
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    return papers.select("paper_no", size("title").alias("title"), size("abstract").alias("abstract"), size("text").alias("text"), size("references_text").alias("references"), F.col("text").isNull().alias("failed"))


def joined_accents(spark: SparkSession, folder: str) -> DataFrame:
    papers = load(spark, folder, "papers").filter("title is not null")
    apart = F.col("title")
    for letter, plain in (("ä", "¨a"), ("ö", "¨o"), ("ü", "¨u"), ("Ä", "¨A"), ("é", "´e"), ("à", "`a")):
        apart = F.replace(apart, F.lit(letter), F.lit(plain))
    return papers.select("paper_no", labels.joined_accents(apart).alias("title"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (corruption_flags, paper_sections, annotation_flatten, filled_prompts, extraction_report, joined_accents)
}

_SAMPLE = "substr(text, 1, 2000)"
SQL: dict[str, str] = {
    "corruption_flags": rf"""
      with s as (select doc_id, {_SAMPLE} as t, length({_SAMPLE})::double as n from documents)
      select doc_id, coalesce(case when n = 0 then true else
        length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) / n < 0.30 or length(regexp_replace(t, '[^\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) / n > 0.20
        or len(regexp_extract_all(t, '[a-zA-ZäöüÄÖÜß][0-9]|[0-9][a-zA-ZäöüÄÖÜß]')) / n > 0.15 or regexp_matches(t, '[\x{{81}}\x{{8D}}\x{{8F}}\x{{90}}\x{{9D}}]')
        or length(regexp_replace(t, '[^=;]', '', 'g')) / n > 0.03 end, true) as corrupted from s""",
    "annotation_flatten": f"select id, '1' as {GATE}, max(model_category) as software_type, null::varchar as llm_error from codings where model_category is not null and dimension = 'software_type' group by id",
    "filled_prompts": """select paper_no, 'Title: ' || coalesce(title, '') || chr(10) || 'Authors: ' || coalesce(authors, '') as prompt,
      round(length('Title: ' || coalesce(title, '') || chr(10) || 'Authors: ' || coalesce(authors, '')) / 4.0)::bigint as tokens from papers""",
    "extraction_report": """select paper_no, coalesce(length(title), 0)::int as title, coalesce(length(abstract), 0)::int as abstract, coalesce(length(text), 0)::int as text,
      coalesce(length(references_text), 0)::int as "references", text is null as failed from papers""",
    "joined_accents": "select paper_no, title from papers where title is not null",
}
