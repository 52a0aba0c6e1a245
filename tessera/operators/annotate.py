"""Annotation by an external model: prompts, answers, retries, and runs that are resumed and stop at a target.

The client is a function from a prompt to an answer text; it runs once for each item in few partitions, its results are
written before anything reads them again, and retries happen inside the call, never by repeating a task.
"""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.decisions import DIMENSIONS, GATE
from tessera.operators.incremental import undone

Client = Callable[[str], str]
ATTEMPTS = 5
#: What an answer says of a dimension besides its categories.
PROSE = ("certainty", "new_suggestion", "explanation")


class Retry(Exception):
    """A failure that may pass: rate limits, server errors, lost connections, blank answers."""


class Stop(Exception):
    """A failure that ends the run: credentials are wrong."""


def first_json(answer: str) -> dict:
    """The first object in an answer, with anything around it; control characters inside strings are allowed."""
    for text in (answer[answer.find("{") :] if "{" in answer else "", *re.findall(r"```(?:json)?\s*(.*?)```", answer, re.DOTALL)):
        try:
            value, _ = json.JSONDecoder(strict=False).raw_decode(text)
        except ValueError:
            continue
        if isinstance(value, dict):
            return value
    raise ValueError("no JSON object in the answer")


def flatten(record: dict) -> dict[str, str | None]:
    """Gate and dimension fields of a nested answer, 23 in all; several categories are joined by ``;``, missing parts are null."""
    gate = record.get(GATE) if isinstance(record.get(GATE), dict) else {"value": record.get(GATE)}
    text = lambda v: None if v is None else str(v)
    out: dict[str, str | None] = {GATE: text(gate.get("value"))}
    for name in ("certainty", "explanation"):
        out[f"{GATE}_{name}"] = text(gate.get(name, record.get(f"{GATE}_{name}")))
    typology = record.get("typology")
    typology = typology if isinstance(typology, dict) else {}
    for dimension in DIMENSIONS:
        part = typology.get(dimension) or {}
        value = part.get("categories", part.get("category")) if isinstance(part, dict) else part
        if isinstance(value, list):
            value = ";".join(str(v) for v in value)
        out[dimension] = text(value)
        for name in PROSE:
            out[f"{dimension}_{name}"] = text(part.get(name)) if isinstance(part, dict) else None
    return out


def fill_prompt(template: str, row: dict[str, str | None]) -> str:
    """Placeholders ``{row['field']}`` filled; unknown and missing fields become empty."""
    return re.sub(r"\{row\['(\w+)'\]\}", lambda m: str(row.get(m.group(1)) or ""), template)


def fill_prompt_column(template: str, fields: list[str]) -> Column:
    """The same as a column expression, for prompts that never leave the executors' memory as Python objects."""
    filled = F.lit(template)
    for name in fields:
        filled = F.replace(filled, F.lit("{row['" + name + "']}"), F.coalesce(F.col(name), F.lit("")))
    return filled


def ask(client: Client, prompt: str, attempts: int = ATTEMPTS, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None]:
    """(answer, error): up to ``attempts`` calls with doubling waits and jitter; one of the two is null."""
    problem = "no attempt"
    for attempt in range(attempts):
        try:
            answer = client(prompt)
            if answer and answer.strip():
                return answer, None
            problem = "blank answer"
        except Retry as failure:
            problem = str(failure) or "retry"
        except Stop:
            raise
        except Exception as failure:  # recorded, not repeated
            return None, f"{type(failure).__name__}: {failure}"
        if attempt + 1 < attempts:
            sleep(wait * 2**attempt * (1 + random.random() / 4))
    return None, problem


#: The 23 columns of a flat answer.
FIELDS = (GATE, f"{GATE}_certainty", f"{GATE}_explanation", *(c for d in DIMENSIONS for c in (d, *(f"{d}_{n}" for n in PROSE))))
ANSWER = ", ".join(f"{c} string" for c in (*FIELDS, "llm_error", "llm_raw_response"))


def flat_columns(answer: Column | str) -> list[Column]:
    """The same fields of a JSON column as native expressions, for answers that are in a table already."""
    read = lambda path: F.get_json_object(answer, f"$.{path}")
    columns = [F.coalesce(read(f"{GATE}.value"), read(GATE)).alias(GATE)]
    columns += [F.coalesce(read(f"{GATE}.{n}"), read(f"{GATE}_{n}")).alias(f"{GATE}_{n}") for n in ("certainty", "explanation")]
    for d in DIMENSIONS:
        given = F.coalesce(read(f"typology.{d}.categories"), read(f"typology.{d}.category"))
        several = F.array_join(F.from_json(given, "array<string>"), ";")
        columns.append(F.when(given.startswith("["), several).otherwise(given).alias(d))
        columns += [read(f"typology.{d}.{n}").alias(f"{d}_{n}") for n in PROSE]
    return columns


def new_suggestions(flat: DataFrame) -> DataFrame:
    """(id, dimension, new_suggestion, certainty, explanation): a row for each dimension of a flat answer that proposes a category."""
    entries = F.array(*[F.struct(F.lit(d).alias("dimension"), F.trim(f"{d}_new_suggestion").alias("new_suggestion"), F.col(f"{d}_certainty").alias("certainty"), F.col(f"{d}_explanation").alias("explanation")) for d in DIMENSIONS])
    return flat.select("id", F.inline(F.filter(entries, lambda e: F.coalesce(e["new_suggestion"] != "", F.lit(False)))))


def targeted_prompt(scheme: DataFrame, fields: list[str]) -> Callable[[DataFrame], DataFrame]:
    """A step from (id, todo, fields) to (id, prompt): only the dimensions in ``todo`` are asked for, with their active keys and the shape of the answer.

    The prompt is put together from one short text for each dimension, so the scheme, which is small, is joined as a map.
    """
    described = scheme.filter("section = 'active' and category_key is not null and not coalesce(deprecated, false)")
    line = F.concat(F.lit("- "), F.col("category_key"), F.coalesce(F.concat(F.lit(": "), "description"), F.lit("")))
    shape = F.when(F.col("multi"), F.lit('{"categories": [], ')).otherwise(F.lit('{"category": "", ')) if "multi" in scheme.columns else F.lit('{"category": "", ')
    blocks = described.groupBy("dimension").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("keys"), F.max(shape).alias("shape"))
    block = F.struct(F.concat(F.lit("## "), "dimension", F.lit("\n"), "keys").alias("keys"), F.concat(F.lit('"'), "dimension", F.lit('": '), "shape", F.lit('"certainty": 0.0, "new_suggestion": "", "explanation": ""}')).alias("shape"))
    table = blocks.agg(F.map_from_entries(F.collect_list(F.struct("dimension", block))).alias("__blocks"))

    def step(work: DataFrame) -> DataFrame:
        asked = F.filter(F.transform(F.split("todo", ";"), lambda d: F.element_at("__blocks", d)), lambda b: b.isNotNull())
        paper = [F.concat(F.lit(f"{name}: "), F.coalesce(F.col(name), F.lit("")), F.lit("\n")) for name in fields]
        head = [F.lit("Annotate only these dimensions: "), F.replace("todo", F.lit(";"), F.lit(", ")), F.lit("\n")]
        keys, shapes = F.array_join(F.transform(asked, lambda b: b["keys"]), "\n"), F.array_join(F.transform(asked, lambda b: b["shape"]), ", ")
        prompt = F.concat(*paper, *head, keys, F.lit('\nAnswer with this JSON only: {"typology": {'), shapes, F.lit("}}"))
        return work.filter("todo <> ''").crossJoin(F.broadcast(table)).select("id", prompt.alias("prompt"))

    return step


def fill_missing(rows: DataFrame, todo: DataFrame, papers: DataFrame, scheme: DataFrame, client: Client, path: str, fields: list[str], partitions: int = 1) -> DataFrame:
    """Checkpoint rows with the cells of ``todo`` filled by targeted questions; answers are kept in ``path``, so that a run goes on where one ended."""
    spark = rows.sparkSession
    prompts = targeted_prompt(scheme, fields)(todo.join(papers.select("id", *fields).dropDuplicates(["id"]), "id", "left"))
    done = written(spark, path)
    left = prompts if done is None else undone(prompts, done)
    annotate(left, "{row['prompt']}", client, partitions).write.mode("append").parquet(path)
    return merge_filled(rows, spark.read.parquet(path), todo)


def annotate(items: DataFrame, template: str, client: Client, partitions: int = 1, attempts: int = ATTEMPTS, wait: float = 1.0) -> DataFrame:
    """(id, the 23 fields, llm_error, llm_raw_response) for every item; write the result before using it twice."""
    fields = [c for c in items.columns if c != "id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item in batch.to_dict("records"):
                answer, error = ask(client, fill_prompt(template, item), attempts, wait)
                flat: dict[str, str | None] = dict.fromkeys(FIELDS)
                if answer is not None:
                    try:
                        flat = flatten(first_json(answer))
                    except ValueError as failure:
                        error = str(failure)
                rows.append({"id": item["id"], **flat, "llm_error": error, "llm_raw_response": answer})
            yield pd.DataFrame(rows, columns=["id", *FIELDS, "llm_error", "llm_raw_response"])

    # calls are limited to few tasks behind an exchange, so that what comes before keeps its own parallelism
    return items.select("id", *fields).repartition(partitions).mapInPandas(run, f"id string, {ANSWER}")


def merge_filled(rows: DataFrame, filled: DataFrame, todo: DataFrame) -> DataFrame:
    """Checkpoint rows with only the requested cells replaced; an answer with an error changes nothing."""
    new = filled.filter("llm_error is null").select("id", *[F.col(d).alias(f"__{d}") for d in DIMENSIONS])
    joined = rows.join(new, "id", "left").join(todo.select("id", F.split("todo", ";").alias("__todo")), "id", "left")
    asked = lambda d: F.coalesce(F.array_contains("__todo", d), F.lit(False))
    return joined.withColumns({d: F.when(asked(d) & F.col(f"__{d}").isNotNull(), F.col(f"__{d}")).otherwise(F.col(d)) for d in DIMENSIONS}).drop(*[f"__{d}" for d in DIMENSIONS], "__todo")


def written(spark: SparkSession, path: str) -> DataFrame | None:
    """What a run has written so far, or None if the folder does not exist; a folder that cannot be read is an error, not an empty run."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return spark.read.parquet(path) if there else None


def bench(items: DataFrame, template: str, clients: dict[str, Client], path: str, partitions: int = 1) -> DataFrame:
    """Answers of every model to every item, one folder for each model; what a model has answered is not asked again."""
    spark = items.sparkSession
    for model, client in clients.items():
        own = f"{path}/model={model}"
        done = written(spark, own)
        annotate(items if done is None else undone(items, done), template, client, partitions).write.mode("append").parquet(own)
    return spark.read.parquet(path)


def annotate_missing(sample: DataFrame, papers: DataFrame, template: str, client: Client, path: str, partitions: int = 1) -> DataFrame:
    """Answers to the sampled papers: those in ``path`` already, and the others, which are asked for and added to it."""
    spark = papers.sparkSession
    wanted = papers.join(sample.select("id").distinct(), "id", "left_semi")
    done = written(spark, path)
    annotate(wanted if done is None else undone(wanted, done), template, client, partitions).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(sample.select("id").distinct(), "id", "left_semi")


def reannotation(rows: DataFrame, gate: Column, order: list[str], limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(worklist, kept): ids of accepted rows in order, at most ``limit``, and the rows that stay when those are purged to be asked again."""
    accepted = rows.filter(gate == 1).groupBy("id").agg(F.min(F.struct(*order)).alias("o")).orderBy("o", "id")
    work = (accepted if limit is None else accepted.limit(limit)).select("id")
    return work, rows.join(work, "id", "left_anti")


def confirm_until(items: DataFrame, order: str, path: str, template: str, client: Client, target: int, batch: int = 50) -> int:
    """Annotates items in order, in batches appended to ``path``, until so many are confirmed; returns their number.

    Items that are in the checkpoint already are not asked again, whatever their answer was.
    """
    spark = items.sparkSession
    while True:
        done = written(spark, path)
        confirmed = 0 if done is None else done.filter(F.col(GATE).try_cast("double") == 1).count()
        rest = items if done is None else undone(items, done)
        if confirmed >= target:
            return confirmed
        work = rest.orderBy(order, "id").limit(batch)
        if work.isEmpty():
            return confirmed
        annotate(work, template, client).write.mode("append").parquet(path)
