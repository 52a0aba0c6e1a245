"""Queries on manifests, confirmed papers, flat answers and the scheme's vocabulary, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import labels
from tessera.operators import annotate, incremental, manifests, vocabulary
from tessera.operators import decisions as D
from tessera.plans import sql as S
from tessera.sources.tables import load

SEED = 42


def _decisions(spark: SparkSession, folder: str) -> DataFrame:
    return D.latest(load(spark, folder, "codings"))


def _confirmed(spark: SparkSession, folder: str) -> DataFrame:
    return D.gates(_decisions(spark, folder)).filter("gate = 1").select("id").distinct()


def manifest_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return manifests.candidates(load(spark, folder, "working_sets"))


def confirmed_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Files of confirmed papers: gold sets hold the candidates, every other set may help out."""
    sets = load(spark, folder, "working_sets")
    gold = F.col("set_name").startswith("gold")
    return manifests.confirmed_sources(_confirmed(spark, folder), sets.filter(gold), sets.filter(~gold))


def set_attrition(spark: SparkSession, folder: str) -> DataFrame:
    rejected = D.rejected_only(D.gates(_decisions(spark, folder)))
    return manifests.attrition(rejected, load(spark, folder, "working_sets").filter("set_name like 'gold%'"))


def pretest_draw(spark: SparkSession, folder: str) -> DataFrame:
    return manifests.pretest(load(spark, folder, "working_sets").filter("set_name like 'final%'"), 40, SEED)


def refill_targets(spark: SparkSession, folder: str) -> DataFrame:
    sets = load(spark, folder, "working_sets").filter("set_name is not null").groupBy("set_name").agg(F.count_distinct("dst").alias("have"))
    needs = load(spark, folder, "sample_targets").groupBy("set_name").agg(F.max("sample_size").alias("need"))
    return sets.join(needs, "set_name").select("set_name", manifests.refill_target(F.col("have"), 4 * F.col("need"), F.lit(100)).cast("long").alias("target"))


def candidate_stream(spark: SparkSession, folder: str) -> DataFrame:
    sets = load(spark, folder, "working_sets")
    return manifests.stream(sets.filter("set_name like 'gold%'"), sets.filter("set_name like 'pool%'"), load(spark, folder, "papers").filter("id is not null"), SEED)


def set_sizes(spark: SparkSession, folder: str) -> DataFrame:
    targets = load(spark, folder, "sample_targets").groupBy("set_name").agg(F.max("sample_size").alias("target"))
    return manifests.sizes(load(spark, folder, "working_sets").filter("set_name is not null"), _confirmed(spark, folder), targets)


def validated_papers(spark: SparkSession, folder: str) -> DataFrame:
    return manifests.validated(load(spark, folder, "papers"), ["title", "authors", "abstract"]).select("paper_no", "title", "missing")


def scheme_guidance(spark: SparkSession, folder: str) -> DataFrame:
    return vocabulary.guidance(load(spark, folder, "schema_categories"))


def _known(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "schema_categories").filter("section = 'active'").select("dimension", F.col("category_key").alias("key"))


def new_category_decisions(spark: SparkSession, folder: str) -> DataFrame:
    own = _decisions(spark, folder).filter(F.col("dimension").isin(*D.DIMENSIONS))
    return vocabulary.new_categories(own, _known(spark, folder))


def coined_sidecar(spark: SparkSession, folder: str) -> DataFrame:
    """A coder's sidecar that has the suggestions' descriptions, brought up to date with the coder's decisions."""
    rows = sidecar_descriptions(spark, folder).withColumn("coder", F.lit("coder_00"))
    own = _decisions(spark, folder).filter(F.col("dimension").isin(*D.DIMENSIONS))
    return vocabulary.with_coined(rows, own, _known(spark, folder), "coder_00").select("dimension", "key", "coder")


def sidecar_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "suggestions").select("dimension", F.col("new_suggestion").alias("key"), F.col("explanation").alias("description"), "model", "suggestion_id", "logged_at")
    return vocabulary.sidecar_descriptions(rows, ["model", "suggestion_id", "logged_at"])


def rename_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Result files named after model and run, some of them renamed already."""
    runs = load(spark, folder, "suggestions").filter("model is not null").select("model", "run").distinct()
    names = runs.select(F.concat_ws("_", F.lit("annotations"), "model", F.lit("run"), F.col("run"), F.lit("checkpoint.csv")).alias("name"))
    done = runs.filter("run = 1").select(F.concat_ws("_", F.lit("annotations"), labels.model_family(F.col("model")), F.lit("run"), F.col("run"), F.lit("checkpoint.csv")).alias("name"))
    return vocabulary.rename_plan(names.unionByName(done).distinct(), load(spark, folder, "suggestions").filter("model is not null"))


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    """One nested JSON answer for each paper, of the largest model category and certainty of each dimension."""
    rows = load(spark, folder, "codings").filter("id is not null").groupBy("id").agg(
        *[F.max(F.when(F.col("dimension") == d, F.col("model_category"))).alias(d) for d in D.DIMENSIONS],
        *[F.max(F.when(F.col("dimension") == d, F.col("model_certainty"))).alias(f"{d}_certainty") for d in D.DIMENSIONS],
    )
    single = lambda d: F.struct(F.col(d).alias("category"), F.col(f"{d}_certainty").alias("certainty"), F.lit("").alias("new_suggestion"), F.concat(F.lit("why "), "id").alias("explanation"))
    several = lambda d: F.struct(F.split(d, ";").alias("categories"), F.col(f"{d}_certainty").alias("certainty"), F.concat(F.lit(" more "), d).alias("new_suggestion"), F.concat(F.lit("why "), "id").alias("explanation"))
    typology = F.struct(*[(single(d) if d == "research_position" else several(d)).alias(d) for d in D.DIMENSIONS])
    answer = F.to_json(F.struct(F.lit(1).alias(D.GATE), F.lit("0.9").alias(f"{D.GATE}_certainty"), F.concat(F.lit('a "quoted" reason of '), "id").alias(f"{D.GATE}_explanation"), typology.alias("typology")))
    return rows.select("id", answer.alias("answer"))


def annotation_columns(spark: SparkSession, folder: str) -> DataFrame:
    """All 23 columns of nested answers; certainties as numbers."""
    flat = _answers(spark, folder).select("id", *annotate.flat_columns("answer"))
    return flat.withColumns({c: F.col(c).cast("double") for c in flat.columns if c.endswith("_certainty")})


def suggestion_log(spark: SparkSession, folder: str) -> DataFrame:
    flat = _answers(spark, folder).select("id", *annotate.flat_columns("answer"))
    return annotate.new_suggestions(flat).withColumn("certainty", F.col("certainty").cast("double"))


def fill_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """The questions that fill what accepted papers lack, asking for the missing dimensions only."""
    now = _decisions(spark, folder)
    todo = incremental.fill_worklist(now, D.gates(now), D.DIMENSIONS)
    titles = load(spark, folder, "papers").filter("id is not null").groupBy("id").agg(F.max("title").alias("title"), F.max("authors").alias("authors"))
    return annotate.targeted_prompt(load(spark, folder, "schema_categories"), ["title", "authors"])(todo.join(titles, "id", "left"))


def reannotation_worklist(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "codings").filter(F.col("dimension") == D.GATE).filter("id is not null")
    return annotate.reannotation(rows, labels.gate_value(F.col("final_category")), ["coded_at", "coding_id"], 50)[0]


def reannotation_kept(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "codings").filter(F.col("dimension") == D.GATE).filter("id is not null")
    return annotate.reannotation(rows, labels.gate_value(F.col("final_category")), ["coded_at", "coding_id"], 50)[1].groupBy("coder").agg(F.count("*").alias("rows"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        manifest_candidates, confirmed_sources, set_attrition, pretest_draw, refill_targets, candidate_stream, set_sizes, validated_papers, scheme_guidance,
        new_category_decisions, coined_sidecar, sidecar_descriptions, rename_plan, annotation_columns, suggestion_log, fill_prompts, reannotation_worklist, reannotation_kept,
    )
}

_T = S.strip
_ACCEPTED = f"with {S.DECISIONS}, accepted as (select distinct id from gates where gate = 1)"
_DIMS = ", ".join(f"'{d}'" for d in D.DIMENSIONS)
_SIDECAR = f"""select {_T("dimension")} as dimension, {_T("new_suggestion")} as key,
  coalesce(arg_min({_T("coalesce(explanation, '')")}, (model, suggestion_id, logged_at)) filter ({_T("coalesce(explanation, '')")} <> ''), '') as description
  from suggestions where {_T("coalesce(dimension, '')")} <> '' and {_T("coalesce(new_suggestion, '')")} <> '' group by 1, 2"""
_COINED = f"""known as (select distinct dimension, category_key as key from schema_categories where section = 'active'),
tokens as (select coder, id, dimension, unnest({S.coder_set("value")}) as key from dec where dimension in ({_DIMS}))"""
_FAMILY = "regexp_extract(split_part(lower(trim(model)), '-', 1), '^[a-z]+')"
_FLAT = f"flat as (select id, {', '.join(f'''max(case when dimension = '{d}' then model_category end) as {d}, max(case when dimension = '{d}' then model_certainty end) as {d}_certainty''' for d in D.DIMENSIONS)} from codings where id is not null group by id)"
_GATE_ROWS = f"g as (select * from codings where dimension = '{D.GATE}' and id is not null), w as (select id from g where {S.gate_value('final_category')} = 1 group by id order by min((coded_at, coding_id)), id limit 50)"

SQL: dict[str, str] = {
    "manifest_candidates": f"select set_name, id, volume, rel_path, coalesce(nullif({_T('dst')}, ''), src) as pdf, pages from working_sets where id is not null",
    "confirmed_sources": _ACCEPTED + """,
      own as (select id, min((set_name, rel_path)) as o from working_sets where set_name like 'gold%' and id is not null group by id),
      sib as (select rel_path, min(set_name) as sibling from working_sets where set_name not like 'gold%' and left(set_name, 1) <> '_' and rel_path is not null group by rel_path),
      placed as (select a.id, own.o[1] as own, coalesce(own.o[2], a.id || '.pdf') as rel_path from accepted a left join own using (id))
      select id, rel_path, coalesce(own, sibling) as source, coalesce(own, sibling) is not null as staged from placed left join sib using (rel_path)""",
    "set_attrition": f"""with {S.DECISIONS}, r as (select id from gates group by id having max(gate) = 0)
      select id, id in (select id from working_sets where set_name like 'gold%' and id is not null) as in_set from r""",
    "pretest_draw": f"""
      with own as (select id, max(volume) as volume, max(score) as score, max(pages) as pages from working_sets where set_name like 'final%' and id is not null and volume is not null group by id),
      sizes as (select volume, count(*) as size from own group by volume), t as (select coalesce(sum(size), 0)::bigint as total from sizes), n as (select least(40, total) as n from t),
      base as (select volume, size, (n * size) // total as base, (n * size) % total as rem, n from sizes, t, n),
      alloc as (select volume, base + (row_number() over (order by rem desc, size desc, volume) <= n - sum(base) over () and rem > 0)::int as alloc from base),
      ranked as (select own.*, row_number() over (partition by volume order by md5('{SEED}:' || volume || ':' || id), id) as r from own)
      select id, volume, score, pages from ranked join alloc using (volume) where r <= alloc""",
    "refill_targets": """with s as (select set_name, count(distinct dst) as have from working_sets where set_name is not null group by set_name), n as (select set_name, max(sample_size) as need from sample_targets group by set_name)
      select set_name, (case when have < 4 * need then greatest(100, 4 * need) end)::bigint as target from s join n using (set_name)""",
    "candidate_stream": f"""
      with a as (select distinct id, 0 as phase from working_sets where set_name like 'gold%' and id is not null),
      b as (select distinct id, 1 as phase from working_sets where set_name like 'pool%' and id is not null and id not in (select id from a)),
      c as (select * from a union all select * from b)
      select id, phase, row_number() over (order by phase, md5('{SEED}:' || id), id) as position from c where id not in (select id from papers where id is not null)""",
    "set_sizes": _ACCEPTED + """,
      t as (select set_name, max(sample_size) as target from sample_targets group by set_name),
      c as (select set_name, count(distinct dst) as on_disk, count(*) as manifest, count(distinct w.id) filter (w.id in (select id from accepted)) as confirmed from working_sets w where set_name is not null group by set_name)
      select set_name, on_disk, manifest, confirmed, target, case when target is null then '' when on_disk >= target then 'OK' else 'SHORT by ' || (target - on_disk) end as status from c left join t using (set_name)""",
    "validated_papers": "with p as (select paper_no, " + ", ".join(f"{_T(f'coalesce({c}, {chr(39) * 2})')} as {c}" for c in ("title", "authors", "abstract")) + """ from papers)
      select paper_no, title, concat_ws(';', case when title = '' then 'title' end, case when authors = '' then 'authors' end, case when abstract = '' then 'abstract' end) as missing from p""",
    "scheme_guidance": """select dimension, case when section = 'active' then 'whitelist' else 'blacklist' end as list, trim(category_key) as key,
      case when section = 'active' then trim(coalesce(description, '')) when trim(coalesce(move_to, '')) = '' then trim(coalesce(reason, ''))
           when trim(coalesce(reason, '')) = '' then 'stattdessen `' || trim(move_to) || '` verwenden' else trim(reason) || ' (stattdessen `' || trim(move_to) || '` verwenden)' end as explanation,
      section <> 'active' or trim(coalesce(description, '')) <> '' as described from schema_categories where section in ('active', 'rejected') and trim(coalesce(category_key, '')) <> ''""",
    "new_category_decisions": f"with {S.DECISIONS}, {_COINED}, fresh as (select distinct coder, id, dimension from tokens t where key <> '{labels.SENTINEL}' and not exists (select 1 from known k where k.dimension = t.dimension and k.key = t.key)) "
    f"select d.coder, d.id, d.dimension, f.id is not null as is_new from dec d left join fresh f on f.coder = d.coder and f.id = d.id and f.dimension = d.dimension where d.dimension in ({_DIMS})",
    "coined_sidecar": f"""with {S.DECISIONS}, {_COINED}, side as ({_SIDECAR}), joint as (
      select dimension, key from side union select dimension, key from tokens t where coder = 'coder_00' and key <> '{labels.SENTINEL}' and not exists (select 1 from known k where k.dimension = t.dimension and k.key = t.key))
      select dimension, key, 'coder_00' as coder from joint""",
    "sidecar_descriptions": _SIDECAR,
    "rename_plan": f"""
      with runs as (select distinct model, run, {_FAMILY} as family from suggestions where model is not null),
      names as (select 'annotations_' || model || '_run_' || run || '_checkpoint.csv' as name from runs union select 'annotations_' || family || '_run_' || run || '_checkpoint.csv' from runs where run = 1),
      moves as (select 'annotations_' || model || '_run_' || run || '_checkpoint.csv' as name, 'annotations_' || family || '_run_' || run || '_checkpoint.csv' as renamed from runs where model <> family)
      select name, renamed, count(*) over (partition by renamed) > 1 or renamed in (select name from names) as clash from moves""",
    "annotation_columns": f"with {_FLAT} select id, '1' as {D.GATE}, 0.9::double as {D.GATE}_certainty, 'a \"quoted\" reason of ' || id as {D.GATE}_explanation, "
    + ", ".join(f"{d}, {d}_certainty, {chr(39) * 2 if d == 'research_position' else chr(39) + ' more ' + chr(39) + ' || ' + d} as {d}_new_suggestion, 'why ' || id as {d}_explanation" for d in D.DIMENSIONS) + " from flat",
    "suggestion_log": f"with {_FLAT} " + " union all ".join(f"select id, '{d}' as dimension, 'more ' || trim({d}) as new_suggestion, {d}_certainty as certainty, 'why ' || id as explanation from flat where {d} is not null" for d in D.DIMENSIONS if d != "research_position"),
    "fill_prompts": f"""
      with {S.DECISIONS}, have as (select id, list(distinct dimension) filter (not {S.blank("value")}) as have from dec group by id), v as (select id, max(gate) as gate from gates group by id),
      todo as (select id, list_filter([{_DIMS}], lambda x: not coalesce(list_contains(have, x), false)) as todo from have join v using (id) where gate <> 0),
      lines as (select dimension, multi, '- ' || category_key || coalesce(': ' || description, '') as line from schema_categories where section = 'active' and category_key is not null and not coalesce(deprecated, false)),
      blocks as (select dimension, '## ' || dimension || chr(10) || string_agg(line, chr(10) order by line) as keys,
        '"' || dimension || '": ' || max(case when multi then '{{"categories": [], ' else '{{"category": "", ' end) || '"certainty": 0.0, "new_suggestion": "", "explanation": ""}}' as shape from lines group by dimension),
      asked as (select id, todo, unnest(todo) as dimension, generate_subscripts(todo, 1) as pos from todo where len(todo) > 0),
      parts as (select id, any_value(todo) as todo, string_agg(keys, chr(10) order by pos) as keys, string_agg(shape, ', ' order by pos) as shapes from asked join blocks using (dimension) group by id),
      titles as (select id, max(title) as title, max(authors) as authors from papers where id is not null group by id)
      select id, 'title: ' || coalesce(title, '') || chr(10) || 'authors: ' || coalesce(authors, '') || chr(10) || 'Annotate only these dimensions: ' || array_to_string(todo, ', ') || chr(10) || keys || chr(10)
        || 'Answer with this JSON only: {{"typology": {{' || shapes || '}}}}' as prompt from parts left join titles using (id)""",
    "reannotation_worklist": f"with {_GATE_ROWS} select id from w",
    "reannotation_kept": f"with {_GATE_ROWS} select coder, count(*) as rows from g where id not in (select id from w) group by coder",
}
