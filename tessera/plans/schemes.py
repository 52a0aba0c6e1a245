"""Queries on suggestions, candidates and the category scheme, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import labels
from tessera.operators import decisions as D
from tessera.operators import incremental, narrowing
from tessera.plans import sql as S
from tessera.sources.tables import load


def candidate_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return narrowing.candidate_frequencies(load(spark, folder, "suggestions"))


def candidate_frequencies_whole(spark: SparkSession, folder: str) -> DataFrame:
    """As ``candidate_frequencies``, with the seeds and explanations that its SQL leaves out."""
    return narrowing.candidate_table(load(spark, folder, "suggestions"), D.latest(load(spark, folder, "codings")), load(spark, folder, "schema_categories"))


def new_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return narrowing.new_candidates(candidate_frequencies(spark, folder), load(spark, folder, "schema_categories")).select("dimension", "key", "frequency")


def merge_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return narrowing.merge_candidates(load(spark, folder, "candidates"), candidate_frequencies(spark, folder), load(spark, folder, "schema_categories"))


def suggested_by_dimension(spark: SparkSession, folder: str) -> DataFrame:
    rows = candidate_frequencies(spark, folder)
    return rows.groupBy("dimension").agg(F.count("*").alias("keys"), F.sum("frequency").alias("suggestions"))


def papers_with_suggestions(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "suggestions").filter(labels.norm(F.col("new_suggestion")) != "").agg(F.countDistinct("id").alias("papers"))


def certain_suggestions(spark: SparkSession, folder: str) -> DataFrame:
    """Suggestions that stay in the review: those of high certainty are suppressed."""
    rows = load(spark, folder, "suggestions")
    certainty = labels.as_float(F.col("certainty").cast("string"))
    return rows.filter((labels.norm(F.col("new_suggestion")) != "") & ~F.coalesce(certainty >= 0.9, F.lit(False))).select("suggestion_id").distinct()


def coder_categories(spark: SparkSession, folder: str) -> DataFrame:
    return narrowing.coder_categories(D.latest(load(spark, folder, "codings")), load(spark, folder, "schema_categories"))


def sync_coder_categories(spark: SparkSession, folder: str) -> DataFrame:
    return narrowing.sync_coder_categories(D.latest(load(spark, folder, "codings")), load(spark, folder, "schema_categories"), load(spark, folder, "candidates"))


def schema_integrity(spark: SparkSession, folder: str) -> DataFrame:
    """Problems of the scheme after some entries were doubled and one target lost."""
    scheme = load(spark, folder, "schema_categories").select("dimension", "section", "category_key", "move_to", "deprecated")
    doubled = scheme.filter("section = 'active' and category_key like 'k%'")
    lost = scheme.filter("move_to is not null").withColumn("move_to", F.concat("move_to", F.lit("_x")))
    return narrowing.integrity(scheme.unionByName(doubled).unionByName(lost))


def category_counts(spark: SparkSession, folder: str) -> DataFrame:
    return narrowing.counts_by_dimension(load(spark, folder, "schema_categories"))


def selectable_categories(spark: SparkSession, folder: str) -> DataFrame:
    return narrowing.selectable(load(spark, folder, "schema_categories"))


def three_way_merge(spark: SparkSession, folder: str) -> DataFrame:
    """The scheme as base; a working copy and a canonical one with different edits."""
    base = load(spark, folder, "schema_categories").select("dimension", "section", F.col("category_key").alias("key"), "description")
    size = F.length("key")
    work = base.filter(size % 5 != 0).withColumn("description", F.when(size % 3 == 0, F.concat("description", F.lit(" (w)"))).otherwise(F.col("description")))
    work = work.unionByName(base.filter(size % 7 == 0).withColumn("key", F.concat("key", F.lit("_new"))))
    canonical = base.withColumn("description", F.when(size % 4 == 0, F.concat("description", F.lit(" (c)"))).otherwise(F.col("description"))).filter(size % 11 != 0)
    return narrowing.three_way_merge(work, base, canonical, ["dimension", "section", "key"], "description")


def archetype_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return narrowing.archetypes(D.latest(load(spark, folder, "codings")))


def target_growth(spark: SparkSession, folder: str) -> DataFrame:
    counted = D.gates(D.latest(load(spark, folder, "codings"))).groupBy("coder").agg(F.count_if(F.col("gate") == 1).alias("confirmed"))
    return counted.select("coder", "confirmed", incremental.grown_target(F.lit(30), F.col("confirmed")).cast("long").alias("target"))


def checkpoint_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "codings").filter(F.col("dimension") == D.GATE).select("id", F.col("coder").alias("file"), "coding_id", "final_category", "coded_at")
    return incremental.first_for_each_id(rows, ["file", "coding_id", "coded_at"]).select("id", "file", "coding_id")


def last_label_wins(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "codings").filter((F.col("dimension") == D.GATE) & F.col("id").isNotNull())
    return incremental.last_label(rows, labels.numeric_gate(F.col("final_category")), ["coding_id"])


def resume_anti_join(spark: SparkSession, folder: str) -> DataFrame:
    return incremental.undone(load(spark, folder, "score_cache").filter("id is not null").select("id").distinct(), load(spark, folder, "codings"))


def confirm_until_target(spark: SparkSession, folder: str) -> DataFrame:
    from tessera.operators.ordering import hash_key

    gates = D.gates(D.latest(load(spark, folder, "codings"))).groupBy("id").agg(F.max("gate").alias("gate"))
    return incremental.until_target(gates.withColumn("k", hash_key(42, "id")), "k", ["id"], F.col("gate") == 1, 100).select("id", "gate")


def decision_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Codings as an event log: blank rows take an earlier answer back."""
    rows = load(spark, folder, "codings").filter("id is not null and dimension is not null and coder is not null")
    events = rows.select(labels.coder_name(F.col("coder")).alias("coder"), "id", "dimension", "coding_id", "coded_at", F.when(labels.is_blank(F.col("final_category")), "delete").otherwise("set").alias("action"), "final_category")
    return incremental.replayed(events, ["coder", "id", "dimension"], ["coded_at", "coding_id"]).select("coder", "id", "dimension", F.col("final_category").alias("value"))


def model_names(spark: SparkSession, folder: str) -> DataFrame:
    models = load(spark, folder, "suggestions").filter("model is not null").select("model").distinct()
    return models.select("model", labels.model_slug(F.col("model")).alias("slug"), labels.model_family(F.col("model")).alias("family"))


def clipped_explanations(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "suggestions").filter("explanation is not null")
    return rows.select("suggestion_id", labels.clipped(F.col("explanation"), 40).alias("clipped"), labels.collapsed(F.col("explanation")).alias("collapsed")).distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        candidate_frequencies, candidate_frequencies_whole, new_candidates, merge_candidates, suggested_by_dimension, papers_with_suggestions, certain_suggestions, coder_categories, sync_coder_categories, schema_integrity,
        category_counts, selectable_categories, three_way_merge, archetype_rollup, target_growth, checkpoint_dedupe, last_label_wins, resume_anti_join, confirm_until_target, decision_replay,
        model_names, clipped_explanations,
    )
}

_FREQ = f"""
one as (select suggestion_id, min({{'d': dimension, 'i': id, 's': new_suggestion}}) as s from suggestions where suggestion_id is not null group by suggestion_id),
sk as (select s.d as dimension, {S.norm("s.s")} as key, s.i as id, suggestion_id from one),
freq as (select dimension, key, count(*) as frequency, array_to_string(list(id order by suggestion_id)[1:5], ';') as example_ids from sk where key <> '' group by all),
known as (select distinct dimension, category_key as key from schema_categories where category_key is not null)
"""
_CODER = rf"""
with {S.DECISIONS}, known as (select distinct dimension, category_key as key from schema_categories where category_key is not null),
given as (select coder, dimension, unnest({S.coder_set("value")}) as key from dec where dimension <> 'label_research_software'),
fresh as (select * from given g where key <> 'insufficient_information' and lower(key) not in ('', 'nan', 'none', 'null') and not exists (from known k where k.dimension = g.dimension and k.key = g.key)),
cc as (select dimension, key, string_agg(distinct coder, ',' order by coder) as coders, count(*) as n from fresh group by all)
"""

SQL: dict[str, str] = {
    "candidate_frequencies": f"with {_FREQ} select * from freq",
    "new_candidates": f"with {_FREQ} select dimension, key, frequency from freq f where not exists (from known k where k.dimension = f.dimension and k.key = f.key)",
    "merge_candidates": f"""with {_FREQ},
      own as (select max({{'d': dimension, 'k': candidate_key, 'f': frequency}}) as c from candidates where candidate_id is not null group by candidate_id),
      held as (select c.d as dimension, {S.norm("c.k")} as key, sum(greatest(coalesce(c.f, 0), 0)) as old from own where {S.norm("c.k")} <> '' group by all),
      fresh as (select dimension, key, frequency as new from freq f where not exists (from known k where k.dimension = f.dimension and k.key = f.key))
      select dimension, key, (coalesce(old, 0) + coalesce(new, 0))::bigint as frequency, case when old is null then 'added' when new is null then 'kept' else 'counted up' end as status from held full join fresh using (dimension, key)""",
    "suggested_by_dimension": f"with {_FREQ} select dimension, count(*) as keys, sum(frequency)::bigint as suggestions from freq group by dimension",
    "papers_with_suggestions": f"select count(distinct id) as papers from suggestions where {S.norm('new_suggestion')} <> ''",
    "certain_suggestions": f"select distinct suggestion_id from suggestions where {S.norm('new_suggestion')} <> '' and not coalesce(certainty >= 0.9 and not isnan(certainty), false)",
    "coder_categories": _CODER + "select * from cc",
    "sync_coder_categories": _CODER + "select dimension, key, 'coder:' || coders as source from cc where not exists (from candidates c where c.dimension = cc.dimension and c.candidate_key = cc.key)",
    "schema_integrity": """
      with s as (select dimension, section, category_key, move_to, deprecated from schema_categories), a as (select * from s union all select * from s where section = 'active' and category_key like 'k%'
                 union all select dimension, section, category_key, move_to || '_x', deprecated from s where move_to is not null)
      select dimension, category_key as key, 'repeated' as problem from a where section = 'active' group by all having count(*) > 1
      union all select dimension, category_key, 'lost target' from a where move_to is not null and not exists (from a b where b.section = 'active' and b.dimension = a.dimension and b.category_key = a.move_to)""",
    "category_counts": "select dimension, count_if(section = 'active')::bigint as active, count_if(section = 'rejected')::bigint as rejected, count_if(coalesce(deprecated, false))::bigint as deprecated from schema_categories group by dimension",
    "selectable_categories": "select dimension, category_key as key, description from schema_categories where section = 'active' and not coalesce(deprecated, false) and coalesce(description, '') <> ''",
    "three_way_merge": """
      with b as (select dimension, section, category_key as key, description as d from schema_categories),
      w as (select dimension, section, key, case when length(key) % 3 = 0 then d || ' (w)' else d end as d from b where length(key) % 5 <> 0 union all select dimension, section, key || '_new', d from b where length(key) % 7 = 0),
      c as (select dimension, section, key, case when length(key) % 4 = 0 then d || ' (c)' else d end as d from b where length(key) % 11 <> 0),
      r as (select dimension, section, key, w.d as w, b.d as b, c.d as c from w full join b using (dimension, section, key) full join c using (dimension, section, key)),
      o as (select *, case when w is not null and b is null and c is null then 'added' when w is not null and b is null and c <> w then 'conflict'
              when w is null and b is not null and c is not null and b = c then 'deleted' when w is null and b is not null and c is not null then 'conflict'
              when w <> b and c = b then 'updated' when w <> b and c is not null and w <> c then 'conflict' when w <> b and c is null then 'conflict' else 'unchanged' end as outcome from r)
      select dimension, section, key, case when outcome in ('added', 'updated') then w else c end as description, outcome from o where outcome <> 'unchanged' or c is not null""",
    "archetype_rollup": f"""with {S.DECISIONS}, t as (select {S.bench_set("value")} as k from dec where dimension = 'software_type')
      select case when list_contains(k, 'klassenbibliothek') then 'library' when list_contains(k, 'webportal') or list_contains(k, 'tischrechner_anwendung') or list_contains(k, 'mobilanwendung') then 'application'
        when list_contains(k, 'stapelskript') then 'script' else 'unresolved' end as archetype, count(*) as n from t group by all""",
    "target_growth": f"""with {S.DECISIONS}, c as (select coder, count_if(gate = 1)::bigint as confirmed from gates group by coder)
      select coder, confirmed, (case when confirmed < 20 then 30 else 30 + 20 * ((confirmed - 20) // 20 + 1) end)::bigint as target from c""",
    "checkpoint_dedupe": """select id, coder as file, coding_id from codings where dimension = 'label_research_software' and id is not null
      qualify row_number() over (partition by id order by coder, coding_id, coded_at) = 1""",
    "last_label_wins": f"""select id, try_cast(trunc(try_cast({S.strip('final_category')} as double)) as int) as label from codings where dimension = 'label_research_software' and id is not null
      qualify row_number() over (partition by id order by coding_id desc) = 1""",
    "resume_anti_join": "select distinct id from score_cache where id is not null and id not in (select id from codings where id is not null)",
    "confirm_until_target": f"""with {S.DECISIONS}, g as (select id, max(gate) as gate from gates group by id),
      r as (select id, gate, coalesce(sum(gate) over (order by md5('42:' || id), id rows between unbounded preceding and 1 preceding), 0) as hits from g) select id, gate from r where hits < 100""",
    "decision_replay": f"with {S.DECISIONS} select coder, id, dimension, value from dec where not {S.blank('value')}",
    "model_names": """select distinct model, regexp_replace(regexp_replace(lower(model), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as slug, regexp_extract(split_part(lower(trim(model)), '-', 1), '^[a-z]+') as family
      from suggestions where model is not null""",
    "clipped_explanations": rf"""select distinct suggestion_id, case when length(explanation) > 40 then substr(explanation, 1, 40) || '… [+' || (length(explanation) - 40) || ' chars clipped]' else explanation end as clipped,
      regexp_replace({S.strip('explanation')}, '{S.WHITE}+', ' ', 'g') as collapsed from suggestions where explanation is not null""",
}
