"""Queries on scoring, sampling and working sets, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import estimator, incremental, narrowing, sampling, workset
from tessera.operators.ordering import hash_key
from tessera.plans.sql import ITEMS
from tessera.sources.tables import load

SIZES = {"narrow": 50, "gold": 100, "final": 150, "pool": 200}
SEED = 42


def items(spark: SparkSession, folder: str) -> DataFrame:
    """The cached papers, one row for each id."""
    cache = load(spark, folder, "score_cache").filter("id is not null")
    return cache.groupBy("id").agg(F.max("score").alias("score"), F.max("pages").alias("pages")).select("id", F.split("id", "/")[0].alias("volume"), "score", "pages")


def estimator_score(spark: SparkSession, folder: str) -> DataFrame:
    return estimator.with_estimate(load(spark, folder, "documents")).select("doc_id", "score")


def estimator_signals(spark: SparkSession, folder: str) -> DataFrame:
    scored = estimator.with_estimate(load(spark, folder, "documents"))
    shown = F.transform(F.map_entries("signals"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return scored.select("doc_id", F.array_join(shown, ";").alias("signals")).filter("signals <> ''")


def estimator_hits(spark: SparkSession, folder: str) -> DataFrame:
    scored = estimator.with_estimate(load(spark, folder, "documents"))
    return scored.select("doc_id", F.explode("hits").alias("signal", "found")).select("doc_id", "signal", F.posexplode("found").alias("place", "hit"))


def non_paper_reasons(spark: SparkSession, folder: str) -> DataFrame:
    papers = load(spark, folder, "papers")
    reason = workset.non_paper_reason(F.col("pages"), F.col("filename"), F.col("text"))
    return papers.select("paper_no", reason.alias("reason")).filter("reason is not null")


def short_fraction(spark: SparkSession, folder: str) -> DataFrame:
    sets = load(spark, folder, "working_sets").filter("set_name is not null and id is not null").groupBy("set_name", "id").agg(F.max("pages").alias("pages"))
    return sets.groupBy("set_name").agg(F.count("*").alias("papers"), F.round(F.avg(workset.is_short(F.col("pages")).cast("double")), 6).alias("short_share"))


def largest_remainder_alloc(spark: SparkSession, folder: str) -> DataFrame:
    sizes = items(spark, folder).filter("score >= 2").groupBy("volume").agg(F.count("*").alias("size"))
    return sampling.allocate(sizes, 100)


def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.stratified_sample(items(spark, folder).filter("score >= 2").select("volume", "id"), 100, SEED)


def folder_weighted_order(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.folder_weighted_order(items(spark, folder).select("id", "volume"), SEED)


def gate_stratified_limit(spark: SparkSession, folder: str) -> DataFrame:
    gated = items(spark, folder).filter("score is not null").select("id", (F.col("score") >= 4).cast("int").alias("gate"))
    return sampling.gate_limit(gated, 120)


def short_cap_order(spark: SparkSession, folder: str) -> DataFrame:
    keyed = items(spark, folder).withColumn("k", hash_key(SEED, "id"))
    return workset.capped_order(keyed, "k", ["id"], workset.is_short(F.col("pages"))).select("id", "pages", F.col("position").cast("long").alias("position"))


def pool_cap_drop(spark: SparkSession, folder: str) -> DataFrame:
    keyed = items(spark, folder).withColumn("k", hash_key(SEED, "id"))
    return workset.capped_keep(keyed, "k", ["id"], workset.is_short(F.col("pages"))).select("id", "pages")


def eligible(spark: SparkSession, folder: str) -> DataFrame:
    found = items(spark, folder).filter("score >= 2 and coalesce(pages, 1) <= 60")
    return found.withColumn("k", hash_key(SEED, "id"))


def working_sets_fill(spark: SparkSession, folder: str) -> DataFrame:
    filled = workset.fill_sets(eligible(spark, folder), "k", ["id"], SIZES, "pool", workset.is_short(F.col("pages")))
    return filled.select("set_name", "id", "pages")


def set_size_report(spark: SparkSession, folder: str) -> DataFrame:
    targets = spark.createDataFrame(list(SIZES.items()), "set_name string, target int")
    return workset.set_report(working_sets_fill(spark, folder), targets)


def include_exclude(spark: SparkSession, folder: str) -> DataFrame:
    sets = load(spark, folder, "working_sets")
    wanted, barred = sets.filter("set_name like 'gold%'"), sets.filter("set_name like 'final%'")
    return incremental.included(items(spark, folder).select("id", "volume"), wanted, barred)


def volume_counts(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder).groupBy("volume").agg(F.count("*").alias("papers"))


def manifest_reconstruct(spark: SparkSession, folder: str) -> DataFrame:
    return incremental.reconstruct_manifest(load(spark, folder, "working_sets"), load(spark, folder, "score_cache"))


def candidates_with_fallback(spark: SparkSession, folder: str) -> DataFrame:
    cached = items(spark, folder).select("id", "volume", "pages")
    papers = load(spark, folder, "papers").filter("id is not null").groupBy("id").agg(F.max("pages").alias("pages"), F.max("source_folder").alias("volume"))
    return incremental.with_fallback(papers, cached, "id", ["volume", "pages"])


def ragged_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Cache lines of both forms, quoted cells and broken lines among them, read back; ids get a comma and a quote."""
    cache = load(spark, folder, "score_cache").filter("id is not null")
    cells = [F.concat("id", F.lit(', "b"')).alias("id"), "volume", "rel_path", "src", "score"]
    style = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    new = F.to_csv(F.struct(*cells, F.concat("pages", F.lit(".0")).alias("pages"), "signals"), style)
    old = F.to_csv(F.struct(*cells, "signals"), style)
    wide = F.concat(old, F.lit(",1,2,3"))
    number = F.length("id")
    lines = cache.select(F.explode(F.array(F.when(number % 2 == 0, new).otherwise(old), F.when(number % 3 == 0, wide).otherwise(F.lit("id,volume,rel_path,src,score,signals")))).alias("value"))
    return incremental.read_ragged(lines)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        estimator_score, estimator_signals, estimator_hits, non_paper_reasons, short_fraction, largest_remainder_alloc, stratified_sample, folder_weighted_order,
        gate_stratified_limit, short_cap_order, pool_cap_drop, working_sets_fill, set_size_report, include_exclude, volume_counts, manifest_reconstruct,
        candidates_with_fallback, ragged_cache,
    )
}


def _hits(name: str) -> str:
    group = next(g for g in estimator.GROUPS if g.name == name)
    pattern = group.alternation.replace("'", "''")
    return f"list_sort(list_distinct([lower(x) for x in regexp_extract_all(text, '{pattern}', 0, 'i')]))[1:{group.cap}]"


#: The word boundary of the SQL engine knows ASCII letters only, so marked letters are spelled out first.
_PLAIN = "text"
for _marked, _spelled in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"), ("ß", "ss")):
    _PLAIN = f"replace({_PLAIN}, '{_marked}', '{_spelled}')"
_HITS = f"spelled as (select doc_id, {_PLAIN} as text from documents), hits as (select doc_id, " + ", ".join(f"{_hits(g.name)} as {g.name}" for g in estimator.GROUPS) + " from spelled)"
_SCORE = " + ".join(f"{g.weight} * len({g.name})" for g in estimator.GROUPS)
_SIGNALS = ", ".join(f"case when len({g.name}) > 0 then '{g.name}:' || len({g.name}) end" for g in estimator.GROUPS)
_SHORT = "coalesce(pages < 6, false)"
_KEPT = """
counted as (select *, sum(s::int) over w as a, sum((not s)::int) over w as l from {source} window w as (order by k, id rows unbounded preceding)),
excess as (select *, case when s then a - l // 4 else 0 end as d from counted),
peaks as (select *, greatest(0, max(d) over (order by k, id rows unbounded preceding)) as now,
          greatest(0, max(d) over (order by k, id rows between unbounded preceding and 1 preceding)) as prior from excess),
kept as (select * from peaks where not s or now = coalesce(prior, 0))
"""
_FILL = f"""
with {ITEMS},
eligible as (select id, volume, pages, {_SHORT} as s, md5('{SEED}:' || id) as k from items where score >= 2 and coalesce(pages, 1) <= 60),
ranked as (select *, row_number() over (order by k, id) as n from eligible),
rest as (select * from ranked where n > 300),
{_KEPT.format(source="rest")},
pooled as (select id, pages, row_number() over (order by k, id) as m from kept),
filled as (select case when n <= 50 then 'narrow' when n <= 150 then 'gold' else 'final' end as set_name, id, pages from ranked where n <= 300
           union all select 'pool', id, pages from pooled where m <= 200)
"""

SQL: dict[str, str] = {
    "estimator_score": f"with {_HITS} select doc_id, round({_SCORE}, 3)::double as score from hits",
    "estimator_signals": f"with {_HITS} select doc_id, concat_ws(';', {_SIGNALS}) as signals from hits where concat_ws(';', {_SIGNALS}) <> ''",
    "estimator_hits": f"with {_HITS} " + " union all ".join(f"select doc_id, '{g.name}' as signal, unnest(generate_series(0, len({g.name}) - 1))::int as place, unnest({g.name}) as hit from hits" for g in estimator.GROUPS),
    "non_paper_reasons": f"""
      select paper_no, reason from (select paper_no, case
        when pages > 60 then 'too_many_pages'
        when regexp_matches(filename, '{"|".join(workset.VOLUME_NAMES)}', 'i') then 'volume_name'
        when regexp_matches(substr(coalesce(text, ''), 1, 4000), '{workset.SERIES}', 'i') and regexp_matches(substr(coalesce(text, ''), 1, 4000), '{workset.EDITORS}', 'i') then 'front_matter'
        when len(list_distinct([regexp_replace(x, '[.,;]+$', '') for x in regexp_extract_all(coalesce(text, ''), '{workset.STAMP}', 1, 'i')])) >= 2 then 'several_contributions' end as reason
        from papers) where reason is not null""",
    "short_fraction": f"""
      with s as (select set_name, id, max(pages) as pages from working_sets where set_name is not null and id is not null group by all)
      select set_name, count(*) as papers, round(avg(({_SHORT})::int::double), 6) as short_share from s group by set_name""",
    "largest_remainder_alloc": f"""
      with {ITEMS}, sizes as (select volume, count(*) as size from items where score >= 2 group by volume),
      t as (select sum(size)::bigint as total from sizes), n as (select least(100, total) as n from t),
      base as (select volume, size, (n * size) // total as base, (n * size) % total as rem, n from sizes, t, n),
      ranked as (select *, row_number() over (order by rem desc, size desc, volume) as r, n - sum(base) over () as left_over from base)
      select volume, size, (base + (r <= left_over and rem > 0)::int)::bigint as alloc from ranked""",
    "stratified_sample": f"""
      with {ITEMS}, own as (select volume, id from items where score >= 2), sizes as (select volume, count(*) as size from own group by volume),
      t as (select sum(size)::bigint as total from sizes), n as (select least(100, total) as n from t),
      base as (select volume, size, (n * size) // total as base, (n * size) % total as rem, n from sizes, t, n),
      alloc as (select volume, base + (row_number() over (order by rem desc, size desc, volume) <= n - sum(base) over () and rem > 0)::int as alloc from base),
      ranked as (select volume, id, row_number() over (partition by volume order by md5('{SEED}:' || volume || ':' || id), id) as r from own)
      select volume, id from ranked join alloc using (volume) where r <= alloc""",
    "folder_weighted_order": f"with {ITEMS} select id, volume, row_number() over (order by md5('{SEED}:' || id), id) as position from items",
    "gate_stratified_limit": f"""
      with {ITEMS}, g as (select id, (score >= 4)::int as gate from items where score is not null),
      q as (select gate, greatest(1, round_even(120 * count(*) / (select count(*) from g), 0))::int as quota from g group by gate),
      r as (select id, gate, row_number() over (partition by gate order by md5('20260805:' || id), id) as r from g)
      select id, gate from r join q using (gate) where r <= quota order by id limit 120""",
    "short_cap_order": f"""
      with {ITEMS}, o as (select id, pages, {_SHORT} as s, md5('{SEED}:' || id) as k from items),
      c as (select *, sum(s::int) over w as kk, sum((not s)::int) over w as i from o window w as (order by k, id rows unbounded preceding)),
      keyed as (select *, case when s then (kk * 5 + 0) // 1 - kk else i end as place, s::int as flag, case when s then kk else i end as tie from c)
      select id, pages, row_number() over (order by place, flag, tie) as position from keyed""",
    "pool_cap_drop": f"with {ITEMS}, o as (select id, pages, {_SHORT} as s, md5('{SEED}:' || id) as k from items), {_KEPT.format(source='o')} select id, pages from kept",
    "working_sets_fill": _FILL + "select set_name, id, pages from filled",
    "set_size_report": _FILL + """, targets(set_name, target) as (values ('narrow', 50), ('gold', 100), ('final', 150), ('pool', 200))
      select t.set_name, count(f.id) as rows, t.target::int as target, case when t.target > count(f.id) then 'SHORT by ' || (t.target - count(f.id)) else 'ok' end as status
      from targets t left join filled f using (set_name) group by t.set_name, t.target""",
    "include_exclude": f"""with {ITEMS} select id, volume from items where id in (select id from working_sets where set_name like 'gold%')
      and id not in (select id from working_sets where set_name like 'final%' and id is not null)""",
    "volume_counts": f"with {ITEMS} select volume, count(*) as papers from items group by volume",
    "manifest_reconstruct": """
      with best as (select id, score, pages from score_cache where score is not null and id is not null
                    qualify row_number() over (partition by id order by score desc, pages desc nulls last) = 1)
      select s.set_name, s.id, b.score, b.pages from (select distinct set_name, id from working_sets) s left join best b using (id)""",
    "candidates_with_fallback": f"""
      with {ITEMS}, p as (select id, max(pages) as pages, max(source_folder) as volume from papers where id is not null group by id)
      select coalesce(p.id, i.id) as id, coalesce(p.volume, i.volume) as volume, coalesce(p.pages, i.pages) as pages from p full join items i on p.id = i.id""",
    "ragged_cache": """select id || ', "b"' as id, volume, rel_path, src, score, case when length(id) % 2 = 0 then pages end as pages, signals from score_cache where id is not null and score is not null""",
}
