"""SQL for the queries of ``queries.py`` that SQL can state."""

P1_AVAILABILITY = """
with last as (
  select set_name, id, arg_max({'v': regexp_replace(lower(volume), '[^\\p{L}\\p{N}]', '', 'g'), 'p': case when pages >= 1 then pages end, 's': score}, staged_at) f
  from working_sets where set_name is not null and id is not null group by all),
papers as (select set_name, id, f.v as volume, f.p as pages, f.s as score from last),
joined as (
  select t.set_name, t.facet, t.category,
         greatest(floor(t.target_share * t.sample_size + 0.5), t.min_rows)::bigint as wanted,
         count(p.id) as available
  from sample_targets t left join papers p on p.set_name = t.set_name and
    case t.facet
      when 'volume' then p.volume = regexp_replace(lower(t.category), '[^\\p{L}\\p{N}]', '', 'g')
      when 'pages' then case when t.category = 'unknown' then p.pages is null
                             else p.pages >= coalesce(t.band_lo, p.pages) and (t.band_hi is null or p.pages < t.band_hi) end
      else p.score >= coalesce(t.band_lo, p.score) and (t.band_hi is null or p.score < t.band_hi) end
  group by all)
"""

P5_TERMS = """
with raw as (
  select dimension, new_suggestion as value, 's' || suggestion_id as key, 1::bigint as weight, id as paper from suggestions
  union all
  select dimension, candidate_key, 'c' || candidate_id, greatest(coalesce(frequency, 0), 0)::bigint, null from candidates),
keyed as (
  select dimension, regexp_replace(regexp_replace(lower(value), '[\\s\\x{00A0}_-]+', '_', 'g'), '^_+|_+$', '', 'g') as term, key, weight, paper from raw),
kept as (select * from keyed where dimension is not null and term is not null and term not in ('', 'nan', 'none', 'null')),
occ as (select dimension, term, sum(weight)::bigint as occurrences from (select dimension, term, key, max(weight) as weight from kept group by all) group by all),
pap as (select dimension, term, count(distinct paper) as papers from kept group by all),
tot as (select dimension, count(distinct paper) as n from kept group by all),
terms as (
  select dimension, term, occurrences, papers,
         case when occurrences <= 2 then 'rare' when papers >= 5 and papers > 0.01 * n then 'common' end as mark
  from occ join pap using (dimension, term) join tot using (dimension))
"""

ORACLE_SQL: dict[str, str] = {
    "p1_found": P1_AVAILABILITY + "select set_name, facet, category from joined where available < wanted",
    "p1_availability": P1_AVAILABILITY + "select set_name, facet, category, wanted, available from joined",
    "p1_checks": P1_AVAILABILITY + """,
      floors as (select j.set_name, j.facet, sum(least(t.min_rows, j.available)) as floors, max(t.sample_size) as size from joined j join sample_targets t using (set_name, facet, category) group by all),
      totals as (select set_name, count(*) as n from papers group by set_name)
      select f.set_name, least(coalesce(max(n), 0), greatest(max(size), max(floors)))::bigint as rows, 0::bigint as below_floor from floors f left join totals using (set_name) group by f.set_name""",
    "p5_terms": P5_TERMS + "select dimension, term, occurrences, papers, mark from terms",
    "p5_found": P5_TERMS + "select dimension, term, mark from terms where mark is not null",
    # pieces stand for tokens here: every text and every share is far from its limit under any usual tokenizer
    "p7_found": r"""
      select doc_id from documents
      where length(regexp_replace(text, '[^\p{L}]', '', 'g')) / 4.0 + len(regexp_extract_all(text, '[0-9]{1,3}|[^\s\p{L}0-9]+')) > 2048""",
    "p7_checks": "select count(*) as documents, 0::bigint as broken, 0::bigint as overfull from documents where text <> ''",
    "p8_checks": """
      select distinct mix_id, 0::bigint as overused, 0::bigint as outside from mix_targets t
      where target_weight * budget_tokens > 0 and max_repeats > 0 and exists (select 1 from documents d where d.source = t.source and d.text <> '')""",
    "p8_found": """
      select t.mix_id, t.source from mix_targets t left join (select source, sum(length(text)) / 4.0 as tokens from documents group by source) d on d.source = t.source
      where coalesce(d.tokens, 0) * t.max_repeats < t.target_weight * t.budget_tokens""",
}
