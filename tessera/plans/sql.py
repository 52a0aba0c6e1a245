"""Pieces of SQL that several equivalents share."""

from __future__ import annotations

WHITE = r"[\s\x{00A0}]"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def norm(c: str) -> str:
    plain = f"lower({strip(f'coalesce({c}, {chr(39) * 2})')})"
    return rf"(case when {plain} in ('', 'nan', 'none', 'null') then '' else regexp_replace({plain}, '[\s\x{{00A0}}-]+', '_', 'g') end)"


def blank(c: str) -> str:
    return f"({c} is null or lower({strip(c)}) in ('', 'nan', 'none'))"


def gate_value(c: str) -> str:
    return f"(case when lower({strip(c)}) in ('1', '1.0', 'true', 'yes', 'ja') then 1 when lower({strip(c)}) in ('0', '0.0', 'false', 'no', 'nein') then 0 end)"


def bench_set(c: str) -> str:
    return f"list_sort(list_distinct([{norm('x')} for x in regexp_split_to_array(coalesce({c}, ''), '[;,]') if {norm('x')} <> '']))"


def coder_set(c: str) -> str:
    return f"list_sort(list_distinct([{strip('x')} for x in string_split(coalesce({c}, ''), ';') if {strip('x')} <> '']))"


def joined(c: str) -> str:
    return f"coalesce(array_to_string({c}, ';'), '')"


#: Current decisions, gates and the coders with most decided papers.
DECISIONS = rf"""
named as (select regexp_replace(lower({strip('coder')}), '{WHITE}', '_', 'g') as coder, id, dimension, final_category as value, is_new, model_category, model_certainty, coded_at, coding_id
          from codings where coder is not null and id is not null and dimension is not null),
dec as (select coder, id, dimension, value, is_new, model_category, model_certainty from named
        qualify row_number() over (partition by coder, id, dimension order by coded_at desc, coding_id desc) = 1),
gates as (select coder, id, case when max(case when dimension = 'label_research_software' then 1 end) = 1
            then max(case when dimension = 'label_research_software' then
              case when {blank('value')} then 1 when try_cast({strip('value')} as double) is null then 1 when trunc(try_cast({strip('value')} as double)) = 1 then 1 else 0 end end)
            else 1 end as gate from dec group by coder, id),
seats as (select coder, row_number() over (order by n desc, coder) - 1 as seat from (select coder, count(distinct id) as n from dec where not contains(coder, '.') group by coder)
          qualify seat < 3)
"""

#: The cached papers, one row for each id.
ITEMS = "items as (select id, split_part(id, '/', 1) as volume, max(score) as score, max(pages) as pages from score_cache where id is not null group by id)"
