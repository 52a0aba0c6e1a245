"""Queries on decisions, votes, scores and agreement, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import labels
from tessera.operators import decisions as D
from tessera.operators import icr, incremental, scoring, votes
from tessera.plans import sql as S
from tessera.runtime import cut
from tessera.sources.tables import load

MULTI = "software_type"
PAIR = ("coder_00", "coder_01")


def current(spark: SparkSession, folder: str) -> DataFrame:
    return D.latest(load(spark, folder, "codings"))


def panel(spark: SparkSession, folder: str) -> DataFrame:
    now = current(spark, folder)
    return votes.panel_votes(now, D.most_decided(now, 3))


def positives_projection(spark: SparkSession, folder: str) -> DataFrame:
    now = current(spark, folder)
    accepted = D.gates(now).filter("gate = 1").select("coder", "id")
    return now.join(accepted, ["coder", "id"], "left_semi").filter(F.col("dimension") == D.GATE).select("coder", "id", labels.collapsed(F.col("value")).alias("value"))


def decision_states(spark: SparkSession, folder: str) -> DataFrame:
    return D.gates(current(spark, folder))


def reference_coder(spark: SparkSession, folder: str) -> DataFrame:
    return D.reference_coder(current(spark, folder))


def gate_tally(spark: SparkSession, folder: str) -> DataFrame:
    return D.tally(D.gates(current(spark, folder)))


def saved_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return D.saved(current(spark, folder)).select("coder", "id", "dimension", "value")


def incomplete_papers(spark: SparkSession, folder: str) -> DataFrame:
    return D.missing_dimensions(current(spark, folder))


def rejected_minus_confirmed(spark: SparkSession, folder: str) -> DataFrame:
    return D.rejected_only(D.gates(current(spark, folder)))


def confirmed_wide(spark: SparkSession, folder: str) -> DataFrame:
    return D.wide(current(spark, folder))


def fill_worklist(spark: SparkSession, folder: str) -> DataFrame:
    now = current(spark, folder)
    return incremental.fill_worklist(now, D.gates(now), D.DIMENSIONS)


def majority_gate(spark: SparkSession, folder: str) -> DataFrame:
    return votes.panel_gate(panel(spark, folder)).select("id", "cast", "gate", "gate_votes", "dissent")


def majority_single(spark: SparkSession, folder: str) -> DataFrame:
    return votes.panel_single(panel(spark, folder))


def majority_multi(spark: SparkSession, folder: str) -> DataFrame:
    return votes.panel_multi(panel(spark, folder), MULTI)


def majority_multi_whole(spark: SparkSession, folder: str) -> DataFrame:
    """As ``majority_multi``, whose SQL has one dimension, for all multi-valued ones."""
    return votes.panel_multis(panel(spark, folder))


def panel_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The panel's labels of every field, each with the seat and certainty of the sheet that stands for it."""
    return votes.panel_labels(cut(panel(spark, folder)))


def dissent_stats(spark: SparkSession, folder: str) -> DataFrame:
    gate = votes.panel_gate(panel(spark, folder)).select("id", F.col("dissent").alias("g"))
    multi = votes.panel_multi(panel(spark, folder), MULTI).select("id", F.col("dissent").alias("m"))
    both = gate.join(multi, "id", "left").fillna("", ["m"])
    return both.agg(F.count("*").alias("papers"), F.count_if((F.col("g") != "") | (F.col("m") != "")).alias("any_split"), F.count_if(F.col("g").contains(D.GATE)).alias("gate_split"))


def vote_dissent(spark: SparkSession, folder: str) -> DataFrame:
    now = current(spark, folder)
    seats = D.most_decided(now, 3)
    return votes.vote_dissent(cut(votes.panel_votes(now, seats)), seats)


def dissent_stats_whole(spark: SparkSession, folder: str) -> DataFrame:
    """As ``dissent_stats``, whose SQL sees the gate and one dimension, over all fields and abstentions."""
    split = F.col("dissent")
    return vote_dissent(spark, folder).agg(F.count("*").alias("papers"), F.count_if(split != "").alias("any_split"), F.count_if(split.contains(D.GATE)).alias("gate_split"))


def _scored(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(gold gates, gold rows, predictions): the reference coder against every other coder as a model."""
    now = current(spark, folder)
    best = D.reference_coder(now).select("coder")
    human = now.join(F.broadcast(best), "coder", "left_semi").drop("coder")
    gold = D.gates(now).join(F.broadcast(best), "coder", "left_semi").select("id", "gate")
    return gold, human, now.join(F.broadcast(best), "coder", "left_anti").withColumnRenamed("coder", "model")


def gate_macro_f1(spark: SparkSession, folder: str) -> DataFrame:
    gold, _, predicted = _scored(spark, folder)
    return scoring.gate_scores(scoring.gate_pairs(gold, predicted))


def dimension_micro_f1(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.dimension_scores(scoring.dimension_pairs(*_scored(spark, folder)))


def overall_score(spark: SparkSession, folder: str) -> DataFrame:
    gold, human, predicted = _scored(spark, folder)
    pairs = scoring.gate_pairs(gold, predicted)
    return scoring.overall_scores(scoring.gate_scores(pairs), scoring.dimension_scores(scoring.dimension_pairs(gold, human, predicted)), pairs)


def coverage_panel(spark: SparkSession, folder: str) -> DataFrame:
    """The ranking with a coverage floor that fits coders, who see only some of the papers."""
    return scoring.rank_models(overall_score(spark, folder), floor=0.02)


def panel_choice(spark: SparkSession, folder: str) -> DataFrame:
    """The panel with a pinned model and a coverage floor that fits coders."""
    return scoring.panel_choice(overall_score(spark, folder), floor=0.02, pin="coder_05")


def merged_vote(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each paper: gate, the label of every dimension with the seat and certainty of its prose, and where the panel was split."""
    now = current(spark, folder)
    seats = D.most_decided(now, 3)
    sheets = cut(votes.panel_votes(now, seats))
    return votes.merged_row(votes.panel_labels(sheets), votes.vote_dissent(sheets, seats))


def category_scores(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.category_scores(scoring.dimension_pairs(*_scored(spark, folder)), load(spark, folder, "schema_categories").filter("section = 'active'"))


def worst_categories(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.worst_categories(category_scores(spark, folder)).select("model", "dimension", "category", "f1")


def paper_comparison(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.comparison_rows(scoring.dimension_pairs(*_scored(spark, folder)))


def category_scores_whole(spark: SparkSession, folder: str) -> DataFrame:
    """As ``category_scores``, with the gate's two classes and both supports, which its SQL leaves out."""
    gold, _, predicted = _scored(spark, folder)
    return scoring.whole_category_scores(category_scores(spark, folder), scoring.gate_pairs(gold, predicted))


def worst_categories_whole(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.worst_categories(category_scores_whole(spark, folder)).select("model", "dimension", "category", "f1", "support_human", "support_model")


def paper_comparison_whole(spark: SparkSession, folder: str) -> DataFrame:
    """As ``paper_comparison``, with the gate's rows, which its SQL leaves out."""
    gold, _, predicted = _scored(spark, folder)
    return paper_comparison(spark, folder).unionByName(scoring.gate_comparison(scoring.gate_pairs(gold, predicted)))


def model_metric_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return dimension_micro_f1(spark, folder).groupBy("model").pivot("dimension", list(D.DIMENSIONS)).agg(F.first("score"))


def unanimous_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Cells that several models answered and none got right."""
    rows = paper_comparison(spark, folder)
    return rows.groupBy("id", "dimension").agg(F.count("*").alias("models"), F.count_if(F.col("status") == "agree").alias("right")).filter("right = 0 and models >= 2").select("id", "dimension", "models")


def gate_crosstab(spark: SparkSession, folder: str) -> DataFrame:
    gold, _, predicted = _scored(spark, folder)
    return scoring.gate_pairs(gold, predicted).filter("answer is not null").groupBy("human", "answer").agg(F.count("*").alias("n"))


def icr_alpha_kappa(spark: SparkSession, folder: str) -> DataFrame:
    now = current(spark, folder)
    return icr.agreement(now, D.gates(now), *PAIR)


def gate_agreement(spark: SparkSession, folder: str) -> DataFrame:
    return icr.gate_agreement(D.gates(current(spark, folder)), *PAIR)


def disagreement_worklist(spark: SparkSession, folder: str) -> DataFrame:
    now = current(spark, folder)
    return icr.disagreements(now, D.gates(now), *PAIR)


def key_differences(spark: SparkSession, folder: str) -> DataFrame:
    return icr.key_differences(current(spark, folder), *PAIR)


def label_normalisers(spark: SparkSession, folder: str) -> DataFrame:
    """The four label-set rules side by side on every typed value."""
    typed = load(spark, folder, "codings").select("final_category").distinct()
    c = F.col("final_category")
    return typed.select(
        F.coalesce(c, F.lit("")).alias("value"), labels.norm(c).alias("norm"), F.array_join(labels.bench_set(c), ";").alias("bench"), F.array_join(labels.coder_set(c), ";").alias("coder"),
        labels.icr_label(c).alias("icr"), labels.gate_value(c).alias("gate"),
    ).distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        positives_projection, decision_states, reference_coder, gate_tally, saved_decisions, incomplete_papers, rejected_minus_confirmed, confirmed_wide, fill_worklist, majority_gate,
        majority_single, majority_multi, majority_multi_whole, panel_labels, dissent_stats, vote_dissent, dissent_stats_whole, gate_macro_f1, dimension_micro_f1, overall_score, coverage_panel, panel_choice, merged_vote, category_scores, worst_categories, paper_comparison,
        category_scores_whole, worst_categories_whole, paper_comparison_whole,
        model_metric_pivot, unanimous_failures, gate_crosstab, icr_alpha_kappa, gate_agreement, disagreement_worklist, key_differences, label_normalisers,
    )
}

_DIMS = "('research_position', 'software_lifecycle', 'software_type', 'techstack', 'evaluation')"
_LIST = "['research_position', 'software_lifecycle', 'software_type', 'techstack', 'evaluation']"
_PANEL = f"""
with {S.DECISIONS},
readable as (select id, seat, bool_or({S.gate_value("value")} is not null and dimension = '{D.GATE}') as ok from dec join seats using (coder) group by id, seat),
votes as (select d.id, s.seat, d.dimension, d.value, not r.ok as error from dec d join seats s using (coder) join readable r on r.id = d.id and r.seat = s.seat),
sheets as (select id, seat, bool_or(error) as error, max(case when dimension = '{D.GATE}' and not error then {S.gate_value("value")} end) as label from votes group by id, seat),
tallied as (select id, count_if(not error) as cast_, count_if(label = 1) as yes, count_if(label = 0) as no, max(case when seat = 0 then label end) as lead,
            string_agg(case when error then '-' when label is null then '?' else label::varchar end, '|' order by seat) as gate_votes from sheets group by id),
gate as (select id, cast_, gate_votes,
         case when cast_ = 0 then null when yes = no then lead when yes > no then 1 else 0 end as gate,
         case when cast_ = 0 then 'all_failed' when yes = no and yes + no > 0 then '{D.GATE}:tie' when yes > 0 and no > 0 then '{D.GATE}' else '' end as dissent from tallied)
"""
_MULTI = f""",
needed as (select id, count(distinct seat) // 2 + 1 as needed from votes where not error group by id),
keyed as (select id, seat, {S.norm("x")} as key, pos from (select id, seat, unnest(string_split(coalesce(value, ''), ';')) as x, generate_subscripts(string_split(coalesce(value, ''), ';'), 1) as pos
          from votes where not error and dimension = '{MULTI}')),
counts as (select id, key, count(distinct seat) as n, min(case when seat = 0 then pos end) as place from keyed where key <> '' group by id, key),
judged as (select *, n >= needed as ok from counts join needed using (id)),
multi as (select id, case when count_if(ok) = 0 then string_agg(case when place is not null then key end, ';' order by place, key)
                          else string_agg(case when ok then key end, ';' order by coalesce(place, 1000000), key) end as categories,
          case when count_if(ok) = 0 then '{MULTI}:no_majority' when count_if(not ok) > 0 then '{MULTI}' else '' end as dissent from judged group by id)
"""
_GOLD = f"""
with {S.DECISIONS},
best as (select coder from seats where seat = 0),
gold as (select id, gate from gates where coder in (from best)),
models as (select distinct coder as model from dec where coder not in (from best)),
answers as (select coder as model, id, max({S.gate_value("value")}) as answer from dec where dimension = '{D.GATE}' and coder not in (from best) group by all),
gp as (select m.model, g.id, g.gate as human, a.answer from gold g cross join models m left join answers a on a.model = m.model and a.id = g.id),
gc as (select model, count(*) as n, count_if(human = 1 and answer = 1)::double as tp, count_if(human = 0 and answer = 1)::double as fp,
       count_if(human = 1 and answer = 0)::double as fn, count_if(human = 0 and answer = 0)::double as tn from gp where answer is not null group by model),
gs as (select model, n, round((tp + tn) / n, 4) as accuracy, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) as f1_yes, round(coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0), 4) as f1_no,
       round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0)) / 2, 4) as macro_f1 from gc),
coded as (select id, dimension, {S.bench_set("value")} as human from dec where coder in (from best) and dimension in {_DIMS} and id in (select id from gold where gate = 1)),
dp as (select a.model, c.id, c.dimension, c.human, coalesce({S.bench_set("d.value")}, []) as answer from coded c join answers a on a.id = c.id and a.answer is not null
       left join dec d on d.coder = a.model and d.id = c.id and d.dimension = c.dimension where len(c.human) > 0),
cells as (select *, len(list_intersect(human, answer)) as hit, len(list_distinct(list_concat(human, answer))) as either from dp),
dsum as (select model, dimension, count(*) as n, sum(hit)::double as tp, sum(len(answer) - hit)::double as fp, sum(len(human) - hit)::double as fn,
         avg(case when either = 0 then 1.0 else hit / either end) as jaccard, avg((human = answer)::int::double) as accuracy from cells group by all),
ds as (select model, dimension, n, round(case when dimension = 'research_position' then accuracy else coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) end, 4) as score, round(jaccard, 4) as jaccard from dsum),
typ as (select model, avg(score) as typology from ds group by model),
reach as (select model, count_if(answer is not null) as n_scored, count_if(answer is null) as n_missing from gp group by model),
ov as (select r.model, gs.macro_f1 as gate_score, round(t.typology, 4) as typology, round(case when t.typology is null then gs.macro_f1 else 0.5 * gs.macro_f1 + 0.5 * t.typology end, 4) as overall,
       n_scored, n_missing, round(n_scored / (n_scored + n_missing), 4) as coverage from reach r left join gs using (model) left join typ t using (model)),
cmp as (select model, id, dimension, case when human = answer then 'agree' when len(answer) = 0 then 'no_answer' when hit > 0 then 'partial' else 'disagree' end as status,
        {S.joined("list_sort(list_filter(human, lambda x: not list_contains(answer, x)))")} as missed, {S.joined("list_sort(list_filter(answer, lambda x: not list_contains(human, x)))")} as extra,
        round(hit / either, 4) as jaccard from cells),
h as (select model, dimension, id, unnest(human) as category from dp), a as (select model, dimension, id, unnest(answer) as category from dp),
cs as (select model, dimension, category, count_if(h.id is not null and a.id is not null)::bigint as tp, count_if(h.id is null)::bigint as fp, count_if(a.id is null)::bigint as fn
       from h full join a using (model, dimension, id, category) group by all),
cat as (select model, dimension, category, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) as recall,
        round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) as f1,
        exists (from schema_categories s where s.section = 'active' and s.dimension = cs.dimension and s.category_key = cs.category) as in_schema from cs)
"""
_PAIR = f"""
with {S.DECISIONS},
st as (select a.id, a.gate as a, b.gate as b, case when a.gate = 1 and b.gate = 1 then 'confirmed' when a.gate <> b.gate then 'vetoed' else 'rejected' end as status
       from gates a join gates b on a.id = b.id where a.coder = '{PAIR[0]}' and b.coder = '{PAIR[1]}'),
one as (select * from dec where coder = '{PAIR[0]}' and dimension in {_DIMS}), two as (select * from dec where coder = '{PAIR[1]}' and dimension in {_DIMS})
"""
_ICR = "(case when {0} = '' then 'nan' else {0} end)"

SQL: dict[str, str] = {
    "positives_projection": rf"with {S.DECISIONS} select d.coder, d.id, regexp_replace({S.strip('value')}, '{S.WHITE}+', ' ', 'g') as value from dec d join gates g using (coder, id) where gate = 1 and dimension = '{D.GATE}'",
    "decision_states": f"with {S.DECISIONS} select coder, id, gate from gates",
    "reference_coder": f"with {S.DECISIONS} select coder, count(distinct id) as decided from dec where not contains(coder, '.') group by coder order by decided desc, coder limit 1",
    "gate_tally": f"with {S.DECISIONS} select coder, count_if(gate = 1)::bigint as accepted, count_if(gate = 0)::bigint as rejected, count(*) as decided from gates group by coder",
    "saved_decisions": f"with {S.DECISIONS} select d.coder, d.id, d.dimension, d.value from dec d join gates g using (coder, id) where gate = 1 or dimension = '{D.GATE}'",
    "incomplete_papers": f"""with {S.DECISIONS}, have as (select coder, id, list(dimension) filter (not {S.blank("value")}) as have from dec group by all)
      select coder, id, missing from (select coder, id, {S.joined(f"list_filter({_LIST}, lambda x: not coalesce(list_contains(have, x), false))")} as missing from have join gates using (coder, id) where gate = 1) where missing <> ''""",
    "rejected_minus_confirmed": f"with {S.DECISIONS} select id from gates group by id having max(gate) = 0",
    "confirmed_wide": f"with {S.DECISIONS} select d.coder, d.id, " + ", ".join(f"max(value) filter (dimension = '{x}') as {x}" for x in D.DIMENSIONS) + " from dec d join gates g using (coder, id) where gate = 1 group by all",
    "fill_worklist": f"""with {S.DECISIONS}, have as (select id, list(distinct dimension) filter (not {S.blank("value")}) as have from dec group by id), v as (select id, max(gate) as gate from gates group by id),
      t as (select id, gate, {S.joined(f"list_filter({_LIST}, lambda x: not coalesce(list_contains(have, x), false))")} as todo from have join v using (id))
      select id, case when gate = 0 or todo = '' then '' else todo end as todo, case when gate = 0 then 'rejected' when todo = '' then 'complete' else 'fill' end as reason from t""",
    "majority_gate": _PANEL + "select id, cast_ as \"cast\", gate, gate_votes, dissent from gate",
    "majority_single": _PANEL + f""", c as (select id, {S.norm("value")} as key, seat from votes where not error and dimension = 'research_position'),
      n as (select id, key, count(*) as n, max((seat = 0)::int) as lead from c where key <> '' group by id, key),
      r as (select id, key, count(*) over (partition by id) > 1 as dissent, row_number() over (partition by id order by n desc, lead desc, key) as r from n)
      select id, key as winner, dissent from r where r = 1""",
    "majority_multi": _PANEL + _MULTI + "select id, coalesce(categories, '') as categories, dissent from multi",
    "dissent_stats": _PANEL + _MULTI + f"""select count(*) as papers, count_if(g.dissent <> '' or coalesce(m.dissent, '') <> '')::bigint as any_split, count_if(contains(g.dissent, '{D.GATE}'))::bigint as gate_split
      from gate g left join multi m using (id)""",
    "gate_macro_f1": _GOLD + "select model, n, accuracy, f1_yes, f1_no, macro_f1 from gs",
    "dimension_micro_f1": _GOLD + "select model, dimension, n, score, jaccard from ds",
    "overall_score": _GOLD + "select model, gate_score, typology, overall, n_scored, n_missing, coverage from ov",
    "coverage_panel": _GOLD + """, r as (select row_number() over (order by overall desc, model) as place, model, overall, round(overall - lead(overall) over (order by overall desc, model), 4) as margin
      from ov where coverage >= 0.02 and overall is not null) select place, model, overall, margin, coalesce(margin < 0.02, false) as narrow from r where place <= 3""",
    "panel_choice": _GOLD + """, e as (select model, overall, row_number() over (order by overall desc, (model = 'coder_05')::int desc, model) as place from ov where coverage >= 0.02 and overall is not null),
      m as (select *, round(overall - lead(overall) over (order by place), 4) as margin from e), p as (select * from m where place <= 3), n as (select count(*) as seats, max(margin) filter (place = 3) as last from p)
      select place, model, overall, margin, case when seats = 2 then 'short of 3, both must agree' when seats < 3 then 'short of 3' when last < 0.02 then 'narrow' else '' end as reason from p, n""",
    "category_scores": _GOLD + "select * from cat",
    "worst_categories": _GOLD + "select model, dimension, category, f1 from cat where in_schema order by f1, tp + fn desc, model, dimension, category limit 40",
    "paper_comparison": _GOLD + "select * from cmp",
    "model_metric_pivot": _GOLD + "select model, " + ", ".join(f"max(score) filter (dimension = '{x}') as {x}" for x in D.DIMENSIONS) + " from ds group by model",
    "unanimous_failures": _GOLD + "select id, dimension, count(*) as models from cmp group by id, dimension having count_if(status = 'agree') = 0 and count(*) >= 2",
    "gate_crosstab": _GOLD + "select human, answer, count(*) as n from gp where answer is not null group by all",
    "icr_alpha_kappa": _PAIR + f""", p as (select a.id, a.dimension, {_ICR.format(S.joined(S.coder_set("a.value")))} as x, {_ICR.format(S.joined(S.coder_set("b.value")))} as y
        from one a join two b using (id, dimension) join st using (id) where status = 'confirmed'),
      l as (select dimension, label, sum(na) as na, sum(nb) as nb from (select dimension, x as label, 1 as na, 0 as nb from p union all select dimension, y, 0, 1 from p) group by all),
      e as (select dimension, sum((na + nb) * (na + nb))::double as sq, sum(na * nb)::double as pr from l group by dimension),
      b as (select dimension, count(*)::double as n, count_if(x = y)::double as same from p group by dimension)
      select dimension, n::bigint as n_shared, round(same / n, 3) as raw_agreement, round(case when 4 * n * n - sq = 0 then 1.0 else 1 - (2 * n - 1) * (2 * (n - same)) / (4 * n * n - sq) end, 3) as krippendorff_alpha,
        round((same / n - pr / (n * n)) / nullif(1 - pr / (n * n), 0), 3) as cohen_kappa from b join e using (dimension)""",
    "gate_agreement": _PAIR + """select count(*) as both, count_if(a = b)::bigint as same, count_if(status = 'confirmed')::bigint as confirmed, count_if(status = 'vetoed')::bigint as vetoed,
      round(coalesce(count_if(a = b) / nullif(count(*), 0), 0), 3) as agreement from st""",
    "disagreement_worklist": _PAIR + f""", c as (select a.id, a.dimension from one a join two b using (id, dimension) where {S.joined(S.coder_set("a.value"))} <> {S.joined(S.coder_set("b.value"))}),
      d as (select id, string_agg(dimension, ';' order by dimension) as dims, count(*) as n from c group by id),
      j as (select id, status = 'vetoed' as gd, case when status = 'confirmed' then coalesce(n, 0) else 0 end + (status = 'vetoed')::int as k, case when status = 'confirmed' then coalesce(dims, '') else '' end as dims from st left join d using (id))
      select id, k::bigint as n_disagree, gd as gate_differs, gd or k >= 3 as critical, dims as dimensions from j where k > 0""",
    "key_differences": _PAIR + f""", sh as (select id, dimension from one join two using (id, dimension)),
      x as (select id, dimension, unnest({S.coder_set("value")}) as key from one), y as (select id, dimension, unnest({S.coder_set("value")}) as key from two),
      x2 as (from x semi join sh using (id, dimension)), y2 as (from y semi join sh using (id, dimension))
      select dimension, key, count_if(y2.id is null)::bigint as only_first, count_if(x2.id is null)::bigint as only_second, count_if(x2.id is not null and y2.id is not null)::bigint as both from x2 full join y2 using (id, dimension, key) group by all""",
    "label_normalisers": f"""select distinct coalesce(final_category, '') as value, {S.norm("final_category")} as norm, {S.joined(S.bench_set("final_category"))} as bench, {S.joined(S.coder_set("final_category"))} as coder,
      {_ICR.format(S.joined(S.coder_set("final_category")))} as icr, {S.gate_value("final_category")} as gate from codings""",
}
