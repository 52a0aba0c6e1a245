"""The stages of a study by name: what each does, whether it calls a paid model, and which queries show its result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.registry import QUERIES


@dataclass(frozen=True)
class Stage:
    name: str
    purpose: str
    queries: tuple[str, ...]
    paid: bool = False


STAGES = (
    Stage("estimate", "score the corpus and fill disjoint working sets", ("estimator_score", "working_sets_fill", "set_size_report")),
    Stage("purge", "name volumes and front matter that are no papers", ("non_paper_reasons",)),
    Stage("pools", "sizes of the sets, refills, pretest draw", ("set_sizes", "refill_targets", "pretest_draw")),
    Stage("annotate", "ask the panel about each paper of a set", ("candidate_stream", "annotation_columns", "suggestion_log"), paid=True),
    Stage("fill", "ask for missing dimensions only", ("fill_worklist", "fill_prompts"), paid=True),
    Stage("reannotate", "ask again about accepted papers", ("reannotation_worklist", "reannotation_kept"), paid=True),
    Stage("confirm", "merge the panel's votes and place the confirmed files", ("merged_vote", "vote_dissent", "confirmed_sources", "set_attrition")),
    Stage("narrow", "count suggested categories and merge them with the candidates", ("candidate_frequencies_whole", "merge_candidates")),
    Stage("code", "coders' decisions, worklists and coined categories", ("decision_states", "incomplete_papers", "new_category_decisions", "coined_sidecar")),
    Stage("agree", "agreement of coders", ("icr_alpha_kappa", "gate_agreement", "disagreement_worklist")),
    Stage("bench", "score models against the reference and choose the panel", ("overall_score", "category_scores_whole", "panel_choice")),
    Stage("scheme", "guidance, integrity and renamed results", ("scheme_guidance", "schema_integrity", "rename_plan")),
)


def run(name: str, spark: SparkSession, folder: str, confirm_paid: Callable[[Stage], bool] = lambda stage: False) -> dict[str, DataFrame]:
    """The frames of a stage's queries; a stage that calls a paid model runs only if ``confirm_paid`` says so."""
    stage = next((s for s in STAGES if s.name == name), None)
    if stage is None:
        raise KeyError(f"no stage {name!r}; there are {', '.join(s.name for s in STAGES)}")
    if stage.paid and not confirm_paid(stage):
        raise PermissionError(f"{name} calls a paid model and was not confirmed")
    return {query: QUERIES[query](spark, folder) for query in stage.queries}
