"""What the queries whose SQL states less than the whole job leave out, on fixtures with known answers."""

from tessera.operators import narrowing, scoring, votes
from tessera.operators.decisions import GATE

VOTES = "id string, seat int, dimension string, value string, error boolean"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def sheet(paper, seat, gate="1", **dimensions):
    error = gate is None
    return [(paper, seat, GATE, gate, error)] + [(paper, seat, d, v, error) for d, v in dimensions.items()]


def test_dissent_names_every_split_field(spark):
    rows = [r for s in range(3) for r in sheet("alike", s, techstack="x", research_position="r")]
    rows += sheet("fields", 0, evaluation="e", techstack="a;b", research_position="r", software_lifecycle="l") + sheet("fields", 1, evaluation="f", techstack="a", research_position="q", software_lifecycle="L")
    rows += sheet("out", 0) + sheet("out", 1, None, techstack="z") + sheet("out", 2, None)
    rows += sheet("tie", 0, "0") + sheet("tie", 1, "1", techstack="t") + sheet("tie", 2, None)
    rows += sheet("failed", 0, None) + sheet("failed", 1, None)
    seats = frame(spark, [(0, "ada"), (1, "bob"), (2, "cleo")], "seat int, coder string")
    got = {r["id"]: r["dissent"] for r in votes.vote_dissent(frame(spark, rows, VOTES), seats).collect()}
    assert got == {
        "alike": "", "fields": "research_position;techstack;evaluation:no_majority", "out": "abstained:bob+cleo",
        "tie": GATE + ":tie;techstack:no_majority;abstained:cleo", "failed": "all_failed",
    }


def test_gate_is_scored_as_two_classes(spark):
    gold = frame(spark, [("p1", 1), ("p2", 1), ("p3", 0), ("p4", 1)], "id string, gate int")
    human = frame(spark, [("p1", "techstack", "x;y")], "id string, dimension string, value string")
    cells = [("m", "p1", GATE, "1"), ("m", "p1", "techstack", "x"), ("m", "p2", GATE, "0"), ("m", "p3", GATE, "1"), ("m", "p4", GATE, "?"), ("idle", "p9", GATE, "1")]
    predicted = frame(spark, cells, "model string, id string, dimension string, value string")
    pairs, dims = scoring.gate_pairs(gold, predicted), scoring.dimension_pairs(gold, human, predicted)
    keys = frame(spark, [("techstack", "x")], "dimension string, category_key string")
    whole = scoring.whole_category_scores(scoring.category_scores(dims, keys), pairs)
    got = {(r["model"], r["category"]): tuple(r[c] for c in ("tp", "fp", "fn", "precision", "recall", "f1", "in_schema", "support_human", "support_model")) for r in whole.collect()}
    assert got == {
        ("m", "research_software"): (1, 1, 1, 0.5, 0.5, 0.5, True, 2, 2), ("m", "not_research_software"): (0, 1, 1, 0.0, 0.0, 0.0, True, 1, 1),
        ("idle", "research_software"): (0, 0, 0, 0.0, 0.0, 0.0, True, 0, 0), ("idle", "not_research_software"): (0, 0, 0, 0.0, 0.0, 0.0, True, 0, 0),
        ("m", "x"): (1, 0, 0, 1.0, 1.0, 1.0, True, 1, 1), ("m", "y"): (0, 0, 1, 0.0, 0.0, 0.0, False, 1, 0),
    }
    assert scoring.worst_categories(whole, 3).filter(f"dimension = '{GATE}'").count() == 3
    got = {(r["model"], r["id"]): (r["status"], r["missed"], r["extra"], r["jaccard"]) for r in scoring.gate_comparison(pairs).collect()}
    assert got == {("m", f"p{i}"): (s, "", "", None) for i, s in enumerate(("agree", "disagree", "disagree", "no_answer"), 1)} | {("idle", f"p{i}"): ("no_answer", "", "", None) for i in range(1, 5)}


def test_all_multi_valued_dimensions_are_merged_and_take_their_prose_from_the_nearest_sheet(spark):
    rows = sheet("a", 0, "0", techstack="x;y", evaluation="e", research_position="r") + sheet("a", 1, "1", techstack="y;z", evaluation="f", research_position="q") + sheet("a", 2, "1", techstack="y", software_lifecycle="l", research_position="q")
    rows += sheet("out", 0, None, techstack="x") + sheet("out", 1, "1") + sheet("out", 2, "0", techstack="t") + sheet("failed", 0, None, techstack="x")
    given = frame(spark, [(*r, r[1] / 10) for r in rows], VOTES + ", certainty double")
    got = {(r["id"], r["dimension"]): (r["categories"], r["dissent"]) for r in votes.panel_multis(given).collect()}
    assert got == {
        ("a", "techstack"): ("y", "techstack"), ("a", "evaluation"): ("e", "evaluation:no_majority"), ("a", "software_lifecycle"): ("", "software_lifecycle:no_majority"),
        ("out", "techstack"): ("", "techstack:no_majority"),
    }
    whole = votes.panel_labels(given).collect()
    got = {(r["id"], r["dimension"]): (r["categories"], r["seat"], r["certainty"]) for r in whole}
    assert len(whole) == len(got) == 12
    assert got["a", "techstack"] == ("y", 2, 0.2) and got["a", "evaluation"] == ("e", 0, 0.0) and got["a", "research_position"] == ("q", 1, 0.1)
    assert got["a", "software_lifecycle"] == ("", 0, None) and got["a", "software_type"] == ("", 0, None)
    assert got["a", GATE] == ("1", 1, 0.1) and got["out", GATE] == ("", 0, 0.0) and got["out", "techstack"] == ("", 1, None)


def test_candidates_come_with_seeds_and_explanations(spark):
    log = [(i, f"p{i}", "techstack", "New Key", None if i % 2 else f" why {i} ") for i in range(1, 15)] + [(2, "p2", "techstack", "New Key", None), (20, "q", "techstack", "bare", "nan"), (21, "q", "techstack", None, "lost")]
    suggestions = frame(spark, log, "suggestion_id long, id string, dimension string, new_suggestion string, explanation string")
    cells = [("techstack", " x; y;x "), ("techstack", "X"), ("techstack", "nan"), ("techstack", None), ("evaluation", "x"), ("research_position", "y")]
    decisions = frame(spark, cells, "dimension string, value string")
    scheme = frame(spark, [("techstack", "active", "x", "d", False), ("techstack", "active", "y", "e", None), ("evaluation", "active", "z", "f", True), ("techstack", "rejected", "w", "g", True)], "dimension string, section string, category_key string, description string, deprecated boolean")
    got = {(r["dimension"], r["key"]): (r["source"], r["frequency"], r["seed_description"], r["example_ids"], r["example_explanations"]) for r in narrowing.candidate_table(suggestions, decisions, scheme).collect()}
    assert got == {
        ("techstack", "x"): ("seed", 2, "d", "", ""), ("techstack", "y"): ("seed", 1, "e", "", ""), ("evaluation", "z"): ("seed", 0, "f", "", ""),
        ("techstack", "new_key"): ("suggested", 14, "", "p1;p2;p3;p4;p5", "why 2 || why 4 || why 6 || why 8 || why 10"), ("techstack", "bare"): ("suggested", 1, "", "q", ""),
    }
