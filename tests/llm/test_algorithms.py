"""Sampling, mapping, frequencies, consensus, packing and mixing against brute force and invariants."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import canonical, consensus, mixing, packing, proportions, termfreq

SETS = "set_name string, id string, volume string, score double, pages int, staged_at timestamp, cats string, spec string"
TARGETS = "set_name string, facet string, category string, band_lo double, band_hi double, target_share double, min_rows int, sample_size int"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def targets_of(name, size, shares, floors=(0, 0)):
    rows = [(name, "volume", "lni1", None, None, shares[0], floors[0], size), (name, "volume", "lni2", None, None, shares[1], floors[1], size)]
    return rows + [(name, "pages", "short", 1.0, 6.0, 0.5, 0, size), (name, "pages", "unknown", None, None, 0.5, 0, size)]


@pytest.mark.parametrize("block", [20_000, 40])
def test_samples_follow_their_targets(spark, block):
    draw = random.Random(5)
    rows = [("a", f"p{i}", draw.choice([" LNI 1", "lni-1", "lni2", "lni2"]), 1.0, draw.choice([3, None, -1]), None, "x", "y") for i in range(400)]
    rows += rows[:50] + [("small", "q", "lni1", None, None, None, "x", "y"), (None, "z", "lni1", 1.0, 1, None, None, None), ("a", None, "lni1", 1.0, 1, None, None, None)]
    targets = frame(spark, targets_of("a", 60, (0.25, 0.75), (10, 0)) + targets_of("small", 5, (0.5, 0.5)), TARGETS)
    sample, report = proportions.draw_samples(frame(spark, rows, SETS), targets, block_rows=block)
    drawn = [(r["set_name"], r["id"]) for r in sample.collect()]
    assert len(drawn) == len(set(drawn)) and abs(sum(s == "a" for s, _ in drawn) - 60) <= 2 and ("small", "q") in drawn
    got = {(r["set_name"], r["category"]): r for r in report.collect()}
    assert got["a", "lni1"]["drawn"] >= 10 and abs(got["a", "lni1"]["drawn"] - 15) <= 3 and abs(got["a", "short"]["drawn"] - 30) <= 3
    assert not got["a", "lni1"]["short"] and got["small", "lni1"]["short"] and got["small", "lni2"]["available"] == 0
    assert got["small", "lni1"]["wanted"] == 3


def test_the_latest_staging_counts(spark):
    rows = frame(spark, [("a", "p", "lni1", 1.0, 3, 1), ("a", "p", "lni2", 1.0, 9, 2)], "set_name string, id string, volume string, score double, pages int, t int").withColumn("staged_at", F.timestamp_seconds("t"))
    assert [(r["volume"], r["pages"]) for r in proportions.latest_papers(rows).collect()] == [("lni2", 9.0)]


def test_empty_sets(spark):
    sample, report = proportions.draw_samples(frame(spark, [], SETS), frame(spark, targets_of("a", 4, (0.5, 0.5)), TARGETS))
    assert sample.count() == 0 and all(r["short"] for r in report.collect())


def test_pivotal_keeps_the_sum():
    p = np.random.default_rng(1).random(500)
    out, held = proportions.pivotal(p, np.random.default_rng(2))
    assert abs(out.sum() - p.sum()) < 1e-6 and ((out == 0) | (out == 1)).sum() >= len(p) - 1


SCHEME = "dimension string, section string, category_key string, description string, deprecated boolean, examples array<string>, move_to string"
ENTRIES = [
    ("d", "active", "formaler_nachweis", "mathematischer Beleg", False, ["formal guarantee"], None), ("d", "active", "feldversuch", "Erprobung im Alltag", False, None, None),
    ("d", "active", "langzeitbeobachtung", "mehrjährige Begleitung", False, [], None), ("d", "rejected", "beweis_alt", "früher", True, [], "formaler_nachweis"),
]


def test_typed_values(spark):
    meant = {
        "formaler_nachweis": ["Formaler Nachweis", "nachweis formaler", "formalernachweis", "FORMAL GUARANTEE", "formaler_nachwei", "formlaer_nachwies", "beweis_alt", "Beweis-Alt", "vermutlich formaler_nachweis", "ｆｏｒｍａｌｅｒ_ｎａｃｈｗｅｉｓ", "fоrmаler nachweis", "formaler_nachw."],
        "feldversuch": ["1) Feldversuch", "-> feldversuch", '"feldversuch"', "feldversuch v2", "feldversuch (siehe Abschnitt 3)", "d: feldversuch", "feld​versuch", "feldver.", "feldversuch / unsicher", "Erprobung im Allatg"],
        "langzeitbeobachtung": ["mehrjÃ¤hrige Begleitung", "langzeitbeobachtungen", "mehrjaehrige_begleitung"],
        None: ["langzeitbelichtung", "feldpost_archiv", "quanten_emulator", "", " ", "NaN", "None", "???", "🙂", "x" * 5000],
    }
    rows = [("d", v, 1) for values in meant.values() for v in values] + [("other", "feldversuch", 1), ("d", None, 1), (None, "feldversuch", 1)] + [("d", "Feldversuch", 1)] * 3
    got = {(r["dimension"], r["value"]): r["category_key"] for r in canonical.map_values(frame(spark, rows, "dimension string, value string, score int"), frame(spark, ENTRIES, SCHEME)).collect()}
    for key, values in meant.items():
        for value in values:
            assert got["d", value.strip()] == key, value
    assert got["other", "feldversuch"] is None and len(got) == len({(d, v.strip()) for d, v, _ in rows if d and v is not None})


def test_mapping_nothing(spark):
    assert canonical.map_values(frame(spark, [], "dimension string, value string"), frame(spark, ENTRIES, SCHEME)).count() == 0
    got = canonical.map_values(frame(spark, [("d", "feldversuch")], "dimension string, value string"), frame(spark, [], SCHEME)).first()
    assert got["category_key"] is None


def counted_by_hand(suggestions, candidates):
    occurrences, papers, key = Counter(), {}, lambda v: "_".join((v or "").lower().replace("-", " ").replace("_", " ").split())
    for sid, paper, value in set(suggestions):
        if key(value) not in ("", "nan", "none", "null"):
            occurrences[key(value)] += 1
            papers.setdefault(key(value), set()).update([paper] if paper else [])
    for cid, value, n in set(candidates):
        if key(value) not in ("", "nan", "none", "null"):
            occurrences[key(value)] += max(n or 0, 0)
            papers.setdefault(key(value), set())
    return {k: (n, len(papers[k])) for k, n in occurrences.items()}


@pytest.mark.parametrize("leaf", [1_000_000, 30])
def test_term_counts_when_partitions_split(spark, leaf):
    draw = random.Random(2)
    words = ["hot"] * 30 + [f"Term {i}" for i in range(40)] + ["term-1", " TERM_2 ", "a  b", "", "NaN", None, "--"]
    suggestions = [(i, draw.choice([None, "p1", "p2", "p3", "p4", "p5", "p6"]), draw.choice(words)) for i in range(400)]
    candidates = [(i, draw.choice(words), draw.choice([None, -3, 0, 2, 50])) for i in range(40)]
    s = frame(spark, [("d", *r, "x") for r in suggestions + suggestions[:90]], "dimension string, suggestion_id long, id string, new_suggestion string, term string")
    c = frame(spark, [("d", *r) for r in candidates + candidates[:9]] + [(None, 99, "hot", 7)], "dimension string, candidate_id long, candidate_key string, frequency int")
    got = {r["term"]: (r["occurrences"], r["papers"]) for r in termfreq.count_terms(s, c, bits=2, leaf_rows=leaf).collect()}
    assert got == counted_by_hand(suggestions, candidates)


def test_one_term_replayed_beyond_every_split(spark):
    s = frame(spark, [("d", 1, "p", "hot")] * 300 + [("d", i, f"p{i}", "hot") for i in range(200)], "dimension string, suggestion_id long, id string, new_suggestion string")
    c = frame(spark, [], "dimension string, candidate_id long, candidate_key string, frequency int")
    row = termfreq.count_terms(s, c, bits=2, leaf_rows=20).first()
    assert (row["occurrences"], row["papers"]) == (200, 201)


def test_no_terms(spark):
    s = frame(spark, [], "dimension string, suggestion_id long, id string, new_suggestion string")
    assert termfreq.count_terms(s, frame(spark, [], "dimension string, candidate_id long, candidate_key string, frequency int")).count() == 0


CODINGS = "coding_id long, id string, coder string, dimension string, final_category string, coded_at timestamp, votes int"


def test_consensus_beats_the_majority(spark):
    draw = random.Random(9)
    right = {f"c{i}": p for i, p in enumerate([0.95, 0.92, 0.9, 0.55, 0.5, 0.52, 0.2, 0.25])}
    truth = {f"p{i}": draw.random() < 0.5 for i in range(600)}
    rows, n = [], 0
    for paper, label in truth.items():
        for coder in draw.sample(sorted(right), 5):
            n += 1
            rows.append((n, paper, draw.choice([coder, coder.upper(), f" {coder}"]), consensus.GATE, draw.choice(["1", "yes", "1.0"] if label == (draw.random() < right[coder]) else ["0", "nein"]), None, 0))
    rows += rows[:40] + [(n + 1, "p0", None, consensus.GATE, "1", None, 0), (n + 2, None, "c1", consensus.GATE, "1", None, 0), (n + 3, "p1", "c9", consensus.GATE, " ", None, 0)]
    labels, coders = consensus.consensus(frame(spark, rows, CODINGS), frame(spark, ENTRIES, SCHEME))
    got = {r["id"]: r for r in labels.collect()}
    accuracy = sum((got[p]["final_category"] == "1") == t for p, t in truth.items()) / len(truth)
    found = {r["coder"]: r["accuracy"] for r in coders.collect()}
    assert accuracy > 0.9 and max(abs(found[c] - p) for c, p in right.items()) < 0.15
    assert all(r["votes"] == 5 for p, r in got.items())


def test_many_coders(spark):
    """Two thousand coders, of whom each met few others; one coder labelled every paper."""
    draw = random.Random(3)
    right = {f"c{i}": draw.choice([0.95, 0.9, 0.85, 0.6]) for i in range(2000)} | {"all": 0.9}
    groups = [[f"c{g * 20 + i}" for i in range(20)] for g in range(100)]
    truth, rows = {f"p{i}": draw.choice(["formaler_nachweis", "feldversuch", "langzeitbeobachtung"]) for i in range(1500)}, []
    for i, (paper, label) in enumerate(truth.items()):
        for coder in draw.sample(groups[i % 100], 8) + ["all"]:
            said = label if draw.random() < right[coder] else draw.choice(["formaler_nachweis", "feldversuch", "langzeitbeobachtung"])
            rows.append((len(rows), paper, coder, consensus.POSITION, f"{said};{said}" if draw.random() < 0.2 else said, None, 0))
    entries = [(consensus.POSITION, *e[1:]) for e in ENTRIES]
    labels, coders = consensus.consensus(frame(spark, rows, CODINGS), frame(spark, entries, SCHEME))
    got = {r["id"]: r for r in labels.collect()}
    assert sum(got[p]["final_category"] == t for p, t in truth.items()) > 0.97 * len(truth) and all(r["votes"] == 9 for r in got.values())
    assert coders.count() == len({r[2] for r in rows})


def skills_by_hand(rates):
    """Medians over every two partners of a coder that met each other."""
    pairs = {(r["a"], r["b"]): (r["kappa"], r["met"]) for r in rates}
    found = {}
    for coder in {a for a, _ in pairs}:
        near = sorted(b for a, b in pairs if a == coder)
        closed = [(*pairs[coder, j], *pairs[coder, k], *pairs[j, k]) for i, j in enumerate(near) for k in near[i + 1 :] if (j, k) in pairs]
        if closed:
            own_j, met_j, own_k, met_k, other, met = map(np.array, zip(*closed))
            found[coder] = consensus.median_skill(own_j, own_k, other, met_j, met_k, met)
    return {c: v for c, v in found.items() if v is not None}


@pytest.mark.parametrize("pairs_of_a_block", [500_000, 60])
def test_every_triplet_of_a_coder_counts(spark, monkeypatch, pairs_of_a_block):
    """Ninety coders that met one another, some far more often than others; two more met few, or a single one."""
    monkeypatch.setattr(consensus, "BLOCK_PAIRS", pairs_of_a_block)
    draw = random.Random(8)
    right = {f"c{i}": draw.choice([0.95, 0.8, 0.7, 0.3]) for i in range(90)}
    often = {c: draw.choice([0.25, 0.5, 0.9]) for c in right}
    rows = []
    for item in range(60):
        for coder, p in right.items():
            if draw.random() < often[coder]:
                rows.append((consensus.GATE, f"p{item}", coder, str(int(draw.random() < p)), 1.0))
    rows += [(consensus.GATE, f"q{i}", c, str(i % 2), 1.0) for i in range(4) for c in ("lone", "c0")] + [(consensus.GATE, f"r{i}", c, str(i % 2), 1.0) for i in range(4) for c in ("few", "c0", "c1")]
    votes = frame(spark, rows, "dimension string, id string, coder string, label string, weight double")
    rates = consensus.pair_rates(votes)
    expected = skills_by_hand(rates.collect())
    got = {r["coder"]: r["value"] for r in consensus.triplet_skills(consensus.cut(rates)).collect()}
    assert {c for c, v in got.items() if v is None} == {"lone"} == set(got) - set(expected)
    assert max(abs(got[c] - v) for c, v in expected.items()) < 1e-9


def test_partners_beyond_the_most_met_count(spark):
    """The partners a coder met most often repeat its errors; those it met less often know its skill."""
    draw = random.Random(4)
    rows = []
    for item in range(300):
        truth = item % 2
        said = truth if draw.random() < 0.6 else 1 - truth
        votes = {"x": said}
        votes |= {f"copy{i}": said if draw.random() < 0.9 else 1 - said for i in range(66) if draw.random() < 0.5}
        if item < 100:
            votes |= {f"good{i}": truth if draw.random() < 0.95 else 1 - truth for i in range(140)}
        rows += [(consensus.GATE, f"p{item}", c, str(v), 1.0) for c, v in votes.items()]
    found = {r["coder"]: r["accuracy"] for r in consensus.coder_reliability(frame(spark, rows, "dimension string, id string, coder string, label string, weight double")).collect()}
    assert found["x"] < 0.75


def test_cells_with_several_labels_are_split_votes(spark):
    entries = [(consensus.POSITION, *e[1:]) for e in ENTRIES]
    rows = [(1, "p", "a", "feldversuch;langzeitbeobachtung"), (2, "p", "b", "Feldversuch"), (3, "p", "c", "langzeitbeobachtung;???"), (4, "p", "d", "Feldversuch, feldversuch"), (5, "q", "a", "???")]
    coded = frame(spark, [(n, p, c, consensus.POSITION, v, None, 0) for n, p, c, v in rows], CODINGS)
    got = {r["id"]: r for r in consensus.consensus(coded, frame(spark, entries, SCHEME))[0].collect()}
    assert got["p"]["final_category"] == "feldversuch" and got["p"]["votes"] == 4 and abs(got["p"]["agreement"] - 2.5 / 6) < 1e-9
    assert got["q"]["final_category"] is None and got["q"]["votes"] == 1


def test_no_codings(spark):
    labels, coders = consensus.consensus(frame(spark, [], CODINGS), frame(spark, ENTRIES, SCHEME))
    assert labels.count() == 0 and coders.count() == 0


def documents(spark, sizes, extra="container"):
    return frame(spark, [(i, " ".join(["word"] * n) if n is not None else None, "s", "x") for i, n in enumerate(sizes)], f"doc_id long, text string, source string, {extra} string")


@pytest.mark.parametrize("sizes", [[], [None, 0], [5] * 40, [100] * 3 + [250, 64, 128]])
def test_packing_edges(spark, sizes):
    packed = packing.pack(documents(spark, sizes), capacity=64).collect()
    assert sum(r["tokens"] for r in packed) == sum(n or 0 for n in sizes)
    loads = Counter()
    for r in packed:
        loads[r["container"]] += r["tokens"]
    assert all(n <= 64 for n in loads.values())


def test_packing_is_whole_and_tight(spark):
    draw = random.Random(4)
    sizes = [draw.choice([draw.randrange(1, 40), draw.randrange(40, 260), 300, draw.randrange(1, 700)]) for _ in range(900)]
    packed = packing.pack(documents(spark, sizes), capacity=256, block_items=120).collect()
    loads, pieces = Counter(), Counter()
    for r in packed:
        loads[r["container"]] += r["tokens"]
        pieces[r["doc_id"]] += r["tokens"]
        assert (r["parts"] > 1) == (sizes[r["doc_id"]] > 256)
    assert dict(pieces) == dict(enumerate(sizes)) and max(loads.values()) <= 256
    assert sum(sizes) / (256 * len(loads)) > 0.97


def test_packing_with_few_small_pieces_and_sliced_lengths(spark):
    sizes = [40] * 700 + [90] * 500 + [3] * 4
    packed = packing.pack(documents(spark, sizes), capacity=128, block_items=50, rank_slice=60).collect()
    loads = Counter()
    for r in packed:
        loads[r["container"]] += r["tokens"]
    assert len(packed) == len(sizes) and max(loads.values()) <= 128
    assert len(loads) <= 1.05 * (500 + 700 / 3)


def test_mixes(spark):
    rows = [(i, f"word {i} " + "more " * (i % 7), "big") for i in range(300)] + [(1000 + i, f"small text {i}", "small") for i in range(10)] + [(2000, "small text 0", "big"), (2001, None, "big"), (2002, "", "small"), (2003, "x", None)]
    targets = frame(spark, [(1, "big", 0.8, 2, 1500), (1, "small", 0.2, 3, 1500), (2, "none", 0.5, 2, 100), (2, "big", 0.5, 1, 100), (3, "big", None, None, None)], "mix_id long, source string, target_weight double, max_repeats int, budget_tokens long")
    mix, report = mixing.mix_sources(frame(spark, rows, "doc_id long, text string, source string"), targets, slices=4)
    got = {(r["mix_id"], r["source"]): r for r in report.collect()}
    assert got[1, "small"]["short"] and got[2, "none"]["short"] and not got[1, "big"]["short"] and not got[2, "big"]["short"]
    assert 1200 <= got[1, "big"]["drawn_tokens"] <= 1215 and 50 <= got[2, "big"]["drawn_tokens"] <= 65
    drawn = mix.collect()
    uses = Counter((r["mix_id"], r["doc_id"]) for r in drawn)
    assert max(n for (m, d), n in uses.items() if m == 1 and d >= 1000) == 3 and (1, 2000) not in uses
    assert all(0 <= r["position"] <= 1 for r in drawn) and [(r["mix_id"], r["position"]) for r in drawn] == sorted((r["mix_id"], r["position"]) for r in drawn)
