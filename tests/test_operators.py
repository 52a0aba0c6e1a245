import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import annotate, decisions, estimator, icr, incremental, narrowing, ordering, runlog, sampling, scoring, sections, votes, workset


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_estimator(spark):
    texts = [
        (1, "Our tool is open source: github.com/x and GitHub.com/y, gitlab.org, zenodo.org, figshare.com"), (2, None), (3, ""), (4, "A prose text about birds."),
        (5, "Listing 3 shows it. Verfügbar unter example.org, frei verfügbar"),
    ]
    got = {r["doc_id"]: r for r in estimator.with_estimate(frame(spark, texts, "doc_id long, text string")).collect()}
    assert got[1]["signals"]["repo_url"] == 3 and got[1]["hits"]["repo_url"] == ["figshare.com", "github.com", "gitlab.org"]
    assert got[1]["score"] == 15 + 4 + 3 + 0.5
    assert got[2]["score"] == got[3]["score"] == got[4]["score"] == 0 and got[2]["signals"] == {}
    assert got[5]["signals"] == {"availability": 2, "code_listing": 1}
    assert len(estimator.GROUPS) == 9 and estimator.MAX_SCORE == sum(g.weight * g.cap for g in estimator.GROUPS)


def test_allocation(spark):
    sizes = frame(spark, [("a", 10), ("b", 10), ("c", 5), ("d", 0)], "volume string, size long")
    got = {r["volume"]: r["alloc"] for r in sampling.allocate(sizes, 7).collect()}
    assert got == {"a": 3, "b": 3, "c": 1, "d": 0}
    assert sum(r["alloc"] for r in sampling.allocate(sizes, 99).collect()) == 25
    assert sampling.allocate(sizes.limit(0), 3).count() == 0


def capped_by_hand(shorts, part, whole):
    kept = []
    for i, short in enumerate(shorts):
        if not short or (sum(shorts[j] for j in kept) + 1) * whole <= part * (len(kept) + 1):
            kept.append(i)
    return kept


def ordered_by_hand(shorts, part, whole):
    longs, held = [i for i, s in enumerate(shorts) if not s], [i for i, s in enumerate(shorts) if s]
    out, used = [], 0
    while longs or held:
        if held and ((used + 1) * whole <= part * (len(out) + 1) or not longs):
            out.append(held.pop(0))
            used += 1
        else:
            out.append(longs.pop(0))
    return out


def test_short_quota_against_loops(spark):
    draw = random.Random(3)
    for _ in range(3):
        shorts = [draw.random() < draw.choice([0.1, 0.5, 0.9]) for _ in range(draw.randrange(1, 80))]
        items = frame(spark, [(i, f"{i:06x}", s) for i, s in enumerate(shorts)], "id int, k string, short boolean")
        kept = sorted(r["id"] for r in workset.capped_keep(items, "k", ["id"], F.col("short")).collect())
        assert kept == capped_by_hand(shorts, 1, 5)
        order = [r["id"] for r in workset.capped_order(items, "k", ["id"], F.col("short")).orderBy("position").collect()]
        assert order == ordered_by_hand(shorts, 1, 5)


def test_running_values_over_key_ranges(spark):
    rows = [(i, f"{(i * 37) % 256:02x}{i:04x}", i % 5) for i in range(300)]
    got = ordering.running(frame(spark, rows, "id int, k string, v int"), "k", ["id"], {"s": F.col("v")}).orderBy("k").collect()
    total = 0
    for r in got:
        total += r["v"]
        assert r["s"] == total


def test_non_papers(spark):
    head = "Lecture Notes in Informatics ... Volume Editors"
    stamps = "cba doi:10.18420/a_1. text cba doi:10.18420/a_2,"
    rows = [(61, "a", None), (60, "a", None), (9, "x_Tagungsband", None), (9, "a", head), (9, "a", "Volume Editors"), (9, "a", stamps), (9, "a", "doi:10.18420/a doi:10.18420/b"), (None, None, None)]
    got = [r["r"] for r in frame(spark, [(i, *r) for i, r in enumerate(rows)], "i int, p int, n string, t string").orderBy("i").select(workset.non_paper_reason(F.col("p"), F.col("n"), F.col("t")).alias("r")).collect()]
    assert got == ["too_many_pages", None, "volume_name", "front_matter", None, "several_contributions", None, None]
    assert [r[0] for r in frame(spark, [(5,), (6,), (None,)], "p int").select(workset.is_short(F.col("p"))).collect()] == [True, False, False]


GATE = decisions.GATE


def panel(spark, rows):
    return frame(spark, rows, "id string, seat int, dimension string, value string, error boolean")


def test_votes(spark):
    rows = []
    for seat, value in enumerate(["1", "0", "1"]):
        rows.append(("majority", seat, GATE, value, False))
    rows += [("tie", 0, GATE, "0", False), ("tie", 1, GATE, "1", False), ("tie", 2, GATE, None, True)]
    rows += [("lead out", 0, GATE, None, True), ("lead out", 1, GATE, "1", False), ("lead out", 2, GATE, "0", False)]
    rows += [("none", s, GATE, None, True) for s in range(3)]
    got = {r["id"]: r for r in votes.panel_gate(panel(spark, rows)).collect()}
    assert (got["majority"]["gate"], got["majority"]["gate_votes"], got["majority"]["dissent"]) == (1, "1|0|1", GATE)
    assert (got["tie"]["gate"], got["tie"]["gate_votes"], got["tie"]["dissent"]) == (0, "0|1|-", GATE + ":tie")
    assert got["lead out"]["gate"] is None and got["lead out"]["dissent"] == GATE + ":tie"
    assert got["none"]["gate"] is None and got["none"]["dissent"] == "all_failed"
    multi = [("a", 0, "techstack", "x;y", False), ("a", 1, "techstack", "y;z", False), ("a", 2, "techstack", "z; y", False), ("b", 0, "techstack", "q;p", False), ("b", 1, "techstack", "r", False), ("b", 2, "techstack", None, False)]
    got = {r["id"]: (r["categories"], r["dissent"]) for r in votes.panel_multi(panel(spark, multi), "techstack").collect()}
    assert got == {"a": ("y;z", "techstack"), "b": ("q;p", "techstack:no_majority")}
    single = [("a", 0, "research_position", "B", False), ("a", 1, "research_position", "a", False), ("b", 0, "research_position", "", False), ("b", 1, "research_position", "c", False), ("b", 2, "research_position", "a", False)]
    got = {r["id"]: (r["winner"], r["dissent"]) for r in votes.panel_single(panel(spark, single)).collect()}
    assert got == {"a": ("b", True), "b": ("a", True)}


def coded(spark, rows):
    full = [(i, *r, False, None, None, None) for i, r in enumerate(rows)]
    return frame(spark, full, "coding_id long, coder string, id string, dimension string, final_category string, is_new boolean, model_category string, model_certainty double, coded_at timestamp")


def test_agreement_by_hand(spark):
    rows = []
    cells = [("x", "x"), ("x", "y"), ("y", "y"), (None, None), ("x;y", "y;x")]
    for i, (a, b) in enumerate(cells):
        rows += [("a", f"p{i}", GATE, "1"), ("b", f"p{i}", GATE, "1"), ("a", f"p{i}", "techstack", a), ("b", f"p{i}", "techstack", b)]
    rows += [("a", "v", GATE, "1"), ("b", "v", GATE, "0"), ("A ", "p0", "techstack", "x")]
    now = decisions.latest(coded(spark, rows))
    gates = decisions.gates(now)
    got = icr.agreement(now, gates, "a", "b").first()
    assert (got["n_shared"], got["raw_agreement"]) == (5, 0.8)
    counts = {"x": (2, 1), "y": (1, 2), "nan": (1, 1), "x;y": (1, 1)}
    pooled = {k: a + b for k, (a, b) in counts.items()}
    alpha = 1 - 9 * 2 * 1 / (100 - sum(v * v for v in pooled.values()))
    chance = sum(a * b for a, b in counts.values()) / 25
    assert got["krippendorff_alpha"] == pytest.approx(alpha, abs=6e-4) and got["cohen_kappa"] == pytest.approx((0.8 - chance) / (1 - chance), abs=6e-4)
    whole = icr.gate_agreement(gates, "a", "b").first()
    assert (whole["both"], whole["confirmed"], whole["vetoed"]) == (6, 5, 1)
    listed = {r["id"]: r["n_disagree"] for r in icr.disagreements(now, gates, "a", "b").collect()}
    assert listed == {"p1": 1, "v": 1}


def test_a_copy_of_the_reference_scores_one(spark):
    rows = [("a", f"p{i}", GATE, str(i % 2)) for i in range(4)] + [("a", f"p{i}", "techstack", "x;y") for i in (1, 3)]
    now = decisions.latest(coded(spark, rows))
    gold = decisions.gates(now).select("id", "gate")
    predicted = now.withColumnRenamed("coder", "model")
    pairs = scoring.gate_pairs(gold, predicted)
    dims = scoring.dimension_scores(scoring.dimension_pairs(gold, now.drop("coder"), predicted))
    got = scoring.overall_scores(scoring.gate_scores(pairs), dims, pairs).first()
    assert (got["gate_score"], got["typology"], got["overall"], got["coverage"]) == (1.0, 1.0, 1.0, 1.0)


def test_target_growth_and_cursors(spark):
    rows = frame(spark, [(89,), (90,), (109,), (110,), (0,)], "c long")
    assert [r[0] for r in rows.select(incremental.grown_target(F.lit(100), F.col("c"))).collect()] == [100, 120, 120, 140, 100]
    items = frame(spark, [(i, f"{i:04x}", i % 2 == 0) for i in range(10)], "id int, k string, hit boolean")
    assert sorted(r["id"] for r in incremental.until_target(items, "k", ["id"], F.col("hit"), 2).collect()) == [0, 1, 2]
    assert incremental.until_target(items.limit(0), "k", ["id"], F.col("hit"), 2).count() == 0
    lines = frame(spark, [("id,volume,rel_path,src,score,pages,signals",), ("a,v,r,s,1.5,7,{}",), ("b,v,r,s,2.5,{}",), ("c,v,r,s,x,{}",), ("broken,line",), ("",)], "value string")
    assert sorted((r["id"], r["score"], r["pages"]) for r in incremental.read_ragged(lines).collect()) == [("a", 1.5, 7), ("b", 2.5, None)]


def test_three_way_merge(spark):
    schema = "k string, d string"
    base = frame(spark, [("same", "1"), ("mine", "1"), ("theirs", "1"), ("both", "1"), ("gone", "1")], schema)
    work = frame(spark, [("same", "1"), ("mine", "2"), ("theirs", "1"), ("both", "2"), ("new", "n")], schema)
    canonical = frame(spark, [("same", "1"), ("mine", "1"), ("theirs", "3"), ("both", "3"), ("gone", "1")], schema)
    got = {r["k"]: (r["d"], r["outcome"]) for r in narrowing.three_way_merge(work, base, canonical, ["k"], "d").collect()}
    assert got == {"same": ("1", "unchanged"), "mine": ("2", "updated"), "theirs": ("3", "unchanged"), "both": ("3", "conflict"), "gone": ("1", "deleted"), "new": ("n", "added")}


def test_trailing_counts_against_loops(spark):
    draw = random.Random(1)
    times = [draw.randrange(0, 9000) for _ in range(120)] + [3600, 3600, 7200]
    rows = frame(spark, list(enumerate(times)), "id int, s int").select("id", F.timestamp_seconds("s").alias("ts"))
    got = {r["id"]: (r["m"], r["h"]) for r in runlog.trailing_counts(rows, "ts", ["id"], {"m": 60, "h": 3600}).collect()}
    for i, t in enumerate(times):
        assert got[i] == (sum(t - 60 <= u <= t for u in times), sum(t - 3600 <= u <= t for u in times))


def test_logs(spark):
    lines = [("2026-01-01 10:00:00 INFO RESPONSE id=a attempt=1 chars=10 body={x}",), ("2026-01-01 10:00:01 INFO PARSE-FAIL id=a attempt=1",), ("noise",)]
    got = runlog.parse_log(frame(spark, lines, "value string")).orderBy("ts").collect()
    assert [(r["event"], r["id"], r["attempt"], r["chars"]) for r in got] == [("RESPONSE", "a", 1, 10), ("PARSE-FAIL", "a", 1, None)]
    bars = [(1, " 5%|#   | 5/100 [0"), (2, "10%|##  | 10/100 [0"), (3, "end")]
    assert runlog.last_progress(frame(spark, bars, "at int, line string"), "line", "at").first()["done"] == 10


RAW = """A Study of Sensor Networks
Klaus Wannemacher, Anna Berg
Universität Beispiel
Abstract: This is the abstract of the paper.
1 Introduction
The body begins here and is long enough to be more than half of the whole text of this small example paper.
It goes on for a while with words and words.
References
[1] Someone: Something. 2001.
[BB01] Other: Thing.
449"""


def test_sections():
    assert sections.title(RAW) == "A Study of Sensor Networks"
    assert sections.authors(RAW) == "Klaus Wannemacher, Anna Berg"
    assert sections.abstract(RAW) == "This is the abstract of the paper."
    assert sections.main_content(RAW).strip().startswith("1 Introduction") and "References" not in sections.main_content(RAW)
    assert sections.references(RAW) == "[1] Someone: Something. 2001.\n[BB01] Other: Thing."
    assert sections.paper_record(None)[-1] is True and sections.main_content("no structure at all") is None


def test_corruption_native_and_python_agree(spark):
    texts = ["", "E4M pM1 c4 " * 40, "plain words " * 40, "a=b;c=d;" * 50, "x\x81y words here", "\x01\x02\x03abc", "1234 5678 90", None]
    got = [r[0] for r in frame(spark, [(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(sections.corrupted(F.col("t"))).collect()]
    assert got == [sections.looks_corrupted(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=400))
def test_sections_take_any_text(text):
    record = sections.paper_record(text)
    assert len(record) == 6


def test_answers_and_retries():
    assert annotate.first_json('Sure: {"a": 1} trailing') == {"a": 1}
    assert annotate.first_json('x ```json\n{"a": "b\nc"}\n```')["a"] == "b\nc"
    with pytest.raises(ValueError):
        annotate.first_json("nothing")
    flat = annotate.flatten({GATE: {"value": 1}, "typology": {"techstack": {"categories": ["a", "b"]}, "evaluation": {"category": "c"}}})
    assert (flat[GATE], flat["techstack"], flat["evaluation"], flat["software_type"]) == ("1", "a;b", "c", None)
    calls = []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise annotate.Retry("429")
        return "ok"

    assert annotate.ask(flaky, "p", sleep=lambda s: None) == ("ok", None) and len(calls) == 3
    assert annotate.ask(lambda p: "", "p", attempts=2, sleep=lambda s: None) == (None, "blank answer")


def test_confirm_until(spark, tmp_path):
    items = frame(spark, [(f"i{i}", i) for i in range(9)], "id string, n int")
    answer = lambda prompt: '{"' + GATE + '": ' + ("1" if int(prompt) % 2 else "0") + "}"
    assert annotate.confirm_until(items, "n", str(tmp_path / "ck"), "{row['n']}", answer, target=2, batch=2) == 2
    assert spark.read.parquet(str(tmp_path / "ck")).count() == 4


def test_streams(spark, tmp_path):
    from tessera.streaming import jobs

    rows = frame(spark, [("a", 0), ("a", 1), ("b", 5), ("a", 0)], "id string, s int").select("id", F.timestamp_seconds("s").alias("staged_at"))
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    jobs.run_once(jobs.new_items(spark, str(tmp_path / "in"), "id string, staged_at timestamp"), str(tmp_path / "c1"), lambda df, n: seen.extend(r["id"] for r in df.collect()))
    assert sorted(seen) == ["a", "b"]
    limited = jobs.limited(spark.readStream.schema("id string, staged_at timestamp").parquet(str(tmp_path / "in")), "id", "staged_at", most=2, seconds=10)
    allowed = []
    jobs.run_once(limited, str(tmp_path / "c2"), lambda df, n: allowed.extend((r["id"], r["allowed"]) for r in df.collect()))
    assert sorted(allowed) == [("a", False), ("a", True), ("a", True), ("b", True)]


def test_sinks(spark, tmp_path):
    from tessera.sources import sinks

    path = str(tmp_path / "t")
    sinks.rewrite(frame(spark, [(1,)], "a int"), path)
    sinks.rewrite(frame(spark, [(2,)], "a int"), path, backup=True)
    assert [r["a"] for r in spark.read.parquet(path).collect()] == [2] and [r["a"] for r in spark.read.parquet(path + ".bak").collect()] == [1]
    assert sinks.markdown(frame(spark, [(1, None)], "a int, b string")) == "| a | b |\n|---|---|\n| 1 | - |"
