"""Files, manifests, the scheme's vocabulary and flat answers on small fixtures."""

import json
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.functions import labels
from tessera.operators import annotate, incremental, manifests, preflight, sections, vocabulary
from tessera.operators.decisions import DIMENSIONS, GATE
from tessera.plans import stages
from tessera.sources import pdf, readers, sinks


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def made_pdf(texts, packed=True):
    parts, kids = [], []
    for i, text in enumerate(texts):
        stream = f"BT /F1 12 Tf 72 720 Td ({text}) Tj 0 -14 Td [(sec) -20 (ond) -300 (line)] TJ ET".encode("latin-1")
        body = zlib.compress(stream) if packed else stream
        kids.append(f"{10 + 2 * i} 0 R")
        parts.append(f"{10 + 2 * i} 0 obj\n<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * i} 0 R >>\nendobj\n".encode())
        parts.append(f"{11 + 2 * i} 0 obj\n<< /Length {len(body)} {'/Filter /FlateDecode' if packed else ''} >>\nstream\n".encode() + body + b"\nendstream\nendobj\n")
    return b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [" + " ".join(kids).encode() + b"] /Count %d >>\nendobj\n" % len(texts) + b"".join(parts) + b"%%EOF"


def test_pdf_files(spark, tmp_path):
    for name, content in {"lni1/a.pdf": made_pdf(["First \\(page\\)", "caf\351"]), "lni1/b.pdf": made_pdf(["plain"], packed=False), "lni2/c.pdf": b"no file of that kind", "lni2/d.pdf": b"\n", "lni2/e.txt": b"x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {r["id"]: r for r in readers.pdf_texts(spark, f"file://{tmp_path}").collect()}
    assert got["lni1/a"]["pages"] == 2 and got["lni1/a"]["text"].split("\n")[:2] == ["First (page)", "second line"] and "café" in got["lni1/a"]["text"]
    assert got["lni1/b"]["pages"] == 1 and got["lni1/b"]["volume"] == "lni1" and got["lni2/c"]["pages"] is None and got["lni2/d"]["warnings"] == "no PDF" and len(got) == 4
    assert pdf.read(made_pdf(["one"]), min_pages=2) == (1, None, "too few pages")


def test_manifests(spark):
    sets = frame(spark, [("gold", "a", "v", "v/a.pdf", "s/a", " ", 3), ("pool", "b", "v", "v/b.pdf", "s/b", "d/b", None), ("_excluded", "c", "v", "c.pdf", "s/c", None, 1), ("gold", None, None, None, None, None, None)], "set_name string, id string, volume string, rel_path string, src string, dst string, pages int")
    assert {(r["id"], r["pdf"]) for r in manifests.candidates(sets).collect()} == {("a", "s/a"), ("b", "d/b"), ("c", "s/c")}
    confirmed = frame(spark, [("a",), ("c",), ("v/b",), ("a",)], "id string")
    rows = manifests.confirmed_sources(confirmed, sets.filter("set_name = 'gold'"), sets.filter("set_name <> 'gold'")).collect()
    assert {(r["id"], r["source"], r["staged"]) for r in rows} == {("a", "gold", True), ("c", None, False), ("v/b", "pool", True)}
    named = sets.unionByName(sets.filter("id = 'b'").withColumn("set_name", F.lit("gold_confirmed")))
    assert [r["id"] for r in manifests.preferred_ids(named, "gold").collect()] == ["b"] and {r["id"] for r in manifests.preferred_ids(sets, "gold").collect()} == {"a", None}
    with pytest.raises(ValueError):
        manifests.preferred_ids(sets, "none")
    assert manifests.pretest(sets.limit(0).withColumn("score", F.lit(1.0)), 5).count() == 0
    got = [(r["id"], r["phase"]) for r in manifests.stream(confirmed, frame(spark, [("a",), ("x",), (None,)], "id string"), frame(spark, [("c",)], "id string")).orderBy("position").collect()]
    assert sorted(got[:2]) == [("a", 0), ("v/b", 0)] and got[2:] == [("x", 1)]


def test_vocabulary(spark):
    names = frame(spark, [("annotations_modell-a-2_run_1.csv",), ("annotations_modell_run_1.csv",), ("other.csv",)], "name string")
    plan = vocabulary.rename_plan(names, frame(spark, [("modell-a-2",), ("modell-a",), ("modell",), (None,)], "model string")).collect()
    assert [(r["name"], r["renamed"], r["clash"]) for r in plan] == [("annotations_modell-a-2_run_1.csv", "annotations_modell_run_1.csv", True)]
    side = frame(spark, [("d", "k", " ", 1), ("d", "k", "second", 2), ("d", "k", "third", 3), ("d", "e", None, 1), (None, "k", "x", 1)], "dimension string, key string, description string, at int")
    assert {(r["key"], r["description"]) for r in vocabulary.sidecar_descriptions(side, ["at"]).collect()} == {("k", "second"), ("e", "")}
    own = frame(spark, [("c", "p", "d", "known;new"), ("c", "q", "d", "known; insufficient_information"), ("c", "r", "d", None)], "coder string, id string, dimension string, value string")
    known = frame(spark, [("d", "known")], "dimension string, key string")
    assert {(r["id"], r["is_new"]) for r in vocabulary.new_categories(own, known).collect()} == {("p", True), ("q", False), ("r", False)}
    held = frame(spark, [("d", "old", "text", "c")], "dimension string, key string, description string, coder string")
    assert {(r["key"], r["description"]) for r in vocabulary.with_coined(held, own, known, "c").collect()} == {("old", "text"), ("new", "")}


ANSWER = {GATE: 1, f"{GATE}_certainty": 0.9, "typology": {"techstack": {"categories": ["a", "b"], "new_suggestion": "c", "certainty": 0.5}, "evaluation": {"category": "d, e"}, "research_position": {"category": None}}}


def test_flat_answers_have_the_same_fields_in_both_ways(spark):
    rows = frame(spark, [("p", json.dumps(ANSWER)), ("q", "no json"), ("r", None), ("s", "{}")], "id string, answer string")
    got = {r["id"]: r.asDict() for r in rows.select("id", *annotate.flat_columns("answer")).collect()}
    assert {k: v for k, v in got["p"].items() if k != "id"} == annotate.flatten(ANSWER) and len(annotate.flatten(ANSWER)) == 23
    assert all(v is None for name in "qrs" for k, v in got[name].items() if k != "id") and annotate.flatten({"typology": "broken"})["techstack"] is None
    flat = rows.select("id", *annotate.flat_columns("answer"))
    assert [(r["id"], r["dimension"], r["new_suggestion"]) for r in annotate.new_suggestions(flat).collect()] == [("p", "techstack", "c")]


def test_missing_cells_are_asked_for_once(spark, tmp_path):
    scheme = frame(spark, [("techstack", True, "active", "java", "a language", False), ("techstack", True, "active", "old", "x", True), ("evaluation", False, "active", "trial", None, False)], "dimension string, multi boolean, section string, category_key string, description string, deprecated boolean")
    papers = frame(spark, [("p", "A {x} title"), ("q", None)], "id string, title string")
    todo = frame(spark, [("p", "techstack;evaluation"), ("q", ""), ("r", "evaluation")], "id string, todo string")
    prompts = {r["id"]: r["prompt"] for r in annotate.targeted_prompt(scheme, ["title"])(todo.join(papers, "id", "left")).collect()}
    assert set(prompts) == {"p", "r"} and "- java: a language" in prompts["p"] and "old" not in prompts["p"] and '"categories"' in prompts["p"] and "techstack" not in prompts["r"]
    rows = frame(spark, [(i, *[None] * 4, "kept") for i in ("p", "q", "r")], "id string, " + ", ".join(f"{d} string" for d in DIMENSIONS))
    asked = tmp_path / "asked"
    asked.mkdir()

    def client(prompt):
        (asked / str(abs(hash(prompt)))).write_text(prompt)
        return json.dumps({"typology": {"techstack": {"categories": ["java"]}, "evaluation": {"category": "trial"}}})

    path = f"file://{tmp_path}/filled"
    for _ in range(2):
        got = {r["id"]: (r["techstack"], r["evaluation"]) for r in annotate.fill_missing(rows, todo, papers, scheme, client, path, ["title"]).collect()}
        assert got == {"p": ("java", "trial"), "q": (None, "kept"), "r": (None, "trial")} and len(list(asked.iterdir())) == 2


def test_an_unreadable_checkpoint_is_no_empty_one(spark, tmp_path):
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"broken")
    items = frame(spark, [("p", "t")], "id string, title string")
    with pytest.raises(Exception):
        annotate.confirm_until(items, "id", f"file://{tmp_path}/bad", "{row['title']}", lambda p: pytest.fail("asked"), 1)
    assert annotate.written(spark, f"file://{tmp_path}/none") is None


def test_cache_lines_with_quotes(spark):
    text = ["id,volume,rel_path,src,score,pages,signals", '"a, ""x""",v,r,s,1.5,7.0,"{""k"": 1, ""l"": 2}"', 'b,v,r,s,2.5,"{""k"": 1, ""l"": 2}"', "c,v,r,s,3,nan,{}", "d,v,r,s,4,5,{},8,9", "e,v,r,s,none,1,{}", "", None]
    lines = frame(spark, [(t,) for t in text], "value string")
    got = sorted((r["id"], r["score"], r["pages"], r["signals"]) for r in incremental.read_ragged(lines).collect())
    assert got == [('a, "x"', 1.5, 7, '{"k": 1, "l": 2}'), ("b", 2.5, None, '{"k": 1, "l": 2}'), ("c", 3.0, None, "{}")]
    assert incremental.cache_lines(lines).filter("width is null").count() == 1


def test_earlier_heading_formats_come_first_wherever_they_are():
    filler = "Some words of plain text that fill the page with letters and nothing else.\n" * 5
    text = "Abstract: short\n1 Introduction\n" + filler + "1\nEinleitung\n" + filler
    assert sections.main_content(text).strip().startswith("1\nEinleitung")


def test_checkpoints_keep_every_row(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"two\nlines, and ""quotes"""\n2,short\n')
    (tmp_path / "b.csv").write_text("id,note,more\n2,again,x\n3\n")
    got = {r["id"]: (r["note"], r["more"]) for r in readers.checkpoints(spark, f"file://{tmp_path}/*.csv").collect()}
    assert got == {"1": ('two\nlines, and "quotes"', None), "2": ("short", None), "3": (None, None)}
    sinks.rewrite(frame(spark, [(1,)], "a int"), f"file://{tmp_path}/t")
    sinks.rewrite(frame(spark, [(2,)], "a int"), f"file://{tmp_path}/t")
    assert [r["a"] for r in spark.read.parquet(f"file://{tmp_path}/t").collect()] == [2] and sorted(p.name for p in tmp_path.iterdir()) == ["a.csv", "b.csv", "t"]


def test_rolling_means_over_days(spark):
    rows = frame(spark, [("a", day * 86_400 + i, float(day + i) if i % 5 else None) for day in (1, 2, 3, 9) for i in range(7)] + [("a", None, 4.0), ("b", 1, None)], "run string, t long, v double").withColumn("ts", F.timestamp_seconds("t"))
    got = {(r["run"], r["t"]): r["rolling"] for r in incremental.rolling_mean(rows, "run", ["ts", "t"], "v", 9).collect()}
    ordered = [4.0] + [float(day + i) if i % 5 else None for day in (1, 2, 3, 9) for i in range(7)]
    times = [None] + [day * 86_400 + i for day in (1, 2, 3, 9) for i in range(7)]
    for at, t in enumerate(times):
        near = [v for v in ordered[max(0, at - 8) : at + 1] if v is not None]
        assert got["a", t] == pytest.approx(sum(near) / len(near)) if near else got["a", t] is None
    assert got["b", 1] is None and labels is not None


def test_preflight_and_staging(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_text("one")
    (tmp_path / "in" / "b.pdf").write_text("two")
    root = f"file://{tmp_path}"
    preflight.require(spark, corpus=f"{root}/in")
    with pytest.raises(FileNotFoundError, match="prompt .*none"):
        preflight.require(spark, corpus=f"{root}/in", prompt=f"{root}/none")
    assert preflight.discover(spark, [root, f"{root}/in"], "a.*").endswith("in/a.pdf")
    for pattern in ("*.pdf", "c.*"):
        with pytest.raises(FileNotFoundError):
            preflight.discover(spark, [f"{root}/in"], pattern)
    files = frame(spark, [("a.pdf",), ("a.pdf",), ("b.pdf",), ("gone.pdf",), (None,)], "rel_path string")
    with pytest.raises(ValueError):
        preflight.stage_files(files, root, f"{root}/in")
    for copied in ({"a.pdf", "b.pdf"}, set()):
        got = preflight.stage_files(files, f"{root}/in", f"{root}/out").collect()
        assert {r["rel_path"] for r in got if r["copied"]} == copied and len(got) == 3
    assert (tmp_path / "out" / "b.pdf").read_text() == "two"
    assert preflight.prompt_sections("intro\n## System\nbe brief\n\n## User\nask") == {"": "intro", "System": "be brief", "User": "ask"}


def test_models_are_asked_once_about_each_paper(spark, tmp_path):
    items = frame(spark, [("p", "t"), ("q", "u")], "id string, title string")
    answer = lambda prompt: json.dumps({GATE: 1, "typology": {"techstack": {"categories": [prompt]}}})
    path = f"file://{tmp_path}/bench"
    for _ in range(2):
        got = annotate.bench(items, "{row['title']}", {"m": answer, "n": answer}, path)
        assert sorted((r["model"], r["id"], r["techstack"]) for r in got.collect()) == [("m", "p", "t"), ("m", "q", "u"), ("n", "p", "t"), ("n", "q", "u")]
    sample = frame(spark, [("q",), ("q",), ("none",)], "id string")
    for _ in range(2):
        assert [(r["id"], r["techstack"]) for r in annotate.annotate_missing(sample, items, "{row['title']}", answer, f"file://{tmp_path}/missing").collect()] == [("q", "u")]


def test_helpers_and_stages(spark):
    row = spark.range(1).select(
        labels.truncated(F.lit("abcdef"), 3).alias("t"), labels.shown(F.lit(0.12345)).alias("n"), labels.shown(F.lit(None).cast("double")).alias("d"), labels.shown(F.lit(float("nan"))).alias("x"),
        labels.same(F.array(F.lit(1), F.lit(None)), F.array(F.lit(1), F.lit(None))).alias("same"), labels.same(F.lit(None), F.lit("a")).alias("other"),
    ).first()
    assert tuple(row) == ("abc", "0.123", "-", "-", True, False)
    assert all(query in stages.QUERIES for stage in stages.STAGES for query in stage.queries)
    with pytest.raises(PermissionError):
        stages.run("annotate", spark, "/nowhere")
    with pytest.raises(KeyError):
        stages.run("none", spark, "/nowhere")
