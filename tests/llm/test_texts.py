"""Languages, scanned text and residue on small fixtures."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import languages, ocr, residue

DE = "Die Kinder spielen heute im Garten. Der Zug kommt später als geplant. Wir haben das Buch nicht gefunden. Das Wetter wird morgen besser."
EN = "The children are playing in the garden. The train arrives later than planned. We have not found the book. The weather will be better tomorrow."
NL = "De kinderen spelen vandaag in de tuin. De trein komt later dan verwacht. Wij hebben het boek niet gevonden. Het weer wordt morgen beter."


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_languages(spark):
    rows = [
        (1, "Deutsch", None, DE, "x"), (2, "en_US", DE, EN, "x"), (3, "??", None, DE + " " + NL, "x"), (4, None, "", "   ", "x"), (5, "de-DE", None, DE + " The end is near now.", "x"), (6, "german", EN, None, "x"),
        (7, "nld", None, "12 34 56", "x"), (8, "fr", None, (DE + " ") * 200, "x"),
    ]
    papers = frame(spark, rows, "paper_no long, lang string, abstract string, text string, segments string")
    found = languages.detect_languages(papers)
    got = sorted((r["paper_no"], r["field"], r["lang"]) for r in languages.misdeclared(found).collect())
    assert got == [(2, "abstract", "de"), (3, "text", "de"), (3, "text", "nl"), (6, "abstract", "en"), (8, "text", "de")]
    mixed = [r for r in found.collect() if r["paper_no"] == 3][0]["segments"]
    assert {s["lang"] for s in mixed} == {"de", "nl"} and all(0 <= s["confidence"] <= 1 for s in mixed)
    assert languages.detect_languages(papers.limit(0)).count() == 0


def test_held_out_sentences():
    prototypes = languages.train([DE, EN, NL])
    nearest = languages.Nearest(prototypes)
    for code, text in (("de", "Am Abend gehen die Leute nach Hause und essen."), ("en", "In the evening people go home and eat their dinner."), ("fr", "Le soir les gens rentrent chez eux pour manger ensemble."), ("es", "Por la noche la gente vuelve a casa para cenar con su familia."), ("nl", "In de avond gaan de mensen naar huis om te eten.")):
        assert languages.segments_of(text, nearest)[0][2] == code


def test_the_kept_products_are_the_bundles_products():
    prototypes = languages.train([])
    grams, starts, ends = languages.sentence_grams(EN, languages.sentence_spans(EN))
    bundles = [languages.Space().bundle(grams[a:b]) for a, b in zip(starts, ends)]
    products = languages.Nearest(prototypes).products_of(grams, starts, ends)
    assert [b @ p for b in bundles for p in prototypes] == pytest.approx(products.ravel().tolist(), rel=1e-3, abs=1e-2)


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=300))
def test_any_text_has_segments_inside_it(text):
    nearest = languages.Nearest(languages.unit(languages.np.ones((5, 64))))
    for start, end, _, confidence, _ in languages.segments_of(text, nearest):
        assert 0 <= start < end <= len(text) and 0 <= confidence <= 1


PROSE = "the modern framework documents the scientific results and the observations of the whole experiment"


def scanned(spark):
    clean = [(i, None, None, "\n".join([PROSE] * 4), None, None, "x") for i in range(20)]
    dirty = "the modern frame-\nLNI12, Workshopband 7\nwork documents the scientific resu1ts\nand the observati0ns of the whole ex¬\nperiment.\n\n- 12 -\n\n3.1 Results\n\nthe client-\nside results and the mess- und observations.\n12 14 19"
    rows = clean + [(50, "A Study of Things", "A. Berg, B. Tal", dirty, "12 A Study of…\nthe whole\nA. Berg, B. Tal   13\nexperiment", "", "x"), (51, None, None, None, " ", None, "x"), (52, None, None, "x" * 20_000, None, None, "x")]
    return frame(spark, rows, "paper_no long, title string, authors string, text string, abstract string, references_text string, changes string")


def test_scanned_text(spark):
    got = {(r["paper_no"], r["field"]): r for r in ocr.repair_papers(scanned(spark)).collect()}
    changes = {(c["kind"], c["item"]) for c in got[50, "text"]["changes"]}
    assert {("hyphen", "framework"), ("hyphen", "experiment"), ("char", "results"), ("char", "observations"), ("line", "LNI12, Workshopband 7"), ("line", "- 12 -")} <= changes
    assert not any(k == "line" and v in ("3.1 Results", "12 14 19") for k, v in changes)
    assert got[50, "text"]["repaired"].startswith("the modern framework documents the scientific results and the observations of the whole experiment.")
    assert {c["item"] for c in got[50, "abstract"]["changes"] if c["kind"] == "line"} == {"12 A Study of…", "A. Berg, B. Tal 13"} and got[50, "abstract"]["repaired"] == "the whole experiment"
    assert (51, "text") not in got and got[0, "text"]["changes"] == [] and got[52, "text"]["repaired"] == "x" * 20_000
    assert ocr.repair_papers(scanned(spark).limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab -\n.1¬­", max_size=200))
def test_repair_takes_any_text(text):
    repaired, changes = ocr.repair(text, None, None, ocr.Lexicon({"ab": 50, "aab": 3}))
    assert isinstance(repaired, str) and len(changes) == len(set(changes))


REAL = "The build dashboard documents the results of the survey. " * 4
CASES = {
    "{{title}}, <your summary>, ${VOLUME}": "template", "Title: {{ paper.TITLE }}\nAuthors: @@x@@\n\nAbstract\n[INSERT VOLUME HERE]": "template", "Replace this paragraph with the text of your contribution.": "template",
    "404 – the requested document was not found on this server. Back to the start page": "error", "FEHLER 503: DER VOLLTEXT IST VORÜBERGEHEND NICHT ERREICHBAR.": "error",
    "Please enable JavaScript in your browser!\nHome | Volumes | Search | Help": "script", "Veuillez activer JavaScript puis rechargez la page! Retour": "script", "Lorem ipsum dolor odio lectus. Magna sapien mauris nulla. " * 3: "filler",
    REAL: None, "Home | Volumes | Search | Help\n" + REAL: None, REAL + 'The crawler recognises pages that say "Please enable JavaScript" and loads them again.': None, REAL + "The set {x} and the macro __init__ are explained.": None, REAL + "Requests that end with 404 Not Found are logged.": None,
    "": None, "   ": None, "1.5/3; 2.6/4;" * 400: None,
}


def test_residue(spark):
    rows = [(i, t, "x") for i, t in enumerate(CASES)] + [(99, None, "x")]
    got = {r["doc_id"]: r for r in residue.mark_residue(frame(spark, rows, "doc_id long, text string, residue string")).collect()}
    for i, (text, kind) in enumerate(CASES.items()):
        assert (got[i]["kind"] if got[i]["excluded"] else None) == kind, text[:60]
    assert not got[99]["excluded"] and len(got) == len(rows)
    assert residue.mark_residue(frame(spark, [], "doc_id long, text string")).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200))
def test_residue_takes_any_text(text):
    share, _ = FINDER.measure(text)
    assert 0 <= share <= 1


FINDER = residue.Finder()
