"""Running headers of titles and authors whose first letters are folded together."""

import pytest

from tessera.llm import ocr


@pytest.mark.parametrize("title", ["Cloud Dienste im Test", "Risk and its Models", "“Cloud” als Dienst", "Edge Dienste im Test"])
def test_headers_are_found_whatever_their_first_letters(title):
    lines = ["Ein Satz des Textes geht hier", title, "weiter und endet dort.", "12 " + title]
    assert ocr.furniture_lines(lines, title, "Ada Maier") == {1, 3}
    assert ocr.furniture_lines(["CIoud Dienste", "Clienste im Netz", "ein Satz."], "Dienste im Netz", "Ada Maier") == {1}
    assert ocr.furniture_lines(["Clara Maier", "weiter und endet dort."], "Edge Dienste", "Clara Maier") == {0}


def test_headers_that_repeat_are_found_without_a_title():
    body = ["the stations of the network measure rain and wind and the", "values are sent to the centre every hour of the day and"]
    lines = []
    for page in range(5):
        lines += [*body, f"Journal of Applied Measurement Vol. 12, No. {page}", "kept there for ten years before they are thrown away.", f"Harbour Report 19{page}7, Berlin", str(page + 10)]
    found = ocr.furniture_lines(lines, None, None)
    assert {i for i, line in enumerate(lines) if line.startswith(("Journal", "Harbour"))} <= found and not any(lines[i] in body for i in found)
    assert ocr.furniture_lines(["12 14 19", "a b", "12 15 20", "Springer, 2001.", "3.1 Results", "12 16 21", "Springer, 2004.", "3.1 Results", "Springer, 2009.", "3.1 Results"], "T", "A") == set()


COUNTS = {"the": 60_000, "of": 40_000, "and": 30_000, "in": 20_000, "network": 300, "stations": 300, "methods": 300, "information": 900, "formation": 3, "results": 500, "exchange": 200, "korpus": 400, "portal": 400}


@pytest.mark.parametrize("seen, meant", [
    ("the networkof stationsand methods", "the network of stations and methods"), ("the in formation of stations", "the information of stations"), ("theresultsof the network", "the results of the network"),
    ("the resu1tsof methods", "the results of methods"), ("the Korpusportal of stations", "the Korpusportal of stations"), ("the ex chan ge of methods", "the exchange of methods"), ("the in-\nforma-\ntion of stations", "the information of stations"),
])
def test_words_are_split_and_merged_in_the_same_search(seen, meant):
    assert ocr.repair(seen, None, None, ocr.Lexicon(COUNTS))[0] == meant


def test_words_beyond_the_broadcast_count_too(spark):
    rows = [(i, None, None, f"the quick results of word{chr(97 + i)} and the network documents\nthe observations of the me-\nthods and the resu1ts", None, None) for i in range(20)]
    rows += [(50, None, None, "the quick observati0ns of the docu-\nments and the netw0rk of the in¬\nstitute", "the rneth0ds", None), (51, None, None, None, "", " ")]
    papers = spark.createDataFrame(rows, "paper_no long, title string, authors string, text string, abstract string, references_text string")
    whole = {(r["paper_no"], r["field"]): (r["repaired"], {tuple(c) for c in r["changes"]}) for r in ocr.repair_papers(papers).collect()}
    for words in (1, 4, 9):
        assert {(r["paper_no"], r["field"]): (r["repaired"], {tuple(c) for c in r["changes"]}) for r in ocr.repair_papers(papers, words=words).collect()} == whole
