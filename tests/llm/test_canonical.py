"""Mapping to lists without descriptions, held-out spellings, and lists cut into shards."""

import random

from tessera.llm import canonical

SCHEME = "dimension string, section string, category_key string, description string, deprecated boolean, examples array<string>, move_to string"
PLACES = ["New York", "Saint Petersburg", "Rio de Janeiro", "Los Angeles", "Buenos Aires", "Amsterdam", "Copenhagen", "Johannesburg", "Melbourne", "Vancouver", "Stockholm", "Marrakesh"]
TITLES = ["Software Engineer", "Data Scientist", "Product Manager", "Nurse Practitioner", "Account Executive", "Mechanical Engineer", "Teaching Assistant", "Warehouse Operative"]
MEANT = {
    "St. Petersburg": "Saint Petersburg", "St Petersburg": "Saint Petersburg", "Rio": "Rio de Janeiro", "New York City": "New York", "Software Engineering": "Software Engineer", "Software Engineer III": "Software Engineer",
    "Senior Data Scientist": "Data Scientist", "software enginer": "Software Engineer", "Newyork": "New York", "AMSTERDAM!": "Amsterdam", "york new": "New York", "Copenh.": "Copenhagen",
}
OTHERS = ["Newcastle", "Petersfield", "Rioja", "Softwood Merchant", "Amstetten", "Melrose", "Stocktaking", "Data Centre Cleaner", "Mechanical Watch", "Teacher"]


def reference(spark):
    rows = [("d", "active", key, None, None, [None] if i % 2 else None, None) for i, key in enumerate(PLACES + TITLES)]
    return spark.createDataFrame(rows, SCHEME)


def mapped(spark, values, **more):
    frame = spark.createDataFrame([("d", v) for v in values], "dimension string, value string")
    return {r["value"]: r["category_key"] for r in canonical.map_values(frame, reference(spark), **more).collect()}


def test_keys_without_descriptions_have_their_own_name_as_form(spark):
    got = mapped(spark, [*MEANT, *OTHERS])
    assert {v: got[v] for v in MEANT} == MEANT and all(got[v] is None for v in OTHERS)


def misspelled(draw, word):
    at = draw.randrange(1, len(word) - 1)
    return draw.choice([word[:at] + word[at + 1 :], word[:at] + draw.choice("aeinrst") + word[at:], word[:at] + word[at + 1] + word[at] + word[at + 2 :], word.upper(), word.replace(" ", "_"), " ".join(reversed(word.split())), f"{word} ({draw.choice(['sic', '2'])})"])


def test_held_out_spellings(spark):
    """Values no threshold was chosen on: at least 95 % come out as meant, and hardly any as another key."""
    draw = random.Random(23)
    values = {misspelled(draw, key): key for key in PLACES + TITLES for _ in range(25)}
    got = mapped(spark, list(values))
    right = sum(got[v.strip()] == k for v, k in values.items())
    assert right >= 0.95 * len(values) and sum(got[v.strip()] not in (None, k) for v, k in values.items()) <= 0.01 * len(values)


def test_shards_give_what_one_index_gives(spark):
    values = [*MEANT, *OTHERS, *PLACES]
    assert mapped(spark, values) == mapped(spark, values, max_postings=300)
