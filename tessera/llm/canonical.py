"""Problem 2: map freely typed values to the keys of a reference list.

Values are deduplicated and normalised; candidates come from an inverted index of the reference list's character 2- and
3-grams, scored by cosine with grams weighted by their length and rarity. A key is accepted above a threshold and a
margin over the second best key. Below a level at which the score alone is sure, an exact check must explain what
differs: single letters, words that one side has more, endings or shortened words. Everything else is unmatched.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import bounded_broadcast, salted_join, spread

#: A key must score this much, and this much more than any other key.
THRESHOLD = 0.25
MARGIN = 0.05
#: From this score on nothing else is asked; below, the exact check decides.
SURE = 0.85
#: Whole words that one side has more need a score of this much.
CONTAINED = 0.35
#: Letters that may differ, as a share of the longer side; two always may.
EDIT_SHARE = 0.15
#: Postings of the index that a task holds; a longer reference list is cut into shards by key.
MAX_POSTINGS = 2_000_000
BLOCK_VALUES = 50_000

#: Weight of a gram by its length.
GRAM_WEIGHT = {2: 1.0, 3: 1.25}
#: Cyrillic letters that look like Latin ones.
LOOKALIKE = ("аеорсухіѕјһАВЕКМНОРСТХУІЅЈ", "aeopcyxisjhABEKMHOPCTXYISJ")
#: Words that decorate a value without changing what it means.
HEDGES = "kategorie|category|label|vermutlich|evtl|eventuell|wohl|vielleicht|eher|probably|maybe|perhaps|unsicher"
SPELLED = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}
NULL_WORDS = ("", "nan", "none", "null")


def _misdecoded() -> dict[str, str]:
    """Letters as they look when their UTF-8 bytes were read as Windows-1252."""
    found = {}
    for code in range(0xC0, 0x180):
        letter = chr(code)
        try:
            found[letter.encode().decode("cp1252")] = letter
        except UnicodeDecodeError:
            continue
    return {k: v for k, v in found.items() if v in "äöüÄÖÜßéèêëàâáçñíìîïóòôúùûÉ"}


def _base_letters() -> tuple[str, str]:
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x180)]
    kept = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept)


def strip_white(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def fold(value: Column) -> Column:
    """Lower-case ASCII form: wide letters, look-alikes, wrong decodings, invisible characters and accents undone."""
    text = value
    for wrong, right in _misdecoded().items():
        text = F.replace(text, F.lit(wrong), F.lit(right))
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    text = F.translate(text, wide, "".join(chr(ord(c) - 0xFEE0) for c in wide))
    text = F.translate(text, *LOOKALIKE)
    text = F.lower(F.regexp_replace(text, r"[\x{00AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]", ""))
    for letter, spelled in SPELLED.items():
        text = F.replace(text, F.lit(letter), F.lit(spelled))
    return F.translate(text, *_base_letters())


def undecorated(value: Column, dimension: Column) -> Column:
    """Folded value without list marks, quotes, the dimension's name, hedges and remarks around it."""
    text = F.regexp_replace(fold(value), r"^[^\p{L}\p{N}]+", "")
    text = F.regexp_replace(text, r"^\d+[.)]\s*", "")
    text = F.when(F.startswith(text, F.concat(dimension, F.lit(":"))), F.ltrim(F.substr(text, F.length(dimension) + 2))).otherwise(text)
    text = F.regexp_replace(text, rf"(?U)^(?:{HEDGES})\b\.?:?\s+(?=\S)", "")
    text = F.regexp_replace(text, r"(?U)\s*[(\[][^)\]]*[)\]]\s*$", "")
    return F.regexp_replace(text, rf"(?U)\s+/\s+(?:{HEDGES})\s*$", "")


def with_words(values: DataFrame) -> DataFrame:
    """Adds ``words`` (runs of letters and digits, blanks between them) and ``cut`` (the value ends in a full stop)."""
    return (
        values.withColumn("__plain", undecorated(F.col("value"), F.col("dimension")))
        .withColumn("words", F.array_join(F.regexp_extract_all("__plain", F.lit(r"[a-z0-9]+"), 0), " "))
        .withColumn("cut", F.rtrim("__plain").endswith(".")).drop("__plain")
    )


def reference_forms(reference: DataFrame) -> DataFrame:
    """(dimension, category_key, words): each form that stands for a key: the key, its description, its examples, deprecated keys that name it."""
    active = reference.filter("section = 'active' and not coalesce(deprecated, false) and category_key is not null")
    described = F.filter(F.concat(F.array("category_key", "description"), F.coalesce("examples", F.array().cast("array<string>"))), lambda d: d.isNotNull())
    sides = F.flatten(F.transform(described, lambda d: F.concat(F.array(d), F.split(d, " / "))))
    own = active.select("dimension", "category_key", F.explode(F.array_distinct(sides)).alias("value"))
    moved = reference.filter("coalesce(deprecated, false) and move_to is not null and category_key is not null").select("dimension", F.col("move_to").alias("category_key"), F.col("category_key").alias("value"))
    forms = with_words(own.unionByName(moved).distinct()).filter("words <> '' and dimension is not null")
    return forms.select("dimension", "category_key", "words").distinct()


def grams_of(text: str, closed: bool = True) -> list[tuple[str, int]]:
    """(gram, place of its last character) over the text with a mark at its start and, where ``closed``, at its end."""
    marked = f"^{text}$" if closed else f"^{text}"
    return [(marked[i : i + n], i + n) for n in GRAM_WEIGHT for i in range(len(marked) - n + 1)]


# --- the exact check -----------------------------------------------------------------------------------------------


def edit_distance(a: str, b: str, most: int) -> int:
    """Edits of single characters and swaps of neighbours (also with edits in between), or more than ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = len(a) + len(b)
    table = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        table[i + 1][1] = i
    for j in range(len(b) + 1):
        table[1][j + 1] = j
    seen: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        met, row_best = 0, far
        for j, y in enumerate(b, 1):
            row, col = seen.get(y, 0), met
            if x == y:
                met = j
            cell = min(table[i][j] + (x != y), table[i + 1][j] + 1, table[i][j + 1] + 1, table[row][col] + (i - row - 1) + 1 + (j - col - 1))
            table[i + 1][j + 1] = cell
            row_best = min(row_best, cell)
        if row_best > most + 2:
            return most + 1
        seen[x] = i
    return table[-1][-1]


def _same_word(a: str, b: str) -> bool:
    """Equal up to an ending of three letters, or one a shortening of the other that keeps its first and last letter."""
    short, long = sorted((a, b), key=len)
    if len(short) >= 4 and long.startswith(short) and len(long) - len(short) <= 3:
        return True
    if not 2 <= len(short) <= 3 or short[0] != long[0] or short[-1] != long[-1]:
        return False
    rest = iter(long)
    return all(c in rest for c in short)


def explained(value: str, form: str, score: float) -> bool:
    """Whether a few letters, more words on one side, endings or shortened words are all that differs; both are words with blanks."""
    a, b = value.replace(" ", ""), form.replace(" ", "")
    sorted_a, sorted_b = "".join(sorted(value.split())), "".join(sorted(form.split()))
    most = max(2, int(EDIT_SHARE * max(len(a), len(b))))
    if edit_distance(a, b, most) <= most or (sorted_a, sorted_b) != (a, b) and edit_distance(sorted_a, sorted_b, most) <= most:
        return True
    words, others = Counter(value.split()), Counter(form.split())
    shared = words & others
    if sum(map(len, shared)) < 3:
        return False
    more, fewer = words - shared, others - shared
    if not more or not fewer:
        return score >= CONTAINED
    left, right = sorted(more.elements()), sorted(fewer.elements())
    return len(left) == len(right) and all(map(_same_word, left, right))


# --- the index -----------------------------------------------------------------------------------------------------


class Index:
    """Gram postings of one dimension's forms, in both views: words run together, and words sorted before."""

    def __init__(self, forms: list[tuple[str, str]], rarity: dict[str, float], unseen: float):
        """``forms`` are (key, words); ``rarity`` gives a gram's weight before its length's, ``unseen`` that of other grams."""
        self.keys = sorted({k for k, _ in forms})
        place = {k: i for i, k in enumerate(self.keys)}
        texts = [(place[k], w, "j", w.replace(" ", "")) for k, w in forms] + [(place[k], w, "s", "".join(sorted(w.split()))) for k, w in forms]
        self.owner = np.array([t[0] for t in texts])
        self.words = [t[1] for t in texts]
        self.view = np.array([t[2] == "s" for t in texts])
        self.texts = [t[3] for t in texts]
        self.lengths = np.array([len(t) for t in self.texts])
        self.unseen = unseen
        posted: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for number, text in enumerate(self.texts):
            for gram, end in grams_of(text):
                posted[gram].append((number, end))
        self.number = {g: i for i, g in enumerate(posted)}
        self.weight = np.array([rarity[g] * GRAM_WEIGHT[len(g)] for g in posted])
        self.sizes = np.array([len(p) for p in posted.values()])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.form = np.array([f for p in posted.values() for f, _ in p])
        self.end = np.array([e for p in posted.values() for _, e in p])
        self.norms = np.array([self.norm(Counter(g for g, _ in grams_of(t))) for t in self.texts])
        self._cut_norms: dict[tuple[int, int], float] = {}

    def norm(self, grams: Counter[str]) -> float:
        total = 0.0
        for gram, n in grams.items():
            at = self.number.get(gram)
            weight = self.weight[at] if at is not None else self.unseen * GRAM_WEIGHT[len(gram)]
            total += (n * weight) ** 2
        return math.sqrt(total)

    def cut_norm(self, form: int, length: int) -> float:
        known = self._cut_norms.get((form, length))
        if known is None:
            known = self._cut_norms[form, length] = self.norm(Counter(g for g, _ in grams_of(self.texts[form][:length], closed=False)))
        return known

    def dots(self, queries: list[tuple[Counter[str], float, int]], bound: float) -> np.ndarray:
        """Products of each query (grams, norm, place up to which a form is met) with every form.

        Grams go from rare to common; those at the end whose length is below ``bound`` of the query's cannot lift a form
        over it that shares none of the grams before. So candidates come from the first part alone, and the common
        grams, which have the longest postings, are looked up for candidates only.
        """
        count = len(self.texts)
        first, last = [], []
        for row, (grams, norm, _) in enumerate(queries):
            known = sorted(((self.weight[at], at, n) for g, n in grams.items() if (at := self.number.get(g)) is not None), reverse=True)
            rest, budget = 0.0, (bound * norm) ** 2
            split = len(known)
            while split and rest + (known[split - 1][0] * known[split - 1][2]) ** 2 < budget:
                split -= 1
                rest += (known[split][0] * known[split][2]) ** 2
            first += [(row, at, n) for _, at, n in known[:split]]
            last += [(row, at, n) for _, at, n in known[split:]]
        found = np.zeros(len(queries) * count)
        self._add(found, first, queries, None)
        if last:
            self._add(found, last, queries, found > 0)
        return found.reshape(len(queries), count)

    def _add(self, found: np.ndarray, wanted: list[tuple[int, int, int]], queries: list, among: np.ndarray | None) -> None:
        if not wanted:
            return
        rows, grams, times = (np.array(x) for x in zip(*wanted))
        sizes = self.sizes[grams]
        at = np.repeat(self.starts[grams] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        row, weight = np.repeat(rows, sizes), np.repeat(times * self.weight[grams] ** 2, sizes)
        limits = np.array([q[2] for q in queries])
        cell = row * len(self.texts) + self.form[at]
        keep = self.end[at] <= limits[row]
        if among is not None:
            keep &= among[cell]
        found += np.bincount(cell[keep], weights=weight[keep], minlength=len(found))

    def best(self, values: list[tuple[str, bool]], threshold: float, margin: float) -> list[list[tuple[float, str, str, str]]]:
        """For each (words, cut) its two best keys as (score, key, words of the form met, words of the value), best first."""
        queries, owners = [], []
        for number, (words, cut) in enumerate(values):
            text = words.replace(" ", "")
            queries.append((Counter(g for g, _ in grams_of(text, not cut)), text, len(text) + 1 if cut else 1 << 40))
            owners.append((number, False))
            if " " in words and not cut:
                ordered = "".join(sorted(words.split()))
                queries.append((Counter(g for g, _ in grams_of(ordered)), ordered, 1 << 40))
                owners.append((number, True))
        tops: list[dict[int, tuple[float, int]]] = [{} for _ in values]
        step = max(1, 4_000_000 // max(len(self.texts), 1))
        for begin in range(0, len(queries), step):
            part = queries[begin : begin + step]
            norms = np.array([self.norm(grams) for grams, _, _ in part])
            dots = self.dots([(grams, norm, limit) for (grams, _, limit), norm in zip(part, norms)], max(threshold - margin, 0.0))
            for k, (_, text, limit) in enumerate(part):
                number, ordered = owners[begin + k]
                met = np.flatnonzero((dots[k] > 0) & (self.view == ordered))
                if not len(met) or norms[k] == 0:
                    continue
                own = self.norms[met].copy()
                if limit < 1 << 40:
                    for i in np.flatnonzero(self.lengths[met] > len(text)):
                        own[i] = self.cut_norm(int(met[i]), len(text))
                scores = dots[k][met] / (own * norms[k])
                for i in np.flatnonzero(scores >= threshold - margin):
                    key, score = int(self.owner[met[i]]), float(scores[i])
                    if score > tops[number].get(key, (0.0, 0))[0]:
                        tops[number][key] = score, int(met[i])
        out = []
        for (words, cut), top in zip(values, tops):
            ranked = sorted(((score, self.keys[key], form) for key, (score, form) in top.items()), key=lambda r: (-r[0], r[1]))[:2]
            shown = [self.texts[f][: len(words.replace(" ", ""))] if cut else self.words[f] for _, _, f in ranked]
            out.append([(score, key, form, words.replace(" ", "") if cut else words) for (score, key, _), form in zip(ranked, shown)])
        return out


def rarities(forms: pd.DataFrame) -> dict[str, tuple[dict[str, float], float]]:
    """For each dimension the weight of each gram, the smaller the more keys have it, and that of a gram no key has."""
    found = {}
    for dimension, own in forms.groupby("dimension"):
        holders: dict[str, set[str]] = defaultdict(set)
        for key, words in zip(own["category_key"], own["words"]):
            for text in {words.replace(" ", ""), "".join(sorted(words.split()))}:
                for gram, _ in grams_of(text):
                    holders[gram].add(key)
        keys = own["category_key"].nunique()
        found[dimension] = {g: math.log(1 + keys / len(h)) for g, h in holders.items()}, math.log(1 + keys)
    return found


def accepted(ranked: list[tuple[float, str, str, str]], threshold: float, margin: float, sure: float) -> tuple[str | None, float]:
    """(key or None, score of the best key) of a value's two best keys."""
    if not ranked:
        return None, 0.0
    score, key, form, words = ranked[0]
    second = ranked[1][0] if len(ranked) > 1 else 0.0
    if score < threshold or score - second < margin:
        return None, 0.0
    return (key, score) if score >= sure or explained(words, form, score) else (None, 0.0)


FOUND = "dimension string, value string, ranked array<struct<score: double, category_key: string, form: string, words: string>>"


def _rank(indexes: dict[str, Index], rows: pd.DataFrame, threshold: float, margin: float) -> pd.DataFrame:
    ranked: dict[tuple[str, str, bool], list] = {}
    for dimension, own in rows.groupby("dimension", sort=False):
        index = indexes.get(dimension)
        forms = list(dict.fromkeys(zip(own["words"], own["cut"].astype(bool))))
        found = index.best(forms, threshold, margin) if index else [[] for _ in forms]
        ranked.update(((dimension, *form), best) for form, best in zip(forms, found))
    cells = [[dict(zip(("score", "category_key", "form", "words"), r)) for r in ranked[d, w, bool(c)]] for d, w, c in zip(rows["dimension"], rows["words"], rows["cut"])]
    return pd.DataFrame({"dimension": rows["dimension"], "value": rows["value"], "ranked": pd.Series(cells, index=rows.index, dtype=object)})


def rank_keys(formed: DataFrame, reference: DataFrame, threshold: float, margin: float, max_postings: int) -> DataFrame:
    """(dimension, value, ranked): the two best keys of every value by one index, or by shards of the keys where it would be too large.

    Shards are cut by key, so the best two of all shards' best two are the best two; weights are those of the whole list.
    """
    forms = reference_forms(reference)
    postings = forms.agg(F.coalesce(F.sum(F.length("words") * 4 + 2), F.lit(0)).alias("n")).first()["n"]

    if postings <= max_postings:
        listed = forms.toPandas()
        weights = rarities(listed)
        own = {d: list(zip(g["category_key"], g["words"])) for d, g in listed.groupby("dimension")}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            indexes = {d: Index(f, *weights[d]) for d, f in own.items()}
            for batch in batches:
                yield _rank(indexes, batch, threshold, margin)

        return spread(formed, "dimension", "words").mapInPandas(run, FOUND)

    keys = forms.groupBy("dimension").agg(F.count_distinct("category_key").alias("keys"))
    texts = F.array_distinct(F.array(F.replace("words", F.lit(" "), F.lit("")), F.array_join(F.array_sort(F.split("words", " ")), "")))
    marked = forms.select("dimension", "category_key", F.explode(texts).alias("t")).select("dimension", "category_key", F.concat(F.lit("^"), "t", F.lit("$")).alias("t"))

    def cuts(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length("t") - (n - 1)), lambda i: F.substr("t", i, F.lit(n)))

    grams = marked.select("dimension", "category_key", F.explode(F.concat(*map(cuts, GRAM_WEIGHT))).alias("gram"))
    rare = grams.groupBy("dimension", "gram").agg(F.count_distinct("category_key").alias("held")).join(keys, "dimension").select("dimension", "gram", F.log(1 + F.col("keys") / F.col("held")).alias("weight"))
    own_grams = grams.distinct().join(rare, ["dimension", "gram"]).groupBy("dimension", "category_key").agg(F.collect_list(F.struct("gram", "weight")).alias("grams"))
    shards = postings // max_postings + 1
    whole = forms.join(own_grams, ["dimension", "category_key"]).join(keys, "dimension").withColumn("shard", F.pmod(F.xxhash64("dimension", "category_key"), shards).cast("int"))
    blocks = formed.count() // BLOCK_VALUES + 1
    whole = whole.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(int(blocks - 1)))))
    placed = formed.withColumn("block", F.pmod(F.xxhash64("dimension", "words"), blocks).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(int(shards - 1)))))

    def score(key: tuple, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        indexes = {}
        for dimension, g in own.groupby("dimension"):
            rarity = {e["gram"]: e["weight"] for grams in g["grams"] for e in grams}
            indexes[dimension] = Index(list(zip(g["category_key"], g["words"])), rarity, math.log(1 + g["keys"].iloc[0]))
        return _rank(indexes, rows, threshold, margin)

    parts = placed.groupBy("shard", "block").cogroup(whole.groupBy("shard", "block")).applyInPandas(score, FOUND)
    together = F.slice(F.array_sort(F.flatten(F.collect_list("ranked")), lambda a, b: F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1)).when(a["category_key"] < b["category_key"], -1).otherwise(1)), 1, 2)
    return parts.groupBy("dimension", "value").agg(together.alias("ranked"))


def _accept(threshold: float, margin: float, sure: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory: dict[tuple, tuple[str | None, float]] = {}
        for batch in batches:
            picked = []
            for ranked in batch["ranked"]:
                rows = tuple((r["score"], r["category_key"], r["form"], r["words"]) for r in ranked)
                if rows not in memory:
                    if len(memory) > 100_000:
                        memory.clear()
                    memory[rows] = accepted(list(rows), threshold, margin, sure)
                picked.append(memory[rows])
            yield pd.DataFrame({"dimension": batch["dimension"], "value": batch["value"], "category_key": pd.Series([p[0] for p in picked], index=batch.index, dtype=object), "score": [float(p[1]) for p in picked]})

    return run


def map_values(
    values: DataFrame, reference: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN, sure: float = SURE, max_postings: int = MAX_POSTINGS
) -> DataFrame:
    """(dimension, value, category_key, score) for every distinct (dimension, value); category_key is null if unmatched.

    Null words, empty values and values without letters or digits are unmatched with score 0; null rows are left out.
    Of keys that score alike neither is taken (the margin). A key without description or examples has its own name as
    its only form. Columns of ``values`` other than the two are ignored.
    """
    distinct = values.filter("dimension is not null and value is not null").select("dimension", strip_white(F.col("value")).alias("value")).distinct()
    usable = (F.col("words") != "") & ~F.lower("value").isin(*NULL_WORDS)
    formed = with_words(distinct).withColumn("words", F.when(usable, F.col("words")).otherwise(F.lit("")))
    return rank_keys(formed, reference, threshold, margin, max_postings).mapInPandas(_accept(threshold, margin, sure), "dimension string, value string, category_key string, score double")


def typed_values(codings: DataFrame, suggestions: DataFrame, candidates: DataFrame, gate: str = "label_research_software") -> DataFrame:
    """(src, row_id, dimension, value) of everything typed, cells split at ``;`` and ``,``, white space around removed."""
    parts = codings.filter(F.col("dimension") != gate).select(F.lit("codings").alias("src"), F.col("coding_id").alias("row_id"), "dimension", F.explode(F.split("final_category", "[;,]")).alias("value"))
    models = suggestions.select(F.lit("suggestions").alias("src"), F.col("suggestion_id").alias("row_id"), "dimension", F.col("new_suggestion").alias("value"))
    reviewers = candidates.select(F.lit("candidates").alias("src"), F.col("candidate_id").alias("row_id"), "dimension", F.col("candidate_key").alias("value"))
    typed = parts.unionByName(models).unionByName(reviewers).filter("row_id is not null and dimension is not null and value is not null")
    return typed.withColumn("value", strip_white(F.col("value")))


def literal_keys(reference: DataFrame) -> DataFrame:
    return reference.filter("section = 'active' and category_key is not null").select("dimension", F.col("category_key").alias("value")).distinct()


def mapped_rows(typed: DataFrame, reference: DataFrame) -> DataFrame:
    """(src, row_id, dimension, value, category_key) of the values that are no literal key; unmatched ones with a null key."""
    free = typed.join(bounded_broadcast(literal_keys(reference)), ["dimension", "value"], "left_anti").filter(~F.lower("value").isin(*NULL_WORDS))
    mapping = map_values(free, reference)
    return salted_join(free, mapping.select("dimension", "value", "category_key"), ["dimension", "value"], ["row_id"], "left", salts=4).select("src", "row_id", "dimension", "value", "category_key")
