"""Problem 3: the language of every stretch of text, by hyperdimensional profiles.

Every letter has a random vector of +1 and -1; a trigram's vector binds its letters' vectors, each rotated by its
place; sentences and languages are bundles (sums) of trigram vectors, and a sentence gets the language whose prototype
has the largest cosine with it. Prototypes come from short seed texts and the sentences of a bounded sample of
labelled papers; what whole texts say decides over labels, which may be wrong.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import widen

DIMENSIONS = 1024
CACHED_GRAMS = 50_000
#: What a change of language between two sentences costs, as a share of the nearest language's product.
CHANGE = 0.2
SAMPLE_ROWS = 500
EPOCHS = 40
RATE = 0.5
FOREIGN = 0.08
CLEAR = 0.1
MIN_SENTENCES = 3
LANGUAGES = ("de", "en", "es", "fr", "nl")

#: Names and codes that denote a language, in lower case, without region.
NOTATIONS = {
    "de": "de deu ger deutsch german germanisch allemand alemán aleman duits",
    "en": "en eng englisch english anglais inglés ingles engels",
    "es": "es spa esp spanisch spanish español espanol castellano espagnol spaans",
    "fr": "fr fra fre französisch franzoesisch french français francais francés frans",
    "nl": "nl nld dut niederländisch niederlaendisch dutch nederlands néerlandais neerlandais neerlandés holländisch",
}
CODE = {name: code for code, names in NOTATIONS.items() for name in names.split()}

SEEDS = {
    "de": """Die Kinder gingen am Morgen durch den alten Garten und suchten nach den Äpfeln, die in der Nacht vom Baum gefallen waren.
Wir haben nicht gewusst, dass der Zug schon um sieben Uhr abfährt und dass man die Karten vorher kaufen muss. Obwohl es
regnete, wollte sie noch einmal an das Ufer des Flusses gehen, weil dort eine Bank unter einer großen Linde steht. Für die
Arbeit werden mehrere Werkzeuge benötigt, die bereits im Keller liegen. Es ist möglich, dass sich das Ergebnis noch ändert.""",
    "en": """The children walked through the old garden in the morning and looked for the apples which had fallen from the tree at
night. We did not know that the train leaves at seven and that the tickets must be bought before. Although it was raining
she wanted to go to the river once more, because there is a bench under a large lime tree. Several tools are needed for the
work, and they are already in the cellar. It is possible that the result will still change after all of this has been done.""",
    "es": """Los niños caminaron por la mañana por el viejo jardín y buscaron las manzanas que habían caído del árbol durante la noche.
No sabíamos que el tren sale a las siete y que hay que comprar los billetes antes. Aunque llovía, ella quería ir otra vez a
la orilla del río, porque allí hay un banco debajo de un gran tilo. Para el trabajo se necesitan varias herramientas, que ya
están en el sótano. Es posible que el resultado todavía cambie, pero la mayor parte de esta obra ya se ha terminado.""",
    "fr": """Les enfants traversaient le vieux jardin le matin et cherchaient les pommes qui étaient tombées de l'arbre pendant la nuit.
Nous ne savions pas que le train part à sept heures et qu'il faut acheter les billets avant. Bien qu'il pleuve, elle voulait
retourner encore une fois au bord de la rivière, parce qu'il y a là un banc sous un grand tilleul. Plusieurs outils sont
nécessaires pour ce travail, ils se trouvent déjà dans la cave. Il est possible que le résultat change encore.""",
    "nl": """De kinderen liepen in de ochtend door de oude tuin en zochten naar de appels die in de nacht van de boom waren gevallen. Wij
wisten niet dat de trein al om zeven uur vertrekt en dat je de kaartjes van tevoren moet kopen. Hoewel het regende wilde zij
nog een keer naar de oever van de rivier gaan, omdat daar een bank onder een grote linde staat. Voor het werk zijn meerdere
gereedschappen nodig, die al in de kelder liggen. Het is mogelijk dat de uitkomst nog verandert, maar het meeste is gedaan.""",
}

_BOUNDARY = re.compile(r"""(?<=[.!?…])(?<![\s(.][A-ZÄÖÜ]\.)["'”»)\]]*\s+(?=["'„“«(\[¿¡]*[^\W\d_a-zäöüßàâçéèêëîïôùûñáíóú])""")
_BROKEN = re.compile(r"[-­¬‐]\s*\n\s*")
_OTHER = re.compile(r"(?:[^\w\x01]|[\d_])+")
_MARK = re.compile(r" *\x01 *")
#: Letters with a vector of their own; all others share one.
ALPHABET = " abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ"
_LETTERS = len(ALPHABET) + 1
_PLACE = np.full(0x200, len(ALPHABET), dtype=np.int64)
_PLACE[[ord(x) for x in ALPHABET]] = np.arange(len(ALPHABET))
_ENDED = re.compile(r"""[.!?…]["'”»)\]]*\s*$""")


def denoted(label: Column) -> Column:
    """The language a label denotes in any notation, or null."""
    name = F.regexp_extract(F.lower(F.trim(label)), r"(?U)^\p{L}+", 0)
    codes = F.create_map(*[F.lit(x) for pair in CODE.items() for x in pair])
    return F.try_element_at(codes, name)


def sentence_grams(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams of a whole text, and where each sentence's own begin and end among them.

    Letters are places in ALPHABET; runs of anything else are one blank, and a sentence has blanks around it.
    """
    marked = _OTHER.sub(" ", _BROKEN.sub("", "\x01".join(text[a:b].replace("\x01", " ") for a, b in spans)).lower())
    marked = " " + _MARK.sub(" \x01 ", marked).strip(" ") + " "
    points = np.frombuffer(marked.encode("utf-32-le"), dtype=np.uint32)
    marks = np.flatnonzero(points == 1)
    letters = _PLACE[np.minimum(points, len(_PLACE) - 1)]
    grams = (letters[:-2] * _LETTERS + letters[1:-1]) * _LETTERS + letters[2:]
    starts = np.concatenate([[0], marks + 1])
    ends = np.maximum(np.concatenate([marks, [len(points)]]) - 2, starts)
    return grams, starts, ends


class Space:
    """Letter and trigram vectors; the same in every process, since a letter's vector comes from its code point."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.letters = np.array([np.random.default_rng(ord(x)).integers(0, 2, dimensions) * 2 - 1 for x in ALPHABET + "\ufffd"], dtype=np.float32)
        self.row = np.full(_LETTERS**3, -1, dtype=np.int32)
        self.table = np.empty((4096, dimensions), dtype=np.float32)
        self.used = 0

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """Bound vectors: the letters' vectors, the first rotated twice and the second once, multiplied."""
        a, b, c = grams // _LETTERS**2, grams // _LETTERS % _LETTERS, grams % _LETTERS
        return np.roll(self.letters[a], 2, axis=1) * np.roll(self.letters[b], 1, axis=1) * self.letters[c]

    def bundle(self, grams: np.ndarray) -> np.ndarray:
        """Sum of the trigrams' vectors."""
        kinds, times = np.unique(grams, return_counts=True)
        fresh = kinds[self.row[kinds] < 0]
        if self.used + len(fresh) > CACHED_GRAMS:
            self.row[:] = -1
            self.used, fresh = 0, kinds
        if len(fresh):
            while self.used + len(fresh) > len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            self.table[self.used : self.used + len(fresh)] = self.vectors(fresh)
            self.row[fresh] = np.arange(self.used, self.used + len(fresh))
            self.used += len(fresh)
        return times.astype(np.float32) @ self.table[self.row[kinds]]


class Nearest:
    """Dot products of sentences with the prototypes.

    A bundle is a sum, so its product with a prototype is the sum of its trigrams' products, which are kept. The norm of
    the bundle is the same for all prototypes: it changes neither the order of the cosines nor their ratios.
    """

    def __init__(self, prototypes: np.ndarray):
        self.space, self.prototypes = Space(prototypes.shape[1]), prototypes.astype(np.float32)
        self.have = np.zeros(_LETTERS**3, dtype=bool)
        self.products = np.zeros((_LETTERS**3, len(prototypes)), dtype=np.float32)

    def products_of(self, grams: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A row of products for each sentence."""
        known = self.have[grams]
        if not known.all():
            fresh = np.unique(grams[~known])
            for at in range(0, len(fresh), 1_000):
                part = fresh[at : at + 1_000]
                self.products[part] = self.space.vectors(part) @ self.prototypes.T
            self.have[fresh] = True
        sums = np.zeros((len(grams) + 1, self.products.shape[1]))
        np.cumsum(self.products[grams], axis=0, dtype=np.float64, out=sums[1:])
        return sums[ends] - sums[starts]


def sentence_spans(text: str) -> list[tuple[int, int]]:
    spans, start = [], 0
    for boundary in _BOUNDARY.finditer(text):
        spans.append((start, boundary.start()))
        start = boundary.end()
    spans.append((start, len(text)))
    return [(a, b) for a, b in spans if text[a:b].strip()]


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=-1, keepdims=True), 1e-9)


def train(texts: list[str], dimensions: int = DIMENSIONS, epochs: int = EPOCHS) -> np.ndarray:
    """Unit prototypes in the order of LANGUAGES from sample texts and the seeds.

    A whole text gets the language of the nearest prototype, its sentences are examples of that language unless another
    one is clearly nearer (a foreign stretch); examples that a prototype misses are then added to the right prototype
    and taken from the wrong one, epoch by epoch.
    """
    space = Space(dimensions)

    def bundles_of(text: str) -> list[np.ndarray]:
        grams, starts, ends = sentence_grams(text, sentence_spans(text))
        return [space.bundle(grams[a:b]) for a, b in zip(starts, ends) if b - a >= 2]

    seeds = np.array([np.sum(bundles_of(SEEDS[code]), axis=0) for code in LANGUAGES], dtype=float)
    bundles, text_no = [], []
    for number, text in enumerate(texts):
        own = bundles_of(text)
        bundles += own
        text_no += [number] * len(own)
    if not bundles:
        return unit(seeds)
    matrix, numbers = np.array(bundles, dtype=np.float32), np.array(text_no)
    whole = np.zeros((len(texts), dimensions), dtype=np.float32)
    np.add.at(whole, numbers, matrix)
    examples = unit(matrix)
    prototypes = unit(seeds)
    for _ in range(2):
        owner = (unit(whole) @ prototypes.T).argmax(1)[numbers]
        near = examples @ prototypes.T
        ahead = near.max(1) - near[np.arange(len(owner)), owner]
        kept = ahead < FOREIGN
        sums = seeds.copy()
        for k in range(len(LANGUAGES)):
            sums[k] += matrix[kept & (owner == k)].sum(0)
        prototypes = unit(sums)
    examples, owner = examples[kept], owner[kept]
    share = 1 / np.maximum(np.bincount(owner, minlength=len(LANGUAGES)), 1)
    for _ in range(epochs):
        near = examples @ prototypes.T
        right = near[np.arange(len(owner)), owner]
        near[np.arange(len(owner)), owner] = -1
        rival = near.argmax(1)
        missed = right - near.max(1) < CLEAR
        if not missed.any():
            break
        step = np.zeros_like(prototypes)
        for k in range(len(LANGUAGES)):
            step[k] += share[k] * examples[missed & (owner == k)].sum(0)
            for other in np.flatnonzero(np.bincount(owner[missed & (rival == k)], minlength=len(LANGUAGES))):
                step[k] -= share[other] * examples[missed & (rival == k) & (owner == other)].sum(0)
        prototypes = unit(prototypes + RATE * step)
    return prototypes


def steadied(products: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Labels of sentences where a change of language costs ``CHANGE``, so that a doubtful sentence follows its neighbours.

    A sentence costs the share by which a language stays behind the nearest one; the cheapest sequence is taken.
    """
    loss = 1 - products / np.maximum(products.max(1, keepdims=True), 1e-9)
    value, back = loss[0], []
    for own in loss[1:]:
        best = int(value.argmin())
        change = value[best] + CHANGE < value
        back.append(np.where(change, best, np.arange(len(value))))
        value = np.where(change, value[best] + CHANGE, value) + own
    state = int(value.argmin())
    out = labels.copy()
    for k in range(len(loss) - 1, -1, -1):
        out[k] = state
        if k:
            state = int(back[k - 1][state])
    return out


def segments_of(text: str, nearest: Nearest) -> list[tuple[int, int, str, float, int]]:
    """(start, end, language, confidence, whole sentences) of every stretch of one language, in text order."""
    found: list[list] = []
    spans = sentence_spans(text)
    if not spans:
        return []
    grams, starts, ends = sentence_grams(text, spans)
    products = nearest.products_of(grams, starts, ends)
    sizes = ends - starts
    labels = products.argmax(axis=1)
    long_enough = np.flatnonzero(sizes >= 2)
    if len(long_enough) > 1 and (labels[long_enough] != labels[long_enough[0]]).any():
        labels[long_enough] = steadied(products[long_enough], labels[long_enough])
    for (a, b), near, label, size in zip(spans, products, labels, sizes):
        if size < 2:
            if found:
                found[-1][1] = b
            continue
        rival = max(float(near[k]) for k in range(len(near)) if k != label)
        code, confidence = LANGUAGES[label], min(max((float(near[label]) - rival) / max(float(near[label]), 1e-9), 0.0), 1.0)
        whole = int(bool(_ENDED.search(text[a:b])) and len(text[a:b].split()) >= 3)
        if found and found[-1][2] == code:
            last = found[-1]
            last[1], last[4] = b, last[4] + whole
            last[3].append(confidence)
        else:
            found.append([a, b, code, [confidence], whole])
    return [(a, b, code, sum(c) / len(c), n) for a, b, code, c, n in found]


SEGMENT = "struct<start: int, end: int, lang: string, confidence: double, sentences: int>"


def _detect(prototypes: np.ndarray, fields: list[str], keys: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nearest = Nearest(prototypes)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in [*keys, "field", "segments"]}
            for field in fields:
                for row, text in enumerate(batch[field]):
                    if text is None or not text.strip():
                        continue
                    for k in keys:
                        out[k].append(batch[k].iloc[row])
                    out["field"].append(field)
                    out["segments"].append([dict(zip(("start", "end", "lang", "confidence", "sentences"), s)) for s in segments_of(text, nearest)])
            if out["field"]:
                yield pd.DataFrame(out)

    return run


def training_sample(papers: DataFrame, rows: int = SAMPLE_ROWS) -> list[str]:
    """At most ``rows`` labelled papers, chosen by a hash of their number, for the prototypes."""
    usable = papers.filter(F.col("lang").isNotNull() & (F.col("text").isNotNull() | F.col("abstract").isNotNull()))
    chosen = usable.filter(denoted(F.col("lang")).isNotNull()).select("paper_no").orderBy(F.xxhash64("paper_no"), "paper_no").limit(rows)
    numbers = [r["paper_no"] for r in chosen.collect()]  # numbers first, so that no texts are sorted
    if not numbers:
        return []
    taken = papers.filter(F.col("paper_no").isin(numbers)).select("paper_no", "abstract", "text").orderBy("paper_no", "abstract", "text").limit(rows).collect()
    return [t for r in taken for t in (r["abstract"], r["text"]) if t]


def detect_languages(papers: DataFrame, fields: tuple[str, ...] = ("abstract", "text"), sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(paper_no, lang, field, segments) for every non-empty field; segments give start, end, language, confidence, sentences.

    Null and blank fields have no row; a field without letters has no segments; other columns are ignored.
    """
    prototypes = train(training_sample(papers, sample_rows))
    narrow = widen(papers.select("paper_no", "lang", *fields))
    return narrow.mapInPandas(_detect(prototypes, list(fields), ["paper_no", "lang"]), f"paper_no long, lang string, field string, segments array<{SEGMENT}>")


def present_languages(detected: DataFrame, least: int = MIN_SENTENCES) -> DataFrame:
    """Adds ``present``: the languages with at least so many whole sentences in the field."""
    codes = F.array(*[F.lit(c) for c in LANGUAGES])
    count = lambda c: F.aggregate("segments", F.lit(0), lambda s, x: s + F.when(x["lang"] == c, x["sentences"]).otherwise(0))
    return detected.withColumn("present", F.filter(codes, lambda c: count(c) >= least))


def misdeclared(detected: DataFrame) -> DataFrame:
    """(paper_no, field, lang) of each present language of the fields whose languages are not exactly the declared one."""
    declared = denoted(F.col("lang"))
    matching = F.coalesce((F.size("present") == 1) & (F.get("present", F.lit(0)) == declared), F.lit(False))
    return present_languages(detected).filter(~matching).select("paper_no", "field", F.explode("present").alias("lang"))
