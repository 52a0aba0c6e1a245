"""Problem 4: repair text from scanned pages.

Word counts of all papers give a lexicon. A text is de-lined (page furniture is taken out) and its chunks are decoded
jointly: a lattice over them allows keeping, correcting, merging (over blanks, line ends and hyphens) and splitting, and
the cheapest path under the lexicon's word probabilities is taken. Confusions are looked up by a key under which
characters that scanners take for each other are the same. Paragraph boundaries are then chosen by dynamic programming.

The most frequent words are broadcast, up to a bound. Where there are more, a first pass over the texts writes down which
other words and keys each text asks for, these are joined with the rest of the lexicon, and every text is decoded with
its own answers; so each word of the corpus counts, however rare, and the result is that of one large lexicon.
"""

from __future__ import annotations

import math
import re
from collections import ChainMap, Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import cut, widen

FIELDS = ("text", "abstract", "references_text")
#: Words of the lexicon that are broadcast; all others are joined.
LEXICON_WORDS = 500_000
#: A word is taken for a misread one only if the right word is this many times as frequent.
TIMES_AS_FREQUENT = 12

#: Characters that stand for a hyphen at a line end.
HYPHENS = "-\u00ad\u00ac\u2010\u2011"
#: What scanners make of characters, in the order in which it is undone to get the key.
PAIRS = (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ii", "u"), ("ri", "n"), ("rn", "m"), ("in", "m"), ("cl", "d"), ("vv", "w"))
#: The other orders in which runs can be undone: ri before ii, and cl as e and l.
ORDERS = tuple(
    PAIRS[:5] + vowel + PAIRS[7:9] + letter + PAIRS[10:]
    for vowel in (PAIRS[5:7], PAIRS[6:4:-1]) for letter in (PAIRS[9:10], ())
)
#: What a 6 may stand for.
SIX = "böóé"
SINGLES = {"0": "o", "1": "l", "5": "s", "6": "b", "9": "g", "2": "z", "8": "b", "@": "a", "!": "i", "|": "l", "†": "t", "$": "s", "ß": "b", "c": "e", "h": "b", "ä": "a", "ö": "o", "ü": "u", "l": "i", "é": "e", "è": "e", "ê": "e", "á": "a", "à": "a", "â": "a", "ó": "o", "ô": "o", "í": "i", "î": "i", "ì": "i", "ú": "u", "û": "u", "ñ": "n", "ç": "e", "ë": "e", "ï": "i"}
#: The letter a character inside a word most likely is, for words the lexicon does not hold.
LIKELY = {"0": "o", "1": "l", "5": "s", "6": "b", "9": "g", "2": "z", "@": "a", "!": "i", "|": "l", "†": "t", "$": "s", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}

_SINGLES = str.maketrans({k: SINGLES.get(v, v) if v in "l" else v for k, v in SINGLES.items()})
_ODD = re.compile("[" + re.escape("".join(LIKELY)) + "]")
_EDGES = ".,;:()[]{}\"„“”«»‚‘…–—?·"
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*-?")


def confusion_key(word: str, pairs: tuple[tuple[str, str], ...] = PAIRS) -> str:
    for seen, meant in pairs:
        if seen in word:
            word = word.replace(seen, meant)
    return word.translate(_SINGLES)


def confusion_keys(seen: str) -> list[str]:
    """Keys under which the right word may stand: runs that can be undone in two orders, and a 6 for b or for a marked vowel.

    What has more than four of them is a number, no word.
    """
    forms = [seen]
    for _ in range(seen.count("6") if seen.count("6") <= 4 else 0):
        forms = [f.replace("6", letter, 1) for f in forms for letter in SIX]
    return list(dict.fromkeys(confusion_key(f, pairs) for f in forms for pairs in (ORDERS if "ri" in seen or "cl" in seen else (PAIRS,))))


def core(chunk: str) -> str:
    """A chunk in lower case without outer punctuation."""
    return chunk.strip(_EDGES).strip("'’").lower()


# --- lexicon -------------------------------------------------------------------------------------------------------


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter[str] = Counter()
    for batch in batches:
        for field in FIELDS:
            for text in batch[field]:
                if not text:
                    continue
                lines = [line.split() for line in text.split("\n")]
                broken = False
                for chunks in lines:
                    if not chunks:
                        continue
                    whole = chunks[1:] if broken else chunks
                    broken = chunks[-1][-1] in HYPHENS
                    counts.update(whole[:-1] if broken else whole)
        if len(counts) > 500_000:
            yield _counted(counts)
            counts = Counter()
    yield _counted(counts)


def _counted(raw: Counter[str]) -> pd.DataFrame:
    words: Counter[str] = Counter()
    for chunk, n in raw.items():
        word = core(chunk)
        if _WORD.fullmatch(word):
            words[word] += n
    return pd.DataFrame({"word": pd.Series(list(words), dtype=object), "n": pd.Series(list(words.values()), dtype="int64")})


def word_counts(papers: DataFrame) -> DataFrame:
    """(word, n) over all fields of all papers; words at broken line ends are left out."""
    counted = widen(papers.select(*FIELDS)).mapInPandas(_count_words, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


class Asked(dict):
    """A table that writes down which keys it was asked for and did not hold."""

    def __init__(self, held: dict):
        super().__init__(held)
        self.missing: set[str] = set()

    def get(self, key, default=None):
        if key in self:
            return self[key]
        self.missing.add(key)
        return default


class Lexicon:
    """Word counts, and the two most frequent words behind each confusion key (one of which may be the word looked up)."""

    def __init__(self, counts: dict[str, int], total: int | None = None, by_key: dict[str, list[str]] | None = None):
        self.counts = counts
        self.total = max(sum(counts.values()) if total is None else total, 1)
        self.log_total = math.log(self.total)
        if by_key is None:
            by_key = {}
            for word in sorted(counts, key=lambda w: (-counts[w], w)):
                for key in {confusion_key(word, pairs) for pairs in ORDERS}:
                    own = by_key.setdefault(key, [])
                    if len(own) < 2:
                        own.append(word)
        self.by_key = by_key
        self.often, self.some = self.total * SPLIT_OFTEN, max(2.0, self.total * SPLIT_SOME)
        self.memory: dict[str, tuple[str, float]] = {}
        self.chunks: dict[str, tuple[str, bool, bool]] = {}

    def recording(self) -> tuple[Lexicon, Asked, Asked]:
        """The same lexicon with tables that write down what they lack; a key with one word only lacks a second."""
        counts, keys = Asked(self.counts), Asked({k: v for k, v in self.by_key.items() if len(v) > 1})
        return Lexicon(counts, self.total, keys), counts, keys

    def with_rest(self, counts: dict[str, int], by_key: dict[str, list[str]]) -> Lexicon:
        """This lexicon and some of the words it lacks, all less frequent than its own."""
        keys = ChainMap({k: [*self.by_key.get(k, ()), *v][:2] for k, v in by_key.items()}, self.by_key)
        return Lexicon(ChainMap(counts, self.counts), self.total, keys)

    def cost(self, word: str) -> float:
        n = self.counts.get(word, 0)
        if n:
            return self.log_total - math.log(n)
        return self.log_total + 2.0 + 0.9 * len(word)

    def decode(self, seen: str) -> tuple[str, float]:
        """The word a string most likely is, and its cost; the string itself if nothing better explains it."""
        known = self.memory.get(seen)
        if known is not None:
            return known
        own = self.counts.get(seen, 0)
        best, cost = seen, self.cost(seen)
        odd = _ODD.search(seen)
        if odd:
            cost += 6.0
        right = self.right_word(seen, own, bool(odd)) if len(seen) >= 2 else None
        if right:
            best, cost = right, self.log_total - math.log(self.counts[right]) + 3.0
        if best == seen and odd and len(seen) >= 4:
            likely = "".join(LIKELY.get(c, c) for c in seen)
            if _WORD.fullmatch(likely) and all(0 < i < len(seen) - 1 or not seen[i].isdigit() for i in range(len(seen)) if seen[i] in LIKELY):
                if not re.search(r"\d\d", seen):
                    best, cost = likely, self.cost(likely) + 3.0
        if len(self.memory) > 300_000:
            self.memory.clear()
        self.memory[seen] = best, cost
        return best, cost

    def look_up(self, chunk: str) -> tuple[str, bool, bool]:
        """The chunk's core, whether it can be settled alone (a known word that is no misreading, or no word at all), and whether it is rare."""
        found = self.chunks.get(chunk)
        if found is None:
            word = core(chunk)
            plain = not word or not any(c.isalpha() for c in word) or (self.counts.get(word, 0) >= 2 and self.decode(word)[0] == word)
            if len(self.chunks) > 300_000:
                self.chunks.clear()
            rare = plain and len(word) > 2 and word.isalpha() and self.counts.get(word, 0) <= self.some
            found = self.chunks[chunk] = word, plain, rare
        return found

    def right_word(self, seen: str, own: int, odd: bool) -> str | None:
        """The most frequent word with a key of the string's, if it is so much more frequent that the string is a misreading."""
        found = [word for key in confusion_keys(seen) for word in self.by_key.get(key, ()) if word != seen]
        if not found:
            return None
        word = min(found, key=lambda w: (-self.counts[w], w))
        n = self.counts[word]
        if n < 2 or (own and n < TIMES_AS_FREQUENT * own) or (len(seen) < 4 and not odd and n < 50 * TIMES_AS_FREQUENT * max(own, 1)):
            return None
        return word


def fit_lexicon(counts: DataFrame, words: int = LEXICON_WORDS) -> dict[str, int]:
    """The most frequent words with their counts; equal counts in the order of the words."""
    return {r["word"]: r["n"] for r in counts.orderBy(F.desc("n"), "word").limit(words).collect()}


# --- page furniture ------------------------------------------------------------------------------------------------

_PAGE_WORDS = frozenset(confusion_key(w) for w in ("seite", "page", "p.", "s.", "pagina", "página", "pág.", "blz.", "pg."))
_ROMAN = re.compile(r"[ivxlcIVXLC1!|]{1,7}")
_NUMBER = re.compile(r"(?=.*\d|[lIO|!]{1,3}$)[\dlIoOSsBZzgb|!]{1,4}")
_INITIALS = re.compile(r"(?:[^\W\d_]\. ?)+[^\W\d_][\w'’!|†@-]*(?:, (?:[^\W\d_]\. ?)+[^\W\d_][\w'’!|†@-]*)*,?")


def is_page_number(line: str) -> bool:
    """A number alone on its line, with marks around it or a word for page."""
    parts = [p for p in re.split(r"[\s\[\]()–—·•|/-]+", line) if p] if not re.fullmatch(r"[\d|!lI]+", line) else [line]
    if not parts or len(parts) > 2:
        return False
    if len(parts) == 1:
        return bool(_NUMBER.fullmatch(parts[0]) or (_ROMAN.fullmatch(parts[0]) and (len(line) <= 7) and line.strip("[]()–—·•|/- ").islower()))
    words = [p for p in parts if not _NUMBER.fullmatch(p)]
    return len(words) == 1 and confusion_key(words[0].lower()) in _PAGE_WORDS


def without_number(line: str) -> str:
    """A header line without a page number at its start or end."""
    parts = line.split()
    if len(parts) > 1 and _NUMBER.fullmatch(parts[-1]):
        parts = parts[:-1]
    elif len(parts) > 1 and _NUMBER.fullmatch(parts[0]):
        parts = parts[1:]
    return " ".join(parts)


def header_key(text: str) -> str:
    return confusion_key(re.sub(r"[^\w|!@†$]+", "", text.lower()))


_SERIES = re.compile(confusion_key("lni") + r"[\dobsgzi]{2,7}" + "w[a-z]{6,16}")
_VOLUME = re.compile(confusion_key("band") + r"[\dobsgzi]{1,7}.{8,60}?[\dobsgzi]{1,4}")


#: How lines that name a series or a volume may start, misread or behind a page number.
_SERIES_START = re.compile(r"(?i)(?:\W|[\doszgbil|!]{1,4}\s)*(?:[l1i|!]\s?n\s?[i1l|!íì]|[b68hß]\s?[aäáàâ@])")
_KEYED = re.compile(r"[\w|!@†$]")
_FOLDED = {(confusion_key(seen[:1]), confusion_key(meant[:1])) for seen, meant in PAIRS}


def first_letters(keys: set[str]) -> set[str]:
    """Keys of the single letters that a text whose key starts with one of these may start with: also those that open a folded run."""
    found = set(keys)
    while more := {seen for seen, meant in _FOLDED if meant in found} - found:
        found |= more
    return found


_DIGITS = bytes.maketrans(b"0123456789", b"#" * 10)
#: Times a line must stand in a text, digits aside, to be a running header that no title explains.
REPEATS = 3


def repeated_lines(lines: list[str]) -> set[int]:
    """Lines that stand in the text several times but for digits and misread characters, mostly inside a sentence, alone between blank lines or beside a page number."""
    seen = Counter(line.encode("utf-8", "replace").translate(_DIGITS) for line in lines)
    often = {k for raw, n in seen.items() if n >= REPEATS and (k := raw.decode()) and sum(map(str.isalpha, k)) >= 5 and k.rstrip()[-1:] not in ".,;:" + HYPHENS and not _HEADING.match(k.replace("#", "1"))}
    if not often:
        return set()
    keys = {header_key(k.replace("#", "")) for k in often}
    found: dict[str, list[int]] = {}
    for i, line in enumerate(lines):
        if line and (key := header_key(re.sub(r"\d", "", line))) in keys:
            found.setdefault(key, []).append(i)
    kept = set()
    for at in found.values():
        def between(i: int) -> bool:
            before, after = lines[i - 1] if i else "", lines[i + 1] if i + 1 < len(lines) else ""
            alone = not before and not after or is_page_number(before) or is_page_number(after)
            return not lines[i][0].islower() and (alone or bool(before) and not _END.search(before) and after[:1].islower())
        if sum(map(between, at)) * 2 > len(at):
            kept.update(at)
    return kept


def furniture_lines(lines: list[str], title: str | None, authors: str | None) -> set[int]:
    """Numbers of the lines that are running headers, footers or page numbers."""
    lines = [" ".join(raw.split()) for raw in lines]
    found = repeated_lines(lines) if len(lines) > 2 * REPEATS else set()
    title_key, author_key = header_key(title or ""), header_key(authors or "")
    first = first_letters({title_key[:1], author_key[:1]})
    longest = max(110, len(title or "") + 12, len(authors or "") + 12)
    seen: dict[str, list[int]] = {}
    for i, line in enumerate(lines):
        if not line or len(line) > longest:
            continue
        if len(line) <= 24 and is_page_number(line):
            found.add(i)
            continue
        head, tail = line[0], line[-1]
        upper = line.isupper()
        dotted = tail == "…" or tail == "." and line.endswith("...") or "…" in line[-6:] or "..." in line[-9:]
        numbered = head in _NUMERIC or tail in _NUMERIC
        series = bool(_SERIES_START.match(line))
        if not (upper or dotted or numbered or series or "." in line[1:3] or _may_open(line, first)):
            continue
        bare = without_number(line)
        cut_off = bare.endswith(("…", "..."))
        names = bare[1:2] == "." and bool(_INITIALS.fullmatch(bare))
        start = _KEYED.search(bare)
        if not series and (not start or confusion_key(start[0].lower()) not in first) and not (cut_off or names or bare.isupper()):
            continue
        key = header_key(bare)
        numbered = bare != line
        if len(key) < 3:
            continue
        whole = header_key(line)
        if _SERIES.fullmatch(key) or (whole.startswith(confusion_key("lni")) and _SERIES.match(key) and len(line) < 40) or (("·" in line or "•" in line) and _VOLUME.fullmatch(whole)):
            found.add(i)
            continue
        if title_key and (key == title_key or ((cut_off or len(key) >= 8) and title_key.startswith(key))):
            found.add(i)
            continue
        if author_key and (key == author_key or (cut_off and author_key.startswith(key))):
            found.add(i)
            continue
        letters = [c for c in bare if c.isalpha()]
        if cut_off or (len(letters) >= 6 and all(c.isupper() or c in "ßlı" for c in letters)) or (names and ("," in bare or numbered)):
            seen.setdefault(key, []).append(i)
    for key, at in seen.items():
        line = lines[at[0]]
        bare = without_number(line)
        # without title or authors to compare with: cut-off titles, capitals, and names that repeat or carry a number
        if bare.endswith(("…", "...")) or len(at) > 1 or bare != line or (not title and not _INITIALS.fullmatch(bare)) or (not authors and _INITIALS.fullmatch(bare) and "," in bare):
            found.update(at)
    if not title:
        found |= interrupting_lines(lines, found)
    return found


_NUMERIC = frozenset("0123456789lIoOSsBZzgb|!")


def _may_open(line: str, first: set[str]) -> bool:
    start = _KEYED.search(line)
    return bool(start) and confusion_key(start[0].lower()) in first


def interrupting_lines(lines: list[str], known: set[int]) -> set[int]:
    """Short lines inside a sentence: wrapping leaves none there, so they are headers (where no title is given to compare)."""
    kept = [i for i in range(len(lines)) if i not in known and lines[i].strip()]
    if len(kept) < 6:
        return set()
    width = max(len(lines[i].rstrip()) for i in kept)
    found = set()
    for before, now, after in zip(kept, kept[1:], kept[2:]):
        last, line, following = lines[before].rstrip(), lines[now].strip(), lines[after].lstrip()
        open_end = not _END.search(last) and not _HEADING.match(last.lstrip())
        plain = line[:1].isupper() or line[:1].isdigit()
        if open_end and plain and len(line) < 0.62 * width and following[:1].islower() and line[-1] not in ".!?:,;" + HYPHENS and len(last) > 0.62 * width:
            found.add(now)
    return found


# --- decoding ------------------------------------------------------------------------------------------------------


class Stream:
    """The de-lined stream: white-space chunks, the numbers of their lines, and the hyphens at line ends by chunk."""

    __slots__ = ("texts", "line_of", "spans", "hyphens")

    def __init__(self, lines: list[str], furniture: set[int]):
        self.texts: list[str] = []
        self.line_of: list[int] = []
        self.spans: list[tuple[int, int, int]] = []
        self.hyphens: dict[int, str] = {}
        for number, line in enumerate(lines):
            if number in furniture:
                continue
            parts = line.split()
            if not parts:
                continue
            begin = len(self.texts)
            self.texts += parts
            self.line_of += [number] * len(parts)
            self.spans.append((number, begin, len(self.texts)))
            last = parts[-1]
            if last[-1] in HYPHENS and len(last) > 1:
                self.hyphens[len(self.texts) - 1] = last[-1]


MERGE_BLANK, SPLIT, KEEP_SCAN_HYPHEN, APART = 7.0, 7.0, 6.0, 1.0
#: Chunks over which a word may be broken; a word in more pieces stays as it is.
LONGEST_MERGE = 6
#: Shares of all words that the parts of words run together must have: each of them, and one of them at least. The
#: second keeps compounds whole, which have no such frequent word in them.
SPLIT_SOME, SPLIT_OFTEN = 2e-5, 3e-3


class Found:
    __slots__ = ("first", "last", "word", "joined", "corrected", "text")

    def __init__(self, first: int, last: int, word: str, joined: bool, corrected: bool, text: str):
        self.first, self.last, self.word, self.joined, self.corrected, self.text = first, last, word, joined, corrected, text


def _with_edges(chunk: str, seen: str, word: str) -> str:
    """The word in place of what was seen, with the chunk's punctuation and capitals."""
    low = chunk.lower()
    at = low.find(seen)
    if at < 0:
        return word
    body = chunk[at : at + len(seen)]
    if len(body) > 1 and sum(c.isupper() for c in body) > sum(c.islower() for c in body):
        shaped = word.upper()
    elif body[:1].isupper():
        shaped = word[:1].upper() + word[1:]
    else:
        shaped = word
    return chunk[:at] + shaped + chunk[at + len(seen) :]


def decode_stream(stream: Stream, lexicon: Lexicon) -> list[Found]:
    """Cheapest segmentation of the parts of the stream that are not settled: all but known words that meet no hyphen.

    A known word is open too if it and a neighbour would be a far more frequent word.
    """
    texts = stream.texts
    n = len(texts)
    known = lexicon.chunks
    look_up, get = lexicon.look_up, known.get
    looked_up = [get(t) or look_up(t) for t in texts]
    is_open = {i for i, found in enumerate(looked_up) if not found[1]}
    for i in stream.hyphens:
        is_open.add(i)
        if i + 1 < n:
            is_open.add(i + 1)
    counts = lexicon.counts
    for i in [i for i, found in enumerate(looked_up) if found[2]]:
        own = counts.get(looked_up[i][0], 0)
        for a, b in ((i - 1, i), (i, i + 1)):
            if 0 <= a and b < n and texts[a][-1:].isalpha() and looked_up[a][0].isalpha() and looked_up[b][0].isalpha() and counts.get(looked_up[a][0] + looked_up[b][0], 0) >= TIMES_AS_FREQUENT * max(own, 1):
                is_open |= {a, b}
    out: list[Found] = []
    end = -1
    for i in sorted(is_open):
        if i <= end:
            continue
        end = i
        while end + 1 in is_open:
            end += 1
        out.extend(_region(stream, [found[0] for found in looked_up[i : end + 1]], i, end + 1, lexicon))
    return out


def _single(seen: str, lexicon: Lexicon) -> tuple[str, float]:
    if not seen or not any(c.isalpha() for c in seen):
        return seen, 2.0
    if not _WORD.fullmatch(seen) and not _ODD.search(seen):
        return seen, lexicon.log_total  # a code, a name with a number, an address: not a word to correct
    return lexicon.decode(seen)


def _region(stream: Stream, cores: list[str], start: int, end: int, lexicon: Lexicon) -> list[Found]:
    """The cheapest path over one region: each arc keeps or corrects a chunk, merges several, or splits one."""
    size = end - start
    texts, hyphens = stream.texts, stream.hyphens
    best: list[float] = [0.0] + [math.inf] * size
    back: list[tuple[int, str, str, bool]] = [(0, "", "", False)] * (size + 1)
    for a in range(size):
        if best[a] == math.inf:
            continue
        paths = [("", False)]
        blanks = 0
        for b in range(a, min(size, a + LONGEST_MERGE)):
            chunk, hyphen = texts[start + b], hyphens.get(start + b, "")
            piece = chunk[: len(chunk) - len(hyphen)].lower()
            if b == a:
                piece = piece.lstrip(_EDGES)
            whole = [(seen + piece, joined) for seen, joined in paths]
            for text, joined in whole:
                word = text.rstrip(_EDGES).rstrip("'’")
                if b == a:
                    tail = "-" if hyphen else ""
                    decoded, cost = _single(word + tail if tail else cores[a], lexicon)
                    if tail:
                        plain, plain_cost = lexicon.decode(word)
                        if plain_cost + 4.0 < cost:  # ends rightly in a hyphen, though not known with it
                            decoded, cost = plain + tail, plain_cost + 4.0
                        cost += APART + (KEEP_SCAN_HYPHEN if hyphen != "-" else 0.0)
                        word += tail
                    else:
                        word = cores[a]
                else:
                    if not _mergeable(word):
                        continue
                    decoded, cost = lexicon.decode(word)
                    if blanks and lexicon.counts.get(decoded, 0) < 2:
                        continue  # pieces apart by a blank are one word only if it is known
                    cost += 0.3 * (b - a) + blanks * MERGE_BLANK
                    if joined and hyphen:
                        cost += 3.0
                total = best[a] + cost
                if total < best[b + 1]:
                    best[b + 1] = total
                    back[b + 1] = (a, word, decoded, joined)
            if b == a and not hyphen:
                split = _split(cores[a], lexicon)
                if split and best[a] + split[1] < best[b + 1]:
                    best[b + 1] = best[a] + split[1]
                    back[b + 1] = (a, cores[a], split[0], False)
            if hyphen:
                paths = [(text, True) for text, _ in whole] + ([(text + "-", joined) for text, joined in whole] if hyphen == "-" else [])
            elif chunk[-1:] in _EDGES:
                break
            else:
                paths = whole
                blanks += 1
    out, b = [], size
    while b > 0:
        a, word, decoded, joined = back[b]
        first, last = start + a, start + b - 1
        if last > first:
            head, tail = texts[first], texts[last]
            lead = head[: len(head) - len(head.lstrip(_EDGES))]
            trail = tail[len(tail.rstrip(_EDGES)) :]
            shaped = decoded[:1].upper() + decoded[1:] if head.lstrip(_EDGES)[:1].isupper() else decoded
            text = lead + shaped + trail
        else:
            text = texts[first] if word == decoded else _with_edges(texts[first], word, decoded)
        corrected = decoded != word and " " not in decoded
        out.append(Found(first, last, decoded, joined and last > first, corrected, text))
        b = a
    return out[::-1]


def _mergeable(word: str) -> bool:
    return 3 <= len(word) <= 60 and bool(_MERGEABLE.fullmatch(word)) and any(map(str.isalpha, word))


_MERGEABLE = re.compile(r"[\w\-'’" + re.escape("".join(LIKELY)) + "]+")


def _split(word: str, lexicon: Lexicon) -> tuple[str, float] | None:
    """Known words that were run together, as one string with blanks, and its cost; the cheapest way over all places to cut."""
    odd = bool(_ODD.search(word))
    if odd:
        word = "".join(LIKELY.get(c, c) for c in word)
    n = len(word)
    if n < 5 or n > 60 or not _WORD.fullmatch(word) or lexicon.counts.get(word, 0) >= 2:
        return None
    # by number of letters: cost without and with a frequent part so far, and where the last part begins
    value = [[math.inf, math.inf] for _ in range(n + 1)]
    come: list[list[tuple[int, int] | None]] = [[None, None] for _ in range(n + 1)]
    value[0][0] = 0.0
    counts = lexicon.counts
    for i in range(n - 1):
        if value[i] == [math.inf, math.inf]:
            continue
        for j in range(i + 2, n + 1):
            if (i, j) == (0, n) or (count := counts.get(word[i:j], 0)) < lexicon.some:
                continue
            cost = lexicon.log_total - math.log(count) + (SPLIT if i else 0.0)
            for state in (0, 1):
                now = 1 if state or count >= lexicon.often else 0
                if value[i][state] + cost < value[j][now]:
                    value[j][now] = value[i][state] + cost
                    come[j][now] = i, state
    if value[n][1] == math.inf:
        return None
    parts, j, state = [], n, 1
    while j:
        i, state = come[j][state]
        parts.append(word[i:j])
        j = i
    return " ".join(reversed(parts)), value[n][1] + 3.0 * odd


# --- paragraphs ----------------------------------------------------------------------------------------------------

_END = re.compile(r"[.!?:…][\"”»)\]]*$")
_ENDING = frozenset(".!?:…\"”»)]*")
_HEADING = re.compile(r"\d+(?:\.\d+)* [^\W\d]")


def paragraph_starts(lines: list[str], kept: list[int]) -> set[int]:
    """Lines that begin a paragraph: the cheapest labelling of the kept lines as starts or continuations.

    Costs: a start after a sentence's end, a blank line or a heading is cheap, after an open line or before a small
    letter dear; furniture between two lines speaks neither way; paragraphs of one short line cost, unless headings.
    """
    if not kept:
        return set()
    stripped = [lines[i].strip() for i in kept]
    width = max(len(lines[i].rstrip()) for i in kept)
    ends = [t[-1] in _ENDING and bool(_END.search(t)) for t in stripped]
    heads = [t[0].isdigit() and len(t) < 60 and bool(_HEADING.match(t)) for t in stripped]
    costs = []
    for k in range(1, len(kept)):
        before, now = kept[k - 1], kept[k]
        last, first, end = stripped[k - 1], stripped[k], ends[k - 1]
        heading, after_heading = heads[k], heads[k - 1] and not end
        clear = False  # blank lines between and nothing else
        if now > before + 1:
            clear = any(not lines[i].strip() for i in range(before + 1, now)) and not any(lines[i].strip() for i in range(before + 1, now))
        titled = heading or after_heading
        start = 3.0 - 4.0 * clear - 2.0 * end - 1.5 * (len(last) < 0.7 * width) - 6.0 * titled + 6.0 * first[0].islower() + 6.0 * (last[-1] in HYPHENS) + 3.0 * (not end and not titled)
        costs.append((start, 4.0 * (clear and end) + 5.0 * titled))
    alone = 1.5
    # state 0: the line continues a paragraph, 1: it starts one
    value, back = [math.inf, 0.0], []
    for start, carry in costs:
        to_carry = min((value[0], 0), (value[1], 1))
        to_start = min((value[0], 0), (value[1] + alone, 1))
        back.append((to_carry[1], to_start[1]))
        value = [to_carry[0] + carry, to_start[0] + start]
    state = 0 if value[0] <= value[1] else 1
    starts = set()
    for k in range(len(costs), 0, -1):
        if state == 1:
            starts.add(kept[k])
        state = back[k - 1][state]
    return starts | {kept[0]}


# --- whole fields --------------------------------------------------------------------------------------------------


def repair(text: str, title: str | None, authors: str | None, lexicon: Lexicon) -> tuple[str, list[tuple[str, str]]]:
    """(continuous paragraphs, changes). A change is (kind, item) with kind hyphen, char or line; each once."""
    lines = text.split("\n")
    furniture = furniture_lines(lines, title, authors)
    changes = dict.fromkeys(("line", " ".join(lines[i].split())) for i in sorted(furniture))
    stream = Stream(lines, furniture)
    pieces: list[str | None] = list(stream.texts)
    for f in decode_stream(stream, lexicon):
        if f.joined:
            changes["hyphen", f.word] = None
        if f.corrected:
            changes["char", f.word] = None
        pieces[f.first] = f.text
        pieces[f.first + 1 : f.last + 1] = [None] * (f.last - f.first)
    starts = paragraph_starts(lines, [number for number, _, _ in stream.spans])
    paragraphs: list[list[str]] = []
    for number, begin, end in stream.spans:
        own = [t for t in pieces[begin:end] if t is not None]
        if own and (number in starts or not paragraphs):
            paragraphs.append([])
        if own:
            paragraphs[-1] += own
    return "\n\n".join(" ".join(p) for p in paragraphs), list(changes)


CHANGE = "struct<kind: string, item: string>"


REPAIRED = f"paper_no long, field string, repaired string, changes array<{CHANGE}>"


def _repaired(batch: pd.DataFrame, lexicon: Callable[[int], Lexicon]) -> pd.DataFrame:
    out: dict[str, list] = {"paper_no": [], "field": [], "repaired": [], "changes": []}
    texts = {field: batch[field].tolist() for field in FIELDS}
    for row, (number, title, authors) in enumerate(zip(batch["paper_no"], batch["title"], batch["authors"])):
        for field in FIELDS:
            text = texts[field][row]
            if not text or not text.strip():
                continue
            repaired, changes = repair(text, title, authors, lexicon(row))
            out["paper_no"].append(number)
            out["field"].append(field)
            out["repaired"].append(repaired)
            out["changes"].append([{"kind": k, "item": v} for k, v in changes])
    return pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in out.items()})


def _keyed(words: DataFrame) -> DataFrame:
    """(key, word, n): the two most frequent words of each confusion key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, w, n) for w, n in zip(batch["word"], batch["n"]) for key in {confusion_key(w, pairs) for pairs in ORDERS}]
            yield pd.DataFrame(rows, columns=["key", "word", "n"])

    order = Window.partitionBy("key").orderBy(F.desc("n"), "word")
    return words.mapInPandas(run, "key string, word string, n long").withColumn("at", F.row_number().over(order)).filter("at <= 2").drop("at")


def repair_papers(papers: DataFrame, words: int = LEXICON_WORDS) -> DataFrame:
    """(paper_no, field, repaired, changes) for every non-blank field; changes name each repair once.

    Null and blank fields have no row. Title and authors, where given, help to know running headers. Of the lexicon the
    ``words`` most frequent ones are broadcast; if there are more, a pass before finds out which of them each paper needs.
    """
    spark = papers.sparkSession
    counts = cut(word_counts(papers)).select("word", "n")
    held, total = fit_lexicon(counts, words), counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    shared = spark.sparkContext.broadcast(held)
    narrow = widen(papers.select("paper_no", "title", "authors", *FIELDS))
    if len(held) < words:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lexicon = Lexicon(shared.value, total)
            for batch in batches:
                yield _repaired(batch, lambda _: lexicon)

        return narrow.mapInPandas(run, REPAIRED)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(shared.value, total)
        for batch in batches:
            asked = []
            for row in range(len(batch)):
                recorder, missing_words, missing_keys = lexicon.recording()
                _repaired(batch.iloc[row : row + 1].reset_index(drop=True), lambda _: recorder)
                asked.append(([w for w in missing_words.missing if w], list(missing_keys.missing)))
            yield batch.assign(words=pd.Series([a[0] for a in asked], dtype=object), keys=pd.Series([a[1] for a in asked], dtype=object))

    fields = f"paper_no long, title string, authors string, {', '.join(f'{f} string' for f in FIELDS)}"
    asked = cut(narrow.mapInPandas(ask, f"{fields}, words array<string>, keys array<string>").withColumn("row", F.expr("uuid()")))
    rest = cut(counts.filter(F.col("n") <= min(held.values())))  # those of the bound's own count are told apart by the broadcast words
    word_rows = asked.select("row", F.explode("words").alias("word")).join(rest, "word").groupBy("row").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    key_rows = asked.select("row", F.explode("keys").alias("key")).join(_keyed(rest), "key").groupBy("row").agg(F.collect_list(F.struct("key", "word", "n")).alias("keyed"))

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(shared.value, total)
        for batch in batches:

            def own(row: int) -> Lexicon:
                known, keyed = batch["known"].iloc[row], batch["keyed"].iloc[row]
                more = {e["word"]: int(e["n"]) for e in (known if known is not None else ())}
                by_key: dict[str, list[str]] = {}
                for e in sorted(keyed if keyed is not None else (), key=lambda e: (-e["n"], e["word"])):
                    if e["word"] not in lexicon.counts:
                        by_key.setdefault(e["key"], []).append(e["word"])
                        more[e["word"]] = int(e["n"])
                return lexicon.with_rest({w: n for w, n in more.items() if w not in lexicon.counts}, by_key)

            yield _repaired(batch, own)

    joined = asked.drop("words", "keys").join(word_rows, "row", "left").join(key_rows, "row", "left").drop("row")
    return joined.mapInPandas(answer, REPAIRED)
