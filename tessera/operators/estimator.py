"""Weighted pattern-group score of a text: every group counts its distinct matches up to a cap."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import widen


@dataclass(frozen=True)
class Group:
    name: str
    weight: float
    cap: int
    patterns: tuple[str, ...]

    @property
    def alternation(self) -> str:
        return "|".join(f"(?:{p})" for p in self.patterns)

    @property
    def scan(self) -> str:
        """The alternation for lower-case text, with the word boundary that most members begin with tested once.

        No two members of different kinds match at the same place, so their order does not matter.
        """
        lower = [p.lower() for p in self.patterns]
        bound = "|".join(f"(?:{p[2:]})" for p in lower if p.startswith(r"\b"))
        free = [f"(?:{p})" for p in lower if not p.startswith(r"\b")]
        return "(?U)" + "|".join(([rf"\b(?:{bound})"] if bound else []) + free)


#: The signal groups with weights, caps and patterns.
GROUPS = (
    Group("repo_url", 5.0, 3, (
        r"github\.com", r"gitlab\.(?:com|org|[a-z]{2,})", r"bitbucket\.org", r"sourceforge\.net", r"codeberg\.org", r"\bgitea\b",
        r"zenodo\.org", r"figshare\.com", r"doi\.org/10\.5281/zenodo", r"\bgit\s+clone\b", r"\.git\b", r"huggingface\.co",
    )),
    Group("availability", 4.0, 2, (
        r"\b(?:source\s+)?code\s+is\s+(?:publicly\s+|freely\s+)?available", r"\bpublicly\s+available\b", r"\bfreely\s+available\b",
        r"\bavailable\s+(?:at|on|from|under|via|online)\b", r"\bopen[\s-]?source(?:d)?\b", r"\breproducib(?:le|ility)\b",
        r"\bverf(?:ü|ue)gbar\s+(?:unter|auf|über|ueber)\b", r"\bfrei\s+verf(?:ü|ue)gbar\b",
        r"\b(?:öffentlich|oeffentlich)\s+(?:verf(?:ü|ue)gbar|zug(?:ä|ae)nglich)\b", r"\bzu\s+finden\s+unter\b", r"\bquelloffen\b",
    )),
    Group("license", 3.0, 2, (
        r"\bMIT\s+Licen[sc]e\b", r"\bApache\s+Licen[sc]e\b", r"\bApache-2\.0\b", r"\bGNU\s+General\s+Public\b", r"\bGPL(?:\s*v?\s*[23])?\b",
        r"\bLGPL\b", r"\bBSD\b", r"\bMozilla\s+Public\s+Licen[sc]e\b", r"\bMPL\b", r"\bCreative\s+Commons\b", r"\bCC[\s-]BY\b", r"\bApache\s+2\b",
    )),
    Group("package_manager", 3.0, 2, (
        r"\bpip\s+install\b", r"\bconda\s+(?:install|env)\b", r"\bnpm\s+(?:install|i)\b", r"\byarn\s+add\b", r"\bdocker\s+(?:run|pull|build|compose)\b",
        r"\bDockerfile\b", r"\bdocker-compose\b", r"\bapt-get\s+install\b", r"\bmaven\b", r"\bgradle\b", r"\brequirements\.txt\b",
        r"\bpackage\.json\b", r"\bpom\.xml\b", r"\bMakefile\b", r"\bvirtualenv\b",
    )),
    Group("first_person_artifact", 3.0, 2, (
        r"\bour\s+(?:tool|system|prototype|framework|implementation|application|software|library|platform)\b",
        r"\bwe\s+(?:have\s+)?(?:implement(?:ed)?|develop(?:ed)?|built|design(?:ed)?\s+and\s+implemented)\b",
        r"\bwe\s+(?:present|propose|introduce)\s+(?:a|an|the|our)\b",
        r"\bunser(?:e|es|em|en)?\s+(?:Prototyp|Werkzeug|System|Anwendung|Implementierung|Framework|Tool|Software)\b",
        r"\bhaben\s+wir\s+(?:ein(?:e|en)?\s+)?(?:\w+\s+){0,3}(?:implementiert|entwickelt|umgesetzt)\b",
    )),
    Group("code_listing", 2.0, 1, (
        r"\bListing\s+\d", r"\bAlgorithm(?:us)?\s+\d", r"\bCode-?Beispiel\b", r"\bcode\s+(?:example|snippet|listing)\b", r"\bCodeausschnitt\b",
    )),
    Group("source_vocab", 2.0, 3, (
        r"\bsource\s+code\b", r"\bcode\s*base\b", r"\brepositor(?:y|ies)\b", r"\bimplement(?:ation|ed|s)\b", r"\bcommand[\s-]line\b", r"\bAPI\b",
        r"\bunit\s+tests?\b", r"\bcontinuous\s+integration\b", r"\bSDK\b", r"\bQuellcode\b", r"\bQuelltext\b", r"\bImplementier(?:ung|t)\b",
        r"\bRepositorium\b", r"\bKommandozeile\b", r"\bSchnittstelle\b",
    )),
    Group("artifact_vocab", 0.5, 3, (
        r"\bframework\b", r"\blibrar(?:y|ies)\b", r"\btoolkit\b", r"\btool\b", r"\bprototype\b", r"\bplug[\s-]?in\b", r"\bsoftware\b",
        r"\bapplication\b", r"\bweb[\s-]?app\b", r"\bplatform\b", r"\bBibliothek\b", r"\bWerkzeug\b", r"\bPrototyp\b", r"\bAnwendung\b",
        r"\bSoftware\b", r"\bPlattform\b",
    )),
    Group("prog_lang", 1.0, 3, (
        r"\bPython\b", r"\bJava(?:Script)?\b", r"\bTypeScript\b", r"\bC\+\+", r"\bC#", r"\bMatlab\b", r"\bMATLAB\b", r"\bHaskell\b", r"\bScala\b",
        r"\bKotlin\b", r"\bGolang\b", r"\bRust\b", r"\bPHP\b", r"\bRuby\b", r"\bReact\b", r"\bAngular\b", r"\bNode\.js\b", r"\bFlask\b",
        r"\bDjango\b", r"\bTensorFlow\b", r"\bPyTorch\b",
    )),
)

MAX_SCORE = sum(g.weight * g.cap for g in GROUPS)


def group_hits(lower: Column, group: Group) -> Column:
    """The first ``cap`` of the group's sorted distinct matches in lower-case text. One scan, so matches use up text."""
    found = F.regexp_extract_all(F.coalesce(lower, F.lit("")), F.lit(group.scan), F.lit(0))
    return F.slice(F.array_sort(F.array_distinct(found)), 1, group.cap)


def with_estimate(frame: DataFrame, text: str = "text", groups: tuple[Group, ...] = GROUPS) -> DataFrame:
    """Adds ``score``, ``signals`` (group to capped count) and ``hits`` (group to matches); empty text scores 0.

    Each group's matches are found once; score and maps read the same arrays.
    """
    lowered = widen(frame).withColumn("__low", F.lower(text))
    found = lowered.withColumns({f"__{g.name}": group_hits(F.col("__low"), g) for g in groups}).drop("__low")
    sizes = {g.name: F.size(f"__{g.name}") for g in groups}
    score = F.round(sum((F.lit(g.weight) * sizes[g.name] for g in groups), F.lit(0.0)), 3)
    entries = F.array(*[F.struct(F.lit(g.name).alias("key"), sizes[g.name].alias("value")) for g in groups])
    lists = F.array(*[F.struct(F.lit(g.name).alias("key"), F.col(f"__{g.name}").alias("value")) for g in groups])
    signals = F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0))
    hits = F.map_from_entries(F.filter(lists, lambda e: F.size(e["value"]) > 0))
    return found.withColumns({"score": score, "signals": signals, "hits": hits}).drop(*[f"__{g.name}" for g in groups])
