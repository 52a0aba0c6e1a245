"""Short papers, non-papers, and the filling of disjoint working sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordering import running

SHORT_PAGES, MAX_PAGES, HEAD = 6, 60, 4000

#: Names that announce a collected volume or front matter.
VOLUME_NAMES = (
    r"komplettband", r"tagungsband", r"gesamtband", r"sammelband", r"gesamtdokument", r"proceedings[\s_-]*band", r"komplett[\s_-]*ausgabe",
    r"front[\s_-]*matter", r"frontmatter", r"titelei", r"backmatter", r"inhaltsverzeichnis", r"table[\s_-]*of[\s_-]*contents",
    r"complete[\s_-]*(?:volume|proceedings)", r"full[\s_-]*proceedings", r"book[\s_-]*of[\s_-]*abstracts", r"gesamtes[\s_-]*proceedings",
)
#: What the front pages of a collected volume hold, and the stamp of a contribution.
SERIES = r"Lecture\s+Notes\s+in\s+Informatics|Gesellschaft\s+f(?:ü|ue)r\s+Informatik\s+e\.?\s?V"
EDITORS = r"Volume\s+Editors|Series\s+Editorial\s+Board|Herausgeberband"
STAMP = r"\bc[byndas]{1,3}\s*doi:\s*(10\.\d{4,9}/\S+)"


def is_short(pages: Column, least: int = SHORT_PAGES) -> Column:
    return F.coalesce(pages < least, F.lit(False))


def contributions(text: Column) -> Column:
    """Number of distinct stamped DOIs."""
    stamps = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?iU)" + STAMP), F.lit(1))
    return F.size(F.array_distinct(F.transform(stamps, lambda s: F.regexp_replace(s, "[.,;]+$", ""))))


def non_paper_reason(pages: Column, name: Column, text: Column) -> Column:
    """Why a file is no single paper, or null. Cheap rules come first."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, HEAD)
    fingerprint = F.regexp_like(head, F.lit("(?iU)" + SERIES)) & F.regexp_like(head, F.lit("(?iU)" + EDITORS))
    return (
        F.when(pages > MAX_PAGES, "too_many_pages")
        .when(F.regexp_like(name, F.lit("(?iU)" + "|".join(VOLUME_NAMES))), "volume_name")
        .when(fingerprint, "front_matter")
        .when(contributions(text) >= 2, "several_contributions")
    )


def capped_order(items: DataFrame, order: str, ties: list[str], short: Column, part: int = 1, whole: int = 5) -> DataFrame:
    """Adds ``position`` so that every prefix has at most part/whole short items; surplus ones come last, none is dropped.

    With running numbers i of the long and k of the short items the place has a closed form: short k goes behind
    ceil(k * whole / part) - k long ones.
    """
    counted = running(items.withColumn("__s", short), order, ties, {"__k": F.col("__s").cast("int"), "__i": (~F.col("__s")).cast("int")})
    totals = counted.agg(F.coalesce(F.max("__k"), F.lit(0)).alias("__shorts"), F.coalesce(F.max("__i"), F.lit(0)).alias("__longs"))
    placed = counted.join(F.broadcast(totals))
    behind = F.expr(f"(__k * {whole} + {part - 1}) div {part} - __k")
    ahead = F.expr(f"((__i - 1) * {part}) div {whole - part}") if whole > part else F.col("__shorts")
    position = F.when(F.col("__s"), F.col("__k") + F.least("__longs", behind)).otherwise(F.col("__i") + F.least("__shorts", ahead))
    return placed.withColumn("position", position).drop("__s", "__k", "__i", "__shorts", "__longs")


def capped_keep(items: DataFrame, order: str, ties: list[str], short: Column, part: int = 1, whole: int = 5) -> DataFrame:
    """Keeps every long item, and a short one where the kept ones then still have at most part/whole short items.

    A short item is kept exactly where the running maximum of (shorts so far - room the longs so far give) does not grow.
    """
    counted = running(items.withColumn("__s", short), order, ties, {"__a": F.col("__s").cast("int"), "__l": (~F.col("__s")).cast("int")})
    excess = counted.withColumn("__d", F.when(F.col("__s"), F.expr(f"__a - (__l * {part}) div {whole - part}")).otherwise(0))
    peaks = running(excess, order, ties, {"__now": F.col("__d")}, keep="max")
    peaks = running(peaks, order, ties, {"__prior": F.col("__d")}, keep="max", last=-1)
    unchanged = F.greatest(F.lit(0), "__now") == F.greatest(F.lit(0), "__prior")
    return peaks.filter(~F.col("__s") | unchanged).drop("__s", "__a", "__l", "__d", "__now", "__prior")


def fill_sets(items: DataFrame, order: str, ties: list[str], sizes: dict[str, int], pool: str, short: Column, part: int = 1, whole: int = 5) -> DataFrame:
    """Adds ``set_name``: items in order fill the sets one after another, then the pool, which keeps its short quota.

    Items behind the last set's end are not staged. The sets before the pool take items as they come.
    """
    ranked = running(items, order, ties, {"__n": F.lit(1)})
    ends, edge = [], 0
    for name, size in sizes.items():
        if name != pool:
            ends.append((name, edge, edge + size))
            edge += size
    chain = None
    for name, start, end in ends:
        inside = (F.col("__n") > start) & (F.col("__n") <= end)
        chain = F.when(inside, name) if chain is None else chain.when(inside, name)
    first = ranked.filter(F.col("__n") <= edge).withColumn("set_name", chain).drop("__n")
    kept = capped_keep(ranked.filter(F.col("__n") > edge).drop("__n"), order, ties, short, part, whole)
    pooled = running(kept, order, ties, {"__n": F.lit(1)}).filter(F.col("__n") <= sizes[pool]).withColumn("set_name", F.lit(pool)).drop("__n")
    return first.unionByName(pooled)


def set_report(staged: DataFrame, targets: DataFrame) -> DataFrame:
    """(set_name, rows, target, status): what each set holds against its target."""
    held = staged.groupBy("set_name").agg(F.count("*").alias("rows"))
    joined = targets.join(held, "set_name", "left").fillna(0, ["rows"])
    missing = F.col("target") - F.col("rows")
    return joined.select("set_name", "rows", "target", F.when(missing > 0, F.concat(F.lit("SHORT by "), missing)).otherwise("ok").alias("status"))
