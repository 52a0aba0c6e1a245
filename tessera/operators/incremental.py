"""Resumable work: cursors, worklists, ragged caches, and target-driven consumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import labels
from tessera.operators.ordering import running


def first_for_each_id(rows: DataFrame, order: list[str]) -> DataFrame:
    """Union of checkpoints deduplicated by id, the first row in file order kept."""
    others = [c for c in rows.columns if c != "id"]
    return rows.filter("id is not null").groupBy("id").agg(F.min_by(F.struct(*others), F.struct(*order)).alias("r")).select("id", "r.*")


def last_label(rows: DataFrame, label: Column, order: list[str]) -> DataFrame:
    """(id, label): the last label of each id in file order, readable or not."""
    return rows.groupBy("id").agg(F.max_by(F.struct(label.alias("label")), F.struct(*order)).alias("r")).select("id", "r.label")


def undone(items: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """The resume cursor: items without a row among the done ones. It goes below any costly step."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def included(items: DataFrame, include: DataFrame | None, exclude: DataFrame | None, key: str = "id") -> DataFrame:
    if include is not None:
        items = items.join(include.select(key).distinct(), key, "left_semi")
    return items if exclude is None else items.join(exclude.select(key).distinct(), key, "left_anti")


def fill_worklist(decisions: DataFrame, gates: DataFrame, dimensions: tuple[str, ...], absent_only: bool = True) -> DataFrame:
    """(id, todo, reason): which dimensions to fill; rejected papers are skipped, coded ones get only what is absent."""
    have = decisions.groupBy("id").agg(F.collect_set(F.when(~labels.is_blank(F.col("value")), F.col("dimension"))).alias("have"))
    verdict = gates.groupBy("id").agg(F.max("gate").alias("gate"))
    wanted = F.array(*[F.lit(d) for d in dimensions])
    todo = F.array_except(wanted, "have") if absent_only else wanted
    reason = F.when(F.col("gate") == 0, "rejected").when(F.size(todo) == 0, "complete").otherwise("fill")
    return have.join(verdict, "id").select("id", F.when(reason == "fill", F.array_join(todo, ";")).otherwise("").alias("todo"), reason.alias("reason"))


def until_target(items: DataFrame, order: str, ties: list[str], hit: Column, target: int) -> DataFrame:
    """Items in order up to the one that reaches the target number of hits."""
    counted = running(items, order, ties, {"__hits": hit.cast("int")}, last=-1)
    return counted.filter(F.col("__hits") < target).drop("__hits")


#: Fields of a cache line; the old form lacks the pages.
CACHE_FIELDS = ("id", "volume", "rel_path", "src", "score", "pages", "signals")


def cache_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """All lines as (width, fields): quoted cells are read as CSV does, header and blank lines are left out.

    ``width`` is null for lines whose number of fields is neither that of the present nor of the old form; their cells
    are null.
    """
    line = F.col(text)
    width = F.regexp_count(F.regexp_replace(line, r'"(?:[^"]|"")*"', ""), F.lit(",")) + 1
    cells = F.from_csv(line, F.lit(", ".join(f"c{i} string" for i in range(len(CACHE_FIELDS)))), {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    read = lines.filter(line.isNotNull() & (line != "")).select(width.alias("w"), cells.alias("c")).filter("not coalesce(c.c0 = 'id', false)")
    now, old = F.col("w") == len(CACHE_FIELDS), F.col("w") == len(CACHE_FIELDS) - 1
    taken = [F.when(now | old, F.col(f"c.c{i}")).alias(name) for i, name in enumerate(CACHE_FIELDS[:5])]
    pages = F.when(now & ~F.coalesce(F.lower(F.trim("c.c5")).isin("", "nan", "none"), F.lit(True)), F.col("c.c5"))
    return read.select(F.when(now | old, F.col("w")).alias("width"), *taken, pages.alias("pages"), F.when(now, F.col("c.c6")).when(old, F.col("c.c5")).alias("signals"))


def read_ragged(lines: DataFrame, text: str = "value") -> DataFrame:
    """(id, volume, rel_path, src, score, pages, signals) of the cache lines of either form with a readable score.

    Pages are cut to whole numbers, as ``7.0`` is 7; what is no number has no pages. Lines of other widths are left out
    (``cache_lines`` counts them).
    """
    rows = cache_lines(lines, text).filter("width is not null")
    number = F.col("pages").try_cast("double")
    return rows.select("id", "volume", "rel_path", "src", F.col("score").try_cast("double").alias("score"), F.when(~F.isnan(number), number.try_cast("int")).alias("pages"), "signals").filter("score is not null")


def reconstruct_manifest(staged: DataFrame, cache: DataFrame) -> DataFrame:
    """Staged files with the cached figures, where there are any; of repeated cache rows the largest score holds."""
    best = cache.filter("score is not null").groupBy("id").agg(F.max(F.struct("score", "pages")).alias("c")).select("id", "c.*")
    return staged.select("set_name", "id").distinct().join(best, "id", "left")


def with_fallback(primary: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """All ids of both sides; each column from the first side where it has one."""
    a = primary.select(key, *[F.col(c).alias(f"__a_{c}") for c in columns])
    b = other.select(key, *[F.col(c).alias(f"__b_{c}") for c in columns])
    return a.join(b, key, "full").select(key, *[F.coalesce(f"__a_{c}", f"__b_{c}").alias(c) for c in columns])


def grown_target(base: Column, confirmed: Column, threshold: int = 10, by: int = 20) -> Column:
    """The target, raised in steps of ``by`` until the confirmed papers are at least ``threshold`` short of it."""
    steps = F.floor((confirmed - (base - threshold)) / by) + 1
    return F.when((F.lit(by) <= 0) | (confirmed < base - threshold), base).otherwise(base + by * steps)


def replayed(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The state after a log of decision events: the last event of each key, deletions gone."""
    others = [c for c in events.columns if c not in keys]
    last = events.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("e")).select(*keys, "e.*")
    return last.filter("action <> 'delete'")


def blanked(rows: DataFrame, target: Column, columns: list[str]) -> DataFrame:
    return rows.withColumns({c: F.when(target, "").otherwise(F.col(c)) for c in columns})


def next_open(rows: DataFrame, position: str, open_: Column, after: int) -> DataFrame:
    """The first open row behind a position, else the first open one from the start (one row, or none)."""
    return rows.filter(open_).orderBy((F.col(position) <= after).cast("int"), position).limit(1)


def rolling_mean(rows: DataFrame, run: str, order: list[str], value: str, last: int = 20) -> DataFrame:
    """Adds ``rolling``, the mean of the run's last rows in the order, the row included; nulls don't count.

    Rows are ordered inside days of the run; a day's first rows take what they lack from the last rows of the days
    before, which are at most ``last - 1``, so a run that holds much of the log is not sorted in one task. The first
    order column is the time.
    """
    day = F.coalesce(F.date_trunc("day", F.col(order[0]).cast("timestamp")), F.lit("0001-01-01").cast("timestamp"))
    keyed = rows.withColumn("__day", day)
    inside = Window.partitionBy(run, "__day").orderBy(*order)
    near = inside.rowsBetween(-(last - 1), 0)
    own = keyed.withColumn("__n", F.row_number().over(inside)).withColumn("__sum", F.coalesce(F.sum(value).over(near), F.lit(0.0))).withColumn("__count", F.count(value).over(near))
    latest = Window.partitionBy(run, "__day").orderBy(*[F.desc(c) for c in order])
    ends = keyed.select(run, "__day", *[c for c in order if c != run], F.col(value).alias("__v")).withColumn("__r", F.row_number().over(latest)).filter(F.col("__r") < last)
    tails = ends.groupBy(run, "__day").agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "__v"))), lambda t: F.struct(t["__v"].alias("v"))).alias("__tail"))
    days = Window.partitionBy(run).orderBy(F.desc("__day")).rowsBetween(1, last - 1)
    carried = tails.withColumn("__before", F.slice(F.flatten(F.collect_list("__tail").over(days)), 1, last - 1)).drop("__tail")
    taken = F.filter(F.slice(F.coalesce("__before", F.array().cast("array<struct<v: double>>")), 1, F.greatest(F.lit(last) - F.col("__n"), F.lit(0))), lambda t: t["v"].isNotNull())
    total = F.col("__sum") + F.aggregate(taken, F.lit(0.0), lambda t, x: t + x["v"])
    rolled = own.join(carried, [run, "__day"], "left").withColumn("rolling", F.try_divide(total, F.col("__count") + F.size(taken)))
    return rolled.drop("__day", "__n", "__sum", "__count", "__before")
