"""Logs of runs: pairing of answers and verdicts, replay buckets, rate windows, progress and stalls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_log(lines: DataFrame, text: str = "value") -> DataFrame:
    """(ts, event, id, attempt, chars, body) of response-log lines; other lines are dropped."""
    shape = r"(?U)^(\S+ \S+) +\S+ +(REQUEST|RESPONSE|OK|PARSE-FAIL|TRUNCATED|NON-DICT)\b(.*)$"
    rest = F.regexp_extract(text, shape, 3)
    field = lambda n: F.nullif(F.regexp_extract(rest, rf"\b{n}=(\S+)", 1), F.lit(""))
    return lines.filter(F.regexp_like(text, F.lit(shape))).select(
        F.regexp_extract(text, shape, 1).try_cast("timestamp").alias("ts"), F.regexp_extract(text, shape, 2).alias("event"), field("id").alias("id"),
        field("attempt").try_cast("int").alias("attempt"), field("chars").try_cast("int").alias("chars"), F.regexp_extract(rest, r"\bbody=(.*)$", 1).alias("body"),
    )


def next_verdict(events: DataFrame, key: str, order: list[str], event: str, answers: list[str], verdicts: list[str]) -> DataFrame:
    """Each answer row with the next verdict of the same key, null where none follows before the next answer.

    Rows are ordered inside days of the key; a day's last row looks at the first one of the key's next day, so a key
    that holds much of the log is not sorted in one task. The first order column is the time.
    """
    kept = events.filter(F.col(event).isin(*answers, *verdicts)).withColumn("__day", F.date_trunc("day", F.col(order[0]).cast("timestamp")))
    inside = kept.withColumn("__next", F.lead(event).over(Window.partitionBy(key, "__day").orderBy(*order)))
    opening = kept.groupBy(key, "__day").agg(F.min_by(event, F.struct(*order)).alias("__open"))
    days = opening.withColumn("__open", F.lead("__open").over(Window.partitionBy(key).orderBy("__day")))
    following = F.coalesce("__next", "__open")
    marked = inside.join(days, [key, "__day"]).withColumn("verdict", F.when(following.isin(*verdicts), following))
    return marked.filter(F.col(event).isin(*answers)).drop("__day", "__next", "__open")


def replay_bucket(then: Column, now: Column) -> Column:
    """How a replayed answer fares now (true: it parses) against what the log says."""
    return (
        F.when(then.isNull(), "UNPAIRED").when(~then & now, "RECOVERED").when(~then & ~now, "STILL-BROKEN").when(then & ~now, "REGRESSION").otherwise("STILL-OK")
    )


def trailing_counts(events: DataFrame, ts: str, ties: list[str], seconds: dict[str, int]) -> DataFrame:
    """Adds, for each name, the number of events in the trailing seconds, both ends included.

    Time is cut into slices as long as the longest span; a slice's window sees its own and the slice before, so no
    window runs over the whole log.
    """
    span = max(seconds.values())
    at = F.col(ts).cast("timestamp").cast("double")
    home = F.floor(at / span)
    copies = events.withColumn("__at", (at * 1_000_000).cast("long")).withColumn("__home", home).withColumn("__slice", F.explode(F.array(home, home + 1)))
    counted = copies.withColumns({
        name: F.count("*").over(Window.partitionBy("__slice").orderBy("__at").rangeBetween(-s * 1_000_000, 0)) for name, s in seconds.items()
    })
    return counted.filter(F.col("__slice") == F.col("__home")).drop("__at", "__home", "__slice")


def checkpoint_stats(rows: DataFrame, group: str, confirmed: Column, error: Column, ts: str) -> DataFrame:
    return rows.groupBy(group).agg(F.count("*").alias("rows"), F.count_if(confirmed).alias("confirmed"), F.count_if(error).alias("errors"), F.max(ts).alias("last_write"))


def stalled(stats: DataFrame, now: Column, seconds: int = 900) -> DataFrame:
    return stats.withColumn("stalled", (now.cast("timestamp").cast("double") - F.col("last_write").cast("timestamp").cast("double")) > seconds)


def last_progress(lines: DataFrame, text: str, position: str) -> DataFrame:
    """The counters of the last progress bar: (done, total, percent), one row or none."""
    shape = r"(\d+)%\|[^|]*\| *(\d+)/(\d+)"
    found = lines.filter(F.regexp_like(text, F.lit(shape))).select(
        position, F.regexp_extract(text, shape, 2).cast("int").alias("done"), F.regexp_extract(text, shape, 3).cast("int").alias("total"), F.regexp_extract(text, shape, 1).cast("int").alias("percent"),
    )
    return found.orderBy(F.desc(position)).limit(1).drop(position)


def eta_seconds(remaining: Column, rate: Column, seconds_each: Column) -> Column:
    """Time to go: what remains over the share of items that count, at the time each takes."""
    return F.try_divide(remaining, rate) * seconds_each
