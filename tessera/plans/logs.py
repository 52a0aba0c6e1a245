"""Queries on run logs, over the event stream, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import incremental, runlog
from tessera.sources.tables import load

#: Views answer to responses, purchases to verdicts that parse, errors to verdicts that fail.
ANSWERS, VERDICTS = ["view"], ["purchase", "error"]


def log_verdict_pairing(spark: SparkSession, folder: str) -> DataFrame:
    events = load(spark, folder, "events").select("event_id", "user_id", "ts", "event_type")
    return runlog.next_verdict(events, "user_id", ["ts", "event_id"], "event_type", ANSWERS, VERDICTS).select("event_id", "verdict")


def replay_buckets(spark: SparkSession, folder: str) -> DataFrame:
    events = load(spark, folder, "events")
    paired = runlog.next_verdict(events, "user_id", ["ts", "event_id"], "event_type", ANSWERS, VERDICTS)
    bucket = runlog.replay_bucket(F.col("verdict") == "purchase", F.col("value") > 5)
    return paired.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def rate_window(spark: SparkSession, folder: str) -> DataFrame:
    events = load(spark, folder, "events").filter("ts is not null").select("event_id", "ts")
    counted = runlog.trailing_counts(events, "ts", ["event_id"], {"last_minute": 60, "last_hour": 3600})
    return counted.select("event_id", "last_minute", "last_hour")


def rolling_api_avg(spark: SparkSession, folder: str) -> DataFrame:
    events = load(spark, folder, "events").select("event_id", "user_id", "ts", "value")
    return incremental.rolling_mean(events, "user_id", ["ts", "event_id"], "value").select("event_id", F.round("rolling", 6).alias("rolling"))


def checkpoint_stats(spark: SparkSession, folder: str) -> DataFrame:
    return runlog.checkpoint_stats(load(spark, folder, "events"), "user_id", F.col("event_type") == "purchase", F.col("event_type") == "error", "ts")


def stalled_checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    events = load(spark, folder, "events")
    now = events.agg(F.max("ts").alias("now"))
    stats = runlog.checkpoint_stats(events, "user_id", F.col("event_type") == "purchase", F.col("event_type") == "error", "ts").join(F.broadcast(now))
    return runlog.stalled(stats, F.col("now"), 86_400).select("user_id", "last_write", "stalled")


def progress_tail(spark: SparkSession, folder: str) -> DataFrame:
    """The last progress bar of a log that is written out and read back."""
    events = load(spark, folder, "events").select("event_id")
    lines = events.withColumn("line", F.when(F.col("event_id") % 7 == 0, F.concat(F.pmod("event_id", F.lit(100)), F.lit("%|###  | "), "event_id", F.lit("/100000 [00:01"))).otherwise("note"))
    return runlog.last_progress(lines, "line", "event_id")


def run_eta(spark: SparkSession, folder: str) -> DataFrame:
    stats = load(spark, folder, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("hits"), F.count("*").alias("n"), F.avg("value").alias("each"))
    return stats.select("user_id", F.round(runlog.eta_seconds(100 - F.col("hits"), F.col("hits") / F.col("n"), F.col("each")), 4).alias("eta"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (log_verdict_pairing, replay_buckets, rate_window, rolling_api_avg, checkpoint_stats, stalled_checkpoints, progress_tail, run_eta)
}

_PAIRED = """with e as (select *, lead(event_type) over (partition by user_id order by ts, event_id) as following from events where event_type in ('view', 'purchase', 'error')),
p as (select *, case when following in ('purchase', 'error') then following end as verdict from e where event_type = 'view')"""

SQL: dict[str, str] = {
    "log_verdict_pairing": _PAIRED + " select event_id, verdict from p",
    "replay_buckets": _PAIRED + """ select case when verdict is null then 'UNPAIRED' when verdict = 'error' and value > 5 then 'RECOVERED' when verdict = 'error' then 'STILL-BROKEN'
      when value <= 5 then 'REGRESSION' else 'STILL-OK' end as bucket, count(*) as n from p group by all""",
    "rate_window": """select event_id, count(*) over (order by ts range between interval 60 seconds preceding and current row) as last_minute,
      count(*) over (order by ts range between interval 3600 seconds preceding and current row) as last_hour from events where ts is not null""",
    "rolling_api_avg": "select event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 19 preceding and current row), 6) as rolling from events",
    "checkpoint_stats": "select user_id, count(*) as rows, count_if(event_type = 'purchase')::bigint as confirmed, count_if(event_type = 'error')::bigint as errors, max(ts) as last_write from events group by user_id",
    "stalled_checkpoints": "select user_id, max(ts) as last_write, (select max(ts) from events) - max(ts) > interval 86400 seconds as stalled from events group by user_id",
    "progress_tail": "select event_id::int as done, 100000 as total, (event_id % 100)::int as percent from events where event_id % 7 = 0 order by event_id desc limit 1",
    "run_eta": "select user_id, round((100 - count_if(event_type = 'purchase')) / nullif(count_if(event_type = 'purchase') / count(*), 0) * avg(value), 4) as eta from events group by user_id",
}
