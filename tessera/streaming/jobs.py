"""Streams: resumable annotation input, rate windows and an enforced rate limit (extensions of the batch operators)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def new_items(spark: SparkSession, folder: str, schema: str, key: str = "id", late: str = "1 day", ts: str = "staged_at") -> DataFrame:
    """A folder of Parquet files as a stream, each key once; state older than ``late`` behind the newest row is dropped."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def rate_windows(events: DataFrame, ts: str = "ts", span: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Events in each time window, final when the watermark has passed it."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, span)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def limited(events: DataFrame, key: str, ts: str, most: int, seconds: int) -> DataFrame:
    """Adds ``allowed``: whether an event keeps its key within ``most`` allowed events in any trailing seconds.

    The allowed times of a key are its state, at most ``most`` of them.
    """

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(ts)
        allowed = []
        for at in rows[ts]:
            now = at.timestamp()
            times = [t for t in times if t > now - seconds]
            allowed.append(len(times) < most)
            if allowed[-1]:
                times.append(now)
        state.update((times,))
        yield pd.DataFrame({key: rows[key].to_numpy(), ts: rows[ts].to_numpy(), "allowed": allowed})

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, ts).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {ts} timestamp, allowed boolean", "times array<double>", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Processes what is there and stops; each batch goes to ``write`` once, restarts continue where the last run ended."""
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
