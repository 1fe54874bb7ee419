"""File activity as a stream: source, debouncing, changes against the last seen size, running totals and daily streaks.

Every operator takes a streaming or a static DataFrame of (key, ts, event_id, value); on a static one it gives the
result that a stream ends with, which is how they are checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def watch_source(spark: SparkSession, path: str, schema: str = SCHEMA, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream of events; temporary and hidden files are ignored by the source."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def file_events(df: DataFrame) -> DataFrame:
    """Events in the columns that the operators read."""
    return df.select(F.col("user_id").alias("key"), "ts", "event_id", "event_type", "value")


def debounce(events: DataFrame, gap: str = "500 milliseconds", delay: str = "1 day") -> DataFrame:
    """One row per key and burst: of events closer than the gap the last one counts.

    A stream closes a burst when the watermark passes its end; events later than the delay are dropped there.
    """
    e = events.withWatermark("ts", delay) if events.isStreaming else events
    g = e.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.max(F.struct("ts", "event_id", "event_type")).alias("last"), F.count("*").alias("events"))
    return g.select("key", F.unix_micros("w.start").alias("start_us"), F.col("last.event_id").alias("event_id"), F.col("last.event_type").alias("event_type"), "events")


def deltas(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Z3: change of each event's value against the key's last one: added for a key that is new, modified for one that is known.

    An event without a value deletes: its change takes away the last value, 0 if there is none, and the next event of the
    key is added again. Events without key, time or id are left out. The state of a key is its last value; it is kept as
    long as the stream runs, or until nothing came for idle_ms of processing time.
    """

    def f(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = []
        for x in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples():
            gone = x.value is None or x.value != x.value
            change = -(last or 0.0) if gone else float(x.value) - (last or 0.0)
            rows.append((int(key[0]), int(x.event_id), "deleted" if gone else "modified" if last is not None else "added", float(change) + 0.0))
            last = None if gone else float(x.value)
        if last is not None:
            state.update((last,))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=["key", "event_id", "kind", "delta"])

    return events.where("key IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL").groupBy("key").applyInPandasWithState(
        f, "key bigint, event_id bigint, kind string, delta double", "last double", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    )


def totals(events: DataFrame) -> DataFrame:
    """Running totals per kind of event: events, keys seen (approximately, in a stream) and summed value."""
    keys = F.approx_count_distinct("key") if events.isStreaming else F.countDistinct("key")
    return events.groupBy("event_type").agg(F.count("*").alias("events"), keys.alias("keys"), F.round(F.sum("value"), 2).alias("value"))


def activity_streaks(events: DataFrame) -> DataFrame:
    """Per key the current and longest run of active days, kept as a state of four numbers.

    The same day changes nothing, the next one goes on, a later one begins anew. Days that arrive out of order
    within a micro-batch are sorted; those before the last day of earlier batches are ignored.
    """

    def f(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, run, best, days = state.get if state.exists else (None, 0, 0, 0)
        for d in sorted({int(x.value // 86_400_000_000_000) for fr in frames for x in fr.ts}):
            if last is not None and d <= last:
                continue
            run = run + 1 if last is not None and d == last + 1 else 1
            last, best, days = d, max(best, run), days + 1
        state.update((last, run, best, days))
        yield pd.DataFrame([(int(key[0]), last, run, best, days)], columns=["key", "last_day", "current", "longest", "days"])

    return events.where("key IS NOT NULL AND ts IS NOT NULL").groupBy("key").applyInPandasWithState(
        f, "key bigint, last_day bigint, current bigint, longest bigint, days bigint", "last bigint, run bigint, best bigint, days bigint", "update", GroupStateTimeout.NoTimeout
    )


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Work off all that is there and stop; results go to Parquet files, exactly once by the checkpoint."""
    if mode == "append":
        q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:
        q = stream.writeStream.outputMode(mode).foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{path}/{i:06d}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
