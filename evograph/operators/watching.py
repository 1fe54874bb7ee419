"""Queries over the event table by the streaming operators; the stateful one runs as a stream over the table's files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..relations import Relations, r2
from ..session import shared_path
from ..streaming import watch


def _events(r: Relations) -> DataFrame:
    return watch.file_events(r.raw("events").withColumn("ts", F.col("ts").cast("timestamp")))


def _stream(r: Relations, name: str, last: DataFrame | None = None) -> tuple[DataFrame, str]:
    """The table's events, laid down in the shared folder, as a stream over their files; and a folder for what comes of it.

    last holds events that come behind all others.
    """
    spark = r.spark
    source = shared_path(spark, f"{name}-events")
    rows = r.raw("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")
    (rows if last is None else rows.unionByName(last)).write.parquet(source)
    return watch.file_events(watch.watch_source(spark, source, files_per_trigger=10_000)), shared_path(spark, name)


def debounced(r: Relations) -> DataFrame:
    """Z2 on the whole table."""
    return watch.debounce(_events(r))


def streamed_bursts(r: Relations) -> DataFrame:
    """Z2 as a stream, worked off to the end. An event of no key, far behind the others, moves the watermark past the last burst."""
    end = r.raw("events").agg(F.max(F.col("ts").cast("timestamp")).alias("ts")).where("ts IS NOT NULL").select(
        F.lit(None).cast("bigint").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(None).cast("bigint").alias("user_id"), F.lit("end").alias("event_type"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("props")
    )
    events, out = _stream(r, "bursts", end)
    watch.run_to_end(watch.debounce(events), f"{out}/rows", f"{out}/checkpoint")
    return r.spark.read.schema("key bigint, start_us bigint, event_id bigint, event_type string, events bigint").parquet(f"{out}/rows").where("event_type <> 'end' AND key IS NOT NULL")


def streamed_deltas(r: Relations) -> DataFrame:
    """The table's files as a stream, worked off to the end; the results are read from the shared folder."""
    events, out = _stream(r, "deltas")
    watch.run_to_end(watch.deltas(events), f"{out}/rows", f"{out}/checkpoint")
    return r.spark.read.parquet(f"{out}/rows").select("key", "event_id", "kind", r2(F.col("delta"), 4).alias("delta"))


def totals(r: Relations) -> DataFrame:
    """Z4."""
    return watch.totals(_events(r))


def day_streaks(r: Relations) -> DataFrame:
    """Z5 by the state machine over the stream of the table's files: what the state of each key ends with."""
    events, out = _stream(r, "streaks")
    watch.run_to_end(watch.activity_streaks(events), f"{out}/rows", f"{out}/checkpoint", "update")
    schema = "key bigint, last_day bigint, current bigint, longest bigint, days bigint, batch bigint"
    rows = r.spark.read.schema(schema).parquet(f"{out}/rows/*")
    return rows.groupBy("key").agg(*[F.max_by(c, "batch").alias(c) for c in ("last_day", "current", "longest", "days")])


def _q(f):
    return lambda spark, d: f(Relations(spark, d))


QUERIES = {"z2_debounced": _q(debounced), "z2_streamed": _q(streamed_bursts), "z3_deltas": _q(streamed_deltas), "z4_totals": _q(totals), "z5_day_streaks": _q(day_streaks)}
SQL = {
    "z2_debounced": """WITH e AS (SELECT user_id AS key, epoch_us(ts) AS us, event_id, event_type FROM events), g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY key ORDER BY us, event_id) < 500000 THEN 0 ELSE 1 END AS new FROM e),
        s AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY us, event_id) AS burst FROM g) SELECT key, min(us) AS start_us, arg_max(event_id, (us, event_id)) AS event_id, arg_max(event_type, (us, event_id)) AS event_type, count(*) AS events FROM s GROUP BY key, burst""",
    "z3_deltas": """SELECT user_id AS key, event_id, CASE WHEN value IS NULL THEN 'deleted' WHEN p IS NULL THEN 'added' ELSE 'modified' END AS kind, floor((coalesce(value, 0) - coalesce(p, 0)) * 10000 + 0.5) / 10000 AS delta FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL)""",
    "z4_totals": "SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS keys, round(sum(value), 2) AS value FROM events GROUP BY 1",
    "z5_day_streaks": """WITH d AS (SELECT DISTINCT user_id AS key, epoch_us(ts) // 86400000000 AS day FROM events WHERE user_id IS NOT NULL), i AS (SELECT key, day - row_number() OVER (PARTITION BY key ORDER BY day) AS island, day FROM d), j AS (SELECT key, island, count(*) AS k, max(day) AS last FROM i GROUP BY 1, 2)
        SELECT key, max(last) AS last_day, arg_max(k, last) AS current, max(k) AS longest, sum(k)::BIGINT AS days FROM j GROUP BY 1""",
}
SQL["z2_streamed"] = SQL["z2_debounced"] + " HAVING key IS NOT NULL"
