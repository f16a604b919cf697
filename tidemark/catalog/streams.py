"""Streaming queries over the events table, each run to its end and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import scratch
from ..streaming import jobs
from . import views as v
from .views import NOW

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def _events(spark: SparkSession, sf: str, files_per_batch: int = 1) -> DataFrame:
    """The events as a stream of at least six batches, from files by time."""
    v.utc(spark)
    events, folder = v.table(spark, sf, "events"), scratch(spark, "events")
    events.repartitionByRange(6, "ts").write.parquet(folder)
    return jobs.file_stream(spark, folder, events.schema, files_per_batch=files_per_batch)


def _run(spark: SparkSession, name: str, stream: DataFrame, start=jobs.append_files, **options) -> str:
    path, checkpoint = scratch(spark, name), scratch(spark, f"{name}-progress")
    start(stream, path, checkpoint, **options).awaitTermination()
    return path


@query(f"SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 48 HOUR")
def x1_lookback(spark, sf):
    recent = jobs.lookback(_events(spark, sf), "ts", v.now().cast("timestamp"))
    return spark.read.parquet(_run(spark, "x1", recent.select("event_id", "user_id", "event_type")))


@query("SELECT DISTINCT user_id, event_type FROM events")
def x2_unique_in_window(spark, sf):
    keys = ["user_id", "event_type"]
    path, progress = scratch(spark, "x2"), scratch(spark, "x2-progress")
    jobs.report_once(_events(spark, sf), keys, path, progress).awaitTermination()
    return spark.read.parquet(path).select(*keys)


@query(f"SELECT DISTINCT user_id, event_type FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 48 HOUR")
def x2_unique_in_lookback(spark, sf):
    """One report per key of the rows that lie in the look-back window."""
    keys = ["user_id", "event_type"]
    path, progress = scratch(spark, "x2-recent"), scratch(spark, "x2-recent-progress")
    recent = jobs.lookback(_events(spark, sf), "ts", v.now().cast("timestamp"))
    jobs.report_once(recent, keys, path, progress).awaitTermination()
    return spark.read.parquet(path).select(*keys)


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS count FROM events GROUP BY 1, 2")
def x3_daily_counts(spark, sf):
    path, progress = scratch(spark, "x3"), scratch(spark, "x3-progress")
    jobs.partial_counts(_events(spark, sf), "ts", "event_type", path, progress).awaitTermination()
    return jobs.daily_totals(spark, path, "event_type")


@query("""
SELECT event_type, count(*) AS observations, max(value) AS score, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day
FROM events GROUP BY 1""")
def x4_entity_state(spark, sf):
    state = jobs.entity_state(_events(spark, sf), "event_type", "value", "ts")
    path = _run(spark, "x4", state, jobs.replace_batches, mode="update")
    latest = jobs.latest_state(spark, path, ["event_type"])
    return latest.select(
        "event_type", "observations", "score",
        F.date_format("first_seen", "yyyy-MM-dd").alias("first_day"), F.date_format("last_seen", "yyyy-MM-dd").alias("last_day"),
    )


@query("SELECT CAST(ts AS DATE) AS scan_date, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY 1")
def x5_dated_sink(spark, sf):
    """Written in six batches, then again in batches of other files, which replaces every date."""
    path = scratch(spark, "x5")
    for files in (1, 4):
        dated = _events(spark, sf, files).withColumn("scan_date", F.to_date("ts"))
        jobs.replace_batches(dated, path, scratch(spark, "x5-progress"), by=("scan_date",)).awaitTermination()
    rows = jobs.current_rows(spark, path, ["scan_date"])
    return rows.groupBy("scan_date").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total"))
