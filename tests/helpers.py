"""Small typed record tables for tests."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.sources.records import RECORD_COLUMNS

NOW = datetime(2026, 7, 28, 12)
SCHEMA = ", ".join(f"{n} {'timestamp_ntz' if t == 'timestamp' else t}" for n, t in RECORD_COLUMNS.items())


def now():
    return F.lit(NOW.isoformat(sep=" ")).cast("timestamp_ntz")


def hours_ago(hours: float) -> datetime:
    return NOW - timedelta(hours=hours)


def record(position: int = 0, **over) -> tuple:
    row = dict(
        source="arXiv", source_id=f"id{position}", title="A Vision-Language Benchmark for Charts", url="https://arxiv.org/abs/2607.00001",
        published_at=hours_ago(6), updated_at=None, summary="", authors=["Ada", "Bob"], organizations=[], artifact_urls=[], metrics={},
        facets={}, event_kind="published", provenance="live", venue="", section="", hint_categories=[], discovered_at=None,
        retrieved_at=None, raw_payload_hash="", position=position,
    )
    row.update(over)
    return tuple(row[c] for c in RECORD_COLUMNS)


def records(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def values(df, col):
    return [r[0] for r in df.select(col).collect()]
