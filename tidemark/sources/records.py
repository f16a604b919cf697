"""The shared record shape every payload mapping ends in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import clean_metrics
from ..functions.text import squash
from ..operators.quality import payload_hash

_EMPTY = "array<string>"

# Column -> type, in the order of a record.
RECORD_COLUMNS = {
    "source": "string",
    "source_id": "string",
    "title": "string",
    "url": "string",
    "published_at": "timestamp",
    "updated_at": "timestamp",
    "summary": "string",
    "authors": _EMPTY,
    "organizations": _EMPTY,
    "artifact_urls": _EMPTY,
    "metrics": "map<string,double>",
    "facets": "map<string,array<string>>",
    "event_kind": "string",
    "provenance": "string",
    "venue": "string",
    "section": "string",
    "hint_categories": _EMPTY,
    "discovered_at": "timestamp",
    "retrieved_at": "timestamp",
    "raw_payload_hash": "string",
    "position": "bigint",
}
RECORD_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in RECORD_COLUMNS.items())


def text(col: Column) -> Column:
    """White space collapsed, NULL as empty."""
    return squash(col)


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def one(value: Column) -> Column:
    """A one-element array, empty for NULL or blank."""
    return F.filter(F.array(value), lambda v: v.isNotNull() & (v != ""))


def facet_map(entries: dict[str, Column]) -> Column:
    """A ``map<string,array<string>>`` of the facets that have a value."""
    pairs = F.array(
        *[F.struct(F.lit(k).alias("key"), v.cast(_EMPTY).alias("value")) for k, v in entries.items()]
    )
    return F.map_from_entries(F.filter(pairs, lambda e: F.coalesce(F.size(e["value"]) > 0, F.lit(False))))


def metric_map(entries: dict[str, Column]) -> Column:
    """Metrics that read as a number above zero."""
    pairs = [x for k, v in entries.items() for x in (F.lit(k), v.cast("string"))]
    return clean_metrics(F.create_map(*pairs))


def position_in_payload(payload_no: str, index: Column) -> Column:
    """Input order of the n-th entry of a payload."""
    return F.shiftleft(F.col(payload_no).cast("bigint"), 32) + index


def to_records(df: DataFrame, columns: dict[str, Column], hash_columns: list[str], now: Column) -> DataFrame:
    """Bring mapped columns to the record shape; what a mapping leaves out gets its default."""
    defaults = {
        "summary": F.lit(""), "venue": F.lit(""), "section": F.lit(""), "event_kind": F.lit("published"),
        "provenance": F.lit("live"), "discovered_at": now, "retrieved_at": now,
        "metrics": F.create_map(), "facets": F.create_map(),
    }
    mapped = df.select(
        "*",
        *[
            columns.get(name, defaults.get(name, F.array() if kind == _EMPTY else F.lit(None))).cast(kind).alias(f"r_{name}")
            for name, kind in RECORD_COLUMNS.items()
            if name != "raw_payload_hash"
        ],
    )
    hashed = mapped.withColumn("r_raw_payload_hash", payload_hash(hash_columns, mapped.schema) if hash_columns else F.lit(""))
    return hashed.select(*[F.col(f"r_{name}").alias(name) for name in RECORD_COLUMNS])
