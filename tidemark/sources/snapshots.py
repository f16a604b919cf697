"""Dated snapshots: public projection, validated sink, scans of tables and JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import first_of
from ..operators.quality import validate_snapshot
from ..operators.score import round2
from ..plans.storage import stored

# Sizes of the list columns in a short published digest.
DIGEST_CAPS = {"authors": 12, "artifact_urls": 8, "matched_terms": 16}
SCORES = ("relevance_score", "evidence_score", "recency_score", "adoption_score", "total_score")
REQUIRED = (
    "source", "source_id", "title", "url", "event_kind", "provenance", "categories", *SCORES, "score_version",
)
OPTIONAL = (
    "published_at", "updated_at", "summary", "authors", "organizations", "artifact_urls", "metrics", "facets",
    "venue", "section", "matched_terms", "model_families", "watchlist", "watchlist_notes", "rationale",
    "suppression_reasons", "corroborating_sources", "discovered_at", "raw_payload_hash",
)
SCHEMA_VERSION = 1

_ITEM = (
    "source string, source_id string, title string, url string, event_kind string, provenance string, "
    "categories array<string>, relevance_score double, evidence_score double, recency_score double, "
    "adoption_score double, total_score double, score_version int, published_at string, updated_at string, "
    "summary string, authors array<string>, organizations array<string>, artifact_urls array<string>, "
    "metrics map<string,double>, venue string, section string, matched_terms array<string>, "
    "model_families array<string>, watchlist array<string>, watchlist_notes array<string>, "
    "rationale array<string>, suppression_reasons array<string>, corroborating_sources array<string>, "
    "discovered_at string, raw_payload_hash string"
)
DOCUMENT_SCHEMA = (
    "schema_version int, date string, generated_at string, since string, "
    "selection struct<fetched:bigint, deduplicated:bigint, out_of_domain:bigint, suppressed:bigint, "
    "below_threshold:bigint, published:bigint, pinned:bigint, minimum_score:double>, "
    "health array<struct<source:string, ok:boolean, item_count:bigint, required:boolean, duration_seconds:double, detail:string>>, "
    f"items array<struct<{_ITEM}>>"
)


class SnapshotError(ValueError):
    """A snapshot failed validation and was not written."""


def public_projection(df: DataFrame, extra: tuple[str, ...] = (), caps: dict[str, int] | None = None) -> DataFrame:
    """Published columns: scores on two decimals, empty optional fields NULL, lists cut only by ``caps``."""
    caps = caps or {}
    types = dict(df.dtypes)

    def published(name: str) -> Column:
        col = first_of(F.col(name), caps.get(name))
        if name in SCORES:
            return round2(col)
        if name == "metrics":
            col = F.transform_values(name, lambda _, v: round2(v))
        if name in REQUIRED:
            return col
        if types[name].startswith(("array", "map")):
            return F.when(F.size(col) > 0, col)
        return F.nullif(col, F.lit("")) if types[name] == "string" else col

    names = [c for c in REQUIRED + OPTIONAL if c in df.columns]
    return df.select(*extra, *[published(c).alias(c) for c in names])


def public_json(df: DataFrame, extra: tuple[str, ...] = (), caps: dict[str, int] | None = None) -> DataFrame:
    """The public projection as one JSON document per record; empty fields are absent, lists cut only by ``caps``."""
    projected = public_projection(df, extra, caps)
    return projected.select(*extra, F.to_json(F.struct(*[c for c in projected.columns if c not in extra])).alias("item"))


def stage_snapshot(items: DataFrame) -> DataFrame:
    """``items`` in the shared folder, computed once and arranged by date: the only shuffle of a snapshot.

    Rebalancing splits a date that holds most rows and packs small ones.
    """
    return stored(items.hint("rebalance", F.col("scan_date")), "staged")


def write_snapshot(items: DataFrame, path: str, fmt: str = "parquet", staged: bool = False) -> None:
    """Write, audit, publish: one partition per date in ``items`` (column ``scan_date``), if all of them are valid.

    Rows are staged in the shared folder, so they are computed once and survive lost executors; the audit reads
    the staged rows, and only rows that pass it reach ``path``. Writing a date again replaces that date and no other.
    Rows of ``stage_snapshot``, or a part of them, are ``staged`` already; they may be written several times.
    """
    rows = items if staged else stage_snapshot(items)
    problems = validate_snapshot(rows).limit(5).collect()
    if problems:
        raise SnapshotError("; ".join(f"{p['source']}:{p['source_id']} {p['violation']}" for p in problems))
    # Staged files hold few dates each, so a task writes few files without another shuffle.
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("scan_date").format(fmt).save(path)


def read_snapshots(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """All snapshot rows; an unreadable file is an error. ``scan_date`` prunes partitions."""
    reader = spark.read.format(fmt)
    if schema:
        reader = reader.schema(schema)
    if fmt == "json":
        reader = reader.option("mode", "FAILFAST")
    return reader.load(path)


def write_item_lines(items: DataFrame, path: str) -> None:
    """One JSON document per item and line, in a folder per scan date: a form that splits over tasks at any size.

    Writing a date again replaces that date and no other.
    """
    lines = public_projection(items, ("scan_date", "position"))
    dated = lines.hint("rebalance", F.col("scan_date")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    dated.partitionBy("scan_date").json(path)


def read_item_lines(spark: SparkSession, path: str) -> DataFrame:
    """Items of a ``write_item_lines`` folder; a line that is no item is an error."""
    return spark.read.schema(f"position bigint, {_ITEM}, scan_date date").option("mode", "FAILFAST").json(path)


def write_documents(items: DataFrame, path: str) -> None:
    """One nested JSON document per scan date, in the published form, for readers that want a file per date.

    A date's items are one row, so this is for digests of bounded size; ``write_item_lines`` is for any size.
    """
    rows = public_projection(items, ("scan_date", "position"))
    item = F.to_json(F.struct(*[c for c in rows.columns if c not in ("scan_date", "position")]))
    listed = rows.groupBy("scan_date").agg(F.array_sort(F.collect_list(F.struct("position", item.alias("item")))).alias("i"))
    head = F.format_string('{"schema_version":%d,"date":"%s","items":[', F.lit(SCHEMA_VERSION), F.col("scan_date").cast("string"))
    document = F.concat(head, F.array_join("i.item", ","), F.lit("]}"))
    writer = listed.select("scan_date", document.alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("scan_date").text(path)


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, health, funnels) from one nested JSON document per date.

    A document without a date takes it from its file name.
    """
    raw = (
        spark.read.schema(DOCUMENT_SCHEMA).option("multiLine", "true").option("mode", "FAILFAST")
        .option("recursiveFileLookup", "true").json(path)
    )
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.json)?$", 1)
    dated = raw.withColumn("scan_date", F.coalesce(F.nullif("date", F.lit("")), stem).cast("date"))
    items = dated.select("scan_date", F.posexplode("items").alias("position", "_item")).select(
        "scan_date", F.col("position").cast("bigint").alias("position"), "_item.*"
    )
    health = dated.select("scan_date", F.inline("health"))
    funnels = dated.select("scan_date", "generated_at", "since", "selection.*")
    return items, health, funnels
