"""Source registry and the union of sources with their health."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import feeds, markdown

Mapping_ = Callable[..., DataFrame]

# Key -> (display label, payload mapping). Adding a source touches nothing else.
SOURCES: dict[str, tuple[str, Mapping_]] = {
    "arxiv": (feeds.ARXIV, feeds.rss_records),
    "arxiv_atom": (feeds.ARXIV, feeds.atom_records),
    "hub_models": (feeds.HUB_MODELS, feeds.hub_records),
    "hub_datasets": (feeds.HUB_DATASETS, feeds.hub_records),
    "hub_papers": (feeds.HUB_PAPERS, feeds.paper_records),
    "repos": (feeds.REPOS, feeds.repo_records),
    "releases": (feeds.RELEASES, feeds.release_records),
    "scholar": (feeds.SCHOLAR, feeds.scholar_records),
    "works": (feeds.WORKS, feeds.works_records),
    "curated": (markdown.CURATED_REPORT, markdown.markdown_table_records),
}


def register(key: str, label: str, mapping: Mapping_) -> None:
    SOURCES[key] = (label, mapping)


class RequiredSourceError(RuntimeError):
    """A required source failed and nothing was kept."""


def collect_sources(
    spark: SparkSession,
    sources: Mapping[str, DataFrame | Callable[[], DataFrame]],
    required: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """(records, health) of all sources in their given order.

    A source is a DataFrame or a function that makes one; a function that fails (missing path,
    wrong columns) is recorded in ``health`` and costs only its own rows. ``position`` orders
    records by source, then by position inside it.
    """
    frames, failures = {}, {}
    for key, source in sources.items():
        try:
            frames[key] = source() if callable(source) else source
        except (PySparkException, ValueError, OSError) as error:
            failures[key] = f"{type(error).__name__}: {error}"
    order = {key: i for i, key in enumerate(sources)}
    records = None
    for key, frame in frames.items():
        shift = F.lit(order[key]).cast("bigint")
        placed = frame.withColumn("source_key", F.lit(key)).withColumn(
            "position", F.shiftleft(shift, 48) + F.col("position")
        )
        records = placed if records is None else records.unionByName(placed, allowMissingColumns=True)
    listed = spark.createDataFrame(
        [(k, k not in failures, k in required, failures.get(k, "")) for k in sources],
        "source_key string, ok boolean, required boolean, detail string",
    )
    if records is None:
        return None, listed.withColumn("item_count", F.lit(0).cast("bigint"))
    counts = records.groupBy("source_key").agg(F.count("*").alias("item_count"))
    health = counts.join(listed, "source_key", "right").withColumn("item_count", F.coalesce("item_count", F.lit(0)))
    return records, health


def payload_files(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options) -> tuple[DataFrame, DataFrame]:
    """(rows, files) of a folder in which files may be unreadable.

    Files are listed without being read; rows come from all that can be, with ``_file``. ``files`` has each
    path with its bytes and rows, and ``ok``, which is false where a file gave no row at all; files of no bytes are not
    listed. A broken file costs its own rows, and what it held before the break is kept.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("length").alias("bytes")
    )
    reader = spark.read.format(fmt).schema(schema).option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true")
    rows = reader.options(**options).load(path).withColumn("_file", F.col("_metadata.file_path"))
    counted = rows.groupBy("_file").agg(F.count("*").alias("rows"))
    files = listed.join(counted, "_file", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    return rows, files.withColumn("ok", F.col("rows") > 0)


def file_health(files: Mapping[str, DataFrame]) -> DataFrame:
    """(source_key, files, bad_files, detail) from the file lists of several sources; ``detail`` names up to five bad files."""
    named = None
    for key, listed in files.items():
        one = listed.select(F.lit(key).alias("source_key"), "_file", "ok")
        named = one if named is None else named.unionByName(one)
    counts = named.groupBy("source_key").agg(F.count("*").alias("files"), F.count_if(~F.col("ok")).alias("bad_files"))
    # A top-k report: five names per source.
    bad = named.where("NOT ok").select("source_key", F.regexp_extract("_file", "[^/]*$", 0).alias("name"))
    few = bad.withColumn("_rn", F.row_number().over(W.partitionBy("source_key").orderBy("name"))).where("_rn <= 5")
    detail = few.groupBy("source_key").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("detail"))
    return counts.join(detail, "source_key", "left").withColumn("detail", F.coalesce("detail", F.lit("")))


def collect_registered(
    spark: SparkSession, payloads: Mapping[str, DataFrame], now: Column, required: tuple[str, ...] = (),
    options: Mapping[str, Mapping[str, object]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``collect_sources`` over payload tables by registered key, with each key's label in ``health``.

    ``options`` holds further arguments of a key's mapping, such as the rules of curated reports. Payloads
    that are not JSON (rows whose ``payload`` no reader takes) cost only themselves: ``health`` counts them
    in ``unreadable`` for payloads that are JSON documents, NULL where the payload is of another form.
    """
    if unknown := payloads.keys() - SOURCES.keys():
        raise KeyError(f"no registered source: {sorted(unknown)}")
    options = options or {}

    def made(key: str) -> Callable[[], DataFrame]:
        extra = dict(options.get(key, {}))
        if key == "hub_datasets":
            extra.setdefault("kind", "datasets")
        return lambda: SOURCES[key][1](payloads[key], now=now, **extra)

    records, health = collect_sources(spark, {key: made(key) for key in payloads}, required)
    labels = spark.createDataFrame([(key, SOURCES[key][0]) for key in payloads], "source_key string, label string")
    counted = None
    for key, table in payloads.items():
        is_json = "payload" in table.columns and key not in ("arxiv", "arxiv_atom")
        bad = F.count_if(F.try_parse_json("payload").isNull()) if is_json else F.lit(None).cast("bigint")
        row = table.agg(bad.alias("unreadable")).withColumn("source_key", F.lit(key))
        counted = row if counted is None else counted.unionByName(row)
    return records, health.join(labels, "source_key").join(counted, "source_key")


def check_required(health: DataFrame, kept: DataFrame) -> None:
    """Raise when a required source failed and the scan kept no record."""
    failed = [row["source_key"] for row in health.where("required and not ok").select("source_key").collect()]
    if failed and kept.isEmpty():
        raise RequiredSourceError("Required sources failed and nothing was collected: " + ", ".join(failed))
