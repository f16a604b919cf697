"""Rollups over the snapshot table: days, counts, trends, facets, velocity, ledger, health.

Items carry ``scan_date``. Tables with one row per scan date are small by nature, so windows
over *dates* (never over items) run in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import has_any, strings
from .match import label_of


def _flag_counts() -> list[Column]:
    pinned = has_any(F.col("model_families")) | has_any(F.col("watchlist"))
    return [
        F.count("*").alias("item_count"),
        F.count_if(pinned).alias("pinned_count"),
        F.count_if(F.col("provenance") == "curated").alias("curated_count"),
    ]


def day_rollup(items: DataFrame, health: DataFrame) -> DataFrame:
    """Per scan date: items, pinned, curated, sources ok and in total."""
    days = items.groupBy("scan_date").agg(*_flag_counts())
    checks = health.groupBy("scan_date").agg(
        F.count_if("ok").alias("sources_ok"), F.count("*").alias("sources_total")
    )
    return days.join(checks, "scan_date", "full").select(
        "scan_date",
        *[
            F.coalesce(c, F.lit(0)).alias(c)
            for c in ("item_count", "pinned_count", "curated_count", "sources_ok", "sources_total")
        ],
    )


def _values(df: DataFrame, col: str, keep: Sequence[str]) -> DataFrame:
    """Non-blank values of a scalar or array column, one row each."""
    exploded = F.explode(col) if dict(df.dtypes)[col].startswith("array") else F.col(col)
    return df.select(*keep, exploded.alias("value")).where("value is not null and value <> ''")


def value_counts(df: DataFrame, col: str, by: Sequence[str] = ("scan_date",)) -> DataFrame:
    """Counts of each value of ``col`` per group; blanks are skipped."""
    return _values(df, col, by).groupBy(*by, "value").agg(F.count("*").alias("count"))


def all_value_counts(df: DataFrame, facets: dict[str, str], by: Sequence[str] = ("scan_date",)) -> DataFrame:
    """``value_counts`` of several columns in one pass: (by…, facet, value, count)."""
    pairs = F.concat(*_facet_pairs(df, facets))
    long = df.select(*by, F.inline(pairs)).where("value is not null and value <> ''")
    return long.groupBy(*by, "facet", "value").agg(F.count("*").alias("count"))


def _facet_pairs(df: DataFrame, facets: dict[str, str]) -> list[Column]:
    types = dict(df.dtypes)

    def tagged(facet: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("value")))

    return [
        tagged(facet, strings(F.col(col)) if types[col].startswith("array") else F.array(F.col(col).cast("string")))
        for facet, col in facets.items()
    ]


def _numbered_dates(df: DataFrame) -> DataFrame:
    dates = df.select("scan_date").distinct()
    return dates.withColumn("scan_no", F.row_number().over(W.orderBy("scan_date")))


def category_trends(items: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """Count, baseline, delta and comparability per (scan, category).

    The baseline is the preceding *scan*, whatever its date; a category of either scan appears.
    ``scans`` lists the scan dates when some hold no item.
    """
    counts = value_counts(items, "categories").withColumnRenamed("value", "category")
    numbered = _numbered_dates(items if scans is None else scans)
    # The date table has one row per calendar day at most.
    current = counts.join(F.broadcast(numbered), "scan_date").select("scan_no", "category", "count")
    previous = current.select((F.col("scan_no") + 1).alias("scan_no"), "category", F.col("count").alias("baseline"))
    both = current.join(previous, ["scan_no", "category"], "full")
    # The inner join drops the baselines that follow the last scan.
    return both.join(numbered, "scan_no").select(
        "scan_date",
        "category",
        F.coalesce("count", F.lit(0)).alias("count"),
        F.coalesce("baseline", F.lit(0)).alias("baseline"),
        (F.coalesce("count", F.lit(0)) - F.coalesce("baseline", F.lit(0))).alias("delta"),
        (F.col("scan_no") > 1).alias("comparable"),
    )


FACETS = {
    "dates": "scan_date",
    "categories": "categories",
    "sources": "source",
    "organizations": "organizations",
    "model_families": "model_families",
    "event_kinds": "event_kind",
    "provenance": "provenance",
}


def facets(items: DataFrame, columns: dict[str, str] = FACETS) -> DataFrame:
    """Distinct values per facet with their display ``place`` from 1: dates newest first, others by value.

    A window over one facet sorts its distinct values alone, and dates are one per day.
    """
    types = dict(items.dtypes)
    filled = items.withColumns(
        {c: F.coalesce(F.col(c).cast("string"), F.lit("live" if c == "provenance" else "")) for c in columns.values() if not types[c].startswith("array")}
    )
    long = filled.select(F.inline(F.concat(*_facet_pairs(filled, columns)))).where("value is not null and value <> ''")
    order = [F.when(F.col("facet") == "dates", F.col("value")).desc_nulls_last(), F.col("value")]
    return long.distinct().withColumn("place", F.row_number().over(W.partitionBy("facet").orderBy(*order)).cast("bigint"))


def totals(items: DataFrame) -> DataFrame:
    """Items, days, pinned and curated over all snapshots."""
    per_day = items.groupBy("scan_date").agg(*_flag_counts())
    return per_day.agg(
        F.coalesce(F.sum("item_count"), F.lit(0)).alias("items"),
        F.count("*").alias("days"),
        F.coalesce(F.sum("pinned_count"), F.lit(0)).alias("pinned"),
        F.coalesce(F.sum("curated_count"), F.lit(0)).alias("curated"),
    )


def velocity(items: DataFrame, labels: dict[str, str], window: int = 7) -> DataFrame:
    """Recent against prior counts per category over the last observed days.

    Days are those on which any category was seen, not calendar days.
    """
    counts = value_counts(items, "categories").withColumnRenamed("value", "category")
    days = counts.select("scan_date").distinct().withColumn("_age", F.row_number().over(W.orderBy(F.desc("scan_date"))))
    # One row per calendar day at most.
    aged = counts.join(F.broadcast(days), "scan_date")
    recent = F.coalesce(F.sum(F.when(F.col("_age") <= window, F.col("count"))), F.lit(0))
    prior = F.coalesce(F.sum(F.when(F.col("_age").between(window + 1, 2 * window), F.col("count"))), F.lit(0))
    spans = days.agg((F.max("_age") > window).alias("comparable")).scalar()
    return aged.groupBy("category").agg(recent.alias("recent"), prior.alias("prior"), F.sum("count").alias("total")).select(
        "category",
        label_of(F.col("category"), labels).alias("label"),
        "recent",
        "prior",
        (F.col("recent") - F.col("prior")).alias("delta"),
        "total",
        spans.alias("comparable"),
    )


def ranked(items: DataFrame, col: str, limit: int = 40) -> DataFrame:
    """Most frequent values: (−count, label)."""
    counts = value_counts(items, col, ()).withColumnRenamed("value", "label")
    return counts.orderBy(F.desc("count"), "label").limit(limit)


def top_categories(items: DataFrame, k: int = 8) -> DataFrame:
    return ranked(items, "categories", k).withColumnRenamed("label", "category")


def family_summary(items: DataFrame) -> DataFrame:
    """Per family: records, last scan, best-scoring record (earliest wins a tie)."""
    seen = items.select("scan_date", "position", "title", "total_score", F.explode("model_families").alias("family"))
    best = F.struct(F.col("total_score"), F.struct((-F.datediff("scan_date", F.lit("1970-01-01"))).alias("d"), -F.col("position")))
    return seen.groupBy("family").agg(
        F.count("*").alias("records"),
        F.max("scan_date").alias("last_seen"),
        F.max_by("title", best).alias("best_title"),
        F.max("total_score").alias("best_score"),
    )


def _top_labels(items: DataFrame, col: str, k: int, label=lambda c: c) -> DataFrame:
    """Per scan date the ``k`` most frequent values as ``value count, …``."""
    counts = value_counts(items, col)
    rank = F.row_number().over(W.partitionBy("scan_date").orderBy(F.desc("count"), "value"))
    top = counts.withColumn("_rn", rank).where(F.col("_rn") <= k)
    text = F.concat(label(F.col("value")), F.lit(" "), F.col("count").cast("string"))
    # At most k rows per date reach this list.
    return top.groupBy("scan_date").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_rn", text.alias("text")))), lambda x: x["text"]), ", "
        ).alias(f"top_{col}")
    )


def ledger(items: DataFrame, funnels: DataFrame, health: DataFrame, labels: dict[str, str]) -> DataFrame:
    """One row per scan: items, pinned, top sources and topics, flow and health."""
    days = day_rollup(items, health)
    sources = _top_labels(items, "source", 3)
    topics = _top_labels(items, "categories", 3, lambda c: label_of(c, labels))
    flow = funnels.select("scan_date", "fetched", "published")
    joined = days.join(sources, "scan_date", "left").join(topics, "scan_date", "left").join(flow, "scan_date", "left")
    return joined.select(
        "scan_date",
        "item_count",
        "pinned_count",
        F.coalesce("top_source", F.lit("—")).alias("top_sources"),
        F.coalesce("top_categories", F.lit("—")).alias("top_topics"),
        F.concat_ws(" → ", F.coalesce("fetched", F.lit(0)), F.coalesce("published", F.lit(0))).alias("flow"),
        F.concat(F.col("sources_ok"), F.lit("/"), F.col("sources_total"), F.lit(" ok")).alias("health"),
    )


def health_status(health: DataFrame) -> DataFrame:
    """Checks per source and status: ok, failed, or failed (required)."""
    status = (
        F.when(F.col("ok"), F.lit("ok")).when(F.col("required"), F.lit("failed (required)")).otherwise(F.lit("failed"))
    )
    return health.groupBy("source", status.alias("status")).agg(
        F.count("*").alias("checks"), F.sum("item_count").alias("item_count")
    )


def latest_health(health: DataFrame) -> DataFrame:
    """Health rows of the newest scan, with their display state."""
    newest = health.agg(F.max("scan_date").alias("d")).scalar()
    state = F.when(F.col("ok"), F.concat(F.lit("ok · "), F.col("item_count").cast("string"))).otherwise(F.lit("failed"))
    return health.where(F.col("scan_date") == newest).select("scan_date", "source", state.alias("state"))


def available_reports(entries: DataFrame, date_col: str = "report_date") -> DataFrame:
    """Entries per dated report, with the newest report marked."""
    counts = entries.where(F.col(date_col).isNotNull()).groupBy(date_col).agg(F.count("*").alias("entries"))
    newest = entries.agg(F.max(date_col).alias("d")).scalar()
    return counts.withColumn("is_latest", F.col(date_col) == newest)


def missing_dates(reports: DataFrame, snapshots: DataFrame, date_col: str = "scan_date", overwrite: bool = False) -> DataFrame:
    """Report dates that have no snapshot yet (all of them when overwriting)."""
    dates = reports.select(date_col).distinct()
    return dates if overwrite else dates.join(snapshots.select(date_col).distinct(), date_col, "left_anti")


def digest(items: DataFrame, k: int = 40) -> DataFrame:
    """Pinned and generic top ``k`` of every scan with the number left out."""
    section = F.when(F.col("pinned"), F.lit("pinned")).otherwise(F.lit("generic"))
    tagged = items.withColumn("section_kind", section)
    keys = ["scan_date", "section_kind"]
    order = [F.desc("total_score"), F.desc_nulls_last("published_at"), F.col("position")]
    top = tagged.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    sizes = tagged.groupBy(*keys).agg(F.greatest(F.count("*") - k, F.lit(0)).alias("remaining"))
    return top.join(sizes, keys)
