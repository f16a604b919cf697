"""Windows, gates, funnel and the ranked selection of a scan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import has_any
from ..functions.dates import hours_before
from ..rules import NO_ANCHOR_REASON
from .dedupe import fresh_first


@dataclass(frozen=True)
class SelectConfig:
    """Defaults of an unconfigured scan; pass 30 to follow a tuned configuration."""

    minimum_score: float = 34.0
    max_items_per_source: int = 300
    report_limit: int = 400


def in_window(df: DataFrame, columns: Sequence[str], now: Column, hours) -> DataFrame:
    """Rows with any candidate timestamp at or after ``now - hours``."""
    since = hours_before(now, hours)
    condition = F.lit(False)
    for c in columns:
        condition = condition | F.coalesce(F.col(c) >= since, F.lit(False))
    return df.where(condition)


def in_scan_window(df: DataFrame, now: Column, live_hours: float = 48.0, curated_hours: float = 720.0) -> DataFrame:
    """Live rows of the scan window and curated rows of their longer one.

    Curated rows without a date use their report date.
    """
    curated = F.col("provenance") == "curated"
    report_date = F.col("report_date") if "report_date" in df.columns else F.lit(None).cast("timestamp")
    live_seen = F.greatest("published_at", "updated_at")
    moment = F.when(curated, F.coalesce(F.col("published_at"), report_date)).otherwise(live_seen)
    hours = F.when(curated, F.lit(curated_hours)).otherwise(F.lit(live_hours))
    return df.where(moment >= hours_before(now, hours))


def classify_event(df: DataFrame, now: Column, hours: float, created: str = "created_at") -> DataFrame:
    """``event_kind``: published when created inside the window, else updated."""
    fresh = F.col(created) >= hours_before(now, hours)
    return df.withColumn("event_kind", F.when(fresh, F.lit("published")).otherwise(F.lit("updated")))


def with_pinned(df: DataFrame) -> DataFrame:
    return df.withColumn("pinned", has_any(F.col("model_families")) | has_any(F.col("watchlist")))


def with_stage(df: DataFrame, config: SelectConfig = SelectConfig()) -> DataFrame:
    """Add ``stage``: the first failing gate, or ``qualified``.

    A pin passes the score floor but no other gate; a missing category counts as out of domain.
    """
    reasons = F.col("suppression_reasons")
    stage = (
        F.when(F.array_contains(reasons, NO_ANCHOR_REASON), F.lit("out_of_domain"))
        .when(F.size(reasons) > 0, F.lit("suppressed"))
        .when(F.size("categories") == 0, F.lit("out_of_domain"))
        .when(~F.col("pinned") & (F.col("total_score") < config.minimum_score), F.lit("below_threshold"))
        .otherwise(F.lit("qualified"))
    )
    return df.withColumn("stage", stage)


def cap_per_source(
    df: DataFrame, limit: int, by: Sequence[str] = (), position: str = "position"
) -> DataFrame:
    """Strongest ``limit`` rows per source by (pinned, score); ties keep merge order.

    ``limit <= 0`` means no cap. The rank filter is pushed below the shuffle, so a source that
    holds most rows sends at most ``limit`` rows per task.
    """
    if limit <= 0:
        return df
    order = [F.desc("pinned"), F.desc("total_score"), fresh_first(df, position)]
    ranked = df.withColumn("_rn", F.row_number().over(W.partitionBy(*by, "source").orderBy(*order)))
    return ranked.where(F.col("_rn") <= limit).drop("_rn")


def select_records(
    scored: DataFrame,
    config: SelectConfig = SelectConfig(),
    by: Sequence[str] = (),
    position: str = "position",
) -> DataFrame:
    """Ranked published records: gates, per-source cap, order (pinned, score, freshness), limit.

    With ``by`` columns every group (a report date, say) is its own scan.
    """
    qualified = with_stage(scored, config).where("stage = 'qualified'").drop("stage")
    capped = cap_per_source(qualified, config.max_items_per_source, by, position)
    order = [F.desc("pinned"), F.desc("total_score"), fresh_first(capped, position)]
    if by:
        rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
        return capped.withColumn("rank", rank).where(F.col("rank") <= config.report_limit)
    return capped.orderBy(*order).limit(config.report_limit)


def funnel(scored: DataFrame, config: SelectConfig = SelectConfig(), by: Sequence[str] = ()) -> DataFrame:
    """Counters per scan: fetched, deduplicated, gate losses, published, pinned.

    Cap and limit are counted, not executed: a source with ``n`` qualified rows publishes
    ``min(n, cap)`` of them, and pinned rows always come first. Rows lost to the cap or the limit
    appear in no bucket. Needs ``copies`` from the merge (1 when absent); a ``stage`` from ``with_stage`` is used as it is.
    """
    copies = F.col("copies") if "copies" in scored.columns else F.lit(1)
    qualified = F.col("stage") == "qualified"
    cap = F.lit(config.max_items_per_source if config.max_items_per_source > 0 else 9223372036854775807)
    per_source = (
        (scored if "stage" in scored.columns else with_stage(scored, config))
        .groupBy(*by, "source")
        .agg(
            F.sum(copies).alias("fetched"),
            F.count("*").alias("deduplicated"),
            *[F.count_if(F.col("stage") == s).alias(s) for s in ("out_of_domain", "suppressed", "below_threshold")],
            F.least(F.count_if(qualified), cap).alias("published"),
            F.least(F.count_if(qualified & F.col("pinned")), cap).alias("pinned"),
        )
    )
    kept = ("fetched", "deduplicated", "out_of_domain", "suppressed", "below_threshold")
    limit = F.lit(config.report_limit).cast("bigint")
    return per_source.groupBy(*by).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in kept],
        *[F.least(F.coalesce(F.sum(c), F.lit(0)), limit).alias(c) for c in ("published", "pinned")],
        F.lit(config.minimum_score).alias("minimum_score"),
    )


def funnel_rollup(funnels: DataFrame, dates: Sequence | None = None, date_col: str = "scan_date") -> DataFrame:
    """Counters summed over the active scan dates (all when ``dates`` is None)."""
    active = funnels if dates is None else funnels.where(F.col(date_col).isin(*dates))
    counters = ("fetched", "deduplicated", "out_of_domain", "suppressed", "below_threshold", "published", "pinned")
    return active.agg(*[F.sum(c).alias(c) for c in counters])


def facet_filter(
    df: DataFrame,
    equals: dict[str, str] | None = None,
    contains: dict[str, str] | None = None,
    query: str | None = None,
    fields: Sequence[str] = ("title", "summary", "source", "section", "organizations", "model_families", "watchlist"),
) -> DataFrame:
    """Conjunction of optional facet predicates and a case-insensitive substring search."""
    types = dict(df.dtypes)
    for column, value in (equals or {}).items():
        base = F.coalesce(F.col(column), F.lit("live")) if column == "provenance" else F.col(column)
        df = df.where(base == value)
    for column, value in (contains or {}).items():
        df = df.where(F.array_contains(column, value))
    if query:
        parts = [
            F.coalesce(F.array_join(c, " ") if types[c].startswith("array") else F.col(c), F.lit(""))
            for c in fields
        ]
        # Missing fields still leave their separator, so a match cannot span two fields by accident.
        hay = F.lower(F.concat(*[x for i, p in enumerate(parts) for x in ((F.lit(" "), p) if i else (p,))]))
        df = df.where(hay.contains(query.lower()))
    return df
