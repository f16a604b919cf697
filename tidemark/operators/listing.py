"""Ordered listings of records and documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedupe import first_by
from .select import with_pinned

# Categories of releases.
MODEL_CATEGORIES = ("vlm_model", "omni_unified", "world_model")


def record_list(items: DataFrame, limit: int = 220, position: str = "position") -> DataFrame:
    """Pinned, then score, then newest; ties keep the newest scan and its order."""
    order = [F.desc("pinned"), F.desc("total_score"), F.desc_nulls_last("published_at"), F.desc("scan_date"), F.col(position)]
    return with_pinned(items).orderBy(*order).limit(limit)


def release_list(items: DataFrame, categories: Sequence[str] = MODEL_CATEGORIES, limit: int = 60, position: str = "position") -> DataFrame:
    """Records of the given categories, newest first (scan date when undated), then by score."""
    wanted = F.array(*map(F.lit, categories))
    released = F.coalesce(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.col("scan_date").cast("string"))
    hits = items.where(F.arrays_overlap("categories", wanted)).withColumn("released", released)
    return hits.orderBy(F.desc("released"), F.desc("total_score"), F.desc("scan_date"), position).limit(limit)


def lookup_in_order(df: DataFrame, keys: Sequence, key_col: str, order: Sequence) -> DataFrame:
    """First row of each listed key, in list order (column ``list_position``).

    The key list is a literal argument, so its table has a known size.
    """
    spark = df.sparkSession
    listed = spark.range(1).select(
        F.posexplode(F.array(*map(F.lit, keys))).alias("list_position", key_col)
    )
    hits = first_by(df.where(F.col(key_col).isin(*keys)), [key_col], order)
    return hits.join(F.broadcast(listed), key_col).orderBy("list_position")
