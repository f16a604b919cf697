"""Global row numbers and neighbours without a window over the whole table.

A window without partitions moves a table to one task. Here rows are sorted over Spark's range partitions, stored
once with their place, and a place becomes a rank by the number of rows in earlier partitions: a table of one row
per partition. The sort key must be unique for a fixed result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.storage import stored

_ROW_BITS = 33  # of monotonically_increasing_id


def _placed(df: DataFrame, key: Column) -> DataFrame:
    """Stored rows with ``_part`` and ``_at``, which both ascend with the key."""
    ordered = df.withColumn("_key", key).repartitionByRange("_key").sortWithinPartitions("_key").drop("_key")
    ordered = ordered.withColumn("_at", F.monotonically_increasing_id())
    return stored(ordered.withColumn("_part", F.shiftright("_at", _ROW_BITS)), "ordered")


def with_global_rank(df: DataFrame, key: Column, out: str = "rank") -> DataFrame:
    """Add the 1-based position of every row in ascending order of ``key`` (a struct column)."""
    placed = _placed(df, key)
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # One row per partition: one window task and a broadcast as small as the plan itself.
    offsets = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_start")).select(
        "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_start") + 1).alias("_shift")
    )
    ranked = placed.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_at") + F.col("_shift"))
    return ranked.drop("_part", "_at", "_shift")


def with_neighbours(df: DataFrame, key: Column, value: str, prev: str = "previous", next: str = "next") -> DataFrame:
    """Add the ``value`` of the rows before and after each row in ascending order of ``key``."""
    placed = _placed(df, key)
    by_part = W.orderBy("_part")
    # One row per partition that has rows.
    edges = placed.groupBy("_part").agg(F.min_by(value, "_at").alias("_low"), F.max_by(value, "_at").alias("_high")).select(
        "_part", F.lag("_high").over(by_part).alias("_before"), F.lead("_low").over(by_part).alias("_after")
    )
    inside = W.partitionBy("_part").orderBy("_at")
    is_first, is_last = F.row_number().over(inside) == 1, F.lead("_at").over(inside).isNull()
    return (
        placed.withColumns({"_lag": F.lag(value).over(inside), "_lead": F.lead(value).over(inside), "_first": is_first, "_last": is_last})
        .join(F.broadcast(edges), "_part")
        .withColumn(prev, F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_lag")))
        .withColumn(next, F.when(F.col("_last"), F.col("_after")).otherwise(F.col("_lead")))
        .drop("_part", "_at", "_lag", "_lead", "_first", "_last", "_before", "_after")
    )


def lower_median(df: DataFrame, column: str, bins: int = 1024, few: int = 100_000):
    """The lower median of a numeric column, NULLs aside; None for a table without values.

    Selection by counting: each round counts the rows of equal ranges and goes on in the one that holds the middle,
    until its distinct values are ``few``. No round moves more than ``bins`` counts, the last one ``few`` values.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL")
    n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    wanted, inside = (n + 1) // 2, n
    while inside > few and low < high and (high - low) / bins > 0:
        bin_of = F.least(F.floor((F.col("v") - low) / ((high - low) / bins)), F.lit(bins - 1))
        counts = values.where(F.col("v").between(low, high)).groupBy(bin_of.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        for b in sorted(counts.collect(), key=lambda r: r["b"]):
            if wanted <= b["n"]:
                break
            wanted -= b["n"]
        low, high, inside = b["low"], b["high"], b["n"]
    counts = values.where(F.col("v").between(low, high)).groupBy("v").agg(F.count("*").alias("n"))
    reached = F.sum("n").over(W.orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    return counts.select("v", reached.alias("reached")).where(F.col("reached") >= wanted).agg(F.min("v")).first()[0]
