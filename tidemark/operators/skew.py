"""Joins against per-key counts in which any key may hold a large share of the rows.

Spark's adaptive rule splits skewed partitions only of joins whose inputs come straight from exchanges. A join
with an aggregate has the aggregate in between and is left alone, so the split is written out: keys that
outweigh a partition are known from their counts, their rows are spread over salts, and only their count
rows are repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_counts(
    left: DataFrame, counts: DataFrame, key: str, n: str, spread_by: list[str], how: str = "inner",
    partitions: int | None = None,
) -> DataFrame:
    """Join ``left`` with ``counts`` (one row per key, frequency in ``n``) on ``key``.

    ``how`` is inner or left_semi. ``spread_by`` are columns of ``left`` that tell rows of one key apart. A
    key with more rows than an average partition gets as many salts as it would fill partitions, so at
    most ``partitions`` keys (default: the session's shuffle partitions) are broadcast.
    """
    partitions = partitions or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filled = F.col(n) * partitions / counts.agg(F.sum(n)).scalar()
    hot = counts.where(filled > 1).select(key, F.ceil(filled).cast("int").alias("_salts"))
    salts = F.coalesce("_salts", F.lit(1))
    salted = left.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread_by), salts).cast("int"))
    repeated = counts.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return salted.drop("_salts").join(repeated.drop("_salts"), [key, "_salt"], how).drop("_salt")
