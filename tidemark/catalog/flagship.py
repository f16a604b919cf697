"""The flagship query: the ranked records of the scan, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.score import with_band, with_rationale
from . import views as v


def ranked_with_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = with_band(with_rationale(v.published(spark, sf_dir), v.RULES.labels))
    return told.select(
        "source", "source_id", "title", "total_score", "band",
        F.array_join("categories", ", ").alias("categories"), F.array_join("rationale", "; ").alias("reasons"),
    )
