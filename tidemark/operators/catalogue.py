"""Standing catalogue: sections, enriched entries, counts, listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import ordered_union, strings
from ..functions.text import normalize, slug
from ..rules import RuleSet
from .match import _names, label_of, rule_hits
from .rollup import value_counts


def with_sections(entries: DataFrame, trail_col: str = "section") -> DataFrame:
    """Add ``section_key``, ``section_title`` and ``subsection`` from a `` > `` trail."""
    trail = F.split(F.coalesce(trail_col, F.lit("")), " > ")
    top = F.when(F.coalesce(trail_col, F.lit("")) == "", F.lit("Uncategorized")).otherwise(F.element_at(trail, 1))
    rest = F.array_join(F.slice(trail, 2, F.size(trail)), " > ")
    keyed = entries.withColumns({"section_title": top, "subsection": rest})
    key = F.coalesce(F.nullif(slug(F.col("section_title")), F.lit("")), F.lit("uncategorized"))
    return keyed.withColumn("section_key", key)


def catalogue_sections(entries: DataFrame, position: str = "position") -> DataFrame:
    """Sections with their first title and their size, largest first."""
    sized = with_sections(entries).groupBy("section_key").agg(
        F.min_by("section_title", F.col(position)).alias("section_title"), F.count("*").alias("entries")
    )
    return sized.orderBy(F.desc("entries"), "section_key")


def section_entries(entries: DataFrame, published: str = "published_at", position: str = "position", first: int | None = None) -> DataFrame:
    """Entries with their section, subsection and ``place`` in it from 1, newest first, undated last.

    ``first`` keeps only the first places, which Spark finds before it moves rows; without it a section is
    sorted as a whole, so its size is that of one task.
    """
    newest = Window.partitionBy("section_key").orderBy(F.desc_nulls_last(published), position)
    placed = with_sections(entries).withColumn("place", F.row_number().over(newest))
    return placed if first is None else placed.where(F.col("place") <= first)


def enrich_catalogue(entries: DataFrame, rules: RuleSet) -> DataFrame:
    """Hinted then inferred categories, families and watch-list names of catalogue entries."""
    text = F.concat_ws(" ", "title", "summary", "section")
    hits = entries.withColumn("_text", normalize(text)).withColumn("_hits", rule_hits(F.col("_text"), rules))
    return hits.withColumns(
        {
            "categories": ordered_union(strings(F.col("hint_categories")), _names(F.col("_hits"), "category", "name")),
            "model_families": _names(F.col("_hits"), "family", "name"),
            "watchlist": _names(F.col("_hits"), "watch", "name"),
        }
    ).drop("_text", "_hits")


def catalogue_counts(enriched: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Long table of counts: entries, sections, per category, per family."""
    sections = with_sections(enriched)
    heads = sections.agg(F.count("*").alias("entries"), F.countDistinct("section_key").alias("sections"))
    head_rows = heads.select(
        F.inline(
            F.array(
                F.struct(F.lit("total").alias("kind"), F.lit("entries").alias("label"), F.col("entries").alias("count")),
                F.struct(F.lit("total").alias("kind"), F.lit("sections").alias("label"), F.col("sections").alias("count")),
            )
        )
    )
    by_category = value_counts(enriched, "categories", ()).select(
        F.lit("category").alias("kind"), label_of(F.col("value"), labels).alias("label"), "count"
    )
    by_family = value_counts(enriched, "model_families", ()).select(
        F.lit("family").alias("kind"), F.col("value").alias("label"), "count"
    )
    return head_rows.unionByName(by_category).unionByName(by_family)


def catalogue_list(entries: DataFrame, limit: int = 240, position: str = "position") -> DataFrame:
    """Entries newest first across all sections."""
    return entries.orderBy(F.desc_nulls_last("published_at"), position).limit(limit)
