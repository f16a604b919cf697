"""The 0-100 priority: relevance, evidence, recency, adoption and their weighted total."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import computed, first_of, has_any, strings
from ..functions.dates import age_hours
from .match import label_of

# Fixed values of the rubric.
SCORE_VERSION = 1
WEIGHTS = {"relevance": 0.38, "evidence": 0.22, "recency": 0.25, "adoption": 0.15}
ADOPTION_CEILINGS = {
    "stars": 4000.0,
    "forks": 800.0,
    "downloads": 60000.0,
    "likes": 800.0,
    "citations": 400.0,
    "upvotes": 250.0,
    "influential_citations": 80.0,
}
PRIMARY_SOURCES = (
    "arXiv",
    "Hugging Face Models",
    "Hugging Face Datasets",
    "Hugging Face Papers",
    "GitHub",
    "GitHub Releases",
    "Survey",
    "Survey Report",
)
BANDS = (("Strong", 65.0), ("Notable", 48.0), ("Watch", 34.0))


@dataclass(frozen=True)
class ScoreConfig:
    lookback_hours: float = 48.0
    curated_lookback_hours: float = 720.0
    primary_sources: tuple[str, ...] = PRIMARY_SOURCES


def clamp(value: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), value))


def relevance(categories: Column, terms: Column, anchors: Column, demotions: Column) -> Column:
    """22 per category, 5 per term, 4 per anchor up to 12, minus 26 per demotion (counts in)."""
    points = 22.0 * categories + 5.0 * terms + F.least(F.lit(12.0), 4.0 * anchors)
    return clamp(points - 26.0 * demotions)


def evidence(
    source: Column,
    summary: Column,
    authors: Column,
    artifact_urls: Column,
    corroborating_sources: Column,
    venue: Column,
    primary_sources: tuple[str, ...] = PRIMARY_SOURCES,
) -> Column:
    """Substance that travels with a record: source, abstract, authors, artifacts, venue."""
    length = F.length(F.coalesce(summary, F.lit("")))

    def points(condition: Column, value: float) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))

    return clamp(
        F.when(source.isin(*primary_sources), F.lit(34.0)).otherwise(F.lit(17.0))
        + points(length >= 120, 18.0)
        + points(length >= 600, 8.0)
        + points(has_any(authors), 10.0)
        + F.least(F.lit(24.0), 8.0 * F.size(strings(artifact_urls)))
        + points(has_any(corroborating_sources), 16.0)
        + points(F.coalesce(venue, F.lit("")) != "", 10.0)
    )


def recency(age: Column, window: Column) -> Column:
    """Linear decay from 100 at age zero to 0 at the end of the window (hours)."""
    return F.when(window <= 0, F.lit(0.0)).otherwise(clamp(100.0 * (1.0 - age / window)))


def adoption(metrics: Column) -> Column:
    """Strongest metric on a log scale up to its ceiling; unknown metrics do not count."""
    ceilings = F.create_map(*[F.lit(x) for pair in ADOPTION_CEILINGS.items() for x in pair])
    scaled = F.transform(
        F.map_entries(metrics),
        lambda m: F.when(
            m["value"] > 0,
            F.log10(1.0 + m["value"]) / F.log10(1.0 + F.try_element_at(ceilings, m["key"])),
        ),
    )
    return clamp(100.0 * F.coalesce(F.array_max(scaled), F.lit(0.0)))


def round2(value: Column) -> Column:
    """Two decimals, half up on the decimal value."""
    return F.round(value.cast("decimal(18,6)"), 2).cast("double")


def total(components: dict[str, Column]) -> Column:
    weighted = [F.lit(weight) * components[name] for name, weight in WEIGHTS.items()]
    return round2(clamp(sum(weighted[1:], weighted[0])))


def score_records(df: DataFrame, now: Column, config: ScoreConfig = ScoreConfig()) -> DataFrame:
    """Add the four component scores and ``total_score`` to matched records.

    ``now`` is a column, so one job can score many scans as of their own dates. Undated
    records count as mid-window; ``published_at`` wins over ``updated_at``.
    """
    window = F.when(F.col("provenance") == "curated", F.lit(config.curated_lookback_hours)).otherwise(
        F.lit(config.lookback_hours)
    )
    moment = F.coalesce(F.col("published_at"), F.col("updated_at"))
    age = F.coalesce(age_hours(now, moment), window / 2.0)
    row = F.struct(
        relevance(
            F.size("categories"), F.size("matched_terms"), F.size("anchors"), F.col("demotions")
        ).alias("relevance_score"),
        evidence(
            *[F.col(c) for c in ("source", "summary", "authors", "artifact_urls", "corroborating_sources", "venue")],
            primary_sources=config.primary_sources,
        ).alias("evidence_score"),
        recency(age, window).alias("recency_score"),
        adoption(F.col("metrics")).alias("adoption_score"),
    )
    names = [f"{name}_score" for name in WEIGHTS]
    scored = computed(df, row, names)
    parts = {name: F.col(f"{name}_score") for name in WEIGHTS}
    return scored.withColumn("total_score", total(parts)).withColumn("score_version", F.lit(SCORE_VERSION))


def score_breakdown(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per record and component: weight, score, contribution."""
    parts = F.array(
        *[
            F.struct(
                F.lit(name).alias("component"),
                F.lit(weight).alias("weight"),
                round2(F.col(f"{name}_score")).alias("score"),
                round2(F.lit(weight) * F.col(f"{name}_score")).alias("contribution"),
            )
            for name, weight in WEIGHTS.items()
        ]
    )
    return df.select(*keys, F.inline(parts))


def with_band(df: DataFrame) -> DataFrame:
    """Add ``band``: Pinned, Strong, Notable, Watch, or NULL below the lowest band."""
    band = F.when(F.col("pinned"), F.lit("Pinned"))
    for name, floor in BANDS:
        band = band.when(F.col("total_score") >= floor, F.lit(name))
    return df.withColumn("band", band)


def band_counts(df: DataFrame) -> DataFrame:
    return with_band(df).groupBy(F.coalesce("band", F.lit("Below")).alias("band")).agg(F.count("*").alias("records"))


def with_rationale(
    df: DataFrame, labels: dict[str, str], max_topics: int | None = None, max_terms: int | None = None
) -> DataFrame:
    """Add ``rationale``: ordered human-readable reasons without repeats; None names all topics and terms."""

    def line(prefix: str, values: Column) -> Column:
        text = F.concat(F.lit(prefix), F.array_join(values, ", "))
        return F.when(F.size(values) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))

    topics = F.transform(first_of(F.col("categories"), max_topics), lambda k: label_of(k, labels))
    lines = F.concat(
        F.transform(strings(F.col("corroborating_sources")), lambda s: F.concat(F.lit("Also found via "), s)),
        F.transform(strings(F.col("demotion_reasons")), lambda r: F.concat(F.lit("Demoted: "), r)),
        line("Topics: ", topics),
        line("Matched: ", first_of(F.col("matched_terms"), max_terms)),
        line("Tracked family: ", F.col("model_families")),
        strings(F.col("watchlist_notes")),
        F.array(F.concat(F.lit("Primary record: "), F.col("source"))),
    )
    return df.withColumn("rationale", F.array_distinct(F.filter(lines, lambda x: x != "")))
