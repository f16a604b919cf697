"""All dashboard tables from the snapshot table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalogue, graph, rollup, select
from ..rules import RuleSet

COUNTED = {
    "category": "categories", "source": "source", "event": "event_kind", "family": "model_families",
    "organization": "organizations",
}


def dashboard(
    items: DataFrame, health: DataFrame, funnels: DataFrame, rules: RuleSet, entries: DataFrame | None = None,
    max_artifacts: int = 240,
) -> dict[str, DataFrame]:
    """Independent tables by name; each is one job over the snapshot table when written."""
    nodes, edges, summary = graph.build_graph(items, rules.labels, max_artifacts)
    tables = {
        "days": rollup.day_rollup(items, health),
        "counts": rollup.all_value_counts(items, COUNTED),
        "trends": rollup.category_trends(items),
        "facets": rollup.facets(items),
        "totals": rollup.totals(items),
        "ledger": rollup.ledger(items, funnels, health, rules.labels),
        "funnel": select.funnel_rollup(funnels),
        "graph_nodes": nodes,
        "graph_edges": edges,
        "graph_summary": summary,
        "topic_velocity": rollup.velocity(items, rules.labels),
        "source_mix": rollup.ranked(items, "source", 40),
        "organizations": rollup.ranked(items, "organizations", 24),
        "model_families": rollup.ranked(items, "model_families", 24),
        "families": rollup.family_summary(items),
    }
    if entries is not None:
        enriched = catalogue.enrich_catalogue(entries, rules)
        tables["catalogue"] = catalogue.with_sections(enriched)
        tables["catalogue_sections"] = catalogue.catalogue_sections(enriched)
        tables["catalogue_counts"] = catalogue.catalogue_counts(enriched, rules.labels)
    return tables


def write_dashboard(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """One folder per table, replaced as a whole."""
    for name, table in tables.items():
        table.withColumn("table_name", F.lit(name)).write.mode("overwrite").format(fmt).save(f"{path}/{name}")
