"""Entity graph over all snapshots: nodes, edges, capped assembly, neighbourhoods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import strings
from ..functions.text import slug
from ..plans.storage import stored
from .dedupe import with_artifact_key
from .match import label_of
from .score import round2
from .skew import join_counts


def _observation(kind: str, node_id: Column, label: Column, relation: str | None) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        node_id.alias("id"),
        label.alias("label"),
        F.lit(relation).cast("string").alias("relation"),
    )


def observations(items: DataFrame, labels: dict[str, str]) -> DataFrame:
    """One row per (record, entity it shows), in record order.

    Columns: artifact, kind, id, label, relation (NULL for the artifact itself), scan_date,
    position, seq, score, url, provenance.
    """
    keyed = with_artifact_key(items, "artifact")

    def names(column: str) -> Column:
        return F.filter(F.transform(strings(F.col(column)), lambda x: F.trim(x)), lambda x: x != "")

    found = F.concat(
        F.array(
            _observation(
                "artifact", F.col("artifact"), F.coalesce(F.nullif("title", F.lit("")), F.col("artifact")), None
            )
        ),
        F.transform(
            F.concat(
                F.array(F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown"))),
                strings(F.col("corroborating_sources")),
            ),
            lambda s: _observation("source", F.concat(F.lit("source:"), slug(s)), s, "FOUND_VIA"),
        ),
        F.transform(
            strings(F.col("categories")),
            lambda c: _observation("topic", F.concat(F.lit("topic:"), c), label_of(c, labels), "HAS_TOPIC"),
        ),
        F.transform(
            names("organizations"),
            lambda o: _observation("organization", F.concat(F.lit("org:"), slug(o)), o, "RELEASED_BY"),
        ),
        F.transform(
            names("model_families"),
            lambda f: _observation("model_family", F.concat(F.lit("family:"), slug(f)), f, "TRACKS_FAMILY"),
        ),
    )
    return keyed.select(
        "artifact",
        "scan_date",
        "position",
        F.coalesce("total_score", F.lit(0.0)).alias("score"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce(F.nullif("provenance", F.lit("")), F.lit("live")).alias("provenance"),
        F.posexplode(found).alias("seq", "_o"),
    ).select("*", "_o.*").drop("_o")


def nodes_of(obs: DataFrame) -> DataFrame:
    """Nodes with counts, peak score, first/last seen; label and URL first seen, provenance last."""
    when = F.struct("scan_date", "position", "seq")
    is_artifact = F.col("kind") == "artifact"
    return obs.groupBy("id", "kind").agg(
        F.min_by("label", when).alias("label"),
        F.count("*").alias("observations"),
        round2(F.max("score")).alias("score"),
        F.min("scan_date").alias("first_seen"),
        F.max("scan_date").alias("last_seen"),
        F.min_by(F.when(is_artifact, F.col("url")), when).alias("url"),
        F.max_by(F.when(is_artifact, F.col("provenance")), when).alias("provenance"),
    )


def edges_of(obs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Edges weighted by co-occurrence count, per group of ``by``."""
    linked = obs.where("relation is not null")
    return linked.groupBy(*by, F.col("artifact").alias("source"), F.col("id").alias("target"), "relation").agg(
        F.count("*").alias("weight")
    )


def graph_nodes(items: DataFrame, labels: dict[str, str]) -> DataFrame:
    return nodes_of(observations(items, labels))


def graph_edges(items: DataFrame, labels: dict[str, str]) -> DataFrame:
    return edges_of(observations(items, labels))


def retain_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are among ``nodes``.

    A context node may end most edges, so targets are joined with their frequencies.
    """
    ids = nodes.select("id")
    from_kept = edges.join(ids, edges["source"] == ids["id"], "left_semi")
    targets = edges.groupBy("target").agg(F.count("*").alias("_n"))
    kept_targets = targets.join(ids, targets["target"] == ids["id"], "left_semi")
    return join_counts(from_kept, kept_targets, "target", "_n", ["source", "relation"], "left_semi")


def top_artifacts(nodes: DataFrame, limit: int = 240) -> DataFrame:
    """Artifacts by (score, last seen), best first."""
    artifacts = nodes.where("kind = 'artifact'")
    return artifacts.orderBy(F.desc("score"), F.desc("last_seen"), "id").limit(limit)


def _published(nodes: DataFrame, max_artifacts: int) -> tuple[DataFrame, DataFrame]:
    """(published nodes, ids of kept artifacts) of a stored table of nodes; the cap bounds the broadcast."""
    kept = top_artifacts(nodes, max_artifacts)
    ids = F.broadcast(kept.select(F.col("id").alias("artifact")))
    return nodes.where("kind <> 'artifact'").unionByName(kept), ids


def _summary(nodes: DataFrame, days: Column) -> DataFrame:
    counts = nodes.agg(F.count_if(F.col("kind") == "artifact").alias("artifact_count"), F.count("*").alias("node_count"))
    return counts.withColumn("generated_from_days", days)


def build_graph(items: DataFrame, labels: dict[str, str], max_artifacts: int = 240) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, summary) of the published graph.

    All context nodes stay, artifacts are capped; ``artifact_count`` is taken before the cap.
    Every edge ends in a context node, so the retained edges are those of kept artifacts. Nodes are aggregated once.
    """
    obs = observations(items, labels)
    nodes = stored(nodes_of(obs), "nodes")
    published, ids = _published(nodes, max_artifacts)
    edges = edges_of(obs.join(ids, "artifact", "left_semi"))
    return published, edges, _summary(nodes, items.agg(F.countDistinct("scan_date").alias("n")).scalar())


def write_graph_partials(items: DataFrame, labels: dict[str, str], path: str) -> None:
    """Writes the nodes and edges of each scan date in ``items`` by themselves, one partition per date.

    A date that is written again is replaced, other dates stay: a new scan costs its own rows, not the history's.
    """
    obs = stored(observations(items, labels), "observations")
    is_artifact = F.col("kind") == "artifact"
    place = ["position", "seq"]
    nodes = obs.groupBy("scan_date", "id", "kind").agg(
        F.count("*").alias("observations"),
        F.max("score").alias("score"),
        F.min(F.struct(*place, "label", F.when(is_artifact, F.col("url")).alias("url"))).alias("first"),
        F.max(F.struct(*place, F.when(is_artifact, F.col("provenance")).alias("provenance"))).alias("last"),
    )
    for name, table in (("nodes", nodes), ("edges", edges_of(obs, ["scan_date"]))):
        writer = table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("scan_date").parquet(f"{path.rstrip('/')}/{name}")


def graph_from_partials(spark: SparkSession, path: str, max_artifacts: int = 240) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``build_graph`` gives over all dates of a ``write_graph_partials`` table, by merging the dates."""
    dated = spark.read.parquet(f"{path.rstrip('/')}/nodes")
    begin, end = F.struct("scan_date", "first.position", "first.seq"), F.struct("scan_date", "last.position", "last.seq")
    nodes = dated.groupBy("id", "kind").agg(
        F.min_by("first.label", begin).alias("label"),
        F.sum("observations").alias("observations"),
        round2(F.max("score")).alias("score"),
        F.min("scan_date").alias("first_seen"),
        F.max("scan_date").alias("last_seen"),
        F.min_by("first.url", begin).alias("url"),
        F.max_by("last.provenance", end).alias("provenance"),
    )
    nodes = stored(nodes, "nodes")
    published, ids = _published(nodes, max_artifacts)
    edges = spark.read.parquet(f"{path.rstrip('/')}/edges").join(ids.withColumnRenamed("artifact", "source"), "source", "left_semi")
    edges = edges.groupBy("source", "target", "relation").agg(F.sum("weight").alias("weight"))
    # The dates are names of partitions.
    return published, edges, _summary(nodes, dated.agg(F.countDistinct("scan_date").alias("n")).scalar())


def neighbours(edges: DataFrame, node_id: str) -> DataFrame:
    """Edges incident to a node."""
    return edges.where((F.col("source") == node_id) | (F.col("target") == node_id))


# The record facet that a node kind filters on.
NODE_FILTERS = {
    "topic": ("categories", "contains"),
    "source": ("source", "equals"),
    "organization": ("organizations", "contains"),
    "model_family": ("model_families", "contains"),
}


def records_of_node(items: DataFrame, kind: str, value: str) -> DataFrame:
    """Records behind a context node: the facet filter its kind stands for."""
    column, how = NODE_FILTERS[kind]
    condition = F.array_contains(column, value) if how == "contains" else F.col(column) == value
    return items.where(condition)


def top_nodes(nodes: DataFrame, k_by_kind: dict[str, int] | None = None) -> DataFrame:
    """Leading nodes per kind by (observations, score); 8 sources, 12 topics, 14 artifacts."""
    limits = k_by_kind or {"source": 8, "topic": 12, "artifact": 14}
    rank = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("observations"), F.desc("score"), "id"))
    kinds = nodes.where(F.col("kind").isin(*limits))
    # The constant bound lets Spark prune rows per task before the shuffle.
    widest = kinds.withColumn("rank", rank).where(F.col("rank") <= max(limits.values()))
    limit_map = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    return widest.where(F.col("rank") <= F.element_at(limit_map, F.col("kind")))
