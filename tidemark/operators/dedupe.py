"""Duplicate keys, cross-source merge, ordered distinct and exact identities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import empty_strings, let, strings
from ..functions.text import normalize, slug
from ..functions.urls import canonical_url
from ..plans.storage import broadcast_if_small, stored

# Fixed value: a title needs this many characters, spaces aside, to identify a record.
MIN_TITLE_KEY = 24

#: Texts that the freshest row with a value fills.
FILLED = ("summary", "venue", "section")
#: Lists that gain what copies add.
LISTS = ("artifact_urls", "organizations", "authors", "hint_categories")
ADDED = ("corroborating_sources", *LISTS, "metrics")
#: Hashes of repeated keys, 8 bytes each, that may be broadcast.
BROADCAST_HASHES = 2_000_000


def digest(*parts: Column) -> Column:
    """SHA-256 over the parts, each closed by a unit separator."""
    closed = [x for part in parts for x in (part, F.lit("\x1f"))]
    return F.sha2(F.concat(*closed).cast("binary"), 256)


def dedupe_key(title: Column, url: Column, identity: Column) -> Column:
    by_url = let(canonical_url(url), lambda c: digest(F.lit("url"), F.when(c != "", c).otherwise(identity)))

    def by_title(folded: Column) -> Column:
        long_enough = F.length(F.replace(folded, F.lit(" "), F.lit(""))) >= MIN_TITLE_KEY
        return F.when(long_enough, digest(F.lit("title"), folded)).otherwise(by_url)

    return let(normalize(title), by_title)


def with_dedupe_key(df: DataFrame, out: str = "dedupe_key") -> DataFrame:
    identity = F.concat_ws(":", "source", "source_id")
    return df.withColumn(out, dedupe_key(F.col("title"), F.col("url"), identity))


def freshness(df: DataFrame) -> Column:
    """Latest of the three record timestamps that exist in ``df``; NULL when none is set."""
    present = [F.col(c) for c in ("updated_at", "published_at", "discovered_at") if c in df.columns]
    return F.greatest(*present) if len(present) > 1 else present[0]


def staleness(df: DataFrame) -> Column:
    """Ascending sort key: freshest first, undated last."""
    return F.coalesce(-F.unix_micros(freshness(df).cast("timestamp")), F.lit(9223372036854775807))


def fresh_first(df: DataFrame, position: str) -> Column:
    """Ascending sort key: freshest first, undated last, then input position."""
    return F.struct(staleness(df).alias("stale"), F.col(position).alias("position"))


def merge_duplicates(
    df: DataFrame, by: Sequence[str] = (), position: str = "position", key: str = "dedupe_key"
) -> DataFrame:
    """Merge records of equal key; the freshest survives and gains what the others add.

    The survivor keeps its columns. Other rows contribute their source (``corroborating_sources``),
    URLs, organisations, authors, hints and the larger metric values; summary, venue and section
    come from the freshest row that has them. ``copies`` counts the merged rows. ``by`` columns
    separate independent merges, such as one per report date. Rows of one key and freshness go by ``position``.

    Texts are read last. Keyed rows are stored once; keys that repeat are found on 8-byte hashes, whose
    collisions are harmless, and all other rows pass without a shuffle. Of repeated keys only row numbers
    are aggregated: which row survives and which ones fill its empty texts. What copies add stays a long table
    (key, field, value, first place), reduced to distinct values before it becomes lists of a result row.
    """
    keys = [*by, key]
    keyed = df if key in df.columns else with_dedupe_key(df, key)
    names = [c for c in keyed.columns if c not in keys and c not in FILLED]
    keyed = keyed.withColumns(
        {"_hash": F.xxhash64(*keys), "_stale": staleness(df), "_row": F.monotonically_increasing_id()}
        | {f"_has_{c}": F.coalesce(F.col(c) != "", F.lit(False)) for c in FILLED}
    )
    keyed = stored(keyed, "keyed")
    repeated = stored(keyed.groupBy("_hash").count().where("count > 1").select("_hash"), "repeated")
    few = broadcast_if_small(repeated, BROADCAST_HASHES)
    columns = [*keys, "copies", *FILLED, *names, *ADDED]

    own = {c: F.coalesce(c, F.lit("")) for c in FILLED} | {c: strings(F.col(c)) for c in LISTS}
    none = {"copies": F.lit(1).cast("long"), "corroborating_sources": empty_strings(), "metrics": _metrics("metrics")}
    single = keyed.join(few, "_hash", "left_anti").withColumns(own | none).select(*dict.fromkeys(columns))

    copies = keyed.join(few, "_hash", "left_semi")
    place = F.struct("_stale", position, "_row")
    chosen = copies.groupBy(*keys).agg(
        F.count("*").alias("copies"), F.min(place)["_row"].alias("_row"),
        *[F.min(F.when(F.col(f"_has_{c}"), place))["_row"].alias(f"_from_{c}") for c in FILLED],
    )
    chosen = stored(chosen, "chosen")
    heads = copies.join(chosen.select("copies", "_row"), "_row").drop("_hash", "_stale")
    # Texts that the survivor lacks, from the rows that have them.
    lent = chosen.select("_row", F.inline(F.array(*[F.struct(F.lit(c).alias("_field"), F.col(f"_from_{c}").alias("_lender")) for c in FILLED])))
    lent = lent.where("_lender <> _row").join(copies.select(F.col("_row").alias("_lender"), *FILLED), "_lender")
    lent = lent.groupBy("_row").agg(*[F.max(F.when(F.col("_field") == c, F.col(c))).alias(f"_lent_{c}") for c in FILLED])
    heads = heads.join(lent, "_row", "left").drop("_row")
    merged = heads.join(_folded(_additions(copies, keys, position), keys), keys, "left")

    def appended(base: Column, extra: Column) -> Column:
        return F.concat(strings(base), F.array_except(strings(extra), strings(base)))

    non_empty_urls = F.array_remove(F.array_remove(strings(F.col("_url")), F.col("url")), "")
    own_metrics = _metrics("metrics")
    filled = {c: F.when(F.col(f"_has_{c}"), F.col(c)).otherwise(F.coalesce(f"_lent_{c}", F.lit(""))) for c in FILLED}
    gained = {
        "corroborating_sources": F.array_remove(strings(F.col("_source")), F.col("source")),
        "artifact_urls": appended(F.col("artifact_urls"), non_empty_urls),
        "organizations": appended(F.col("organizations"), F.array_remove(strings(F.col("_org")), "")),
        "authors": appended(F.col("authors"), F.col("_author")),
        "hint_categories": appended(F.col("hint_categories"), F.col("_hint")),
        "metrics": F.coalesce(
            F.transform_values(
                "_metric",
                lambda k, v: F.when(F.map_contains_key(own_metrics, k), v).otherwise(F.greatest(F.lit(0.0), v)),
            ),
            own_metrics,
        ),
    }
    return merged.withColumns(filled | gained).select(*dict.fromkeys(columns)).unionByName(single)


def _metrics(name: str) -> Column:
    return F.coalesce(name, F.create_map().cast("map<string,double>"))


def _additions(copies: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """(key, field, value, first place, largest amount) of what rows of repeated keys bring along."""

    def tagged(field: str, values: Column) -> Column:
        none = F.lit(None).cast("double").alias("amount")
        return F.transform(strings(values), lambda v: F.struct(F.lit(field).alias("field"), v.alias("value"), none))

    entries = F.concat(
        tagged("source", F.array("source")),
        tagged("url", F.concat(F.array("url"), strings(F.col("artifact_urls")))),
        *[tagged(field, F.col(c)) for field, c in {"org": "organizations", "author": "authors", "hint": "hint_categories"}.items()],
        F.transform(
            F.coalesce(F.map_entries("metrics"), F.array().cast("array<struct<key:string,value:double>>")),
            lambda m: F.struct(F.lit("metric").alias("field"), m["key"].alias("value"), m["value"].alias("amount")),
        ),
    )
    place = F.struct("_stale", position, "_row", "_at")
    listed = copies.select(*keys, "_stale", position, "_row", F.posexplode(entries).alias("_at", "_entry"))
    return listed.groupBy(*keys, F.col("_entry.field").alias("field"), F.col("_entry.value").alias("value")).agg(
        F.min(place).alias("_first"), F.max("_entry.amount").alias("amount")
    )


def _folded(added: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: lists of its distinct values in order of first appearance, and its metrics."""

    def gathered(field: str) -> Column:
        found = F.collect_list(F.when(F.col("field") == field, F.struct("_first", "value")))
        return F.transform(F.array_sort(found), lambda x: x["value"]).alias(f"_{field}")

    metric_entries = F.collect_list(F.when(F.col("field") == "metric", F.struct("value", "amount")))
    return added.groupBy(*keys).agg(
        *[gathered(f) for f in ("source", "url", "org", "author", "hint")],
        F.map_from_entries(metric_entries).alias("_metric"),
    )


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in the given order.

    The rank filter lets Spark keep one row per key and task before the shuffle.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def dedupe_overlap(reports: DataFrame, catalogue: DataFrame, position: str = "position") -> DataFrame:
    """Report rows and catalogue rows under one ``slug(title):url`` key, report rows first."""
    both = reports.withColumn("_priority", F.lit(0)).unionByName(
        catalogue.withColumn("_priority", F.lit(1)), allowMissingColumns=True
    )
    keyed = both.withColumn("overlap_key", F.concat_ws(":", slug(F.col("title")), F.col("url")))
    return first_by(keyed, ["overlap_key"], [F.col("_priority"), F.col(position)]).drop("_priority")


# Identifier shapes and the hub paths that are not repositories.
DOI = r"""(?U)(10\.\d{4,9}/[^\s"'<>]+)"""
ARXIV = r"(?i)arxiv\.org/(?:abs|pdf|html)/(\d{4}\.\d{4,5})"
HUB_PAPER = r"(?i)huggingface\.co/papers/(\d{4}\.\d{4,5})"
HUB_REPO = r"(?iU)huggingface\.co/(?:datasets/|models/)?([A-Za-z0-9][\w.\-]*/[\w.\-]+)"
GIT_REPO = r"(?iU)github\.com/([A-Za-z0-9][\w.\-]*/[\w.\-]+)"
HUB_RESERVED = ("papers", "collections", "spaces", "blog", "docs", "api")


def artifact_key(
    source: Column, source_id: Column, title: Column, url: Column, artifact_urls: Column, facets: Column | None = None
) -> Column:
    """Exact identity: DOI, arXiv id, hub id, hub URL, git URL, canonical URL, then a slug.

    Nothing fuzzy: similar titles never meet. Only the first hub path counts; when it is a
    reserved one, hub identity is given up. ``facets`` is a ``map<string,array<string>>``.
    """
    parts = [F.array(F.coalesce(url, F.lit(""))), strings(artifact_urls)]
    if facets is not None:
        for name, prefix in (("doi", "https://doi.org/"), ("arxiv_id", "https://arxiv.org/abs/")):
            value = F.nullif(F.try_element_at(F.try_element_at(facets, F.lit(name)), F.lit(1)), F.lit(""))
            parts.insert(0, F.array_compact(F.array(F.concat(F.lit(prefix), value))))
    joined = F.array_join(F.concat(*parts), " ")

    def tagged(prefix: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(prefix), value))

    doi = F.rtrim(F.lower(F.regexp_extract(joined, DOI, 1)), F.lit(".,;"))
    has_doi = joined.rlike(DOI)
    arxiv = F.coalesce(
        F.nullif(F.regexp_extract(joined, ARXIV, 1), F.lit("")), F.regexp_extract(joined, HUB_PAPER, 1)
    )
    hub = F.lower(F.regexp_extract(joined, HUB_REPO, 1))
    hub_ok = ~F.split_part(hub, F.lit("/"), F.lit(1)).isin(*HUB_RESERVED)
    git = F.regexp_replace(F.lower(F.regexp_extract(joined, GIT_REPO, 1)), r"\.git$", "")
    from_hub = source.startswith("Hugging Face") & (F.coalesce(source_id, F.lit("")) != "")
    fallback = F.concat_ws(" ", source, F.coalesce(F.nullif(source_id, F.lit("")), title, F.lit("")))
    return F.coalesce(
        F.when(has_doi, F.concat(F.lit("doi:"), doi)),
        tagged("arxiv:", arxiv),
        F.when(from_hub, F.concat(F.lit("hf:"), F.lower(source_id))),
        F.when(hub_ok, tagged("hf:", hub)),
        tagged("gh:", git),
        tagged("url:", F.lower(canonical_url(url))),
        F.concat(F.lit("id:"), slug(fallback)),
    )


def with_artifact_key(df: DataFrame, out: str = "artifact_key") -> DataFrame:
    facets = F.col("facets") if "facets" in df.columns else None
    columns = [F.col(c) for c in ("source", "source_id", "title", "url", "artifact_urls")]
    return df.withColumn(out, artifact_key(*columns, facets))
