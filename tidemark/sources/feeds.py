"""Payload tables to record tables, one mapping per feed shape.

Each mapping takes rows with a raw ``payload`` string and a ``payload_no`` that fixes input
order (plus the columns it names), and returns records. Nothing is gated or scored here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import first_of
from ..functions.dates import hours_before, parse_datetime
from ..functions.text import strip_markdown, truncate
from ..functions.urls import owner_of
from ..operators.dedupe import first_by
from .records import blank_to_null, facet_map, metric_map, one, position_in_payload, text, to_records

ARXIV = "arXiv"
HUB_MODELS, HUB_DATASETS, HUB_PAPERS = "Hugging Face Models", "Hugging Face Datasets", "Hugging Face Papers"
REPOS, RELEASES = "GitHub", "GitHub Releases"
SCHOLAR, WORKS = "Semantic Scholar", "OpenAlex"


@dataclass(frozen=True)
class Limits:
    """Characters of texts and values of lists that a record keeps; None keeps all."""

    abstract: int | None = None
    description: int | None = None
    card: int | None = None
    notes: int | None = None
    authors: int | None = None
    tags: int | None = None
    topics: int | None = None
    institutions: int | None = None


ALL = Limits()
# The limits of a short published digest.
DIGEST = Limits(abstract=1400, description=700, card=900, notes=800, authors=24, tags=24, topics=20, institutions=8)

# Announcement kinds of the RSS feed.
EVENT_KINDS = {"new": "published", "cross": "cross-listed", "replace": "updated", "replace-cross": "updated"}

_XML = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}
_PAPER_ID = r"(\d{4}\.\d{4,5})(?:v\d+)?"
_ANNOUNCE = r"(?iU)^arXiv:(\S+)\s+Announce Type:\s*([\w-]+)\s*"
_ABSTRACT = r"(?is)Abstract:\s*(.*)"


def _paper_id(value: Column) -> Column:
    return F.regexp_extract(F.coalesce(value, F.lit("")), _PAPER_ID, 1)


def _prefixed(prefix: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(prefix), value))


def _non_blank(values: Column) -> Column:
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def _entries(payloads: DataFrame, parsed: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per element of an array expression, with its position."""
    return payloads.select("payload_no", *keep, F.posexplode(parsed).alias("_i", "e")).withColumn(
        "position", position_in_payload("payload_no", F.col("_i"))
    )


def _first_wins(records: DataFrame) -> DataFrame:
    return first_by(records, ["source_id"], [F.col("position")])


def rss_records(payloads: DataFrame, now: Column, limits: Limits = ALL) -> DataFrame:
    """RSS announcements; the ``feed`` column names the listing."""
    schema = (
        "channel struct<lastBuildDate:string, pubDate:string, item:array<struct<title:string, link:string, "
        "description:string, creator:string, category:array<string>, pubDate:string>>>"
    )
    parsed = payloads.withColumn("_x", F.from_xml("payload", schema, _XML))
    built = parsed.withColumn(
        "channel_date", F.coalesce(blank_to_null(text(F.col("_x.channel.lastBuildDate"))), text(F.col("_x.channel.pubDate")))
    )
    rows = _entries(built, F.col("_x.channel.item"), ("feed", "channel_date")).select(
        "*", text(F.col("e.title")).alias("title"), text(F.col("e.link")).alias("link"),
        F.coalesce("e.description", F.lit("")).alias("raw"),
    ).where("title <> '' and link <> ''")
    stripped = F.regexp_replace("raw", r"(?U)^\s+|\s+\z", "")
    announced = F.regexp_extract(stripped, _ANNOUNCE, 2)
    identified = rows.withColumns(
        {
            "kind": F.lower(announced),
            "paper": F.coalesce(
                blank_to_null(_paper_id(F.regexp_extract(stripped, _ANNOUNCE, 1))), _paper_id(F.col("link"))
            ),
        }
    )
    kinds = F.create_map(*[F.lit(x) for pair in EVENT_KINDS.items() for x in pair])
    authors = F.transform(F.split(text(F.col("e.creator")), ",| and "), lambda a: F.trim(a))
    columns = {
        "source": F.lit(ARXIV),
        "source_id": F.coalesce(blank_to_null(F.col("paper")), F.col("link")),
        "title": F.col("title"),
        "url": F.coalesce(_prefixed("https://arxiv.org/abs/", F.col("paper")), F.col("link")),
        "published_at": parse_datetime(F.coalesce(blank_to_null(text(F.col("e.pubDate"))), F.col("channel_date"))),
        "summary": truncate(text(F.regexp_extract("raw", _ABSTRACT, 1)), limits.abstract),
        "authors": first_of(_non_blank(authors), limits.authors),
        "event_kind": F.coalesce(F.try_element_at(kinds, F.col("kind")), F.lit("published")),
        "facets": facet_map(
            {"arxiv_categories": _non_blank(F.transform(F.col("e.category"), text)), "feed": one(F.col("feed"))}
        ),
        "artifact_urls": one(_prefixed("https://arxiv.org/pdf/", F.col("paper"))),
        "position": F.col("position"),
    }
    return to_records(identified, columns, ["title", "link", "feed"], now)


def atom_records(payloads: DataFrame, now: Column, limits: Limits = ALL) -> DataFrame:
    """Atom query results."""
    schema = (
        "entry array<struct<id:string, title:string, published:string, updated:string, summary:string, "
        "author:array<struct<name:string>>, link:array<struct<_href:string,_title:string>>, "
        "category:array<struct<_term:string>>, primary_category:struct<_term:string>>>"
    )
    rows = _entries(payloads, F.from_xml("payload", schema, _XML)["entry"]).select(
        "*", text(F.col("e.title")).alias("title"), _paper_id(text(F.col("e.id"))).alias("paper"),
        text(F.col("e.published")).alias("published"), text(F.col("e.updated")).alias("updated"),
    ).where("title <> '' and paper <> ''")
    pdfs = F.filter(F.col("e.link"), lambda l: (l["_title"] == "pdf") & (F.coalesce(l["_href"], F.lit("")) != ""))
    names = F.transform(F.col("e.author"), lambda a: text(a["name"]))
    columns = {
        "source": F.lit(ARXIV),
        "source_id": F.col("paper"),
        "title": F.col("title"),
        "url": _prefixed("https://arxiv.org/abs/", F.col("paper")),
        "published_at": parse_datetime(F.col("published")),
        "updated_at": parse_datetime(F.col("updated")),
        "summary": truncate(text(F.col("e.summary")), limits.abstract),
        "authors": first_of(_non_blank(names), limits.authors),
        "event_kind": F.when((F.col("updated") != "") & (F.col("updated") != F.col("published")), "updated").otherwise("published"),
        "facets": facet_map(
            {
                "arxiv_categories": F.transform(F.col("e.category"), lambda c: c["_term"]),
                "primary_category": one(F.col("e.primary_category._term")),
                "feed": F.array(F.lit("atom")),
            }
        ),
        "artifact_urls": F.transform(pdfs, lambda l: l["_href"]),
        "position": F.col("position"),
    }
    return to_records(rows, columns, ["paper", "updated"], now)


def _list_or_scalar(raw: Column) -> Column:
    """A JSON field that is a string or a list of strings, as an array."""
    return F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(one(raw))


def hub_records(
    payloads: DataFrame, now: Column, kind: str = "models", cards: DataFrame | None = None,
    card_limit: int | None = None, lookback_hours: float = 48.0, limits: Limits = ALL,
) -> DataFrame:
    """Hub repositories (``kind`` models or datasets); the ``query`` column names the search.

    ``cards(repo_id, body)`` gives prose to all records, or to the freshest ``card_limit`` ones.
    """
    card_fields = ("license", "language", "task_categories", "base_model", "size_categories")
    schema = (
        "array<struct<id:string, modelId:string, createdAt:string, lastModified:string, last_modified:string, "
        "downloads:string, likes:string, pipeline_tag:string, library_name:string, sha:string, tags:array<string>, "
        f"cardData:struct<{', '.join(f'{f}:string' for f in card_fields)}>>>"
    )
    e = F.col("e")
    rows = _entries(payloads, F.from_json("payload", schema), ("query",)).select(
        "*",
        F.trim(F.coalesce(blank_to_null(e["id"]), e["modelId"], F.lit(""))).alias("id"),
        F.coalesce(blank_to_null(e["lastModified"]), e["last_modified"]).alias("lastModified"),
        e["downloads"].alias("downloads"),
    ).where("id <> ''")
    prefix = "https://huggingface.co/datasets/" if kind == "datasets" else "https://huggingface.co/"
    url = F.concat(F.lit(prefix), F.col("id"))
    created, modified = parse_datetime(e["createdAt"]), parse_datetime(F.col("lastModified"))
    fresh = F.coalesce(created >= hours_before(now, lookback_hours), F.lit(False))
    columns = {
        "source": F.lit(HUB_DATASETS if kind == "datasets" else HUB_MODELS),
        "source_id": F.col("id"),
        "title": F.col("id"),
        "url": url,
        "published_at": F.when(blank_to_null(e["createdAt"]).isNotNull(), created).otherwise(modified),
        "updated_at": modified,
        "organizations": one(owner_of(F.col("id"))),
        "artifact_urls": F.array(url),
        "metrics": metric_map({"downloads": e["downloads"], "likes": e["likes"]}),
        "facets": facet_map(
            {
                "tags": first_of(_non_blank(e["tags"]), limits.tags),
                "query": one(F.col("query")),
                "hub_kind": F.array(F.lit(kind)),
                **{f: one(e[f]) for f in ("pipeline_tag", "library_name", "sha")},
                **{f: _list_or_scalar(e["cardData"][f]) for f in card_fields},
            }
        ),
        "event_kind": F.when(fresh, "published").otherwise("updated"),
        "position": F.col("position"),
    }
    records = _first_wins(to_records(rows, columns, ["id", "lastModified", "downloads"], now))
    if cards is None:
        return records
    prose = cards.select(F.col("repo_id").alias("source_id"), strip_markdown(F.col("body"), limits.card).alias("_card"))
    if card_limit is not None:
        newest = F.greatest("updated_at", "published_at")
        freshest = records.orderBy(F.desc_nulls_last(newest), "position").limit(card_limit).select("source_id")
        prose = prose.join(freshest, "source_id", "left_semi")
    # Of several cards of one repository the first in text order counts.
    joined = records.join(prose.groupBy("source_id").agg(F.min("_card").alias("_card")), "source_id", "left")
    return joined.withColumn("summary", F.coalesce("_card", "summary")).select(*records.columns)


def paper_records(payloads: DataFrame, now: Column, limits: Limits = ALL) -> DataFrame:
    """Daily listed papers; ``listed_on`` is the listing date, newest listing first in order."""
    schema = (
        "array<struct<paper:struct<id:string, title:string, summary:string, publishedAt:string, upvotes:string, "
        "authors:array<string>>, id:string, title:string, summary:string, publishedAt:string, upvotes:string, "
        "authors:array<string>, numComments:string>>"
    )
    e = F.col("e")
    inner = lambda field: F.when(e["paper"].isNotNull(), e["paper"][field]).otherwise(e[field])
    rows = _entries(payloads, F.from_json("payload", schema), ("listed_on",)).select(
        "*", F.trim(F.coalesce(inner("id"), F.lit(""))).alias("id"), text(inner("title")).alias("title"),
        inner("upvotes").alias("upvotes"),
    ).where("id <> '' and title <> ''")

    def author(raw: Column) -> Column:
        named = F.from_json(raw, "name string, fullname string")
        return F.when(raw.startswith("{"), F.coalesce(blank_to_null(named["name"]), named["fullname"])).otherwise(raw)

    columns = {
        "source": F.lit(HUB_PAPERS),
        "source_id": F.col("id"),
        "title": F.col("title"),
        "url": F.concat(F.lit("https://huggingface.co/papers/"), F.col("id")),
        "published_at": parse_datetime(F.coalesce(blank_to_null(inner("publishedAt")), e["publishedAt"])),
        "summary": truncate(text(inner("summary")), limits.abstract),
        "authors": first_of(_non_blank(F.transform(inner("authors"), author)), limits.authors),
        "artifact_urls": F.array(F.concat(F.lit("https://arxiv.org/abs/"), F.col("id"))),
        "metrics": metric_map({"upvotes": F.col("upvotes"), "comments": e["numComments"]}),
        "facets": facet_map({"listed_on": one(F.col("listed_on"))}),
        "event_kind": F.lit("featured"),
        "position": F.col("position"),
    }
    return _first_wins(to_records(rows, columns, ["id", "upvotes"], now))


def repo_records(payloads: DataFrame, now: Column, lookback_hours: float = 48.0, limits: Limits = ALL) -> DataFrame:
    """Repository search results; the ``query`` column names the search."""
    schema = (
        "items array<struct<full_name:string, html_url:string, description:string, homepage:string, "
        "stargazers_count:string, forks_count:string, created_at:string, pushed_at:string, updated_at:string, "
        "owner:struct<login:string>, topics:array<string>, language:string, license:struct<spdx_id:string>>>"
    )
    e = F.col("e")
    rows = _entries(payloads, F.from_json("payload", schema)["items"], ("query",)).select(
        "*", F.trim(F.coalesce(e["full_name"], F.lit(""))).alias("repo"), e["pushed_at"].alias("pushed_at"),
    ).where((F.col("repo") != "") & (F.coalesce(e["html_url"], F.lit("")) != ""))
    homepage = F.trim(F.coalesce(e["homepage"], F.lit("")))
    created = parse_datetime(e["created_at"])
    fresh = F.coalesce(created >= hours_before(now, lookback_hours), F.lit(False))
    login = blank_to_null(e["owner"]["login"])
    columns = {
        "source": F.lit(REPOS),
        "source_id": F.col("repo"),
        "title": F.col("repo"),
        "url": e["html_url"],
        "published_at": created,
        "updated_at": parse_datetime(F.coalesce(blank_to_null(e["pushed_at"]), e["updated_at"])),
        "summary": truncate(text(e["description"]), limits.description),
        "organizations": F.array(F.coalesce(login, owner_of(F.col("repo")))),
        "artifact_urls": F.concat(F.array(e["html_url"]), F.when(homepage.startswith("http"), F.array(homepage)).otherwise(F.array())),
        "metrics": metric_map({"stars": e["stargazers_count"], "forks": e["forks_count"]}),
        "facets": facet_map(
            {
                "query": one(F.col("query")),
                "topics": first_of(_non_blank(e["topics"]), limits.topics),
                "language": one(e["language"]),
                "license": one(e["license"]["spdx_id"]),
            }
        ),
        "event_kind": F.when(fresh, "published").otherwise("updated"),
        "position": F.col("position"),
    }
    return _first_wins(to_records(rows, columns, ["repo", "pushed_at"], now))


def release_records(payloads: DataFrame, now: Column, lookback_hours: float = 48.0, limits: Limits = ALL) -> DataFrame:
    """Releases of the repository named in the ``repo`` column, inside the window."""
    schema = (
        "array<struct<tag_name:string, name:string, html_url:string, published_at:string, created_at:string, "
        "body:string, draft:boolean, prerelease:boolean>>"
    )
    e = F.col("e")
    published = parse_datetime(F.coalesce(blank_to_null(e["published_at"]), e["created_at"]))
    rows = _entries(payloads, F.from_json("payload", schema), ("repo",)).select(
        "*", F.trim(F.coalesce(e["tag_name"], F.lit(""))).alias("tag"), published.alias("at"),
    )
    kept = rows.where(
        ~F.coalesce(e["draft"], F.lit(False)) & (F.col("at") >= hours_before(now, lookback_hours))
        & (F.col("tag") != "") & (F.coalesce(e["html_url"], F.lit("")) != "")
    )
    name = F.coalesce(blank_to_null(text(e["name"])), F.col("tag"))
    columns = {
        "source": F.lit(RELEASES),
        "source_id": F.concat_ws("@", "repo", "tag"),
        "title": F.trim(F.concat_ws(" ", F.col("repo"), name)),
        "url": e["html_url"],
        "published_at": F.col("at"),
        "summary": strip_markdown(e["body"], limits.notes),
        "organizations": F.array(owner_of(F.col("repo"))),
        "artifact_urls": F.array(F.concat(F.lit("https://github.com/"), F.col("repo"))),
        "facets": facet_map(
            {
                "tag": one(F.col("tag")),
                "prerelease": F.array(F.coalesce(e["prerelease"], F.lit(False)).cast("string")),
                "repository": one(F.col("repo")),
            }
        ),
        "event_kind": F.lit("released"),
        "position": F.col("position"),
    }
    return to_records(kept, columns, ["repo", "tag"], now)


def scholar_records(payloads: DataFrame, now: Column, limits: Limits = ALL) -> DataFrame:
    """Scholarly search results; the ``query`` column names the search."""
    schema = (
        "data array<struct<paperId:string, title:string, abstract:string, venue:string, year:string, "
        "publicationDate:string, externalIds:map<string,string>, url:string, openAccessPdf:struct<url:string>, "
        "citationCount:string, influentialCitationCount:string, authors:array<struct<name:string>>>>"
    )
    e = F.col("e")
    external = lambda k: blank_to_null(F.try_element_at(e["externalIds"], F.lit(k)))
    rows = _entries(payloads, F.from_json("payload", schema)["data"], ("query",)).select(
        "*", text(e["title"]).alias("title"), e["citationCount"].alias("citations"),
        external("ArXiv").alias("arxiv_id"), external("DOI").alias("doi"),
    ).where("title <> ''")
    links = F.array_compact(
        F.array(
            _prefixed("https://arxiv.org/abs/", F.col("arxiv_id")),
            _prefixed("https://doi.org/", F.col("doi")),
            blank_to_null(e["openAccessPdf"]["url"]),
        )
    )
    year = F.when(F.coalesce(e["year"], F.lit("")).isin("", "0"), F.lit(None)).otherwise(e["year"])
    identified = rows.withColumn(
        "paperId", F.coalesce(blank_to_null(e["paperId"]), F.col("doi"), F.col("title"))
    )
    columns = {
        "source": F.lit(SCHOLAR),
        "source_id": F.col("paperId"),
        "title": F.col("title"),
        "url": F.coalesce(blank_to_null(e["url"]), F.get(links, F.lit(0)), F.lit("")),
        "published_at": parse_datetime(F.coalesce(blank_to_null(e["publicationDate"]), F.concat(year, F.lit("-01-01")))),
        "summary": truncate(text(e["abstract"]), limits.abstract),
        "authors": first_of(_non_blank(F.transform(e["authors"], lambda a: a["name"])), limits.authors),
        "artifact_urls": links,
        "metrics": metric_map({"citations": e["citationCount"], "influential_citations": e["influentialCitationCount"]}),
        "facets": facet_map(
            {"query": one(F.col("query")), "arxiv_id": one(F.col("arxiv_id")), "doi": one(F.col("doi")), "year": one(year)}
        ),
        "venue": text(e["venue"]),
        "position": F.col("position"),
    }
    records = to_records(identified, columns, ["paperId", "citations"], now)
    return _first_wins(records.where("url <> ''"))


def rebuilt_abstract(inverted: Column, limit: int | None = None) -> Column:
    """Text from a ``map<word, positions>``, cut like any abstract.

    One work's words stay inside its row; equal positions order by word.
    """
    placed = F.flatten(
        F.transform(
            F.map_entries(inverted),
            lambda entry: F.transform(entry["value"], lambda at: F.struct(at.alias("at"), entry["key"].alias("word"))),
        )
    )
    words = F.transform(F.array_sort(F.filter(placed, lambda p: p["at"].isNotNull())), lambda p: p["word"])
    return truncate(F.coalesce(F.array_join(words, " "), F.lit("")), limit)


def works_records(payloads: DataFrame, now: Column, limits: Limits = ALL) -> DataFrame:
    """Works with inverted abstracts; the ``query`` column names the search."""
    schema = (
        "results array<struct<id:string, display_name:string, title:string, publication_date:string, type:string, "
        "cited_by_count:string, doi:string, abstract_inverted_index:map<string,array<int>>, "
        "authorships:array<struct<author:struct<display_name:string>, institutions:array<struct<display_name:string>>>>, "
        "primary_location:struct<source:struct<display_name:string>, pdf_url:string>>>"
    )
    e = F.col("e")
    rows = _entries(payloads, F.from_json("payload", schema)["results"], ("query",)).select(
        "*", text(F.coalesce(blank_to_null(e["display_name"]), e["title"])).alias("title"),
        F.trim(F.coalesce(e["id"], F.lit(""))).alias("id"),
    ).where("title <> '' and id <> ''")
    empty_people = F.coalesce(
        e["authorships"],
        F.array().cast("array<struct<author:struct<display_name:string>,institutions:array<struct<display_name:string>>>>"),
    )
    names = F.transform(empty_people, lambda a: a["author"]["display_name"])
    institutions = F.flatten(
        F.transform(
            F.filter(empty_people, lambda a: a["institutions"].isNotNull()),
            lambda a: F.transform(a["institutions"], lambda i: i["display_name"]),
        )
    )
    columns = {
        "source": F.lit(WORKS),
        "source_id": F.substring_index("id", "/", -1),
        "title": F.col("title"),
        "url": F.coalesce(blank_to_null(e["doi"]), F.col("id")),
        "published_at": parse_datetime(e["publication_date"]),
        "summary": rebuilt_abstract(e["abstract_inverted_index"], limits.abstract),
        "authors": first_of(_non_blank(names), limits.authors),
        "organizations": first_of(F.array_distinct(_non_blank(institutions)), limits.institutions),
        "artifact_urls": _non_blank(F.array(e["doi"], e["primary_location"]["pdf_url"])),
        "metrics": metric_map({"citations": e["cited_by_count"]}),
        "facets": facet_map({"query": one(F.col("query")), "type": one(e["type"])}),
        "venue": F.coalesce(e["primary_location"]["source"]["display_name"], F.lit("")),
        "position": F.col("position"),
    }
    return _first_wins(to_records(rows, columns, ["id"], now))
