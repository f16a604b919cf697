"""Feed mappings run on payloads that are written from the documents and parts tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.text import squash as text
from ..sources import feeds, markdown
from . import views as v
from .records import sql_summary
from .views import NOW, RULES

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


SQL_SQUASH = "trim(regexp_replace({x}, '[\\s\\x0B\\x1c-\\x1f]+', ' ', 'g'))"


def _squash(x: str) -> str:
    return SQL_SQUASH.replace("{x}", x)


# Documents with the fields that payloads are written from.
DOCS_SQL = f"""
docs AS (
  SELECT d.doc_id, d.text, d.lang, d.source, {_squash("split_part(d.text, chr(10), 1)")} AS title, {_squash('d.text')} AS flat,
    e.ts, e.value, '2401.' || lpad(CAST(d.doc_id AS VARCHAR), 5, '0') AS paper
  FROM documents d JOIN events e ON e.event_id = (d.doc_id * 37) % (SELECT count(*) FROM events)
)"""


def _docs(spark, sf) -> DataFrame:
    v.utc(spark)
    documents, events = v.table(spark, sf, "documents"), v.table(spark, sf, "events")
    n = events.agg(F.count("*").alias("n")).scalar()
    joined = documents.withColumn("event_id", (F.col("doc_id") * 37) % n).join(events.select("event_id", "ts", "value"), "event_id")
    return joined.select(
        "doc_id", "text", "lang", "source", "ts", "value",
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.concat(F.lit("2401."), F.lpad(F.col("doc_id").cast("string"), 5, "0")).alias("paper"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("iso"),
    )


def inverted(words: Column) -> Column:
    """A ``map<word, places>`` of a list of words, made inside the row.

    (word, place) pairs are sorted, and where the word changes an entry begins.
    """
    def entries(pairs: Column, starts: Column) -> Column:
        def entry(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(pairs))
            places = F.transform(F.slice(pairs, start + 1, end - start), lambda p: p["at"])
            return F.struct(F.get(pairs, start)["word"].alias("key"), places.alias("value"))

        return F.map_from_entries(F.transform(starts, entry))

    def grouped(pairs: Column) -> Column:
        first = lambda i: (i == 0) | (F.get(pairs, i)["word"] != F.get(pairs, i - 1)["word"])
        return let(F.filter(F.transform(pairs, lambda _, i: i), first), lambda starts: entries(pairs, starts))

    return let(F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at")))), grouped)


def _now():
    return F.lit(NOW).cast("timestamp")


def _payloads(df: DataFrame, payload, **extra) -> DataFrame:
    return df.select(F.col("doc_id").alias("payload_no"), payload.alias("payload"), *[c.alias(n) for n, c in extra.items()])


_DAY = "strftime(ts, '%Y-%m-%d %H:%M:%S')"


def _day(col: str = "published_at"):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias(col)


_KIND = "CASE doc_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'cross' WHEN 2 THEN 'replace' ELSE 'replace-cross' END"


@query(f"""WITH {DOCS_SQL}
SELECT paper AS source_id, title, 'https://arxiv.org/abs/' || paper AS url, {_DAY} AS published_at,
  sha256(flat) AS summary_hash, 'Ada ' || lang || '|Bob|Eve' AS authors,
  CASE doc_id % 4 WHEN 0 THEN 'published' WHEN 1 THEN 'cross-listed' ELSE 'updated' END AS event_kind,
  'https://arxiv.org/pdf/' || paper AS artifact_urls FROM docs WHERE title <> ''""")
def s1_rss_records(spark, sf):
    kind = F.expr(_KIND)
    item = F.struct(
        F.col("title"), F.concat(F.lit("https://arxiv.org/abs/"), "paper", F.lit("v2")).alias("link"),
        F.concat(F.lit("arXiv:"), "paper", F.lit("v1 Announce Type: "), kind, F.lit("\nAbstract: "), "text").alias("description"),
        F.concat(F.lit("Ada "), "lang", F.lit(", Bob and Eve")).alias("creator"), F.array("lang", "source").alias("category"),
        F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")).alias("pubDate"),
    )
    xml = F.to_xml(F.struct(F.struct(F.array(item).alias("item")).alias("channel")), {"rowTag": "rss"})
    records = feeds.rss_records(_payloads(_docs(spark, sf), xml, feed=F.lit("cs.CV")), _now())
    return records.select(
        "source_id", "title", "url", _day(), F.sha2("summary", 256).alias("summary_hash"),
        F.array_join("authors", "|").alias("authors"), "event_kind", F.array_join("artifact_urls", "|").alias("artifact_urls"),
    )


@query(f"""WITH {DOCS_SQL}
SELECT paper AS source_id, title, {_DAY} AS published_at, sha256(flat) AS summary_hash, 'Ada|Bob ' || lang AS authors,
  CASE WHEN doc_id % 2 = 0 THEN 'updated' ELSE 'published' END AS event_kind, 'https://arxiv.org/pdf/' || paper AS artifact_urls
FROM docs WHERE title <> ''""")
def s2_atom_records(spark, sf):
    updated = F.when(F.col("doc_id") % 2 == 0, F.lit("2024-02-01T00:00:00Z")).otherwise(F.col("iso"))
    link = lambda title, href: F.struct(href.alias("_href"), F.lit(title).alias("_title"))
    pdf = F.concat(F.lit("https://arxiv.org/pdf/"), "paper")
    entry = F.struct(
        F.concat(F.lit("http://arxiv.org/abs/"), "paper", F.lit("v1")).alias("id"), "title", F.col("iso").alias("published"),
        updated.alias("updated"), F.col("text").alias("summary"),
        F.array(F.struct(F.lit("Ada").alias("name")), F.struct(F.concat(F.lit("Bob "), "lang").alias("name"))).alias("author"),
        F.array(link("abs", F.lit("https://arxiv.org/abs/x")), link("pdf", pdf)).alias("link"),
        F.array(F.struct(F.col("lang").alias("_term"))).alias("category"),
    )
    xml = F.to_xml(F.struct(F.array(entry).alias("entry")), {"rowTag": "feed"})
    records = feeds.atom_records(_payloads(_docs(spark, sf), xml), _now())
    return records.select(
        "source_id", "title", _day(), F.sha2("summary", 256).alias("summary_hash"),
        F.array_join("authors", "|").alias("authors"), "event_kind", F.array_join("artifact_urls", "|").alias("artifact_urls"),
    )


@query(f"""WITH {DOCS_SQL}, repos AS (
  SELECT 'org' || (doc_id % 5) || '/' || source || '-' || (doc_id // 2) AS id, min(doc_id) AS doc_id FROM docs GROUP BY 1),
raw AS (SELECT 'org' || (doc_id % 5) || '/' || source || '-' || (doc_id // 2) AS source, text AS x FROM docs), {sql_summary('x')},
prose AS (SELECT source AS id, min(summary) AS card FROM summaries GROUP BY 1)
SELECT sha256(card) AS summary_hash, r.id AS source_id, 'https://huggingface.co/datasets/' || r.id AS url, {_DAY} AS published_at,
  CASE WHEN date_trunc('second', d.ts) >= TIMESTAMP '{NOW}' - INTERVAL 48 HOUR THEN 'published' ELSE 'updated' END AS event_kind,
  'org' || (d.doc_id % 5) AS organizations, CASE WHEN d.value > 0 THEN round(d.value, 2) END AS downloads, 'mit' AS license, lang || '|a' AS tags
FROM repos r JOIN docs d ON d.doc_id = r.doc_id JOIN prose p ON p.id = r.id""")
def s3_hub_records(spark, sf):
    repo_id = F.concat(F.lit("org"), (F.col("doc_id") % 5).cast("string"), F.lit("/"), "source", F.lit("-"), F.floor(F.col("doc_id") / 2).cast("string"))
    repo = F.struct(
        repo_id.alias("id"), F.col("iso").alias("createdAt"), F.col("iso").alias("lastModified"), F.col("value").alias("downloads"),
        F.lit(0).alias("likes"), F.array(F.col("lang"), F.lit("a")).alias("tags"), F.struct(F.lit("mit").alias("license")).alias("cardData"),
    )
    docs = _docs(spark, sf)
    payloads = _payloads(docs, F.to_json(F.array(repo)), query=F.lit("vqa"))
    cards = docs.select(repo_id.alias("repo_id"), F.col("text").alias("body"))
    records = feeds.hub_records(payloads, _now(), "datasets", cards)
    return records.select(
        F.sha2("summary", 256).alias("summary_hash"),
        "source_id", "url", _day(), "event_kind", F.array_join("organizations", "|").alias("organizations"),
        F.round(F.try_element_at("metrics", F.lit("downloads")), 2).alias("downloads"),
        F.array_join(F.try_element_at("facets", F.lit("license")), "|").alias("license"),
        F.array_join(F.try_element_at("facets", F.lit("tags")), "|").alias("tags"),
    )


@query(f"""WITH {DOCS_SQL}
SELECT paper AS source_id, title, {_DAY} AS published_at, sha256(flat) AS summary_hash, 'Ada|Bob' AS authors,
  CASE WHEN value > 0 THEN round(value, 2) END AS upvotes, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 3)::DOUBLE END AS comments FROM docs WHERE title <> ''""")
def s4_paper_records(spark, sf):
    paper = F.struct(
        F.col("paper").alias("id"), "title", F.col("text").alias("summary"), F.col("iso").alias("publishedAt"), F.col("value").alias("upvotes"),
        F.array(F.create_map(F.lit("name"), F.lit("Ada")), F.create_map(F.lit("fullname"), F.lit("Bob"))).alias("authors"),
    )
    record = F.struct(paper.alias("paper"), (F.col("doc_id") % 3).alias("numComments"))
    payloads = _payloads(_docs(spark, sf), F.to_json(F.array(record)), listed_on=F.date_format("ts", "yyyy-MM-dd"))
    records = feeds.paper_records(payloads, _now())
    return records.select(
        "source_id", "title", _day(), F.sha2("summary", 256).alias("summary_hash"), F.array_join("authors", "|").alias("authors"),
        F.round(F.try_element_at("metrics", F.lit("upvotes")), 2).alias("upvotes"),
        F.try_element_at("metrics", F.lit("comments")).alias("comments"),
    )


@query(f"""WITH {DOCS_SQL}
SELECT 'me/' || source || '-' || doc_id AS source_id, sha256(flat) AS summary_hash, lang AS organizations,
  'https://github.com/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '|https://home.example.org' ELSE '' END AS artifact_urls,
  CASE WHEN doc_id > 0 THEN doc_id::DOUBLE END AS stars, {_DAY} AS published_at FROM docs""")
def s5_repo_records(spark, sf):
    repo = F.struct(
        F.concat(F.lit("me/"), "source", F.lit("-"), F.col("doc_id").cast("string")).alias("full_name"),
        F.concat(F.lit("https://github.com/"), F.col("doc_id").cast("string")).alias("html_url"), F.col("text").alias("description"),
        F.when(F.col("doc_id") % 2 == 0, "https://home.example.org").otherwise("none").alias("homepage"),
        F.col("doc_id").alias("stargazers_count"), F.lit(0).alias("forks_count"), F.col("iso").alias("created_at"),
        F.col("iso").alias("pushed_at"), F.struct(F.col("lang").alias("login")).alias("owner"), F.array("lang").alias("topics"),
    )
    payloads = _payloads(_docs(spark, sf), F.to_json(F.struct(F.array(repo).alias("items"))), query=F.lit("q"))
    records = feeds.repo_records(payloads, _now())
    return records.select(
        "source_id", F.sha2("summary", 256).alias("summary_hash"), F.array_join("organizations", "|").alias("organizations"),
        F.array_join("artifact_urls", "|").alias("artifact_urls"), F.try_element_at("metrics", F.lit("stars")).alias("stars"), _day(),
    )


@query(f"""WITH {DOCS_SQL}
SELECT 'own/' || source || '@v' || doc_id AS source_id, 'own/' || source || ' ' || CASE WHEN doc_id % 3 = 0 THEN 'v' || doc_id ELSE 'Release ' || lang END AS title,
  {_DAY} AS published_at, 'own' AS organizations
FROM docs WHERE doc_id % 4 <> 0 AND date_trunc('second', ts) >= TIMESTAMP '{NOW}' - INTERVAL 240 HOUR""")
def s6_release_records(spark, sf):
    release = F.struct(
        F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("tag_name"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("Release "), "lang")).alias("name"),
        F.lit("https://github.com/x").alias("html_url"), F.col("iso").alias("published_at"), F.col("text").alias("body"),
        (F.col("doc_id") % 4 == 0).alias("draft"),
    )
    payloads = _payloads(_docs(spark, sf), F.to_json(F.array(release)), repo=F.concat(F.lit("own/"), "source"))
    records = feeds.release_records(payloads, _now(), 240.0)
    return records.select("source_id", "title", _day(), F.array_join("organizations", "|").alias("organizations"))


@query(f"""WITH {DOCS_SQL}
SELECT 'p' || doc_id AS source_id, title, CASE WHEN doc_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE '2023-01-01' END AS published_at,
  sha256(flat) AS summary_hash, 'https://arxiv.org/abs/' || paper || '|https://doi.org/10.5555/' || doc_id AS artifact_urls,
  'https://arxiv.org/abs/' || paper AS url, source AS venue, CASE WHEN doc_id > 0 THEN doc_id::DOUBLE END AS citations FROM docs WHERE title <> ''""")
def s7_scholar_records(spark, sf):
    paper = F.struct(
        F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("paperId"), "title", F.col("text").alias("abstract"), F.col("source").alias("venue"),
        F.lit(2023).alias("year"), F.when(F.col("doc_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).alias("publicationDate"),
        F.create_map(F.lit("ArXiv"), F.col("paper"), F.lit("DOI"), F.concat(F.lit("10.5555/"), F.col("doc_id").cast("string"))).alias("externalIds"),
        F.col("doc_id").alias("citationCount"), F.array(F.struct(F.lit("Ada").alias("name"))).alias("authors"),
    )
    payloads = _payloads(_docs(spark, sf), F.to_json(F.struct(F.array(paper).alias("data"))), query=F.lit("q"))
    records = feeds.scholar_records(payloads, _now())
    return records.select(
        "source_id", "title", F.date_format("published_at", "yyyy-MM-dd").alias("published_at"), F.sha2("summary", 256).alias("summary_hash"),
        F.array_join("artifact_urls", "|").alias("artifact_urls"), "url", "venue", F.try_element_at("metrics", F.lit("citations")).alias("citations"),
    )


@query(f"""WITH {DOCS_SQL}
SELECT 'W' || doc_id AS source_id, title, sha256(flat) AS summary_hash, 'Ada' AS authors, 'Uni ' || lang || '|Lab' AS organizations,
  source AS venue FROM docs WHERE title <> ''""")
def s8_works_records(spark, sf):
    named = lambda c: F.struct(c.alias("display_name"))
    work = F.struct(
        F.concat(F.lit("https://openalex.org/W"), F.col("doc_id").cast("string")).alias("id"), F.col("title").alias("display_name"),
        inverted(F.split(text(F.col("text")), " ")).alias("abstract_inverted_index"),
        F.array(
            F.struct(named(F.lit("Ada")).alias("author"), F.array(named(F.concat(F.lit("Uni "), "lang")), named(F.lit("Lab")), named(F.lit("Lab"))).alias("institutions"))
        ).alias("authorships"),
        F.struct(named(F.col("source")).alias("source")).alias("primary_location"),
    )
    payloads = _payloads(_docs(spark, sf), F.to_json(F.struct(F.array(work).alias("results"))), query=F.lit("q"))
    records = feeds.works_records(payloads, _now())
    return records.select(
        "source_id", "title", F.sha2("summary", 256).alias("summary_hash"), F.array_join("authors", "|").alias("authors"),
        F.array_join("organizations", "|").alias("organizations"), "venue",
    )


@query("""
SELECT 'part/' || p_partkey AS origin, p_name AS title, 'https://parts.example.org/' || p_partkey AS url,
  CASE WHEN p_partkey % 2 = 0 THEN '2024-01-15' ELSE '2024-03-01' END AS published_at, p_brand AS organizations,
  'Kind: ' || p_type AS summary, p_type || ' > ' || replace(p_brand, '#', '') AS section, 'https://code.example.org/' || p_partkey AS artifact_urls,
  CASE WHEN contains(lower(p_type), 'economy') THEN 'license' ELSE '' END AS hint_categories
FROM part""")
def s9_markdown_records(spark, sf):
    """One small list per part: heading levels, a fenced table, a row without a link."""
    v.utc(spark)
    part = v.table(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("# Title\n\n## Old\n\n## "), F.col("p_type"), F.lit("\n\n### "), F.col("p_brand"),
        F.lit("\n\n```\n| Fenced | Link |\n| --- | --- |\n| no | [x](https://no.example.org) |\n```\n\n| Name | Date | Kind | Link |\n| --- | :-: | --- | --- |\n| **["),
        F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(")](https://parts.example.org/"), key, F.lit(")** | "),
        F.when(F.col("p_partkey") % 2 == 0, "01/15/2024").otherwise("soon"),
        F.lit(" | "), F.col("p_type"), F.lit(" | [code](https://code.example.org/"), key, F.lit(") |\n| no link here | 2024 | x | - |\n\ntail\n"),
    )
    documents = part.select(F.concat(F.lit("part/"), key).alias("origin"), text.alias("text"), F.lit("2024-03-01").alias("report_date"))
    records = markdown.markdown_table_records(documents, RULES, _now())
    return records.select(
        F.array_join(F.try_element_at("facets", F.lit("survey_origin")), "").alias("origin"), "title", "url",
        F.date_format("published_at", "yyyy-MM-dd").alias("published_at"), F.array_join("organizations", "|").alias("organizations"),
        "summary", "section", F.array_join("artifact_urls", "|").alias("artifact_urls"), F.array_join("hint_categories", "|").alias("hint_categories"),
    )
