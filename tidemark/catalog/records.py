"""Queries over the records view: text jobs, matching, scoring, selection, merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import clean_metrics
from ..functions.dates import age_hours, day_key, parsed_date
from ..functions.text import normalize, slug, strip_markdown
from ..functions.urls import canonical_url, host_name, html_links
from ..functions.cells import informative, publisher_parts
from ..operators import dedupe, match, quality, score, select
from . import views as v
from .views import NOW, RECORDS_SQL, SCAN_SQL, SELECT, SINGLE_SQL, sql_canonical, sql_normalize, sql_slug

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query and, when there is one, its SQL twin."""

    def register(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def _texts(spark, sf):
    df = v.records(spark, sf)
    text = v.match_text(*[F.col(c) for c in ("title", "summary", "section", "venue", "facets")])
    return df.withColumns({"match_text": text, "raw_text": v.raw_text(F.col("title"), F.col("summary"))})


def _joined(*columns):
    return [F.array_join(c, "|").alias(c) for c in columns]


# --- text jobs ------------------------------------------------------------------------------


@query(f"""
SELECT sha256({sql_normalize('text')}) AS text_hash, count(*) AS documents, min(doc_id) AS first_doc
FROM documents GROUP BY 1 HAVING count(*) > 1""")
def n1_duplicate_texts(spark, sf):
    folded = normalize(F.col("text"))
    hashed = v.table(spark, sf, "documents").select("doc_id", F.sha2(folded, 256).alias("text_hash"))
    groups = hashed.groupBy("text_hash").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))
    return groups.where("documents > 1")


@query(f"""
WITH {RECORDS_SQL}
SELECT {sql_slug('title')} AS slug, count(*) AS records, count(DISTINCT title) AS titles FROM records GROUP BY 1""")
def n2_slug_collisions(spark, sf):
    keyed = v.records(spark, sf).select(slug(F.col("title")).alias("slug"), "title")
    return keyed.groupBy("slug").agg(F.count("*").alias("records"), F.countDistinct("title").alias("titles"))


_COLLAPSE = "trim(regexp_replace({x}, '[\\s\\x0B\\x1c-\\x1f]+', ' ', 'g'), ' -*|#>' || chr(9))"


def sql_summary(expr: str) -> str:
    """CTEs from ``raw(source, x)`` to ``summaries(source, summary)``."""
    body = expr
    for pattern, replacement in (
        ("(?s)\\A---\\s*\\n.*?\\n---\\s*\\n", ""), ("(?s)<!--.*?-->", " "), ("(?s)```.*?```", " "), ("!\\[[^\\]]*\\]\\([^)]*\\)", " "),
        ("\\[([^\\]]*)\\]\\(([^)]*)\\)", "\\1"), ("<[^>]+>", " "), ("`([^`]*)`", "\\1"), ("(?m)^\\s{0,3}#{1,6}\\s*", ""), ("(\\*\\*|__|\\*|_)", ""),
    ):
        body = f"regexp_replace({body}, '{pattern}', '{replacement}', 'g')"
    clean = lambda x: _COLLAPSE.replace("{x}", x)
    return f"""
bodies AS (SELECT source, {body} AS b FROM raw),
pieces AS (
  SELECT source, b, list_filter(list_transform(string_split(b, chr(10) || chr(10)), lambda p: {clean('p')}),
    lambda p: length(p) >= 40 AND length(p) - length(replace(p, '|', '')) <= 3) AS ps FROM bodies),
taken AS (SELECT source, b, array_to_string(ps, ' ') AS j FROM pieces),
summaries AS (
  SELECT source, CASE WHEN j <> '' THEN j WHEN length({clean('b')}) >= 40 THEN {clean('b')} ELSE '' END AS summary FROM taken)"""


@query(f"""WITH raw AS (
  SELECT source, text AS x FROM documents
  UNION ALL SELECT regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:]+)', 2)), '^www\\.', ''), html FROM pages
), {sql_summary('x')}
SELECT source, count(*) AS texts, round(avg(CASE WHEN summary = '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS empty_share,
  round(avg(length(summary)), 3) AS mean_length, max(length(summary)) AS longest FROM summaries GROUP BY 1""")
def n3_markdown_summaries(spark, sf):
    """Share of empty summaries and mean summary length per source, from whole page texts."""
    v.utc(spark)
    docs = v.table(spark, sf, "documents").select("source", strip_markdown(F.col("text")).alias("summary"))
    pages = v.table(spark, sf, "pages").select(
        host_name(F.col("url")).alias("source"), strip_markdown(F.col("html")).alias("summary")
    )
    both = docs.unionByName(pages)
    return both.groupBy("source").agg(
        F.count("*").alias("texts"),
        F.round(F.avg((F.col("summary") == "").cast("double")), 6).alias("empty_share"),
        F.round(F.avg(F.length("summary")), 3).alias("mean_length"),
        F.max(F.length("summary")).cast("bigint").alias("longest"),
    )


@query(f"""
SELECT {sql_canonical('url')} AS canonical, count(*) AS pages, count(DISTINCT url) AS spellings, min(page_id) AS first_page
FROM pages GROUP BY 1""")
def n4_canonical_urls(spark, sf):
    keyed = v.table(spark, sf, "pages").select(canonical_url(F.col("url")).alias("canonical"), "url", "page_id")
    return keyed.groupBy("canonical").agg(
        F.count("*").alias("pages"), F.countDistinct("url").alias("spellings"), F.min("page_id").alias("first_page")
    )


# One of nine spellings per order date, by order key.
_SPELLINGS = (
    ("yyyy-MM-dd", "%Y-%m-%d"), ("MM/dd/yyyy", "%m/%d/%Y"), ("yyyy/MM/dd", "%Y/%m/%d"), ("MM/yyyy", "%m/%Y"),
    ("yyyy", "%Y"), ("dd MMM yyyy", "%d %b %Y"), ("MMM d, yyyy", "%b %-d, %Y"), ("yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ"),
)
_N5_NAMES = ("iso", "us_day", "slash_day", "us_month", "year", "day_month_year", "long_month", "iso")


@query(f"""
WITH spelled AS (SELECT o_orderkey % 9 AS k, o_orderdate AS d FROM orders)
SELECT CASE k {' '.join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_N5_NAMES))} ELSE 'unreadable' END AS format,
  count(*) AS dates,
  min(CASE WHEN k = 8 THEN NULL WHEN k = 3 THEN strftime(date_trunc('month', d), '%Y-%m-%d')
      WHEN k = 4 THEN strftime(date_trunc('year', d), '%Y-%m-%d') ELSE strftime(d, '%Y-%m-%d') END) AS first_day,
  max(CASE WHEN k = 8 THEN NULL WHEN k = 3 THEN strftime(date_trunc('month', d), '%Y-%m-%d')
      WHEN k = 4 THEN strftime(date_trunc('year', d), '%Y-%m-%d') ELSE strftime(d, '%Y-%m-%d') END) AS last_day
FROM (SELECT CASE WHEN k = 6 AND strftime(d, '%B') <> strftime(d, '%b') THEN 9 ELSE k END AS k0, k, d FROM spelled)
GROUP BY 1""".replace("CASE k WHEN", "CASE WHEN k0 = 9 THEN 'short_month' ELSE CASE k WHEN", 1).replace("ELSE 'unreadable' END AS format", "ELSE 'unreadable' END END AS format", 1))
def n5_date_formats(spark, sf):
    v.utc(spark)
    orders = v.table(spark, sf, "orders")
    spelled = F.lit("Undisclosed")
    for i, (fmt, _) in enumerate(_SPELLINGS):
        spelled = F.when(F.col("o_orderkey") % 9 == i, F.date_format("o_orderdate", fmt)).otherwise(spelled)
    read = orders.select(spelled.alias("raw")).select(parsed_date(F.col("raw")).alias("read"))
    parsed = read.select(F.coalesce("read.format", F.lit("unreadable")).alias("format"), day_key(F.col("read.value")).alias("day"))
    return parsed.groupBy("format").agg(
        F.count("*").alias("dates"), F.min("day").alias("first_day"), F.max("day").alias("last_day")
    )


@query(f"""
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events,
  round(max(greatest(0.0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 3.6e9)), 3) AS oldest_hours,
  round(min(greatest(0.0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 3.6e9)), 3) AS newest_hours
FROM events GROUP BY 1""")
def n6_event_ages(spark, sf):
    v.utc(spark)
    events = v.table(spark, sf, "events").select(day_key(F.col("ts")).alias("day"), age_hours(v.now(), F.col("ts")).alias("age"))
    return events.groupBy("day").agg(
        F.count("*").alias("events"), F.round(F.max("age"), 3).alias("oldest_hours"), F.round(F.min("age"), 3).alias("newest_hours")
    )


_HREF = """'<[aA]\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']'"""


@query(f"""
WITH links AS (
  SELECT page_id, unnest(regexp_extract_all(html, {_HREF}, 1)) AS link FROM pages
), hosted AS (
  SELECT page_id, replace(link, '&amp;', '&') AS link FROM links
)
SELECT CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:]')
    THEN regexp_replace(lower(regexp_extract(link, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:]+)', 2)), '^www\\.', '')
    ELSE link END AS host,
  count(*) AS links, count(DISTINCT page_id) AS pages
FROM hosted GROUP BY 1""")
def n7_link_hosts(spark, sf):
    pages = v.table(spark, sf, "pages").select("page_id", F.explode(html_links(F.col("html"))).alias("link"))
    hosts = pages.select("page_id", host_name(F.col("link")).alias("host"))
    return hosts.groupBy("host").agg(F.count("*").alias("links"), F.countDistinct("page_id").alias("pages"))


@query("""
WITH titles AS (
  SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ' (' || p_brand || ')' WHEN 1 THEN p_name || ' (preview of ' || p_brand || ')'
    WHEN 2 THEN p_name || ' (Maker Of Very Many Fine Parts)' ELSE p_name END AS title FROM part
), parts AS (
  SELECT title, regexp_extract(title, '\\(([^()]{2,48})\\)\\s*$', 1) AS note FROM titles
)
SELECT CASE WHEN note <> '' AND len(string_split(note, ' ')) <= 5 AND regexp_matches(note, '^[A-Z]')
    AND NOT regexp_matches(lower(note), '^(gated|preview|note|see|visual|text)') THEN note ELSE '' END AS publisher,
  count(*) AS titles, min(trim(regexp_replace(title, '\\([^()]{2,48}\\)\\s*$', ''))) AS first_name
FROM parts GROUP BY 1""")
def n8_publishers(spark, sf):
    part = v.table(spark, sf, "part")
    title = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")))
        .when(F.col("p_partkey") % 4 == 1, F.concat("p_name", F.lit(" (preview of "), "p_brand", F.lit(")")))
        .when(F.col("p_partkey") % 4 == 2, F.concat("p_name", F.lit(" (Maker Of Very Many Fine Parts)")))
        .otherwise(F.col("p_name"))
    )
    name, publisher = publisher_parts(F.col("title"))
    split = part.select(title.alias("title")).select(name.alias("name"), publisher.alias("publisher"))
    return split.groupBy("publisher").agg(F.count("*").alias("titles"), F.min("name").alias("first_name"))


@query("""
WITH cells AS (
  SELECT unnest([{'c': 'brand', 'x': CASE WHEN p_partkey % 5 = 0 THEN 'N/A' ELSE p_brand END},
                 {'c': 'type', 'x': CASE WHEN p_partkey % 3 = 0 THEN 'Paper' ELSE p_type END},
                 {'c': 'name', 'x': CASE WHEN p_partkey % 7 = 0 THEN '--' ELSE p_name END}]) AS s FROM part
)
SELECT s.c AS col, count(*) AS cells, count(*) FILTER (WHERE s.x NOT IN ('Paper', '--')) AS filled,
  round(count(*) FILTER (WHERE s.x NOT IN ('Paper', '--')) / count(*), 6) AS fill_rate
FROM cells GROUP BY 1""")
def n9_fill_rates(spark, sf):
    # ``N/A`` folds to ``n a``, which is no placeholder: such cells count as filled.
    part = v.table(spark, sf, "part")
    placeholder = lambda n, text, c: F.when(F.col("p_partkey") % n == 0, F.lit(text)).otherwise(F.col(c))
    cells = F.array(
        F.struct(F.lit("brand").alias("col"), placeholder(5, "N/A", "p_brand").alias("cell")),
        F.struct(F.lit("type").alias("col"), placeholder(3, "Paper", "p_type").alias("cell")),
        F.struct(F.lit("name").alias("col"), placeholder(7, "--", "p_name").alias("cell")),
    )
    long = part.select(F.inline(cells))
    filled = F.count_if(informative(F.col("cell")))
    return long.groupBy("col").agg(
        F.count("*").alias("cells"), filled.alias("filled"), F.round(filled / F.count("*"), 6).alias("fill_rate")
    )


@query(f"""
WITH {RECORDS_SQL}
SELECT source_id, sha256({sql_normalize(v.RECORD_TEXT)}) AS text_hash FROM records""")
def n10_match_text(spark, sf):
    return _texts(spark, sf).select("source_id", F.sha2("match_text", 256).alias("text_hash"))


# --- filters --------------------------------------------------------------------------------


@query(f"""
WITH {RECORDS_SQL}
SELECT source_id, provenance, published_at FROM records
WHERE published_at >= TIMESTAMP '{NOW}' - INTERVAL 48 HOUR
   OR (provenance = 'curated' AND published_at >= TIMESTAMP '{NOW}' - INTERVAL 720 HOUR)""")
def f1_scan_window(spark, sf):
    window = select.in_scan_window(v.records(spark, sf), v.now())
    return window.select("source_id", "provenance", "published_at")


@query(f"""WITH {SINGLE_SQL}
SELECT source_id, array_to_string(anchors, '|') AS anchors, len(anchors) > 0 AS in_domain,
  CASE WHEN len(anchors) = 0 THEN 'No vision-language domain anchor in upstream text.' END AS domain_reason FROM scored""")
def f2_domain_gate(spark, sf):
    gated = match.domain_gate(_texts(spark, sf), v.RULES)
    return gated.select("source_id", *_joined("anchors"), "in_domain", "domain_reason")


@query(f"""WITH {SINGLE_SQL}
SELECT source_id, array_to_string(categories, '|') AS categories FROM scored WHERE len(categories) > 0""")
def f3_category_gate(spark, sf):
    found = match.match_terms(_texts(spark, sf), v.RULES)
    return found.where(F.size("categories") > 0).select("source_id", *_joined("categories"))


@query(f"""WITH {SINGLE_SQL}
SELECT source_id, CASE WHEN suppressions > 0 THEN 'Junk text.' ELSE '' END AS suppression_reasons,
  suppressions > 0 AS suppressed FROM scored""")
def f4_suppression_gate(spark, sf):
    judged = match.suppress(_texts(spark, sf), v.RULES.low_value)
    return judged.select("source_id", *_joined("suppression_reasons"), "suppressed")


@query(f"""WITH {SINGLE_SQL}
SELECT source_id, total_score, pinned FROM scored WHERE pinned OR total_score >= 30""")
def f5_score_floor(spark, sf):
    kept = v.scored(spark, sf).where(F.col("pinned") | (F.col("total_score") >= 30))
    return kept.select("source_id", "total_score", "pinned")


@query(f"""WITH {SINGLE_SQL}
SELECT source_id, title, total_score FROM scored
WHERE provenance = 'curated' AND list_contains(categories, 'lang_en')
  AND lower(concat(title, ' ', summary, ' ', source, ' ', '', ' ', org, array_to_string(list_transform(family_orgs, lambda x: ' ' || x), ''),
      ' ', array_to_string(families, ' '), ' ', array_to_string(watch, ' '))) LIKE '%license%'""")
def f6_facet_filter(spark, sf):
    hits = select.facet_filter(
        v.scored(spark, sf), equals={"provenance": "curated"}, contains={"categories": "lang_en"}, query="LICENSE"
    )
    return hits.select("source_id", "title", "total_score")


@query(f"""WITH {SINGLE_SQL}
SELECT source_id, array_to_string(families, '|') AS model_families, array_to_string(watch, '|') AS watchlist, pinned FROM scored""")
def f7_pinned(spark, sf):
    found = match.match_watchlist(match.match_entities(_texts(spark, sf), v.RULES), v.RULES)
    return select.with_pinned(found).select("source_id", *_joined("model_families", "watchlist"), "pinned")


@query(f"""WITH {RECORDS_SQL}
SELECT source_id, CASE WHEN published_at >= TIMESTAMP '{NOW}' - INTERVAL 48 HOUR THEN 'published' ELSE 'updated' END AS event_kind
FROM records""")
def f8_event_kind(spark, sf):
    kinds = select.classify_event(v.records(spark, sf), v.now(), 48.0, "published_at")
    return kinds.select("source_id", "event_kind")


# --- matching joins -------------------------------------------------------------------------


@query(f"""WITH {SINGLE_SQL}
SELECT source_id, array_to_string(anchors, '|') AS anchors, array_to_string(categories, '|') AS categories,
  array_to_string(terms, '|') AS matched_terms FROM scored""")
def j1_match_terms(spark, sf):
    found = match.match_terms(_texts(spark, sf), v.RULES)
    return found.select("source_id", *_joined("anchors", "categories", "matched_terms"))


_PART_TERMS = """
terms AS (
  SELECT p_type AS category, 1 AS cat_ord, lower(split_part(p_name, ' ', 2)) AS term, min(p_partkey) AS term_ord FROM part GROUP BY 1, 3
  UNION ALL SELECT 'license', 0, unnest(['licensed under', 'mit license', 'apache license']), 0
  UNION ALL SELECT 'prose', 2, lower(n), 0 FROM (SELECT unnest(['the', 'und', 'des', 'que']) AS n)
)"""


@query(f"""WITH {RECORDS_SQL}, {_PART_TERMS},
texts AS (SELECT source_id, {sql_normalize(v.RECORD_TEXT)} AS t FROM records)
SELECT source_id, category, term FROM texts JOIN terms
  ON regexp_matches(t, '(^|[^a-z0-9])' || term || '(s|es|ed|ing)?([^a-z0-9]|$)')""")
def j1_match_term_table(spark, sf):
    """Matching against a rule table derived from the part names."""
    part = v.table(spark, sf, "part")
    named = part.groupBy(F.col("p_type").alias("category"), F.lower(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("term")).agg(
        F.min("p_partkey").alias("term_ord")
    )
    fixed = lambda cat, o, words: spark.range(1).select(
        F.lit(cat).alias("category"), F.lit(o).alias("cat_ord"), F.explode(F.array(*map(F.lit, words))).alias("term"), F.lit(0).cast("bigint").alias("term_ord")
    )
    terms = (
        named.withColumn("cat_ord", F.lit(1))
        .unionByName(fixed("license", 0, ["licensed under", "mit license", "apache license"]))
        .unionByName(fixed("prose", 2, ["the", "und", "des", "que"]))
    )
    return match.match_term_table(_texts(spark, sf), terms, "source_id").select("source_id", "category", "term")


@query(f"""WITH {SINGLE_SQL}
SELECT source_id, array_to_string(families, '|') AS model_families,
  array_to_string(list_concat([org], list_filter(family_orgs, lambda x: x <> org)), '|') AS organizations FROM scored""")
def j2_match_entities(spark, sf):
    found = match.match_entities(_texts(spark, sf), v.RULES)
    return found.select("source_id", *_joined("model_families", "organizations"))


@query(f"""WITH {SINGLE_SQL}
SELECT source_id, array_to_string(watch, '|') AS watchlist,
  CASE WHEN len(watch) > 0 THEN 'Permissive license text.' ELSE '' END AS watchlist_notes FROM scored""")
def j3_match_watchlist(spark, sf):
    found = match.match_watchlist(_texts(spark, sf), v.RULES)
    return found.select("source_id", *_joined("watchlist", "watchlist_notes"))


@query(f"""WITH {SINGLE_SQL}
SELECT source_id, demotions, CASE WHEN suppressions > 0 THEN 'Junk text.' ELSE '' END AS suppression_reasons FROM scored""")
def j4_low_value(spark, sf):
    judged = match.match_low_value(_texts(spark, sf), v.RULES.low_value)
    return judged.select("source_id", "demotions", *_joined("suppression_reasons"))


@query("""
SELECT p_partkey, array_to_string(list_distinct(list_concat(
    CASE WHEN contains(lower(p_type), 'economy') THEN ['license'] ELSE [] END,
    CASE WHEN contains(lower(p_type || ' ' || p_brand), 'brand#1') THEN
      CASE WHEN contains(lower(p_type), 'economy') THEN ['lang_en'] ELSE ['lang_en', 'license'] END ELSE [] END)), '|') AS raw_categories
FROM part""".replace("array_to_string(list_distinct(list_concat(", "array_to_string((list_concat("))
def j5_heading_categories(spark, sf):
    part = v.table(spark, sf, "part").withColumn("trail", F.concat_ws(" > ", "p_type", "p_brand"))
    found = match.with_heading_categories(part, v.RULES)
    return found.select("p_partkey", F.array_join("hint_categories", "|").alias("raw_categories"))


@query(f"""WITH {SINGLE_SQL}, exploded AS (SELECT unnest(categories) AS category FROM scored)
SELECT category, CASE category WHEN 'lang_en' THEN 'English prose' WHEN 'lang_de' THEN 'German prose'
  WHEN 'lang_fr' THEN 'French prose' WHEN 'lang_es' THEN 'Spanish prose' ELSE 'License' END AS label, count(*) AS records
FROM exploded GROUP BY 1, 2""")
def j6_labels(spark, sf):
    found = match.match_terms(_texts(spark, sf), v.RULES).select(F.explode("categories").alias("category"))
    counts = found.groupBy("category").agg(F.count("*").alias("records"))
    return match.with_labels(counts, v.RULES).select("category", "label", "records")


# --- dedupe ---------------------------------------------------------------------------------


@query(f"WITH {RECORDS_SQL}, {v.KEYED_SQL} SELECT source_id, dedupe_key FROM keyed")
def d1_dedupe_key(spark, sf):
    return dedupe.with_dedupe_key(v.records(spark, sf)).select("source_id", "dedupe_key")


@query(f"""WITH {RECORDS_SQL}, {v.KEYED_SQL}, {v.MERGED_SQL},
metrics AS (SELECT dedupe_key, array_to_string(list(metric || '=' || round(amount, 2) ORDER BY metric), '|') AS metrics FROM metric_max GROUP BY 1)
SELECT dedupe_key, source, source_id, copies, array_to_string(corroborating, '|') AS corroborating_sources,
  array_to_string(artifact_urls, '|') AS artifact_urls, array_to_string(authors, '|') AS authors,
  array_to_string(orgs, '|') AS organizations, metrics
FROM merged JOIN metrics USING (dedupe_key)""")
def d2_merge_duplicates(spark, sf):
    merged = dedupe.merge_duplicates(v.records(spark, sf))
    metrics = F.array_sort(F.transform(F.map_entries("metrics"), lambda m: F.concat(m["key"], F.lit("="), F.round(m["value"], 2).cast("string"))))
    return merged.select(
        "dedupe_key", "source", "source_id", "copies",
        *_joined("corroborating_sources", "artifact_urls", "authors", "organizations"),
        F.array_join(metrics, "|").alias("metrics"),
    )


@query("""
SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def d3_first_by(spark, sf):
    events = v.table(spark, sf, "events")
    return dedupe.first_by(events, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select(
        "user_id", "event_type", "event_id", "value"
    )


@query(f"""WITH {RECORDS_SQL}, both_inputs AS (
  SELECT title, url, source_id, position, 0 AS priority FROM records WHERE provenance = 'curated'
  UNION ALL SELECT title, url, source_id, position, 1 FROM records
), ranked AS (
  SELECT *, {sql_slug('title')} || ':' || url AS overlap_key FROM both_inputs
)
SELECT overlap_key, source_id FROM (
  SELECT *, row_number() OVER (PARTITION BY overlap_key ORDER BY priority, position) AS rn FROM ranked) WHERE rn = 1""")
def d4_overlap(spark, sf):
    records = v.records(spark, sf).select("title", "url", "source_id", "position", "provenance")
    reports = records.where("provenance = 'curated'")
    return dedupe.dedupe_overlap(reports, records).select("overlap_key", "source_id")


# Identifiers of six shapes built from document ids, to reach every branch of the key.
_D5_URL = """CASE doc_id % 6 WHEN 0 THEN 'https://doi.org/10.1234/AB' || doc_id || '.' WHEN 1 THEN 'https://arxiv.org/pdf/2401.' || lpad(doc_id::VARCHAR, 5, '0')
  WHEN 2 THEN 'https://huggingface.co/datasets/Org/Set-' || doc_id WHEN 3 THEN 'https://huggingface.co/spaces/x/' || doc_id
  WHEN 4 THEN 'https://github.com/Org/Repo' || doc_id || '.git' ELSE 'HTTPS://Example.org/Doc/' || doc_id || '/?ref=x' END"""


@query(f"""
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'doi:10.1234/ab' || doc_id WHEN 1 THEN 'arxiv:2401.' || lpad(doc_id::VARCHAR, 5, '0')
  WHEN 2 THEN 'hf:org/set-' || doc_id WHEN 3 THEN 'url:https://huggingface.co/spaces/x/' || doc_id
  WHEN 4 THEN 'gh:org/repo' || doc_id ELSE 'url:https://example.org/doc/' || doc_id END AS artifact_key FROM documents""")
def d5_artifact_key(spark, sf):
    docs = v.table(spark, sf, "documents").withColumn("url", F.expr(_D5_URL.replace("::VARCHAR", "").replace("lpad(doc_id", "lpad(CAST(doc_id AS STRING)")))
    shaped = docs.select(
        "doc_id", "source", F.col("doc_id").cast("string").alias("source_id"), F.lit("t").alias("title"), "url",
        F.array().cast("array<string>").alias("artifact_urls"),
    )
    return dedupe.with_artifact_key(shaped).select("doc_id", "artifact_key")


# --- scores ---------------------------------------------------------------------------------

for _name, _col in (("r1_relevance", "relevance_score"), ("r2_evidence", "evidence_score"), ("r3_recency", "recency_score"), ("r4_adoption", "adoption_score"), ("r5_total", "total_score")):
    QUERIES[_name] = lambda spark, sf, c=_col: v.merged_scored(spark, sf).select("dedupe_key", F.round(c, 4).alias(c))
    ORACLES[_name] = f"WITH {SCAN_SQL} SELECT dedupe_key, CAST(round({_col}, 4) AS DOUBLE) AS {_col} FROM scored"


@query(f"""WITH {SINGLE_SQL}, parts AS (
  SELECT source_id, unnest([{{'component': 'relevance', 'weight': 0.38::DOUBLE, 's': relevance_score}}, {{'component': 'evidence', 'weight': 0.22::DOUBLE, 's': evidence_score}},
    {{'component': 'recency', 'weight': 0.25::DOUBLE, 's': recency_score}}, {{'component': 'adoption', 'weight': 0.15::DOUBLE, 's': adoption_score}}]) AS p FROM scored)
SELECT source_id, p.component, p.weight, CAST(round(CAST(p.s AS DECIMAL(18,6)), 2) AS DOUBLE) AS score,
  CAST(round(CAST(p.weight * p.s AS DECIMAL(18,6)), 2) AS DOUBLE) AS contribution FROM parts""")
def r6_breakdown(spark, sf):
    return score.score_breakdown(v.scored(spark, sf), ["source_id"])


@query(f"""WITH {SINGLE_SQL}
SELECT CASE WHEN pinned THEN 'Pinned' WHEN total_score >= 65 THEN 'Strong' WHEN total_score >= 48 THEN 'Notable'
  WHEN total_score >= 34 THEN 'Watch' ELSE 'Below' END AS band, count(*) AS records FROM scored GROUP BY 1""")
def r7_bands(spark, sf):
    return score.band_counts(v.scored(spark, sf))


_LABELS_SQL = "list_transform(categories, lambda c: CASE c WHEN 'lang_en' THEN 'English prose' WHEN 'lang_de' THEN 'German prose' WHEN 'lang_fr' THEN 'French prose' WHEN 'lang_es' THEN 'Spanish prose' ELSE 'License' END)"


@query(f"""WITH {SCAN_SQL}
SELECT dedupe_key, array_to_string(list_filter(list_concat(
    list_transform(corroborating, lambda s: 'Also found via ' || s),
    [CASE WHEN demotions > 0 THEN 'Demoted: Shouting.' END,
     CASE WHEN len(categories) > 0 THEN 'Topics: ' || array_to_string({_LABELS_SQL}, ', ') END,
     CASE WHEN len(terms) > 0 THEN 'Matched: ' || array_to_string(terms, ', ') END,
     CASE WHEN len(families) > 0 THEN 'Tracked family: ' || array_to_string(families, ', ') END,
     CASE WHEN len(watch) > 0 THEN 'Permissive license text.' END,
     'Primary record: ' || source]), lambda x: x IS NOT NULL), ' / ') AS rationale FROM scored""")
def r8_rationale(spark, sf):
    told = score.with_rationale(v.merged_scored(spark, sf), v.RULES.labels)
    return told.select("dedupe_key", F.array_join("rationale", " / ").alias("rationale"))


# --- selection ------------------------------------------------------------------------------


@query(f"""WITH {SCAN_SQL}
SELECT source, source_id, title, total_score, pinned, copies FROM published""")
def t1_select_records(spark, sf):
    return v.published(spark, sf).select("source", "source_id", "title", "total_score", "pinned", "copies")


@query(f"""WITH {SCAN_SQL}
SELECT source, source_id, cap_rn AS place FROM capped""")
def w1_cap_per_source(spark, sf):
    """The capped rows of each source with their place in it."""
    from pyspark.sql import Window as W

    qualified = select.with_stage(v.merged_scored(spark, sf), SELECT).where("stage = 'qualified'")
    capped = select.cap_per_source(qualified, SELECT.max_items_per_source)
    order = [F.desc("pinned"), F.desc("total_score"), dedupe.fresh_first(capped, "position")]
    return capped.select("source", "source_id", F.row_number().over(W.partitionBy("source").orderBy(*order)).cast("bigint").alias("place"))


@query(f"""WITH {SCAN_SQL}
SELECT (SELECT count(*) FROM records) AS fetched, (SELECT count(*) FROM staged) AS deduplicated,
  count(*) FILTER (WHERE stage = 'out_of_domain') AS out_of_domain, count(*) FILTER (WHERE stage = 'suppressed') AS suppressed,
  count(*) FILTER (WHERE stage = 'below_threshold') AS below_threshold, (SELECT count(*) FROM published) AS published,
  (SELECT count(*) FROM published WHERE pinned) AS pinned, 30.0::DOUBLE AS minimum_score FROM staged""")
def a6_funnel(spark, sf):
    return select.funnel(v.merged_scored(spark, sf), SELECT)


@query("""
SELECT event_id, CASE event_type WHEN 'view' THEN 'downloads' WHEN 'click' THEN 'likes' ELSE 'stars' END
    || '=' || round(value, 2) AS metrics FROM events WHERE value > 0 AND event_id % 3 <> 0
UNION ALL SELECT event_id, '' FROM events WHERE NOT (value > 0) OR event_id % 3 = 0""")
def s14_clean_metrics(spark, sf):
    events = v.table(spark, sf, "events")
    name = F.when(F.col("event_type") == "view", "downloads").when(F.col("event_type") == "click", "likes").otherwise("stars")
    raw = F.when(F.col("event_id") % 3 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    cleaned = events.withColumn("metrics", clean_metrics(F.create_map(name, raw, F.lit("zero"), F.lit("0"))))
    text = F.transform(F.map_entries("metrics"), lambda m: F.concat(m["key"], F.lit("="), F.round(m["value"], 2).cast("string")))
    return cleaned.select("event_id", F.array_join(text, "|").alias("metrics"))


@query("""
SELECT o_orderkey, 'sha256:' || sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS raw_payload_hash
FROM orders""")
def s15_payload_hash(spark, sf):
    orders = v.table(spark, sf, "orders")
    return quality.with_payload_hash(orders, ["o_orderkey", "o_custkey", "o_orderstatus"]).select("o_orderkey", "raw_payload_hash")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey % 3 <> 0 AND o_orderkey % 5 <> 0")
def s15_unchanged_rows(spark, sf):
    """Of orders seen before, some with another status by now, those whose fingerprint is the stored one."""
    columns, orders = ["o_orderkey", "o_custkey", "o_orderstatus"], v.table(spark, sf, "orders")
    stored = quality.with_payload_hash(orders.where("o_orderkey % 5 <> 0").select(*columns), columns)
    changed = F.when(F.col("o_custkey") % 3 == 0, F.concat("o_orderstatus", F.lit("*"))).otherwise(F.col("o_orderstatus"))
    now = quality.with_payload_hash(orders.select("o_orderkey", "o_custkey", changed.alias("o_orderstatus")), columns)
    return quality.unchanged_rows(stored, now, ["o_orderkey"]).select("o_orderkey", "o_orderstatus")


@query(f"""
WITH {RECORDS_SQL}
SELECT trim(summary) AS summary, count(*) AS records FROM records WHERE length(trim(summary)) >= 60 GROUP BY 1 HAVING count(*) >= 4""")
def a18_boilerplate(spark, sf):
    return quality.boilerplate(v.records(spark, sf))
