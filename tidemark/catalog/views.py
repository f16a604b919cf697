"""Views that shape the test tables like the library's inputs, with their SQL twins.

``records``: documents with the time of an event, the URL of a page and metrics by event type.
``trials``: order lines as attempts, averaged per model and task. ``catalogue``: parts as standing entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedupe import merge_duplicates
from ..operators.leaderboard import average_attempts
from ..operators.match import match_records
from ..operators.score import score_records
from ..operators.select import SelectConfig, select_records
from ..functions.text import match_text, raw_text
from ..rules import RuleSet

NOW = "2024-01-31 00:00:00"
N_TASKS = 46

CONFIG = {
    "domain": {"anchors": ["of", "with", "pour", "los"]},
    "taxonomy": {
        "lang_en": {"label": "English prose", "terms": ["the", "and"]},
        "lang_de": {"label": "German prose", "terms": ["der", "und"]},
        "lang_fr": {"label": "French prose", "terms": ["le", "des"]},
        "lang_es": {"label": "Spanish prose", "terms": ["que", "la"]},
        "license": {"terms": ["licensed under", "mit license"]},
    },
    "model_families": [
        {"name": "Apache", "aliases": ["apache license"], "org": "Apache Foundation"},
        {"name": "MIT", "aliases": ["mit license"], "org": "MIT"},
        {"name": "GNU", "aliases": ["gnu general public"], "org": "Free Software"},
        {"name": "Creative Commons", "org": "CC"},
    ],
    "watchlist": [{"name": "Apache License", "note": "Permissive license text."}],
    "low_value": {
        "demote": [{"pattern": "!!.*!!", "reason": "Shouting."}],
        "suppress": [{"pattern": "(?i)worthless", "reason": "Junk text."}],
    },
    "heading_categories": {"economy": ["license"], "brand#1": ["lang_en", "license"]},
}
RULES = RuleSet.from_config(CONFIG)
SELECT = SelectConfig(minimum_score=30.0, max_items_per_source=30, report_limit=400)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utc(spark: SparkSession) -> None:
    """String dates and day keys are UTC; the session zone has to say so."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    utc(spark)
    documents, events = table(spark, sf_dir, "documents"), table(spark, sf_dir, "events")
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    n_events = events.agg(F.count("*").alias("n")).scalar()
    n_pages = pages.agg(F.count("*").alias("n")).scalar()
    metric = F.create_map(
        *[F.lit(x) for pair in (
            ("view", "downloads"), ("click", "likes"), ("purchase", "stars"), ("signup", "upvotes"), ("error", "unknown"),
        ) for x in pair]
    )
    # What belongs to an id is joined without the texts, which then meet it in one shuffle.
    beside = (
        documents.select("doc_id").distinct()
        .withColumn("event_id", (F.col("doc_id") * 37) % n_events)
        .withColumn("page_id", F.col("doc_id") % n_pages)
        .join(events.select("event_id", "ts", "event_type", "value"), "event_id")
        .join(pages.select("page_id", "url"), "page_id")
        .join(labels.select("doc_id", F.lit(True).alias("_labelled")).distinct(), "doc_id", "left")
    )
    timed = documents.join(beside, "doc_id")
    empty = F.array().cast("array<string>")
    return timed.select(
        "source",
        F.col("doc_id").cast("string").alias("source_id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("summary"),
        "url",
        F.col("ts").alias("published_at"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
        F.lit("").alias("venue"),
        F.lit("").alias("section"),
        F.array(F.concat(F.lit("author "), (F.col("doc_id") % 7).cast("string"))).alias("authors"),
        F.array(F.concat(F.lit("org "), (F.col("doc_id") % 5).cast("string"))).alias("organizations"),
        F.array("url").alias("artifact_urls"),
        empty.alias("hint_categories"),
        F.create_map(F.element_at(metric, F.col("event_type")), "value").alias("metrics"),
        F.create_map(F.lit("tags"), F.array("lang")).alias("facets"),
        F.when(F.col("_labelled"), F.lit("curated")).otherwise(F.lit("live")).alias("provenance"),
        F.lit("published").alias("event_kind"),
        F.to_date("ts").alias("scan_date"),
        F.col("doc_id").alias("position"),
    )


def matched(df: DataFrame) -> DataFrame:
    """Records with their match texts and all rule columns (facet tags stay out of the prose)."""
    texts = df.withColumns(
        {
            "match_text": match_text(*[F.col(c) for c in ("title", "summary", "section", "venue", "facets")]),
            "raw_text": raw_text(F.col("title"), F.col("summary")),
        }
    )
    return match_records(texts, RULES).drop("match_text", "raw_text")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record matched and scored as of ``NOW``, without merging copies."""
    single = records(spark, sf_dir).withColumn("corroborating_sources", F.array().cast("array<string>"))
    return score_records(matched(single), now())


def merged_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan: copies merged, then matched and scored as of ``NOW``."""
    return score_records(matched(merge_duplicates(records(spark, sf_dir))), now())


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_records(merged_scored(spark, sf_dir), SELECT)


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    nation, part = table(spark, sf_dir, "nation"), table(spark, sf_dir, "part")
    # One category per task: that of its smallest part.
    categories = part.groupBy((F.col("p_partkey") % N_TASKS).alias("task")).agg(
        F.min_by("p_type", "p_partkey").alias("category")
    )
    lines = lineitem.select(
        "l_suppkey", (F.col("l_partkey") % N_TASKS).alias("task"),
        F.round(F.col("l_discount") * 10, 2).alias("reward"),
        (F.col("l_returnflag") == "R").alias("errored"),
        (F.col("l_extendedprice") / 1000).alias("cost"),
        F.col("l_quantity").alias("steps"),
        (F.col("l_quantity") * 2).alias("minutes"),
    )
    models = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("model"), F.col("n_name").alias("org")
    )
    # Attempts are averaged on their two keys alone; names join the few rows that remain.
    trials = average_attempts(lines, ["l_suppkey", "task"])
    return trials.join(models, "l_suppkey").join(categories, "task").select(
        "model", "org", "task", "category", "reward", "errored", "cost", "steps", "minutes"
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    utc(spark)
    part = table(spark, sf_dir, "part")
    empty = F.array().cast("array<string>")
    return part.select(
        F.col("p_name").alias("title"),
        F.concat(F.lit("https://parts.example.org/"), F.col("p_partkey").cast("string")).alias("url"),
        F.concat_ws(" ", F.lit("The part"), "p_name", "p_brand").alias("summary"),
        F.concat_ws(" > ", "p_type", "p_brand").alias("section"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 30).cast("int")).alias("published_at"),
        F.array("p_brand").alias("organizations"),
        empty.alias("hint_categories"),
        F.col("p_partkey").alias("position"),
    )


# ---------------------------------------------------------------------------------- SQL twins

def _word(term: str) -> str:
    return f"regexp_matches(t, '(^|[^a-z0-9]){term}(s|es|ed|ing)?([^a-z0-9]|$)')"


SEP_CLASS = r"""[-_/\\.,;:()\[\]{}"''`*~|+]"""


def sql_normalize(expr: str) -> str:
    folded = f"lower(regexp_replace(strip_accents({expr}), '[^\\x00-\\x7F]', '', 'g'))"
    return f"trim(regexp_replace(regexp_replace({folded}, '{SEP_CLASS}', ' ', 'g'), '[\\s\\x0B\\x1c-\\x1f]+', ' ', 'g'))"


def sql_slug(expr: str) -> str:
    return f"trim(regexp_replace({sql_normalize(expr)}, '[^a-z0-9]+', '-', 'g'), '-')"


_TRACKING = "('utm_source','utm_medium','utm_campaign','utm_term','utm_content','ref','referrer','source','fbclid','gclid','spm')"


def sql_canonical(expr: str) -> str:
    """Canonical form of http(s) URLs whose parameters need no re-encoding, as in ``pages``."""
    part = lambda i: f"regexp_extract({expr}, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\\?([^#]*))?(#.*)?$', {i})"
    query = (
        f"array_to_string(list_filter(string_split({part(5)}, '&'), lambda x: regexp_matches(x, '^[^=]*=.') "
        f"and lower(string_split(x, '=')[1]) not in {_TRACKING}), '&')"
    )
    path = f"(case when rtrim({part(3)}, '/') = '' then '/' else rtrim({part(3)}, '/') end)"
    return (
        f"(lower({part(1)}) || '://' || lower({part(2)}) || {path} || "
        f"case when {query} = '' then '' else '?' || {query} end)"
    )


RECORDS_SQL = f"""
records AS (
  SELECT d.source, CAST(d.doc_id AS VARCHAR) AS source_id,
         split_part(d.text, chr(10), 1) AS title, d.text AS summary, p.url,
         e.ts AS published_at, 'author ' || (d.doc_id % 7) AS author, 'org ' || (d.doc_id % 5) AS org,
         CASE e.event_type WHEN 'view' THEN 'downloads' WHEN 'click' THEN 'likes' WHEN 'purchase' THEN 'stars'
              WHEN 'signup' THEN 'upvotes' ELSE 'unknown' END AS metric, e.value AS amount, d.lang,
         CASE WHEN d.doc_id IN (SELECT doc_id FROM labels) THEN 'curated' ELSE 'live' END AS provenance,
         CAST(e.ts AS DATE) AS scan_date, d.doc_id AS position
  FROM documents d
  JOIN events e ON e.event_id = (d.doc_id * 37) % (SELECT count(*) FROM events)
  JOIN pages p ON p.page_id = d.doc_id % (SELECT count(*) FROM pages)
)"""

KEYED_SQL = f"""
keyed AS (
  SELECT r.*, CASE WHEN length(replace({sql_normalize('title')}, ' ', '')) >= 24
    THEN sha256('title' || chr(31) || {sql_normalize('title')} || chr(31))
    ELSE sha256('url' || chr(31) || {sql_canonical('url')} || chr(31)) END AS dedupe_key
  FROM records r
)"""

# Copies: everything a merged record needs, as plain scalars and ordered lists.
MERGED_SQL = f"""
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY published_at DESC, position) AS rn FROM keyed
),
lists AS (
  SELECT dedupe_key, count(*) AS copies,
         list(source ORDER BY rn) AS all_sources, list(url ORDER BY rn) AS all_urls,
         list(author ORDER BY rn) AS all_authors, list(org ORDER BY rn) AS all_orgs
  FROM ordered GROUP BY dedupe_key
),
metric_max AS (
  SELECT dedupe_key, metric, max(amount) AS amount FROM ordered GROUP BY dedupe_key, metric
),
uniq AS (
  SELECT dedupe_key,
    (SELECT list(v ORDER BY i) FROM (SELECT v, min(i) AS i FROM (SELECT unnest(all_sources) AS v, generate_subscripts(all_sources, 1) AS i) GROUP BY v)) AS sources,
    (SELECT list(v ORDER BY i) FROM (SELECT v, min(i) AS i FROM (SELECT unnest(all_urls) AS v, generate_subscripts(all_urls, 1) AS i) GROUP BY v)) AS urls,
    (SELECT list(v ORDER BY i) FROM (SELECT v, min(i) AS i FROM (SELECT unnest(all_authors) AS v, generate_subscripts(all_authors, 1) AS i) GROUP BY v)) AS author_list,
    (SELECT list(v ORDER BY i) FROM (SELECT v, min(i) AS i FROM (SELECT unnest(all_orgs) AS v, generate_subscripts(all_orgs, 1) AS i) GROUP BY v)) AS org_list,
    copies
  FROM lists
),
merged AS (
  SELECT o.dedupe_key, o.source, o.source_id, o.title, o.summary, o.url, o.published_at, o.provenance,
         o.scan_date, o.position, o.lang, u.copies, list_filter(u.sources, lambda x: x <> o.source) AS corroborating,
         u.urls AS artifact_urls, u.author_list AS authors, u.org_list AS orgs
  FROM ordered o JOIN uniq u USING (dedupe_key) WHERE o.rn = 1
)"""



def _keep(terms: list[tuple[str, str]]) -> str:
    cases = ", ".join(f"CASE WHEN {_word(term)} THEN '{name}' END" for name, term in terms)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def _any(terms: list[str]) -> str:
    return "(" + " OR ".join(_word(t) for t in terms) + ")"


def _entity_list(entities) -> str:
    cases = ", ".join(f"CASE WHEN {_any(list(e.terms))} THEN '{e.name}' END" for e in entities)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def sql_matched(source: str, text: str, raw: str, name: str = "matched") -> str:
    """Rule columns of every row of ``source`` as CTE ``name``."""
    cats = ", ".join(f"CASE WHEN {_any(list(c.terms))} THEN '{c.key}' END" for c in RULES.categories)
    terms = [(t, t) for c in RULES.categories for t in c.terms]
    orgs = ", ".join(f"CASE WHEN {_any(list(e.terms))} THEN '{e.org}' END" for e in RULES.families)
    return f"""
{name}_text AS (SELECT *, {sql_normalize(text)} AS t, {raw} AS raw FROM {source}),
{name} AS (
  SELECT * EXCLUDE (t, raw),
    {_keep([(a, a) for a in RULES.anchors])} AS anchors,
    list_filter([{cats}], lambda x: x IS NOT NULL) AS categories,
    {_keep(terms)} AS terms,
    {_entity_list(RULES.families)} AS families,
    list_filter([{orgs}], lambda x: x IS NOT NULL) AS family_orgs,
    {_entity_list(RULES.watchlist)} AS watch,
    CASE WHEN regexp_matches(raw, '!!.*!!') THEN 1 ELSE 0 END AS demotions,
    CASE WHEN regexp_matches(raw, '(?i)worthless') THEN 1 ELSE 0 END AS suppressions
  FROM {name}_text
)"""


RECORD_TEXT = "concat_ws(' ', nullif(title, ''), nullif(summary, ''), lang)"
RECORD_RAW = "concat_ws(' ', nullif(title, ''), nullif(summary, ''))"


def sql_scored(source: str, n_sources: str, n_artifacts: str, n_authors: str, adoption: str, name: str = "scored") -> str:
    """Component scores of matched rows as CTE ``name``."""
    return f"""
{name}_parts AS (
  SELECT *,
    least(100.0, greatest(0.0, 22.0 * len(categories) + 5.0 * len(terms) + least(12.0, 4.0 * len(anchors)) - 26.0 * demotions)) AS relevance_score,
    least(100.0, 17.0 + CASE WHEN length(summary) >= 120 THEN 18.0 ELSE 0.0 END
      + CASE WHEN length(summary) >= 600 THEN 8.0 ELSE 0.0 END + CASE WHEN {n_authors} > 0 THEN 10.0 ELSE 0.0 END
      + least(24.0, 8.0 * {n_artifacts}) + CASE WHEN {n_sources} > 0 THEN 16.0 ELSE 0.0 END) AS evidence_score,
    least(100.0, greatest(0.0, 100.0 * (1.0 - greatest(0.0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(published_at)) / 3.6e9)
      / CASE WHEN provenance = 'curated' THEN 720.0 ELSE 48.0 END))) AS recency_score,
    {adoption} AS adoption_score,
    (len(families) > 0 OR len(watch) > 0) AS pinned
  FROM {source}
),
{name} AS (
  SELECT *, CAST(round(CAST(least(100.0, greatest(0.0, 0.38 * relevance_score + 0.22 * evidence_score
    + 0.25 * recency_score + 0.15 * adoption_score)) AS DECIMAL(18,6)), 2) AS DOUBLE) AS total_score,
    CASE WHEN len(anchors) = 0 THEN 'out_of_domain' WHEN suppressions > 0 THEN 'suppressed'
         WHEN len(categories) = 0 THEN 'out_of_domain' ELSE 'gate' END AS gate
  FROM {name}_parts
)"""


def sql_adoption(metric: str, amount: str) -> str:
    ceiling = (
        f"CASE {metric} WHEN 'downloads' THEN 60000.0 WHEN 'likes' THEN 800.0 WHEN 'stars' THEN 4000.0 "
        f"WHEN 'upvotes' THEN 250.0 END"
    )
    return f"CASE WHEN {amount} > 0 THEN log10(1.0 + {amount}) / log10(1.0 + {ceiling}) END"


SINGLE_SQL = (
    RECORDS_SQL + "," + sql_matched("records", RECORD_TEXT, RECORD_RAW)
    + "," + sql_scored("matched", "0", "1", "1", f"least(100.0, 100.0 * coalesce({sql_adoption('metric', 'amount')}, 0.0))")
)

_MERGED_ADOPTION = (
    f"least(100.0, 100.0 * coalesce((SELECT max({sql_adoption('m.metric', 'm.amount')}) FROM metric_max m "
    f"WHERE m.dedupe_key = merged_matched.dedupe_key), 0.0))"
)
SCAN_SQL = (
    RECORDS_SQL + "," + KEYED_SQL + "," + MERGED_SQL
    + "," + sql_matched("merged", RECORD_TEXT, RECORD_RAW, "merged_matched")
    + "," + sql_scored("merged_matched", "len(corroborating)", "len(artifact_urls)", "len(authors)", _MERGED_ADOPTION)
    + f""",
staged AS (
  SELECT *, CASE WHEN gate <> 'gate' THEN gate WHEN NOT pinned AND total_score < {SELECT.minimum_score}
    THEN 'below_threshold' ELSE 'qualified' END AS stage FROM scored
),
capped AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pinned DESC, total_score DESC,
    published_at DESC, position) AS cap_rn FROM staged WHERE stage = 'qualified')
  WHERE cap_rn <= {SELECT.max_items_per_source}
),
published AS (
  SELECT * FROM capped ORDER BY pinned DESC, total_score DESC, published_at DESC, position LIMIT {SELECT.report_limit}
)"""
)

TRIALS_SQL = f"""
task_category AS (
  SELECT p_partkey % {N_TASKS} AS task, arg_min(p_type, p_partkey) AS category FROM part GROUP BY 1
),
trials AS (
  SELECT s.s_name AS model, n.n_name AS org, x.task, c.category, x.reward, x.errored, x.cost, x.steps, x.minutes
  FROM (
    SELECT l_suppkey, task, round(CAST(sum(CAST(CASE WHEN errored THEN 0 ELSE reward END AS DECIMAL(28,6))) AS DOUBLE) / count(*), 9) AS reward,
           bool_and(errored) AS errored, round(CAST(sum(CAST(cost AS DECIMAL(28,6))) AS DOUBLE) / count(*), 9) AS cost,
           round(CAST(sum(CAST(steps AS DECIMAL(28,6))) AS DOUBLE) / count(*), 9) AS steps,
           round(CAST(sum(CAST(minutes AS DECIMAL(28,6))) AS DOUBLE) / count(*), 9) AS minutes
    FROM (
      SELECT l_suppkey, l_partkey % {N_TASKS} AS task, round(l_discount * 10, 2) AS reward, l_returnflag = 'R' AS errored,
             l_extendedprice / 1000 AS cost, l_quantity AS steps, l_quantity * 2 AS minutes
      FROM lineitem
    ) GROUP BY l_suppkey, task
  ) x
  JOIN supplier s ON s.s_suppkey = x.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey
  JOIN task_category c ON c.task = x.task
),
effective AS (SELECT *, CASE WHEN errored THEN 0.0 ELSE reward END AS eff FROM trials)"""

BOARD_SQL = TRIALS_SQL + f""",
board AS (
  SELECT model, org, sum(eff) / {N_TASKS} AS mean_reward, count(*) FILTER (WHERE eff >= 0.90) AS pass_90,
         count(*) FILTER (WHERE eff >= 0.95) AS pass_95, count(*) FILTER (WHERE eff >= 1.0) AS pass_100,
         avg(cost) AS cost
  FROM effective GROUP BY model, org
)"""

CATALOGUE_SQL = """
catalogue AS (
  SELECT p_name AS title, 'https://parts.example.org/' || p_partkey AS url,
         'The part ' || p_name || ' ' || p_brand AS summary, p_type || ' > ' || p_brand AS section,
         CAST(DATE '2024-01-01' + CAST(p_partkey % 30 AS INTEGER) AS DATE) AS published_at, p_brand AS organization,
         p_type AS section_title, p_brand AS subsection, p_partkey AS position
  FROM part
)"""
