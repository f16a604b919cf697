"""Markdown tables of curated lists to records.

Files come as ``(origin, text)`` rows, for instance from ``spark.read.text(path,
wholetext=True)``. Lines are exploded and tables found with windows inside a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import first_of, let
from ..functions.cells import PLACEHOLDERS, clean_cell, clean_heading, informative, publisher_parts
from ..functions.dates import parse_datetime
from ..functions.text import normalize, slug, truncate
from ..functions.urls import markdown_links
from ..operators.dedupe import first_by
from ..operators.match import heading_categories
from ..rules import RuleSet
from .records import one, to_records

CURATED_LIST, CURATED_REPORT = "Survey", "Survey Report"

# Line shapes, and the header words of a date column.
HEADING = r"(?U)^(#{1,6})\s+(.+?)\s*#*$"
DIVIDER = r"(?U)^\s*\|?[\s:|-]*-[\s:|-]*\|?\s*$"
DATE_HEADERS = ("date", "year", "released", "release")
FILE_DATE = r"(\d{4}-\d{2}-\d{2})"
LEVELS = range(1, 7)


def files_to_documents(files: DataFrame, path_col: str = "path", text_col: str = "value") -> DataFrame:
    """Dated reports from whole files: ``origin`` and ``report_date`` from the file name."""
    stem = F.regexp_extract(path_col, r"([^/]*?)(?:\.[^./]*)?$", 1)
    date = F.nullif(F.regexp_extract(stem, FILE_DATE, 1), F.lit(""))
    return files.select(
        F.concat(F.lit("report/"), date).alias("origin"), date.alias("report_date"), F.col(text_col).alias("text")
    ).where("report_date is not null")


def table_rows(documents: DataFrame) -> DataFrame:
    """Body rows of every table: origin, line number, heading trail, headers, cells.

    Fenced code is skipped. A table is a row line followed by a divider; its body is the run of
    row lines after it. Level-1 headings reset the trail without being part of it.
    """
    keep = [c for c in documents.columns if c != "text"]
    lines = documents.select(*keep, F.posexplode(F.split("text", r"\r\n|[\n\r]")).alias("n", "line"))
    in_file = W.partitionBy("origin").orderBy("n")
    so_far = in_file.rowsBetween(W.unboundedPreceding, 0)

    fence = F.trim("line").startswith("```")
    fenced = lines.withColumn("_fences", F.sum(fence.cast("int")).over(so_far)).withColumn(
        "_live", (F.col("_fences") % 2 == 0) & ~fence
    )
    level = F.when(F.col("_live") & F.col("line").rlike(HEADING), F.length(F.regexp_extract("line", HEADING, 1)))
    pipes = F.length("line") - F.length(F.replace("line", F.lit("|"), F.lit("")))
    shaped = fenced.withColumn("_level", level).withColumns(
        {
            "_label": F.when(F.col("_level").isNotNull(), clean_heading(F.regexp_extract("line", HEADING, 2))),
            "_row": F.col("_live") & F.col("_level").isNull() & (pipes >= 2),
            "_divider": F.col("line").rlike(DIVIDER),
        }
    )
    seen = {
        f"_h{l}": F.last(F.when(F.col("_level") == l, F.struct("n", "_label")), ignorenulls=True).over(so_far)
        for l in LEVELS
    }
    linked = shaped.withColumns(
        {**seen, "_next_divider": F.lead("_divider").over(in_file), "_prev_row": F.lag("_row").over(in_file)}
    )
    # A heading holds while no later heading of its own or a higher level follows.
    trail = []
    for l in list(LEVELS)[1:]:
        above = F.greatest(F.lit(-1), *[F.coalesce(F.col(f"_h{u}.n"), F.lit(-1)) for u in range(1, l)])
        trail.append(F.when((F.col(f"_h{l}.n") > above) & (F.col(f"_h{l}._label") != ""), F.col(f"_h{l}._label")))
    member = F.col("_row") | (F.col("_divider") & F.col("_live") & F.coalesce("_prev_row", F.lit(False)))
    runs = (
        linked.withColumn("trail", F.array_compact(F.array(*trail)))
        .withColumn("_member", member)
        .withColumn("_run", F.sum((~F.col("_member")).cast("int")).over(so_far))
        .where("_member")
    )
    in_run = W.partitionBy("origin", "_run")
    starts = F.col("_row") & F.coalesce("_next_divider", F.lit(False))
    started = runs.withColumn("_start", F.min(F.when(starts, F.col("n"))).over(in_run))
    headed = started.withColumn("_header", F.min(F.when(F.col("n") == F.col("_start"), F.col("line"))).over(in_run))
    ends = F.min(F.when((F.col("n") > F.col("_start") + 1) & ~F.col("_row"), F.col("n"))).over(in_run)
    body = headed.withColumn("_end", ends).where(
        (F.col("n") > F.col("_start") + 1) & (F.col("_end").isNull() | (F.col("n") < F.col("_end")))
    )
    return body.select(
        *keep, "n", "trail",
        F.transform(_split_row(F.col("_header")), clean_cell).alias("headers"),
        _split_row(F.col("line")).alias("cells"),
    )


def _split_row(line: Column) -> Column:
    trimmed = F.regexp_replace(line, r"(?U)^\s+|\s+\z", "")
    inner = F.regexp_replace(trimmed, r"^\||\|\z", "")
    return F.transform(F.split(inner, r"\|"), lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+\z", ""))


def markdown_table_records(
    documents: DataFrame, rules: RuleSet, now: Column, source: str = CURATED_REPORT,
    summary_limit: int | None = None, max_links: int | None = None, section_depth: int | None = None,
) -> DataFrame:
    """Records of every table row that has a title and a link.

    ``documents(origin, text[, report_date])``; the report date stands in for a missing or
    unreadable date cell and for the discovery time. The limits cut summaries and further links and
    keep the innermost headings of a section; None keeps all. One file is one task's work.
    """
    if "report_date" not in documents.columns:
        documents = documents.withColumn("report_date", F.lit(None).cast("string"))
    rows = table_rows(documents).where(F.size("headers") >= 2)
    http = lambda cell: F.filter(markdown_links(cell), lambda u: u.startswith("http"))
    dated = F.transform(
        F.col("headers"),
        lambda h: let(normalize(h), lambda t: F.exists(F.array(*map(F.lit, DATE_HEADERS)), lambda m: F.contains(t, m))),
    )
    title = clean_cell(F.element_at("cells", 1))
    cleaned = rows.select(
        "*",
        title.alias("_title"),
        (F.array_position(dated, True) - 1).cast("int").alias("_date_at"),
        F.transform("cells", clean_cell).alias("_clean"),
        F.array_distinct(F.flatten(F.transform("cells", http))).alias("_links"),
        http(F.element_at("cells", 1)).alias("_own_links"),
    )
    url = F.coalesce(F.get("_own_links", F.lit(0)), F.get("_links", F.lit(0)))
    kept = cleaned.withColumn("url", url).where(
        (F.col("_title") != "") & ~normalize(F.col("_title")).isin(*PLACEHOLDERS) & F.col("url").isNotNull()
    )
    name, publisher = publisher_parts(F.col("_title"))
    named = kept.withColumns({"title": name, "publisher": publisher}).withColumn(
        "record_id", F.concat_ws(":", "origin", slug(F.col("title")), slug(F.col("url")))
    )
    first = first_by(named, ["origin", "record_id"], [F.col("n")])

    heads = F.transform("headers", clean_heading)
    date_cell = F.when(F.col("_date_at") >= 0, F.get("_clean", F.col("_date_at")))
    published = F.coalesce(parse_datetime(date_cell), parse_datetime(F.col("report_date")))
    indexed = F.transform(F.col("_clean"), lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    told = F.filter(
        indexed,
        lambda x: (x["i"] != 0) & (x["i"] != F.col("_date_at")) & informative(x["c"]) & (F.length(x["c"]) >= 2),
    )
    phrases = F.transform(
        told,
        lambda x: F.when(
            F.coalesce(F.get(F.col("_heads"), x["i"]), F.lit("")) != "",
            F.concat(F.get(F.col("_heads"), x["i"]), F.lit(": "), x["c"]),
        ).otherwise(x["c"]),
    )
    filled = F.filter(indexed, lambda x: (x["i"] < F.size("_heads")) & informative(x["c"]))
    pairs = F.transform(
        filled,
        lambda x: F.concat(
            F.when(F.get(F.col("_heads"), x["i"]) != "", F.get(F.col("_heads"), x["i"])).otherwise(
                F.concat(F.lit("column_"), x["i"].cast("string"))
            ),
            F.lit("="), x["c"],
        ),
    )
    inner = F.col("trail")
    if section_depth is not None:
        inner = F.slice(inner, F.greatest(F.lit(1), F.size(inner) - (section_depth - 1)), section_depth)
    section = F.array_join(inner, " > ")
    extra = first_of(F.array_remove("_links", F.col("url")), max_links)
    ready = first.withColumn("_heads", heads).withColumn("_section", section)
    facets = F.map_filter(
        F.create_map(
            F.lit("survey_section"), one(F.col("_section")),
            F.lit("survey_origin"), F.array("origin"),
            F.lit("report_date"), one(F.col("report_date")),
            F.lit("columns"), pairs,
        ),
        lambda _, v: F.size(v) > 0,
    )
    columns = {
        "source": F.lit(source),
        "source_id": F.col("record_id"),
        "title": F.col("title"),
        "url": F.col("url"),
        "published_at": published,
        "summary": truncate(F.array_join(phrases, ". "), summary_limit),
        "organizations": one(F.col("publisher")),
        "artifact_urls": extra,
        "facets": facets,
        "hint_categories": heading_categories(F.array_join("trail", " > "), rules),
        "section": F.col("_section"),
        "event_kind": F.lit("curated"),
        "provenance": F.lit("curated"),
        "discovered_at": F.coalesce(parse_datetime(F.col("report_date")), now),
        "position": F.col("n"),
    }
    return to_records(ready, columns, ["origin", "title", "url"], now)
