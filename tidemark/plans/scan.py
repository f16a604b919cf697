"""The daily scan and the backfill of dated reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import hours_before
from ..functions.text import match_text, raw_text
from ..operators.dedupe import merge_duplicates
from ..operators.match import match_records
from ..operators.quality import boilerplate
from ..operators.rollup import missing_dates
from ..operators.score import ScoreConfig, score_records, with_rationale
from ..operators.select import SelectConfig, funnel, select_records
from ..rules import RuleSet
from ..sources.registry import check_required
from .storage import cut


class BoilerplateError(RuntimeError):
    """Many records share one summary, so a mapping is broken."""


@dataclass(frozen=True)
class Scan:
    """Published records, every scored record, funnel and health of one run."""

    published: DataFrame
    scored: DataFrame
    funnel: DataFrame
    health: DataFrame | None
    since: Column


def score_table(records: DataFrame, rules: RuleSet, now: Column, config: ScoreConfig = ScoreConfig()) -> DataFrame:
    """Match, score and explain merged records as of ``now``."""
    texts = records.withColumns(
        {
            "match_text": match_text(*[F.col(c) for c in ("title", "summary", "section", "venue", "facets")]),
            "raw_text": raw_text(F.col("title"), F.col("summary")),
        }
    )
    matched = match_records(texts, rules).drop("match_text", "raw_text")
    return with_rationale(score_records(matched, now, config), rules.labels)


def run_scan(
    records: DataFrame,
    rules: RuleSet,
    now: Column,
    health: DataFrame | None = None,
    scoring: ScoreConfig = ScoreConfig(),
    selection: SelectConfig = SelectConfig(),
    boilerplate_threshold: int = 4,
) -> Scan:
    """Merge, match, score, guard and select one scan."""
    scored = cut(score_table(merge_duplicates(records), rules, now, scoring))
    repeated = boilerplate(scored, boilerplate_threshold).limit(1).collect()
    if repeated:
        raise BoilerplateError(f"{repeated[0]['records']} records share a summary: {repeated[0]['summary'][:120]!r}")
    published = select_records(scored, selection)
    if health is not None:
        check_required(health, published)
    return Scan(published, scored, funnel(scored, selection), health, hours_before(now, scoring.lookback_hours))


def run_backfill(
    entries: DataFrame,
    rules: RuleSet,
    snapshots: DataFrame | None = None,
    scoring: ScoreConfig = ScoreConfig(),
    selection: SelectConfig = SelectConfig(),
    overwrite: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(published, funnels) of every report date at once, each scored as of its own date.

    ``entries`` carry ``scan_date``. Dates that already have a snapshot are left out unless
    ``overwrite`` is set.
    """
    todo = entries
    if snapshots is not None:
        wanted = missing_dates(entries, snapshots, overwrite=overwrite)
        # One row per calendar day at most.
        todo = entries.join(F.broadcast(wanted), "scan_date", "left_semi")
    merged = merge_duplicates(todo, by=("scan_date",))
    scored = cut(score_table(merged, rules, F.col("scan_date").cast("timestamp"), scoring))
    published = select_records(scored, selection, by=("scan_date",))
    return published, funnel(scored, selection, by=("scan_date",))
