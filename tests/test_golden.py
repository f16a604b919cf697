"""Two published records, recomputed from the terms that concern them."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.plans.scan import score_table
from tidemark.rules import RuleSet

from .helpers import record, records

# The anchors and terms that these records can touch.
RULES = RuleSet.from_config(
    {
        "domain": {"anchors": ["vlm", "mllm", "image", "images", "visual", "vision", "video", "perception", "clip"]},
        "taxonomy": {
            "vlm_model": {"label": "VLM releases", "terms": ["vision language model", "vlm", "mllm"]},
            "benchmark": {"label": "Benchmarks", "terms": ["benchmark", "leaderboard", "test set"]},
            "video": {"label": "Video understanding", "terms": ["video understanding", "long video", "temporal grounding"]},
            "safety": {"label": "Safety & fairness", "terms": ["safety", "jailbreak", "bias"]},
            "domain_apps": {"label": "Applied domains", "terms": ["medical", "clinical", "radiology"]},
        },
        "model_families": [{"name": "Claude", "aliases": ["claude opus"], "org": "Anthropic"}],
    }
)
# Two published records, whose scores are recomputed below.
FIRST = dict(
    title="IMCBench",
    section="3. New Benchmarks",
    published_at=datetime(2026, 6, 26),
    summary=(
        "Task: Multi-turn image-grounded medical conversations. Eval Protocol: Clinical images + synthetic patient profiles, judged on "
        "safety / accuracy / uncertainty handling; 8 frontier models across 4 families (Claude, GPT, Nova, Llama). Key Finding: Best model "
        "(Claude Opus 4.6) scores only 3.61/5; no model excels uniformly, and safety degrades on malignant or rare conditions"
    ),
)
SECOND = dict(
    title="HPP: Hierarchical Programmatic Probing for Long Video Understanding",
    section="4. Applications > 4.3 Long Video Understanding",
    published_at=datetime(2026, 6, 19),
    summary=(
        "Key Contribution: Decouples perception from reasoning: a coding-capable LLM iteratively probes hierarchically segmented video, calling "
        "a VLM only for localized analysis; substantially outperforms end-to-end methods on long-video benchmarks"
    ),
)


def test_published_scores(spark):
    rows = [record(i, source="Survey Report", provenance="curated", authors=[], **r) for i, r in enumerate((FIRST, SECOND))]
    base = records(spark, rows).withColumn("corroborating_sources", F.array().cast("array<string>"))
    as_of = F.lit("2026-06-27 00:00:00").cast("timestamp_ntz")
    one, two = score_table(base, RULES, as_of).orderBy("position").collect()
    assert one["matched_terms"] == ["benchmark", "safety", "medical", "clinical"]
    assert one["categories"] == ["benchmark", "safety", "domain_apps"] and one["organizations"] == ["Anthropic"]
    assert one["rationale"] == [
        "Topics: Benchmarks, Safety & fairness, Applied domains", "Matched: benchmark, safety, medical, clinical",
        "Tracked family: Claude", "Primary record: Survey Report",
    ]
    assert two["matched_terms"] == ["vlm", "benchmark", "video understanding", "long video"]
    scores = ("relevance_score", "evidence_score", "recency_score", "adoption_score", "total_score")
    # Both published records had no links beyond their URL and 52 evidence points.
    assert [one[s] for s in scores] == pytest.approx([94.0, 52.0, 96.67, 0.0, 71.33], abs=0.01)
    assert [two[s] for s in scores] == pytest.approx([98.0, 52.0, 73.33, 0.0, 67.01], abs=0.01)
