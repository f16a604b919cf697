import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import match, score
from tidemark.operators.select import SelectConfig, funnel, select_records, with_stage
from tidemark.plans.scan import score_table
from tidemark.operators.dedupe import merge_duplicates
from tidemark.rules import NO_ANCHOR_REASON, RuleSet, guide_tokens

from .helpers import hours_ago, now, record, records, values

CONFIG = {
    "domain": {"anchors": ["vlm", "vision language", "visual", "vit"]},
    "taxonomy": {
        "models": {"label": "Model releases", "terms": ["vision language model", "vlm"]},
        "benchmark": {"terms": ["benchmark", "test set", "vlm"]},
    },
    "model_families": [{"name": "Qwen-VL", "aliases": ["qwen2.5 vl"], "org": "Alibaba"}],
    "watchlist": [{"name": "MMMU", "note": "College-level."}],
    "low_value": {
        "demote": [{"pattern": r"(?i)\b(gguf|awq)\b", "reason": "Quantised."}, {"pattern": "(?i)mirror of", "reason": "Mirror."}],
        "suppress": [{"pattern": r"(?i)^(test|tmp)\b", "reason": "Placeholder."}],
    },
}
RULES = RuleSet.from_config(CONFIG)


def matched(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, match_text string")
    return match.match_terms(df, RULES).orderBy("i")


def test_boundaries_inflections_and_order(spark):
    rows = matched(spark, ["we invite you", "two vits", "vlms and benchmarks", "benchmarking vision language models", "vision languages", "visually", "a!vlm?x"]).collect()
    assert [r["anchors"] for r in rows] == [[], ["vit"], ["vlm"], ["vision language"], ["vision language"], [], ["vlm"]]
    assert rows[2]["categories"] == ["models", "benchmark"] and rows[2]["matched_terms"] == ["vlm", "benchmark"]
    assert rows[3]["matched_terms"] == ["vision language model", "benchmark"]


def test_literal_and_table_matching_agree(spark):
    texts = ["vlm benchmark", "test sets of vision language models", "nothing here", "the vision  language", "vlmed", "xvlm", "test-set", "testset"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, match_text string")
    terms = spark.createDataFrame(
        [(c.key, n, t, k) for n, c in enumerate(RULES.categories) for k, t in enumerate(c.terms)],
        "category string, cat_ord int, term string, term_ord int",
    )
    from_table = {(r["i"], r["term"]) for r in match.match_term_table(df, terms, "i").collect()}
    literal = {(r["i"], t) for r in match.match_terms(df, RULES).collect() for t in r["matched_terms"]}
    assert from_table == literal


@pytest.mark.parametrize("broadcast", [250_000, -1])
def test_term_table_equals_patterns(spark, monkeypatch, broadcast):
    """Random folded texts, nine in ten of which hold one word, against a pattern per term."""
    monkeypatch.setattr(match, "BROADCAST_WORDS", broadcast)
    rng = random.Random(12)
    words, joints = ["the", "c", "net", "test", "tests", "testing", "set", "ing", "s", "q", "a", "deep", "learned"], [" "] * 6 + ["#", "&", " & ", "# ", " #", "  ", "="]
    texts = []
    for _ in range(250):
        line = "".join(rng.choice(words) + rng.choice(joints) for _ in range(rng.randrange(1, 9)))
        texts.append(("the " if rng.random() < 0.9 else "") + rng.choice(["", "#"]) + line)
    texts += [None, "", "#", "the", "c#", "#c", "c#s", "xc#"]
    terms = ["the", "the net", "the test set", "c#", "#c", "q&a", "q & a", "c# net", "deep", "set the", "absent word", "the absent", "##", "s", "test", "learn", "the  net"]
    rules = spark.createDataFrame([(f"k{i % 3}", i % 3, x, i) for i, x in enumerate(terms)] + [("k0", 0, "the", 0)], "category string, cat_ord int, term string, term_ord int")
    df = spark.createDataFrame(list(enumerate(texts)), "i int, match_text string").repartition(3)
    got = {(r["i"], r["category"], r["term"]) for r in match.match_term_table(df, rules, "i").collect()}
    want = set()
    for n, term in enumerate(terms):
        folded = " ".join(term.split())
        if re.search("[a-z0-9]", folded):
            pattern = re.compile(rf"(?<![a-z0-9]){re.escape(folded)}(?:s|es|ed|ing)?(?![a-z0-9])")
            want |= {(i, f"k{n % 3}", folded) for i, x in enumerate(texts) if x and pattern.search(x)}
    assert got == want and len(want) > 300


def test_guide_tokens():
    assert guide_tokens("vlm")[1] and "vlms" in guide_tokens("vlm")[0]
    assert guide_tokens("vision language model") == (("language",), False)
    assert guide_tokens("&&") == ((), False)


def test_entities_watchlist_and_low_value(spark):
    rows = [record(0, title="Qwen2.5-VL on MMMU", summary="A GGUF mirror of it"), record(1, title="test upload", summary="")]
    scored = {r["position"]: r for r in score_table(merge_input(spark, rows), RULES, now()).collect()}
    first, second = scored[0], scored[1]
    assert first["model_families"] == ["Qwen-VL"] and first["organizations"] == ["Alibaba"]
    assert first["watchlist"] == ["MMMU"] and first["watchlist_notes"] == ["College-level."]
    assert first["demotions"] == 2 and first["pinned"]
    assert second["suppression_reasons"] == ["Placeholder.", NO_ANCHOR_REASON]
    assert first["rationale"][:2] == ["Demoted: Quantised.", "Demoted: Mirror."]


def merge_input(spark, rows):
    return records(spark, rows).withColumn("corroborating_sources", F.array().cast("array<string>"))


def test_relevance_points(spark):
    lit = lambda *v: [F.lit(x) for x in v]
    row = spark.range(1).select(
        score.relevance(*lit(1, 2, 1, 0)).alias("a"), score.relevance(*lit(9, 9, 9, 0)).alias("b"), score.relevance(*lit(0, 1, 9, 3)).alias("c"),
        score.relevance(*lit(2, 4, 9, 1)).alias("d"),
    ).first()
    assert list(row) == [36.0, 100.0, 0.0, 50.0]


def test_recency_decay(spark):
    row = spark.range(1).select(*[score.recency(F.lit(float(h)), F.lit(48.0)) for h in (0, 24, 48, 90)], score.recency(F.lit(1.0), F.lit(0.0))).first()
    assert list(row) == [100.0, 50.0, 0.0, 0.0, 0.0]


def test_adoption_log_scale(spark):
    df = spark.createDataFrame([({"stars": 4000.0},), ({"stars": 63.0, "odd": 1e9},), ({},), ({"likes": 1e6, "forks": 1.0},)], "m map<string,double>")
    got = values(df.select(score.adoption(F.col("m")).alias("a")), "a")
    assert got == pytest.approx([100.0, 100 * math.log10(64) / math.log10(4001), 0.0, 100.0])


def test_total_matches_published_example(spark):
    parts = {"relevance": 94.0, "evidence": 52.0, "recency": 96.67, "adoption": 0.0}
    assert spark.range(1).select(score.total({k: F.lit(v) for k, v in parts.items()})).first()[0] == pytest.approx(71.33, abs=0.01)


def test_evidence_and_undated_midwindow(spark):
    rows = [
        record(0, source="Blog", authors=[], published_at=None, summary="x" * 119),
        record(1, published_at=None, updated_at=hours_ago(12), summary="x" * 600, artifact_urls=["a", "b", "c", "d"], venue="V"),
        record(2, provenance="curated", published_at=hours_ago(360), summary="x" * 120),
        record(3, published_at=hours_ago(-5)),
    ]
    got = {r["position"]: r for r in score_table(merge_input(spark, rows), RULES, now()).collect()}
    # The second row earns 104 points and is clamped.
    assert [got[i]["evidence_score"] for i in range(4)] == [17.0, 100.0, 34 + 18 + 10, 44.0]
    assert [got[i]["recency_score"] for i in range(4)] == [50.0, 75.0, 50.0, 100.0]


def scan_rows():
    long = "visual study of vlm systems " * 6
    return [
        record(0, title="A completely unrelated cooking manual", url="http://c/0", summary="salt"),
        record(1, title="tmp visual vlm thing number one", url="http://c/1"),
        record(2, title="Only a visual anchor and no category", url="http://c/2"),
        record(3, title="visual vlm with a weak score overall", url="http://c/3", published_at=hours_ago(400), authors=[], source="Blog"),
        record(4, title="Pinned old MMMU vlm result with weak score", url="http://c/4", published_at=hours_ago(400), source="Blog", authors=[]),
        record(5, title="A strong vision language model benchmark", url="http://c/5", summary=long),
        record(6, title="Another vision language model benchmark", url="http://c/6", summary=long, published_at=hours_ago(1)),
        record(7, title="Third one: a vision language model test set", url="http://c/7", summary=long, published_at=hours_ago(2)),
        record(8, title="Third one: a vision language model test set", url="http://d/8", source="OpenAlex", published_at=hours_ago(3)),
    ]


def test_gates_funnel_cap_and_ranking(spark):
    config = SelectConfig(minimum_score=50.0, max_items_per_source=2, report_limit=2)
    scored = score_table(merge_duplicates(records(spark, scan_rows())), RULES, now())
    stages = {r["position"]: r["stage"] for r in with_stage(scored, config).collect()}
    assert stages == {
        0: "out_of_domain", 1: "suppressed", 2: "out_of_domain", 3: "below_threshold", 4: "qualified", 5: "qualified", 6: "qualified", 7: "qualified",
    }
    ranked = select_records(scored, config).collect()
    assert [r["position"] for r in ranked] == [4, 7]
    f = funnel(scored, config).first()
    assert (f["fetched"], f["deduplicated"], f["out_of_domain"], f["suppressed"], f["below_threshold"], f["published"], f["pinned"]) == (9, 8, 2, 1, 1, 2, 1)


def test_selection_ignores_partitioning_and_input_order(spark):
    config = SelectConfig(minimum_score=0.0, max_items_per_source=2, report_limit=4)
    base = records(spark, scan_rows())
    runs = []
    for n, rows in ((1, base), (7, base.orderBy(F.desc("position")).repartition(7))):
        scored = score_table(merge_duplicates(rows.repartition(n)), RULES, now())
        runs.append([(r["position"], r["total_score"]) for r in select_records(scored, config).collect()])
    assert runs[0] == runs[1]
