"""Licence scans, decontamination and quality rules against plain versions."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, decontaminate, licenses, quality, tokens
from tidemark.llm.common import folded_word_spans, folded_words

from . import brute

ODD = [None, "", " \t\n", "ß É x", "A\x0bB\x0cC", "*** ### |", "a b c a b c a b c " * 400, "one", "\n\n", "İ ﬁ Σς", "x" * 50_000]


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def texts(seed, n, vocabulary, most=60):
    rng = random.Random(seed)
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(most))) for _ in range(n)]


def test_word_spans_point_into_the_original():
    text = "Äb, C--d\n é!"
    starts, ends = folded_word_spans(text.encode())
    assert [text[a:b] for a, b in zip(starts, ends)] == ["Äb", "C", "d", "é"]
    assert [w.decode() for w in folded_words(text.encode())] == ["Äb", "c", "d", "é"]


def test_phrases_equal_brute_force(spark):
    words = "GNU general Public license, apache cc by mit (BY) nc sa".split() + ["LICENSE.", "x"]
    rows = list(enumerate(ODD + texts(1, 120, words)))
    every = licenses.BASE_PHRASES | licenses.NOTICE_PHRASES
    for r in licenses.scan_licenses(table(spark, rows)).collect():
        n, starts, base = brute.phrases(r.text, licenses.BASE_PHRASES)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(starts), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == base and r.labels == brute.phrases(r.text, every)[2]
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


@pytest.mark.parametrize(
    ("line", "postfix", "usable"),
    [
        ("MIT", "mit", True),
        ("GPL-2.0-only OR MIT", "gpl-2.0-only mit or", True),
        ("GPL-2.0-only AND MIT OR Apache-2.0", "gpl-2.0-only mit and apache-2.0 or", True),
        ("GPL-2.0-only AND (MIT OR Apache-2.0)", "gpl-2.0-only mit apache-2.0 or and", False),
        ("GPL-2.0-only WITH Classpath-exception-2.0 AND MIT", "gpl-2.0-only classpath-exception-2.0 with mit and", True),
        ("MIT */ int x", "mit", True),
        ("MIT OR", "mit", True),
        ("(MIT", "", False),
        ("AND MIT", "", False),
        ("", "", False),
    ],
)
def test_shunting_yard(line, postfix, usable):
    found, written = licenses.parse_expression(line)
    assert " ".join(found) == postfix and line.startswith(written)
    assert licenses.evaluate(found) == usable


def test_tags_in_texts(spark):
    rows = [
        (1, "# SPDX-License-Identifier: MIT OR GPL-2.0-only\ncode"), (2, "SPDX-License-Identifier: GPL-3.0-only\nSPDX-License-Identifier : MIT"),
        (3, "SPDX-License-Identifier without one"), (3, "SPDX-License-Identifier: (MIT"),
    ]
    out = licenses.scan_licenses(table(spark, rows)).orderBy("doc_id").collect()
    assert [(r.expressions, r.permitted) for r in out] == [(["MIT OR GPL-2.0-only"], True), (["GPL-3.0-only", "MIT"], False), ([], None), ([], None)]
    assert out[0].labels == ["gpl-2.0-only", "mit"]


def test_decontamination_equals_brute_force(spark):
    vocabulary = ["a", "B", "c", "Ä"]
    items = [(i, t) for i, t in enumerate(texts(2, 12, vocabulary, 14))] + [(50, None), (51, ""), (None, "c c c a a a b b b c"), (52, "A! a")]
    rows = list(enumerate(ODD + texts(3, 80, vocabulary, 80)))
    bench = table(spark, items, "item_id long, text string")
    whole = decontaminate.decontaminate(table(spark, rows), bench).collect()
    for r in whole:
        assert (r.n_words, r.n_hit, r["items"]) == brute.hits(r.text, items)
        inside = "".join(f" {r.text[a:b]} " for a, b in r.spans)
        assert len(brute.folded(inside)) == r.n_hit
    blocks = decontaminate.decontaminate(table(spark, rows), bench, block_bytes=60).collect()
    assert sorted(map(str, blocks)) == sorted(map(str, whole))


def test_blocks_are_scanned_one_at_a_time(spark, monkeypatch):
    items = [(i, t) for i, t in enumerate(texts(2, 12, ["a", "B", "c"], 14))]
    bench = table(spark, items + [(99, "a b c a b c")] * 300, "item_id long, text string")
    df = table(spark, list(enumerate(texts(3, 30, ["a", "B", "c"], 80))) + [(3, "a b c a b c")] * 2).withColumns({"odd col": F.lit(1)})
    whole, sizes, scan = decontaminate.decontaminate(df, bench).collect(), [], decontaminate._scan
    monkeypatch.setattr(decontaminate, "_scan", lambda rows, items, *a: sizes.append(len(items)) or scan(rows, items, *a))
    out = decontaminate.decontaminate(df, bench, block_bytes=60)
    assert len(sizes) > 3 and max(sizes) <= 13  # copies of an item count once
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(str, out.collect())) == sorted(map(str, whole))


def test_decontamination_without_items_or_rows(spark):
    bench = table(spark, [], "item_id long, text string")
    out = decontaminate.decontaminate(table(spark, [(1, "a b")]), bench).collect()
    assert [(r.n_words, r.n_hit, r["items"], r.spans) for r in out] == [(2, 0, [], [])]
    assert decontaminate.decontaminate(table(spark, []), bench).count() == 0


def test_quality_measures_equal_brute_force(spark):
    rows = list(enumerate(ODD + texts(4, 80, ["a", "b", "the", "c|", "d\n", "\n"], 90)))
    for r in quality.apply_rules(table(spark, rows)).withColumnRenamed("text", "t").join(table(spark, rows), "doc_id").collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.quality(r.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and not r.failed_rules)


def test_pairs_path_gives_the_same_windows(spark, monkeypatch):
    rows = list(enumerate(texts(5, 30, ["a", "b", "c"], 60)))
    monkeypatch.setattr(quality, "_POSITION_BITS", 3)  # most texts are longer than 8 words
    for r in quality.measure(table(spark, rows).withColumn("t", F.col("text")), "t").collect():
        assert r.n_repeat_words == brute.quality(r.text)[4]


def test_quality_keeps_prose_and_drops_junk(spark):
    rng = random.Random(6)
    prose = " ".join(rng.choice(["the", "of", "and"] + [f"word{i}" for i in range(400)] * 1) if i % 6 else "the" for i in range(120))
    rows = [(1, prose), (2, " ".join(w + "***" for w in prose.split())), (3, "word " * 80), (4, prose.replace("the", "zzz").replace("of", "yyy").replace("and", "q"))]
    kept = {r.doc_id: r.kept for r in quality.apply_rules(table(spark, rows)).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False}


@pytest.mark.parametrize("run", [
    lambda df: licenses.scan_licenses(df), lambda df: quality.apply_rules(df),
    lambda df: decontaminate.decontaminate(df, df.select(F.col("doc_id").alias("item_id"), "text")),
])
def test_clashing_columns_repeated_rows_and_empty_tables(spark, run):
    df = table(spark, [(1, "the MIT License")] * 2).withColumns({"N_Words": F.lit("x"), "labels": F.lit(1), "items": F.lit(2), "kept": F.lit(3), "extra col": F.lit(4)})
    out = run(df)
    assert "n_words" in out.columns and "N_Words" not in out.columns and "extra col" in out.columns
    assert [r.n_words for r in out.collect()] == [3, 3]
    assert run(df.where("false")).count() == 0


def test_kept_texts_travel_once_and_in_slices(spark):
    long = "a word " * 200_000
    df = spark.createDataFrame([(i, long if i % 2 else None) for i in range(8)], "doc_id long, text string").coalesce(1)
    sizes = lambda: lambda batch: [[len(batch)] * len(batch)]
    got = common.map_texts(df, "text", "beside int", sizes, keep=["text", "doc_id"])
    assert got.columns == ["text", "doc_id", "beside"]
    rows = got.collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [(i, long if i % 2 else None) for i in range(8)]
    # 5.6 MB of text are two slices, and the task reads the text in one column.
    assert {r.beside for r in rows} == {4}
    read = got._jdf.queryExecution().optimizedPlan().children().head().children().head().output().toString()
    assert read.count("text#") == 1


def test_tokenizers_go_when_another_operator_runs():
    first = tokens.chunked_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert tokens.chunked_tokenizer(public_tokenizers.path("word_bpe_49k.json")) is first
    tokens.release()
    assert tokens.chunked_tokenizer(public_tokenizers.path("word_bpe_49k.json")) is not first
