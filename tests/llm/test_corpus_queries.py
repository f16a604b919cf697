"""The registered corpus queries over the smallest tables, and the pipeline step by step."""

import os
import zlib

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import queries, sharding

from . import brute

SF = os.environ.get("TIDEMARK_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {name} AS FROM '{SF}/{name}.parquet'")
    return con


def fetched(con, sql):
    return con.sql(sql).fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, tables, name):
    got, want = queries.QUERIES[name](spark, SF), tables.sql(queries.ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = sorted(tuple(r[c] for c in names) for r in got.collect())
    at = [want.columns.index(c) for c in names]
    assert rows == sorted(tuple(r[i] for i in at) for r in want.fetchall())


@pytest.mark.parametrize("limit", [1000, 40_000])
def test_shards_equal_sql(spark, tables, limit):
    docs = queries.table(spark, SF, "documents").select("doc_id", "text")
    got = sorted((r.doc_id, r.shard, r.shard_bytes, r.shard_rows, r.oversized) for r in sharding.shard(docs, "doc_id", "text", limit).collect())
    want = sorted(fetched(tables, f"SELECT doc_id, shard, shard_bytes, shard_rows, oversized FROM ({sharding.oracle(limit)})"))
    assert got == want and len({r[1] for r in got}) > 3


def test_contamination_query(spark, tables):
    items = fetched(tables, "SELECT item_id, text FROM benchmark")
    texts = dict(fetched(tables, "SELECT doc_id, text FROM documents"))
    rows = queries.op7_decontaminate(spark, SF).collect()
    assert len(rows) == len(texts) and any(r.contaminated for r in rows)
    joined = {i: " " + " ".join(brute.folded(t)) + " " for i, t in texts.items()}
    windows = {i: [" " + " ".join(w[k : k + 10]) + " " for k in range(max(1, len(w) - 9))] for i, t in items if (w := brute.folded(t))}
    for r in rows:
        assert r.n_items == sum(any(x in joined[r.doc_id] for x in w) for w in windows.values())
        assert r.contaminated == (r.n_hit > 0) == (r.n_items > 0)


def test_other_queries_cover_their_tables(spark, tables):
    docs, pages = (fetched(tables, f"SELECT count(*) FROM {t}")[0][0] for t in ("documents", "pages"))
    for name, n in (("op2_license_scan", docs), ("op4_token_counts", docs), ("op5_html_text", pages), ("op9_warc_round_trip", pages)):
        assert queries.QUERIES[name](spark, SF).count() == n


def test_held_out_rows_are_marked(spark):
    for r in queries.op10_toxicity(spark, SF).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3)


def test_pipeline_equals_plain_steps(spark, tables):
    documents = queries.table(spark, SF, "documents")
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, SF)
        assert docs.columns == documents.columns
        seen[name] = before, {r.doc_id for r in docs.collect()}
    before, after = seen["toxicity"]
    scores = {r.doc_id: r.score for r in queries.op10_toxicity(spark, SF).collect()}
    assert after == {i for i in before if scores[i] < queries.TOXIC_FROM}
    before, after = seen["n-gram Jaccard join"]
    assert after == {i for i, (_, c) in brute.groups(list(before.items())).items() if c == i}
    before, after = seen["benchmark decontamination"]
    items = fetched(tables, "SELECT item_id, text FROM benchmark")
    runs = [" " + " ".join(w[k : k + 10]) + " " for _, t in items if (w := brute.folded(t)) for k in range(max(1, len(w) - 9))]
    text = {i: " " + " ".join(brute.folded(t)) + " " for i, t in before.items()}
    assert after == {i for i in before if not any(x in text[i] for x in runs)}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = corpus_pipeline.run(spark, SF).collect()
    sizes = {i: len(tokenizer.encode(before[i], add_special_tokens=False).ids) + 1 for i in after}
    assert {r.doc_id: r.doc_tokens for r in rows} == sizes and sum(r.length for r in rows) == sum(sizes.values())


def test_quality_stage_keeps_what_the_sql_keeps(spark, tables):
    docs = queries.table(spark, SF, "documents")
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_low_quality(spark, docs, SF).collect())
    want = fetched(tables, f"SELECT doc_id FROM ({queries.ORACLES['op6_quality_rules']}) WHERE kept ORDER BY doc_id")
    assert kept == [i for i, in want] and 0 < len(kept) < docs.count()


def test_one_text_of_each_group_stays(spark):
    words = [[f"{c}{i}" for i in range(40)] for c in "abc"]
    a, b, c = (" ".join(w) for w in words)
    near_a, near_b = (" ".join(w[:-1] + ["other"]) for w in words[:2])
    rows = [(5, a, 1), (5, b, 2), (6, near_a, 3), (7, near_b, 4), (7, "", 11), (5, a, 5), (8, c, 6), (8, None, 7), (8, " ", 8), (None, a, 9), (4, near_a + " more", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, grp int")
    kept = sorted((r.doc_id or 0, r.text or "", r.grp) for r in corpus_pipeline.drop_near_copies(spark, df, SF).collect())
    assert kept == [(0, a, 9), (4, near_a + " more", 10), (5, b, 2), (7, "", 11), (8, "", 7), (8, " ", 8), (8, c, 6)]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, name, stage):
    from pyspark.sql import functions as F

    prose = "the quick brown fox and the lazy dog " + " ".join(f"word{i}" for i in range(60))
    rows = [(1, prose, "en", "a", 9), (1, prose, "en", "a", 9), (2, None, None, None, None), (None, prose + " more", "en", "a", 9), (3, "", "", "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").withColumns({"score": F.lit(1), "n_hit": F.lit(2), "kept": F.lit("x"), "_text": F.lit(3)})
    out = stage(spark, df, SF)
    assert out.count() <= (len(rows) if name != "packing" else 10)
    if name != "packing":
        assert out.columns == df.columns
    assert stage(spark, df.where("false"), SF).count() == 0
