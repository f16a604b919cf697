"""Extra columns that bear the names operators use inside come back as they were."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard, licenses, packing, quality, sharding, toxicity

PROSE = "the quick brown fox jumps over the lazy dog and runs away from it all again"
ROWS = [(1, PROSE), (2, PROSE + " once more"), (3, None), (4, ""), (None, "mit license"), (1, PROSE)]
NAMES = {
    "shard": ["h", "depth", "prefix", "cell", "above", "below", "n", "bytes", "least"],
    "quality": ["_t", "_words", "_lines", "_packed", "_twins", "_starts", "_kept_0", "col"],
    "decontaminate": ["_text", "_number", "item", "start", "end", "_kept_0"],
    "licenses": ["_text", "_kept_0", "text_", "start"],
    "keys": ["_text", "t", "n", "shared", "own"],
}


def made(spark, names):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df, df.withColumns({n: F.lit(f"mine {n}") for n in names})


OPERATORS = {
    "shard": lambda df: sharding.shard(df, "doc_id", "text", 100),
    "quality": quality.apply_rules,
    "licenses": licenses.scan_licenses,
    "keys": lambda df: jaccard.set_keys(df, "text", "made"),
}


def held(df, names, clashing):
    rows = df.collect()
    assert all(r[n] == f"mine {n}" for r in rows for n in names if n in r) if clashing else True
    return sorted((str([r[c] for c in sorted(set(df.columns) - set(names))]) for r in rows))


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_keep_columns_of_their_inner_names(spark, name):
    df, more = made(spark, NAMES[name])
    got = OPERATORS[name](more)
    assert set(NAMES[name]) <= set(got.columns)
    assert held(got, NAMES[name], True) == held(OPERATORS[name](df), NAMES[name], False)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_decontamination_keeps_them_in_one_pass_and_in_blocks(spark, block):
    df, more = made(spark, NAMES["decontaminate"])
    bench = spark.createDataFrame([("q1", "brown fox jumps over the lazy dog and runs away"), ("q2", "mit license"), ("q3", None)], "item_id string, text string")
    run = lambda d: decontaminate.decontaminate(d, bench, block_bytes=block)
    got = run(more)
    assert set(NAMES["decontaminate"]) <= set(got.columns)
    assert held(got, NAMES["decontaminate"], True) == held(run(df), NAMES["decontaminate"], False)
    assert sum(r.n_hit > 0 for r in got.collect()) == 4


def test_packing_and_groups_do_not_read_other_columns(spark):
    df, more = made(spark, ["start", "length", "doc_tokens", "offset", "n", "key", "id", "token", "t", "shared", "grp"])
    pack = lambda d: sorted((r.doc_id or 0, r.start, r.length, r.ids_crc32) for r in packing.pack(d, public_tokenizers.path("word_bpe_49k.json")).collect())
    assert pack(more) == pack(df)
    groups = lambda d: sorted(map(str, jaccard.similar_groups(d).collect()))
    assert groups(more) == groups(df)


def test_texts_of_several_megabytes(spark):
    long = "Lorem ipsum dolor sit amet mit license " * 80_000
    df = spark.createDataFrame([(1, long), (2, "short"), (3, "x" * 3_000_000)], "doc_id long, text string")
    assert {r.doc_id: r.row_bytes for r in sharding.shard(df, "doc_id", "text", 1 << 20).collect()} == {1: len(long), 2: 5, 3: 3_000_000}
    pieces = packing.pack(df, public_tokenizers.path("word_bpe_49k.json")).collect()
    total = {r.doc_id: r.doc_tokens for r in pieces}
    assert all(sum(r.length for r in pieces if r.doc_id == d) == n for d, n in total.items()) and max(r.length for r in pieces) == 2048
