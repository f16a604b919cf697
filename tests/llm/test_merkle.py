"""Merkle manifests against plain recursion."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


def row_hash(values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain(nodes):
    """(root, siblings of every leaf, level by level) of digests in order."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for leaf, i in enumerate(at):
            run = runs[i // 16]
            paths[leaf].append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        at, nodes = [i // 16 for i in at], [H(*r) for r in runs]
    return nodes[0], paths


def expected(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    below, subroots = {}, []
    for s in sources:
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, row_hash(r)))
        root, paths = plain([row_hash(r) for r in mine])
        below[s] = mine, root, paths
        subroots.append(root)
    root, tops = plain(subroots)
    out = []
    for s, top in zip(sources, tops):
        mine, subroot, paths = below[s]
        out += [(r[0], row_hash(r), subroot, root, p + top) for r, p in zip(mine, paths)]
    return out


def proved(df, keep=("doc_id",)):
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    leaves = df.select(F.col("source").alias("grp"), F.col("doc_id").alias("ord"), merkle.row_digest(values).alias("digest"), F.struct(*keep).alias("row"))
    return merkle.prove(leaves)


def collected(df):
    got = proved(df).withColumns({"proof": merkle.proof_digest("path"), "folded": merkle.fold("path", F.col("leaf"))}).collect()
    assert all(r.folded == r.root for r in got)
    return sorted(((r.row.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in got), key=str)


def wanted(rows):
    return sorted(((i, leaf, sub, root, H(*[x + y for x, y in p])) for i, leaf, sub, root, p in expected(rows)), key=str)


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [300, 1, 16, 33], [1] * 40])
def test_digests_and_proofs_equal_plain_recursion(spark, sizes):
    rng, rows = random.Random(len(sizes)), []
    for s, n in enumerate(sizes):
        rows += [(rng.randrange(10**6), None if s == 1 else f"s{s}é", rng.choice([None, "en"]), rng.choice([None, 5]), f"Text {rng.random()} ñ") for _ in range(n)]
    rng.shuffle(rows)
    assert collected(spark.createDataFrame(rows, SCHEMA).repartition(3)) == wanted(rows)


def test_null_repeated_and_long_rows(spark):
    rows = [(None, None, None, None, None)] * 20 + [(7, "a", "en", 1, "same")] * 35 + [(7, "a", "en", 1, "other"), (8, "a", "", 0, ""), (9, "a", "en", 9, "é" * 2_000_000)]
    assert collected(spark.createDataFrame(rows, SCHEMA)) == wanted(rows)


def test_a_changed_leaf_does_not_verify(spark):
    rows = [(i, f"s{i % 3}", "en", 1, f"T{i}") for i in range(90)]
    got = proved(spark.createDataFrame(rows, SCHEMA)).withColumn("folded", merkle.fold("path", F.lit("0" * 64))).collect()
    assert len(got) == 90 and not any(r.folded == r.root for r in got)


def test_empty_tables_and_clashing_columns(spark):
    names = ["grp", "ord", "digest", "row", "at", "part", "gid", "n", "lo", "hi", "kids", "path", "around", "bucket", "subroot", "root"]
    rows = [(i, "a", "en", 1, f"t{i}") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in names})
    keep = ["doc_id", *names]
    got = proved(df, keep).select("row.*").collect()
    assert sorted(r.doc_id for r in got) == list(range(40)) and all(r.kids == "x" and r.n == "x" for r in got)
    assert proved(df.where("false")).count() == 0
