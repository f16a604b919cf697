"""Alignment of two tokenizers against plain loops over all token pairs."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import alignment, queries

from .test_corpus_queries import SF

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def byte_table():
    """The usual table from bytes to printable characters."""
    keep = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    extra = [b for b in range(256) if b not in keep]
    return {chr(c): b for c, b in zip(keep + [256 + i for i in range(len(extra))], keep + extra)}


def plain(rows):
    model = Tokenizer.from_file(A)
    model.encode_special_tokens = True
    pieces, table = sentencepiece.SentencePieceProcessor(model_file=B), byte_table()

    def groups(text):
        if not text:
            return []
        a, b = model.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
        of_a = [bytes(table[c] for c in model.id_to_token(i)) for i in a]
        of_b = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
            return []
        out, x, y, at_a, at_b = [([], [])], 0, 0, 0, 0
        while x < len(a) or y < len(b):
            if at_a <= at_b:
                out[-1][0].append(a[x])
                at_a, x = at_a + len(of_a[x]), x + 1
            else:
                out[-1][1].append(b[y])
                at_b, y = at_b + len(of_b[y]), y + 1
            if at_a == at_b:
                out.append(([], []))
        return out[:-1]

    cut = [groups(t) for _, t in rows]
    links = [[(i, j) for x, y in g for i in x for j in y] for g in cut]
    count = Counter(p for found in links for p in set(found))
    most = Counter()
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    out = []
    for (doc, _), g, found in zip(rows, cut, links):
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((
            doc, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(found), sum(count[p] == most[p[0]] for p in found),
            sum(count[p] for p in found), hashlib.sha256(told.encode()).hexdigest() if g else "",
        ))
    return sorted(out, key=str)


def collected(df):
    assert df.columns == NAMES
    return sorted((tuple(r) for r in df.collect()), key=str)


def aligned(df, **kw):
    return alignment.align(df, A, public_tokenizers.PATTERN, B, **kw)


ODD = [
    None, "", " ", "  two  spaces ", "a▁b", "<|endoftext|> and <s> </s> <0x0A> <unk>", "tab\tand\r\nline\n\n", "nul\x00byte", "été naïve ﬁne ½²",
    "日本語のテキスト", "é😀👩‍👩‍👧", " nbsp　wide", "don't WE'LL 'tis 12345 3.14", "x" * 3000, "한국어 " * 40, "the same text", "the same text", "the same text", "...!!!???", "﻿mark",
]


def test_odd_texts_equal_plain_loops(spark):
    rng = random.Random(3)
    words = ["the", "The", "straße", "naïve", "token", "tokenizer", "12", "(x)", "\n", "été", "—", "ab"]
    rows = list(enumerate(ODD)) + [(None, "no id"), (5, "again"), (5, "again")]
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ["key", "chunk", "pair", "n", "copies", *NAMES[1:]]})
    assert collected(aligned(df)) == plain(rows)
    # Chunks of a few texts give the same answers.
    assert collected(aligned(df.select("doc_id", "text").repartition(3), chunk_bytes=200)) == plain(rows)
    assert aligned(df.where("false")).count() == 0


def test_long_groups_are_counted_by_distinct_ids():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 500), rng.integers(0, 7, 700)
    group_a, group_b = np.sort(rng.integers(0, 5, 500)), np.sort(rng.integers(0, 5, 700))
    want = alignment.linked_pairs(a, b, group_a, group_b, 5)
    for listed in (0, 10_000, 15_000):
        for x, y in zip(alignment.linked_pairs(a, b, group_a, group_b, 5, listed), want):
            assert x.tolist() == y.tolist()
    pairs = Counter((int(x), int(y)) for g in range(5) for x in a[group_a == g] for y in b[group_b == g])
    assert {(int(p) >> 32, int(p) & 0xFFFFFFFF): int(n) for p, n in zip(*want)} == pairs


def test_a_text_of_several_megabytes(spark):
    rows = [(1, "Die Bank and the été 12 " * 100_000), (2, "the é")]
    assert collected(aligned(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


def test_query_equals_plain_loops(spark):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]
    assert collected(queries.op12_token_alignment(spark, SF)) == plain(rows)
