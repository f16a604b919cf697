"""SimHash fingerprints and groups against all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import queries, simhash

from . import brute
from .test_corpus_queries import SF


def plain_print(text):
    words = brute.spaced(text)
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """Component of each of distinct fingerprints, as the smallest index in a list of them."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(prints))]


def expected(rows):
    prints = {}
    for i, t in rows:
        prints.setdefault(plain_print(t), []).append(i)
    values = list(prints)
    least = {}
    group = plain_groups(values)
    for v, g in zip(values, group):
        ids = [i for i in prints[v] if i is not None]
        least[g] = min([*ids, *([least[g]] if least.get(g) is not None else [])], default=None)
    where = {v: least[g] for v, g in zip(values, group)}
    return sorted(((i, f"{plain_print(t):016x}", where[plain_print(t)]) for i, t in rows), key=str)


def collected(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize("width", [3, 4])
def test_subsets_meet_every_set_of_matches(width):
    family = simhash.position_subsets(width)
    assert len(family) == {3: 20, 4: 70}[width]
    for four in combinations(range(8), 4):
        assert any(set(s) <= set(four) for s in family)


def near(seed, centres, each, bits):
    rng, out = random.Random(seed), set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(each):
            x = c
            for b in rng.sample(range(64), rng.randrange(bits)):
                x ^= 1 << b
            out.add(x)
    return list(out)


@pytest.mark.parametrize("width, block, values", [(3, 1 << 14, near(1, 60, 6, 9)), (4, 1 << 14, near(2, 40, 8, 10)), (3, 16, near(3, 3, 120, 12)), (3, 1 << 14, near(4, 2, 200, 14))])
def test_links_connect_what_all_pairs_connect(spark, width, block, values):
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "print long"), width, block).collect()
    parent = {x: x for x in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 4
        parent[root(r.a)] = root(r.b)
    group = plain_groups(values)
    for i, j in combinations(range(len(values)), 2):
        assert (group[i] == group[j]) == (root(signed[i]) == root(signed[j]))
    assert 1 < len(set(group)) < len(group)


def test_rows_of_all_kinds(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(99)}" for _ in range(400)]
    rows = [(900, None), (901, ""), (902, " \n\t"), (903, "Ab"), (904, "aB"), (905, "a b c d"), (None, "a b c d"), (None, "alone here"), (905, "é x"), (905, "a b c d")]
    for i in range(40):
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(400)] = f"v{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("print", "component", "component_id", "fingerprint", "key", "subset", "_text")})
    assert collected(simhash.simhash_groups(df)) == expected(rows)
    assert collected(simhash.simhash_groups(df.select("doc_id", "text"), block=8)) == expected(rows)
    assert simhash.simhash_groups(df.where("false")).count() == 0


def test_long_texts():
    rng = random.Random(6)
    text = " ".join(f"W{rng.randrange(50_000)}" for _ in range(150_000))
    assert simhash.fingerprint(text.encode()) == plain_print(text)


def test_query_equals_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]
    assert collected(queries.op11_simhash_groups(spark, SF)) == expected(rows)
