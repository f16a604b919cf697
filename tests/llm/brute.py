"""Plain versions of the corpus operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def folded(text):
    return FOLDED.findall(fold(text))


def spaced(text):
    return SPACED.findall(fold(text))


def shingle_set(text):
    words = spaced(text)
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def groups(rows):
    """{id: (set size, smallest reachable id)} of (id, text) rows with distinct ids."""
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in sets}


def hits(text, items, window=10):
    """(words, hit words, ids of occurring items)."""
    words = folded(text)
    hit, named = set(), set()
    for item, t in items:
        w = folded(t)
        if not w:
            continue
        for i in range(max(1, len(w) - window + 1)):
            run = w[i : i + window]
            for j in range(len(words) - len(run) + 1):
                if words[j : j + len(run)] == run:
                    hit.update(range(j, j + len(run)))
                    if item is not None:
                        named.add(str(item))
    return len(words), len(hit), sorted(named)


def phrases(text, table):
    """Starts and labels of all places of phrases."""
    words = folded(text)
    found = []
    for phrase, label in table.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), sorted(i for i, _ in found), sorted({x for _, x in found})


def quality(text):
    text = text or ""
    words = SPACED.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def shards(rows, hashes, limit, bits):
    """{row number: shard prefix} by splitting one bucket after another; rows are byte sizes."""
    out, todo = {}, [("", list(range(len(rows))))]
    while todo:
        prefix, members = todo.pop()
        if sum(rows[i] for i in members) <= limit or len({hashes[i] for i in members}) == 1:
            out.update(dict.fromkeys(members, prefix))
            continue
        sides = defaultdict(list)
        for i in members:
            sides[f"{hashes[i]:0{bits}b}"[len(prefix)]].append(i)
        todo += [(prefix + b, m) for b, m in sides.items()]
    return out
