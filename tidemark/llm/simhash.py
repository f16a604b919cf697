"""SimHash fingerprints, and the groups of fingerprints that differ in few bits.

Two fingerprints within ``BITS`` bits differ in at most ``BITS`` of their 8 bytes, so they share at least 8 - BITS
positional bytes: the least number of matches that the inverted index of (position, byte) has to count for a pair.
Posting lists of single bytes hold 1/256 of all fingerprints each, so counting over them as a whole grows with the
square of the table. The index is therefore cut into shards: a family of position subsets, chosen so that any
8 - BITS positions contain one of them, keys a fingerprint by its bytes at each subset. A pair that reaches the
least number of matches meets in a shard at least once, and in a shard its matches at the other positions are
counted from the postings there. Pairs that reach the count are verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import broadcast_if_small, stored
from .common import map_texts, quoted, spaced_words
from .components import smallest_reachable

SHINGLE, SEED, BITS = 4, 42, 4
MATCHES = 8 - BITS
#: Distinct fingerprints from which keys take four bytes instead of three: 2^24 shards then hold many each.
FOUR_BYTES_FROM = 1 << 27
#: Fingerprints of one shard that one task compares; larger shards are compared block by block.
SHARD_BLOCK = 1 << 14
#: Entries, 16 bytes each, that may be broadcast.
BROADCAST_ROWS = 250_000
#: Shingles hashed at a time.
_STEP = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """Bits set in over half of the hashes of all word shingles, repeats included; no words give zero."""
    words = spaced_words(text)
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - SHINGLE + 1].tolist()
    ends = ends[SHINGLE - 1 :].tolist()
    total = np.zeros(64, np.int64)
    for i in range(0, len(ends), _STEP):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[i : i + _STEP], ends[i : i + _STEP])], np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(ends), bitorder="little").view(np.uint64)[0])


def position_subsets(width: int) -> list[tuple[int, ...]]:
    """Subsets of ``width`` byte positions of which any ``MATCHES`` positions contain one.

    With as many positions as matches these are all subsets. With one less, positions are dealt to three groups in
    a ring: the subsets lie in one group, or have one position in a group and the others in the group before it.
    """
    every = list(combinations(range(8), width))
    if width >= MATCHES:
        return every
    if width != 3:
        raise ValueError("keys take three or four positions")
    ring = {(a, a, a) for a in range(3)} | {tuple(sorted((a, a, (a + 1) % 3))) for a in range(3)}
    return [s for s in every if tuple(sorted(p % 3 for p in s)) in ring]


def _close(values: np.ndarray, one: np.ndarray | np.uint64) -> np.ndarray:
    """Whether values share enough positional bytes with ``one`` and, where they do, differ in few enough bits."""
    apart = values ^ one
    shared = (apart[:, None].view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    close = shared >= MATCHES
    close[close] = np.bitwise_count(apart[close]) <= BITS
    return close


class Shard:
    """Fingerprints of one shard with the postings of their positional bytes."""

    def __init__(self, values: np.ndarray, positions: tuple[int, ...]):
        self.values, self.free = values, [p for p in range(8) if p not in positions]
        self.need = MATCHES - len(positions)
        self.bytes = values.view(np.uint8).reshape(-1, 8)
        self.order = {p: np.argsort(self.bytes[:, p], kind="stable") for p in self.free}
        self.starts = {p: np.searchsorted(self.bytes[self.order[p], p], np.arange(257)) for p in self.free}

    def partners(self, i: int, left: np.ndarray) -> np.ndarray:
        """Members marked in ``left`` that are within the bound of member ``i``."""
        if self.need <= 0:
            found = np.flatnonzero(left)
        else:
            postings = []
            for p in self.free:
                b = int(self.bytes[i, p])
                postings.append(self.order[p][self.starts[p][b] : self.starts[p][b + 1]])
            met = np.concatenate(postings)
            if self.need == 1 and len(met) < len(left) // 8:
                found = np.unique(met[left[met]])
            else:
                found = np.flatnonzero(left & (np.bincount(met, minlength=len(left)) >= self.need))
        return found[np.bitwise_count(self.values[found] ^ self.values[i]) <= BITS]

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """Links that connect all members which pairs within the bound connect: at most one less than members."""
        left, a, b = np.ones(len(self.values), bool), [], []
        for seed in range(len(self.values)):
            if not left[seed]:
                continue
            left[seed] = False
            todo = [seed]
            while todo:
                i = todo.pop()
                found = self.partners(i, left)
                left[found] = False
                todo += found.tolist()
                a.append(np.full(len(found), self.values[i]))
                b.append(self.values[found])
        return (np.concatenate(a), np.concatenate(b)) if a else (self.values[:0], self.values[:0])


def _shards(prints: DataFrame, subsets: list[tuple[int, ...]]) -> DataFrame:
    """(key, print) of every fingerprint at every subset of positions; ``prints`` has distinct values."""
    masks = [sum(0xFF << 8 * p for p in s) for s in subsets]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    keyed = [F.struct(F.lit(k).cast("short").alias("subset"), F.col("print").bitwiseAND(F.lit(signed(m)).cast("long")).alias("key")) for k, m in enumerate(masks)]
    return prints.select("print", F.inline(F.array(*keyed)))


def _links_of_groups(ordered: DataFrame, keys: list[str], subsets: list[tuple[int, ...]]) -> DataFrame:
    """Links (a, b) between members of the same group; rows lie sorted by ``keys``, the first being the subset."""

    def groups(table: pa.Table, starts: np.ndarray, a: list, b: list) -> None:
        """Links of whole groups, which begin at ``starts``; the last entry is the end."""
        prints = table.column("print").to_numpy().view(np.uint64)[: starts[-1]]
        sizes = np.diff(starts)
        # Members close to the first of their group; a group that all are close to is settled.
        first = np.repeat(starts[:-1], sizes)
        close = _close(prints, prints[first]) & (np.arange(len(prints)) != first)
        a.append(prints[first][close])
        b.append(prints[close])
        missed = sizes - 1 - np.add.reduceat(close.astype(np.int64), starts[:-1])
        subset = table.column("subset").to_numpy()
        for g in np.flatnonzero((missed > 0) & (sizes > 2)):
            members = np.unique(prints[starts[g] : starts[g + 1]])
            for found, out in zip(Shard(members, subsets[subset[starts[g]]]).forest(), (a, b)):
                out.append(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts)
            size = table.num_rows
            change = np.zeros(size, bool)
            for k in keys:
                c = table.column(k).to_numpy()
                change[1:] |= c[1:] != c[:-1]
            a, b = [], []
            groups(table, np.concatenate(([0], np.flatnonzero(change), [size])), a, b)
            x, y = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            # The last group of a batch may go on in the next one.
            columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
            inner = np.logical_or.reduce([c != c[-1] for c in columns])
            tail = int(np.flatnonzero(inner)[-1]) + 1 if inner.any() else 0
            if held and last != [c[0] for c in columns]:
                yield flush(held)
                held = []
            if tail:
                yield flush([*held, batch.slice(0, tail)])
                held = []
            held.append(batch.slice(tail))
            last = [c[-1] for c in columns]
        if held:
            yield flush(held)

    return ordered.mapInArrow(run, "a long, b long")


def links(prints: DataFrame, width: int = 3, block: int = SHARD_BLOCK) -> DataFrame:
    """Links (a, b) that connect all fingerprints of ``prints`` (print, distinct) within the bound.

    Not every pair is listed, but each is connected. Shards of more than ``block`` members are cut into blocks by a
    hash, and every two blocks of a shard are one group, so no task holds more than two blocks.
    """
    subsets = position_subsets(width)
    shards = stored(_shards(prints, subsets).repartition("subset", "key").sortWithinPartitions("subset", "key"), "shards")
    sizes = shards.groupBy("subset", "key").agg(F.count("*").alias("members")).where("members > 1")
    large = stored(sizes.where(F.col("members") > block).select("subset", "key", F.ceil(2 * F.col("members") / block).cast("int").alias("blocks")), "large")
    if large.isEmpty():
        return stored(_links_of_groups(shards, ["subset", "key"], subsets), "links")
    placed = shards.join(broadcast_if_small(large, BROADCAST_ROWS), ["subset", "key"], "left")
    plain = placed.where("blocks IS NULL").select("subset", "key", "print").repartition("subset", "key").sortWithinPartitions("subset", "key")
    own = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")
    dealt = placed.where("blocks IS NOT NULL").withColumn("own", own).select("subset", "key", "print", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    names = ["subset", "key", "low", "high"]
    dealt = dealt.select("subset", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "print")
    dealt = dealt.repartition(*names).sortWithinPartitions(*names)
    return stored(_links_of_groups(plain, ["subset", "key"], subsets).unionByName(_links_of_groups(dealt, names, subsets)), "links")


def simhash_groups(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int | None = None, block: int = SHARD_BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    ``component_id`` is the smallest id that links reach, the row's own included; equal fingerprints are linked.
    NULL and empty texts and those of white space have the fingerprint zero. Links hold between texts: rows that repeat
    an id with other texts may lie in several components. A row without an id gets the component of its fingerprint, or
    NULL when no row there has an id. Ids are whole numbers; other columns are not read.
    """
    marked = map_texts(documents.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), F.col(quoted(text)).alias("text")), "text", "print long", _prints, ["doc_id"])
    rows = stored(marked, "prints")
    classes = stored(rows.groupBy("print").agg(F.min("doc_id").alias("id")), "classes")
    if width is None:
        width = 3 if classes.count() < FOUR_BYTES_FROM else 4
    roots = smallest_reachable(links(classes.select("print"), width, block))
    joined = classes.join(roots.withColumnRenamed("id", "print"), "print", "left").select("print", "id", F.coalesce("component", "print").alias("component"))
    joined = stored(joined, "joined")
    least = stored(joined.groupBy("component").agg(F.min("id").alias("component_id")), "least")
    by_print = stored(joined.join(least, "component").select("print", "component_id"), "components")
    return rows.join(broadcast_if_small(by_print, BROADCAST_ROWS), "print", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )


def _prints():
    def work(batch: list[bytes | None]) -> list:
        return [np.array([fingerprint(t) for t in batch], np.uint64).view(np.int64)]

    return work
