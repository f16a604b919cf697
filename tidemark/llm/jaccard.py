"""N-gram Jaccard self-join by PartEnum signatures, and the groups that its links form.

A document's set holds its distinct word shingles. For each band of set sizes the domain of shingles is cut
into parts, a fifth as many as the band's largest set has shingles, and each part into three pieces. What a set
holds of two pieces of a part is a signature, so a part gives the three subsets of two pieces. Two sets with
100 * |A and B| >= 75 * |A or B| differ in at most (|A| + |B|) / 7 <= |A| / 3 =: k shingles. A part in which they
differ at most once has two pieces in which they don't, and as the parts number more than k / 2, there is such a part.

Signatures of empty pieces would be common to all small sets, and not all others are needed. The first
difference in a part changes at most two of its signatures that hold a shingle, the next ones the third, so
from a set's own parts follows how many of these, ``lost``, k differences can change. A set with more than ``lost``
of them shares one with its partner, even among its lost + 1 rarest ones, because both order signatures alike; a
set with fewer gives all signatures, those of empty pieces too. Nothing at or above the bound is lost.

Links are then found in two steps, neither of which lists the pairs of a bucket:

1. Every set is compared with the one that is most often the smallest of its buckets.
2. Buckets that still hold several groups are compared in full, in blocks of bounded size.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import broadcast_if_small, stored
from .common import map_texts, quoted, spaced_words, text_bytes
from .components import smallest_reachable

SHINGLE = 5
#: A link needs PERCENT * |union| <= 100 * |intersection|; the bounds above are those of 75.
PERCENT = 75
#: Entries, 16 bytes each, of the list of frequent shingles. It only orders signatures: any list, an empty
#: one too, gives the same links.
FREQUENT = 200_000
#: Shingles, 8 bytes each, that a task holds at a time to find the common ones among them.
POOL = 2 << 20
#: Ids, 8 bytes each, that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Shingles of a band's largest set for each part; with fewer than seven, parts outnumber half of the differences.
PART_SHARE = 5
#: Bits of a signature. Signatures that are equal by chance cost a comparison, no more.
TOKEN_BITS = 48
#: Sets in one block of the second step.
BLOCK = 256
#: Sizes in one class of blocks lie within this ratio.
SIZE_STEP = 1.15

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


_CUT, _NEVER = np.uint64(64 - TOKEN_BITS), np.int64(2**62)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than a shingle are one."""
    words = spaced_words(text)
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.array([digest(w) for w in words], np.uint64)
    n = len(hashes) - SHINGLE + 1
    if n < 1:
        return _mix(np.array([(hashes * _ODD[: len(hashes)]).sum(dtype=np.uint64) + np.uint64(len(hashes))], np.uint64))
    total = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        total += hashes[j : j + n] * _ODD[j]
    return np.unique(_mix(total))


def signatures(found: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The signatures that a set needs, rarest first by the counts of its frequent shingles."""
    n = len(found)
    if n < 3:
        # Only an equal set is similar.
        return _mix(found.sum(dtype=np.uint64)[None])[:n] >> _CUT
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        usual = np.where(frequent[at] == found, counts[at], 0)
    else:
        usual = np.zeros(n, np.int64)
    differ, band, mixed = n // 3, _band(n), _mix(found)
    spread = found * np.uint64(0x9FB21C651E98DF25)
    high, low = spread >> np.uint64(32), spread & np.uint64(0xFFFFFFFF)
    out = []
    for b in (band, band + 1) if 4 * n > 3 << band else (band,):
        parts = -(-(1 << b) // PART_SHARE)
        piece = ((high * np.uint64(parts) >> np.uint64(32)) * np.uint64(3) + (low * np.uint64(3) >> np.uint64(32))).astype(np.int64)
        order = np.argsort(piece, kind="stable")
        piece = piece[order]
        first = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
        sums, rare, filled = np.zeros(3 * parts, np.uint64), np.full(3 * parts, _NEVER), np.zeros(3 * parts, bool)
        sums[piece[first]] = np.add.reduceat(mixed[order], first)
        rare[piece[first]] = np.minimum.reduceat(usual[order], first)
        filled[piece[first]] = True
        sums, rare, filled = (x.reshape(parts, 3) for x in (sums, rare, filled))
        # The subset without the first, second and third piece.
        tokens = (sums[:, [1, 0, 0]] + sums[:, [2, 2, 1]]).ravel()
        tokens = _mix(tokens ^ (np.arange(3 * parts, dtype=np.uint64) << np.uint64(8) | np.uint64(b)) * _ODD[0]) >> _CUT
        holds = filled[:, [1, 0, 0]] | filled[:, [2, 2, 1]]
        each, some = holds.sum(axis=1), holds.ravel()
        parts_held, whole = np.count_nonzero(each), np.count_nonzero(each == 3)
        lost = 2 * min(differ, parts_held) + min(max(differ - parts_held, 0), whole)
        if np.count_nonzero(some) > lost:
            rarity = np.minimum(rare[:, [1, 0, 0]], rare[:, [2, 2, 1]]).ravel()[some]
            tokens = tokens[some]
            if rarity.any():
                tokens = tokens[np.lexsort((tokens, rarity))[: lost + 1]]
            else:
                tokens = np.partition(tokens, lost)[: lost + 1]
        out.append(tokens)
    return np.concatenate(out)


def _band(n: int) -> int:
    return max(2, int(n - 1).bit_length())


def sketch(found: np.ndarray) -> bytes:
    """Parities of a set's shingles over 2 to 4 times as many hash values as it has shingles.

    Two sets differ in at least as many shingles as their sketches differ in bits, so a sketch can rule a
    pair out but never wrongly.
    """
    bits = 2 << max(6, _band(len(found)))
    return np.packbits(np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def _folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches as rows of 64-bit words, longer ones folded to ``size`` bytes."""
    rows = []
    for raw in sketches:
        bits = np.frombuffer(raw, np.uint64)
        while bits.nbytes > size:
            half = len(bits) // 2
            bits = bits[:half] ^ bits[half:]
        rows.append(bits)
    return np.array(rows)


def text_sets(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, key, sketch) of every row and, in the same pass, (shingle, n) of shingles common in a batch.

    ``key`` is equal for equal sets. Rows of shingles have a NULL key.
    """
    rows = df.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, marks, seen, pool, held = [], [], [], set(), [], 0
            usual, times = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

            def count_pool() -> None:
                which, n = np.unique(np.concatenate(pool), return_counts=True)
                common = n >= max(3, 0.002 * len(pool))
                usual.append(which[common].view(np.int64))
                times.append(n[common].astype(np.int64))
                pool.clear()

            for raw in text_bytes(batch.column(1)):
                found = shingles(raw)
                key = _set_key(found)
                sizes.append(len(found))
                keys.append(key)
                marks.append(sketch(found) if len(found) else b"")
                if key not in seen and len(found):
                    seen.add(key)
                    pool.append(found)
                    held += len(found)
                if held > POOL:
                    count_pool()
                    held = 0
            if pool:
                count_pool()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(marks, pa.binary()), pa.nulls(len(sizes), pa.int64())],
                names=["doc_id", "n", "key", "sketch", "shingle"],
            )
            which, n = np.concatenate(usual), np.concatenate(times)
            empty = pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(n), batch.column(0).type), pa.array(n), empty, empty, pa.array(which)],
                names=["doc_id", "n", "key", "sketch", "shingle"],
            )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, key binary, sketch binary, shingle long")


def _set_key(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


#: The key of texts without words, which are in no group.
NO_WORDS = _set_key(np.empty(0, np.uint64))


def _key_node(key: bytes) -> int:
    """The node of a class whose smallest id belongs to several texts: Spark's ``xxhash64`` of its key."""
    node = xxhash.xxh64_intdigest(key, 42)
    return node - (1 << 64) if node >> 63 else node


@dataclass(frozen=True)
class Texts:
    """Texts that stand for the classes of equal sets.

    ``rows`` has doc_id, t, shared; the node of a class is its smallest id, or a hash of its set where that id is
    ``shared`` by several classes. ``any_shared`` tells whether there are such ids.
    """

    rows: DataFrame
    any_shared: bool

    def sets_of(self, nodes: DataFrame) -> DataFrame:
        """(id, s) of the nodes in column id; nodes of shared ids may be added."""
        small = broadcast_if_small(nodes.select(F.col("id").alias("doc_id")), BROADCAST_IDS)
        rows = self.rows.where("NOT shared").join(small, "doc_id", "left_semi")
        if self.any_shared:
            rows = rows.unionByName(self.rows.where("shared"))

        def make():
            def work(batch):
                found = [shingles(raw) for raw in batch]
                return [[f.view(np.int64) for f in found], [_key_node(_set_key(f)) for f in found]]

            return work

        sets = map_texts(rows, "t", "s array<long>, own long", make, ["doc_id", "shared"])
        return sets.select(F.when(F.col("shared"), F.col("own")).otherwise(F.col("doc_id")).alias("id"), "s").dropDuplicates(["id"])


def _buckets(tokens: DataFrame) -> DataFrame:
    """(token, hub, id) of tokens that several ids have, the hub being the smallest id.

    Rows are sorted by token, so a task streams through its buckets and holds none of them.
    """
    ordered = tokens.repartition("token").sortWithinPartitions("token", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int, bool] | None = None  # token, its smallest id, whether that row was given
        for batch in batches:
            if not batch.num_rows:
                continue
            token, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            start = np.concatenate(([held is None or token[0] != held[0]], token[1:] != token[:-1]))
            first = np.flatnonzero(start)
            # Rows before the first start go on with the bucket of the last batch.
            group = np.cumsum(start) - 1
            hubs = np.concatenate((ids[first], [held[1] if held else 0]))[group]
            other = ids != hubs
            lead = np.zeros(len(first) + 1, bool)
            np.logical_or.at(lead, group, other)
            # The hub's own row, once its bucket turns out to have another id.
            own = first[np.flatnonzero(lead[:-1])]
            given = [(token[other], hubs[other], ids[other]), (token[own], ids[own], ids[own])]
            if held and lead[-1] and not held[2]:
                given.append(tuple(np.array([x]) for x in (held[0], held[1], held[1])))
            if len(first):
                held = (token[-1], ids[first[-1]], bool(lead[len(first) - 1]))
            elif lead[-1]:
                held = (held[0], held[1], True)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*given)], names=["token", "hub", "id"])

    return ordered.mapInArrow(run, "token long, hub long, id long")


def _possible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) that their sketches and sizes don't rule out."""
    side = lambda x: sketches.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    narrow = broadcast_if_small(pairs, BROADCAST_IDS // 4)
    joined = narrow.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "s_a", "s_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            apart = [
                int(np.bitwise_count(np.bitwise_xor(*_folded([x, y], min(len(x), len(y))))).sum())
                for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())
            ]
            keep = 7 * np.array(apart, np.int64) <= n + m
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: Texts) -> DataFrame:
    """The pairs (a, b) whose sets are similar, by the sets themselves, computed again for their documents."""
    pairs = stored(pairs, "possible")
    ids = stored(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    sets = stored(texts.sets_of(ids), "arrays")
    side = lambda x: sets.select(F.col("id").alias(x), F.col("s").alias(f"s_{x}"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    similar = 100 * both >= PERCENT * (F.size("s_a") + F.size("s_b") - both)
    narrow = broadcast_if_small(pairs, BROADCAST_IDS // 4)
    return stored(narrow.join(side("b"), "b").join(side("a"), "a").where(similar).select("a", "b"), "similar")


def _block_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of two blocks that sketches don't rule out; ``rows`` has pair (of blocks), side, id, label, n, sketch."""

    names = ["side", "id", "label", "n", "sketch"]

    def compare(part: pa.Table, a: list, b: list) -> None:
        side, ids, label, n = (part.column(c).to_numpy() for c in names[:4])
        if label.min() == label.max():
            return
        sketches = part.column("sketch").to_pylist()
        bits = _folded(sketches, min(map(len, sketches)))
        left = np.flatnonzero(side == 0)
        right = left if len(left) == len(side) else np.flatnonzero(side == 1)
        for i in left:
            apart = np.bitwise_count(bits[right] ^ bits[i]).sum(axis=1, dtype=np.int64)
            hit = right[(7 * apart <= n[right] + n[i]) & (label[right] != label[i])]
            a += [ids[i]] * len(hit)
            b += ids[hit].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of a pair of blocks that may go on in the next batch
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                table = pa.Table.from_batches([batch])
                held = table if held is None else pa.concat_tables([held, table])
            if held is None or not held.num_rows:
                continue
            pair = held.column("pair").to_numpy()
            starts = [0, *(np.flatnonzero(pair[1:] != pair[:-1]) + 1).tolist()]
            if batch is None:
                starts.append(held.num_rows)
            a, b = [], []
            for start, end in zip(starts, starts[1:]):
                compare(held.slice(start, end - start), a, b)
            held = held.slice(starts[-1])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    ordered = rows.select("pair", *names).repartition("pair").sortWithinPartitions("pair")
    found = ordered.mapInArrow(run, "a long, b long")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def links(classes: DataFrame, texts: Texts, frequent: DataFrame) -> DataFrame:
    """Links (a, b) that connect all nodes of ``classes`` (id, n, sketch) with similar sets.

    Not every similar pair is listed, but each is connected.
    """
    top = frequent.groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(FREQUENT).toPandas()
    order = np.argsort(top["shingle"].to_numpy(np.int64).view(np.uint64))
    shared = classes.sparkSession.sparkContext.broadcast(
        (top["shingle"].to_numpy(np.int64).view(np.uint64)[order], top["n"].to_numpy(np.int64)[order])
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raws, several = batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist()
            for i in range(0, len(ids), 200):
                sets = [shingles(r) for r in raws[i : i + 200]]
                nodes = [_key_node(_set_key(s)) if many else doc for s, doc, many in zip(sets, ids[i : i + 200], several[i : i + 200])]
                found = [signatures(s, *shared.value) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), [len(f) for f in found]))],
                    names=["token", "id"],
                )

    buckets = stored(_buckets(texts.rows.select("doc_id", "t", "shared").mapInArrow(sign, "token long, id long")), "buckets")
    # Step 1: of the hubs of its buckets, the one that a set meets most often.
    met = buckets.where("hub != id").groupBy("id", "hub").agg(F.count("*").alias("n"))
    best = stored(met.groupBy("id").agg(F.min_by("hub", F.struct((-F.col("n")).alias("n"), "hub")).alias("hub")), "best")
    tested = _possible(best.select(F.col("id").alias("a"), F.col("hub").alias("b")), classes)
    stars = _verified(tested, texts).select(F.col("a").alias("id"), F.col("b").alias("hub"))
    # A label is the hub of a hub at most: sets with one label are connected.
    up = stars.select(F.col("id").alias("hub"), F.col("hub").alias("upper"))
    labels = stored(stars.join(up, "hub", "left").select("id", F.coalesce("upper", "hub").alias("label")), "labels")
    # Step 2: the ids of buckets with several labels, gathered around each bucket's smallest label.
    labelled = buckets.select("token", "id").join(broadcast_if_small(labels, BROADCAST_IDS // 4), "id", "left").select("token", "id", F.coalesce("label", "id").alias("label"))
    around = labelled.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    met = labelled.join(around.select("token", "low"), "token").select("low", "id", "label").distinct()
    met = stored(met, "met")
    crowds = broadcast_if_small(stored(met.groupBy("low").agg(F.count("*").alias("crowd")).where(F.col("crowd") > BLOCK), "crowds"), BROADCAST_IDS // 4)
    # Only a group of more than one block is dealt by size and hash; any other is one block.
    step = F.when(F.col("crowd").isNotNull(), F.floor(F.log(SIZE_STEP, F.col("n")))).otherwise(0).cast("int")
    placed = met.join(classes.select("id", "n"), "id").join(crowds, "low", "left").withColumn("step", step)
    blocks = placed.groupBy("low", "step").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    blocks = broadcast_if_small(stored(blocks, "blocks"), BROADCAST_IDS // 4)
    block = F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int")
    placed = placed.join(blocks, ["low", "step"], "left").withColumn("block", block)
    placed = stored(placed.select("low", "step", "block", "id", "label"), "placed")
    each = placed.groupBy("low", "step", "block").agg(F.min("label").alias("least"), F.max("label").alias("most"))
    x, y = each.alias("x"), each.alias("y")
    pairs = x.join(y, F.expr("x.low = y.low AND y.step BETWEEN x.step AND x.step + 3 AND (x.step < y.step OR x.block <= y.block)"))
    pairs = pairs.where("NOT (x.least = x.most AND y.least = y.most AND x.least = y.least)").select(
        F.xxhash64("x.low", "x.step", "x.block", "y.step", "y.block").alias("pair"),
        F.expr("x.low"), F.expr("array(struct(0 AS side, x.step AS step, x.block AS block), struct(1 AS side, y.step AS step, y.block AS block))").alias("ends"),
        F.expr("x.step = y.step AND x.block = y.block").alias("same"),
    )
    ends = pairs.select("pair", "low", "same", F.inline("ends")).where("side = 0 OR NOT same").drop("same")
    rows = ends.join(placed, ["low", "step", "block"]).join(classes, "id").select("pair", "side", "id", "label", "n", "sketch")
    return stars.select(F.col("id").alias("a"), F.col("hub").alias("b")).unionByName(_verified(_block_pairs(rows), texts))


def grouped_sets(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, key, grp, component_id) of every row: its set's size and key, its group and the group's smallest id.

    Rows without words have no group, and so have rows whose set no row with an id has.
    """
    found = stored(text_sets(documents, doc_id, text), "sets")
    rows = found.where("key IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "n", "key", "sketch")
    least = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    least = stored(least.where("doc_id IS NOT NULL"), "classes")
    named = stored(least.groupBy("doc_id").agg((F.count("*") > 1).alias("shared")), "named")
    any_shared = not named.where("shared").isEmpty()
    small = broadcast_if_small(named, BROADCAST_IDS)
    if any_shared:
        classes = least.join(small, "doc_id").select("key", "doc_id", "n", "sketch", F.when(F.col("shared"), F.xxhash64("key")).otherwise(F.col("doc_id")).alias("id"))
    else:
        classes = least.withColumn("id", F.col("doc_id"))
    texts = documents.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), F.col(quoted(text)).alias("t"))
    texts = Texts(texts.join(small, "doc_id"), any_shared)
    roots = smallest_reachable(links(classes.select("id", "n", "sketch"), texts, found.where("shingle IS NOT NULL").select("shingle", "n")))
    by_key = classes.join(roots, "id", "left").select("key", "doc_id", F.coalesce("component", "id").alias("grp"))
    if any_shared:
        by_key = stored(by_key, "groups")
        by_key = by_key.join(by_key.groupBy("grp").agg(F.min("doc_id").alias("component_id")), "grp").select("key", "grp", "component_id")
    else:
        by_key = by_key.select("key", "grp", F.col("grp").alias("component_id"))
    by_key = stored(by_key, "roots")
    # Most classes are one row; what is joined are narrow rows, and Spark splits the key of a large class.
    grouped = rows.where("n > 0").select("doc_id", "n", "key").join(broadcast_if_small(by_key, BROADCAST_IDS // 4), "key", "left")
    none = F.lit(None).cast("long")
    alone = rows.where("n = 0").select("doc_id", "n", "key", none.alias("grp"), F.col("doc_id").alias("component_id"))
    return grouped.select("doc_id", "n", "key", "grp", "component_id").unionByName(alone)


def set_keys(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the key of each text's set, which equal sets share."""
    return map_texts(df, text, f"{out} binary", lambda: lambda batch: [[_set_key(shingles(raw)) for raw in batch]])


def similar_groups(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    ``component_id`` is the smallest id that is reachable by links, the row's own included. Rows without
    words (NULL, empty or white-space texts) have no shingles and stay alone. Equal sets are one class and
    are compared once. Links hold between texts: rows that repeat an id with other texts may lie in several
    components, and each text is linked with all that are similar to it. A row without an id gets the component of
    its class, or NULL when no row of the class has an id. Ids are whole numbers; other columns are not read.
    """
    return grouped_sets(documents, doc_id, text).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
