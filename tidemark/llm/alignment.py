"""Alignment of two tokenizers: which ids of one stand for the same bytes as which ids of the other.

Texts are shuffled in full, so that each distinct one is tokenized and aligned once and counts as often as it
occurs. Measures of a text need counts over all texts. Their table of id pairs grows with the corpus, so it is
never broadcast: texts lie in chunks of bounded size, each chunk asks for the pairs that it holds, the answers are
shuffled to it, and the measures that come out are joined to the ids of the rows.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import broadcast_if_small, stored
from .common import quoted, text_bytes

#: Bytes of text, and texts, of one chunk; a longer text is a chunk of its own.
CHUNK_BYTES, CHUNK_TEXTS = 8 << 20, 20_000
#: Rows of about 80 bytes that may be broadcast.
BROADCAST_ROWS = 100_000
#: Links of one group that are listed at a time; larger groups are counted by distinct ids first.
LISTED_LINKS = 1 << 20
#: Bytes of text that are tokenized at a time.
_STEP_BYTES = 4 << 20
_ID_BITS = 32

MEASURES = ["n_a", "n_b", "n_groups", "n_links"]
_ALIGNED = "key binary, copies long, chunk long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>"


class ByteLevelTokenizer:
    """A byte-level BPE tokenizer from the JSON file of its vocabulary, whose ids are merge ranks."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model.get("added_tokens", [])}
        vocabulary = {token: i for token, i in model["model"]["vocab"].items() if token not in special}
        # Printable bytes stand for themselves, the others for the code points from 256 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items()}
        self._encoding = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._encoding.encode_ordinary(" " + t) for t in texts]


class PieceTokenizer:
    """A sentencepiece model that puts a space in front of a text."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self._model.get_piece_size()):
            piece = self._model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self._model.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


class Aligner:
    """Tokens of both tokenizers, cut where both end at the same byte."""

    def __init__(self, a, b):
        self.sides = a, b
        self.lengths = [np.array([len(x) for x in t.bytes], np.int64) for t in self.sides]
        size = max(len(t.bytes) for t in self.sides)
        self.size = size
        # Text of an id before another of its group, at the end of a group's first half, at the end of a group.
        self.parts = [f"{i}{end}" for end in (",", "|", ";") for i in range(size)]

    def align(self, text: bytes, a: list[int], b: list[int]) -> tuple | None:
        """(group of each A token, of each B token, number of groups), or None where bytes are not those of the text."""
        whole = b" " + text
        if any(b"".join(map(t.bytes.__getitem__, ids)) != whole for t, ids in zip(self.sides, (a, b))):
            return None
        ends = [np.cumsum(n[ids]) for n, ids in zip(self.lengths, (a, b))]
        shared = ends[0][ends[1][np.searchsorted(ends[1], ends[0])] == ends[0]]
        return np.searchsorted(shared, ends[0]), np.searchsorted(shared, ends[1]), len(shared)

    def listing(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> str:
        """Groups as decimal ids: those of A, a bar, those of B; groups are separated by semicolons."""
        at_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
        at_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
        part = np.empty(len(a) + len(b), np.int64)
        part[at_a] = a + self.size * np.append(group_a[1:] != group_a[:-1], True)
        part[at_b] = b + 2 * self.size * np.append(group_b[1:] != group_b[:-1], True)
        return "".join(map(self.parts.__getitem__, part.tolist()))[:-1]


def linked_pairs(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, groups: int, listed: int = LISTED_LINKS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of ids in the same group, as A << 32 | B, and the links of each.

    Links of a group are all pairs of its tokens. Of groups with more than ``listed`` links distinct ids are
    counted first, so a long group takes the space of its distinct pairs.
    """
    n_a, n_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    large = n_a * n_b > listed
    use = ~large[group_a]
    times = n_b[group_a[use]]
    first = np.cumsum(n_b) - n_b
    total = int(times.sum())
    within = np.arange(total) - np.repeat(np.cumsum(times) - times, times)
    pairs = [np.repeat(a[use], times) << _ID_BITS | b[np.repeat(first[group_a[use]], times) + within]]
    links = [np.ones(total, np.int64)]
    for g in np.flatnonzero(large):
        ids_a, count_a = np.unique(a[group_a == g], return_counts=True)
        ids_b, count_b = np.unique(b[group_b == g], return_counts=True)
        pairs.append((ids_a[:, None] << _ID_BITS | ids_b).ravel())
        links.append((count_a[:, None] * count_b).ravel())
    found, place = np.unique(np.concatenate(pairs), return_inverse=True)
    return found, np.bincount(place, np.concatenate(links), len(found)).astype(np.int64)


_ALIGNERS: dict[tuple, Aligner] = {}


def _aligner(byte_level: str, pattern: str, piece: str) -> Aligner:
    """The aligner of this worker process, which later tasks use again."""
    key = byte_level, pattern, piece
    if key not in _ALIGNERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ALIGNERS[key] = Aligner(ByteLevelTokenizer(byte_level, pattern), PieceTokenizer(piece))
    return _ALIGNERS[key]


def aligned_texts(texts: DataFrame, byte_level: str, pattern: str, piece: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Distinct texts (text, key, copies) as keys, copies, chunks, measures and linked pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, chunk = _aligner(byte_level, pattern, piece), TaskContext.get().partitionId() << _ID_BITS
        held = held_rows = 0

        def aligned(raw: bytes, a: list[int], b: list[int]) -> tuple:
            found = work.align(raw, a, b)
            if found is None:
                return 0, 0, 0, 0, "", [], []
            x, y = np.array(a, np.int64), np.array(b, np.int64)
            pairs, links = linked_pairs(x, y, *found)
            digest = hashlib.sha256(work.listing(x, y, *found[:2]).encode()).hexdigest()
            return len(a), len(b), found[2], int(links.sum()), digest, pairs, links

        for batch in batches:
            raws = text_bytes(batch.column(0))
            start = 0
            while start < len(raws):
                stop, size = start, 0
                while stop < len(raws) and (stop == start or size + len(raws[stop]) <= _STEP_BYTES):
                    size += len(raws[stop])
                    stop += 1
                part = raws[start:stop]
                words = [r.decode() for r in part]
                ids = [t.encode(words) for t in work.sides]
                rows, chunks = [], []
                for raw, a, b in zip(part, *ids):
                    if held_rows and (held + len(raw) > chunk_bytes or held_rows == CHUNK_TEXTS):
                        chunk, held, held_rows = chunk + 1, 0, 0
                    held, held_rows = held + len(raw), held_rows + 1
                    chunks.append(chunk)
                    rows.append(aligned(raw, a, b))
                columns = list(zip(*rows))
                numbers = [pa.array(c, pa.int64()) for c in columns[:4]]
                lists = [pa.ListArray.from_arrays(np.cumsum([0, *map(len, c)]).astype(np.int32), pa.array(np.concatenate([np.asarray(x, np.int64) for x in c]))) for c in columns[5:]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(start, len(part)), batch.column(2).slice(start, len(part)), pa.array(chunks, pa.int64()), *numbers, pa.array(columns[4], pa.string()), *lists],
                    names=["key", "copies", "chunk", *MEASURES, "groups_sha256", "pairs", "links"],
                )
                start = stop

    return texts.select("text", "key", "copies").mapInArrow(run, _ALIGNED)


def _asked(aligned: DataFrame) -> DataFrame:
    """(chunk, pair, n): the documents of a chunk that hold a pair; a chunk read in several steps has several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            pairs = batch.column(2)
            size, flat = np.diff(pairs.offsets.to_numpy()), pairs.flatten().to_numpy()
            of = np.repeat(np.arange(len(chunk)), size)
            for c in np.unique(chunk):
                here = chunk[of] == c
                found, place = np.unique(flat[here], return_inverse=True)
                n = np.bincount(place, copies[of[here]], len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), c)), pa.array(found), pa.array(n)], names=["chunk", "pair", "n"])

    return aligned.select("chunk", "copies", "pairs").where("n_links > 0").mapInArrow(run, "chunk long, pair long, n long")


def _measured(aligned: DataFrame, answers: DataFrame) -> DataFrame:
    """(key, n_best, count_sum) of every aligned text, from the counts that its chunk asked for."""

    def run(key: tuple, texts: pa.Table, known: pa.Table) -> pa.Table:
        pair, count, best = (known.column(c).to_numpy() for c in ("pair", "count", "best"))
        order = np.argsort(pair, kind="stable")
        pair, count, best = pair[order], count[order], best[order]
        lists = texts.column("pairs").combine_chunks()
        size, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
        links = texts.column("links").combine_chunks().flatten().to_numpy()
        at, of = np.searchsorted(pair, flat), np.repeat(np.arange(len(size)), size)
        n_best, total = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        np.add.at(n_best, of, links * best[at])
        np.add.at(total, of, links * count[at])
        return pa.table({"key": texts.column("key"), "n_best": pa.array(n_best), "count_sum": pa.array(total)})

    held = aligned.where("n_links > 0").select("chunk", "key", "pairs", "links").groupBy("chunk")
    return held.cogroup(answers.groupBy("chunk")).applyInArrow(run, "key binary, n_best long, count_sum long")


def align(documents: DataFrame, byte_level: str, pattern: str, piece: str, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Measures of the alignment of every row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Tokenizer A reads a space and the text, tokenizer B puts the space there itself. Where both end a token at the
    same byte a group ends; tokens of a group are linked. A pair of ids counts the rows that hold it linked, and is
    best where no other B id of its A id has a higher count. NULL and empty texts, and texts that a tokenizer does not give back byte
    by byte, have no tokens: zeros and an empty string. Repeated rows count each; ids of any kind are passed on.
    """
    rows = documents.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text"))
    filled = rows.where("length(text) > 0")
    texts = filled.groupBy("text").agg(F.count("*").alias("copies")).withColumn("key", F.unhex(F.sha2("text", 256)))
    aligned = stored(aligned_texts(texts, byte_level, pattern, piece, chunk_bytes), "aligned")
    asked = stored(_asked(aligned), "asked")
    counts = asked.groupBy("pair").agg(F.sum("n").alias("count"))
    # An A id has at most as many pairs as B has ids.
    most = F.max("count").over(Window.partitionBy(F.shiftright("pair", _ID_BITS)))
    counts = stored(counts.select("pair", "count", (F.col("count") == most).cast("long").alias("best")), "counts")
    measured = _measured(aligned, asked.select("chunk", "pair").join(counts, "pair"))
    by_key = stored(aligned.select("key", *MEASURES, "groups_sha256").join(measured, "key", "left"), "measures")
    keyed = rows.select("doc_id", F.when(F.length("text") > 0, F.unhex(F.sha2("text", 256))).alias("key"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in [*MEASURES, "n_best", "count_sum"]]
    joined = keyed.join(broadcast_if_small(by_key, BROADCAST_ROWS), "key", "left")
    return joined.select("doc_id", *zero, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
