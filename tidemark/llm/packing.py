"""Packing of token sequences: best-fit decreasing with a segment tree over remaining capacity.

Documents longer than a window are first cut into full windows. What remains goes, longest first, into
the open window with the least room that still holds it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import stored
from .common import parts, quoted, text_bytes
from .tokens import chunked_tokenizer

WINDOW = 2048
#: Tokens that one packing task places: enough windows for tight fits, few enough rows for one task.
TOKENS_PER_TASK = 32 << 20

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_SEQUENCES_PER_TASK = 1 << 40


class CapacityTree:
    """Open windows by remaining capacity, as counts in a segment tree."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        i = room + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, window) with the smallest room of at least ``least``; the window leaves the tree."""
        i, count, size = least + self.size, self.count, self.size
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - size
        window = self.windows[room].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return room, window


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int], int]:
    """Window and offset of each length, given longest first, and the number of windows."""
    tree, windows, offsets, opened = CapacityTree(capacity), [], [], 0
    for n in lengths:
        room, window = tree.take(n) or (capacity, opened)
        opened += window == opened
        windows.append(window)
        offsets.append(capacity - room)
        if room > n:
            tree.put(room - n, window)
    return windows, offsets, opened


def cut_pieces(documents: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = 1) -> DataFrame:
    """Full windows and the rest of every document's ids, each with the CRC-32 of its ids."""
    rows = documents.select(F.col(quoted(doc_id)).cast("long"), F.col(quoted(text)))
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunked_tokenizer(tokenizer)
        for batch in (p for b in batches for p in parts(b, 1)):
            out: list[tuple] = []
            for doc, raw in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                ids = (encoder.encode(raw) if raw else b"") + last
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    out.append((doc, start, len(piece) // 4, zlib.crc32(piece), total))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=pa.int64()) for c in zip(*out)] if out else [pa.array([], type=pa.int64())] * 5,
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return rows.mapInArrow(run, PIECES)


def place(pieces: DataFrame, window: int = WINDOW, tokens_per_task: int = TOKENS_PER_TASK) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; the pieces are a stored table.

    Narrow rows are dealt evenly over tasks, so no document, source or length can fill one of them.
    Every task leaves at most about one loose window.
    """
    total = pieces.agg(F.sum("length").alias("n")).first().n or 0
    tasks = max(1, ceil(total / tokens_per_task))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        doc, start, length, crc = (table.column(i).fill_null(-1).to_numpy() for i in range(4))
        order = np.lexsort((crc, start, doc, -length))
        windows, offsets, _ = best_fit_decreasing(length[order].tolist(), window)
        first = TaskContext.get().partitionId() * _SEQUENCES_PER_TASK
        arrays = [c.combine_chunks() for c in table.take(pa.array(order)).columns]
        arrays += [pa.array(np.array(windows, np.int64) + first), pa.array(np.array(offsets, np.int64))]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for i in range(0, len(order), 20_000):
            yield pa.RecordBatch.from_arrays([a.slice(i, 20_000) for a in arrays], names=names)

    return pieces.repartition(tasks).mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def pack(
    documents: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
    end_id: int = 1, tokens_per_task: int = TOKENS_PER_TASK,
) -> DataFrame:
    """Where every piece of every document lies in sequences of at most ``window`` ids.

    A document's ids are those of the tokenizer at path ``tokenizer``, without special ones, and then
    ``end_id``. NULL and empty texts are that one id. Each id lies in exactly one piece and the pieces of
    a sequence leave no gap from offset 0. Repeated rows are packed once each; a NULL id stays NULL.
    Pieces are stored before they are placed, so texts are tokenized once.
    """
    return place(stored(cut_pieces(documents, tokenizer, doc_id, text, window, end_id), "pieces"), window, tokens_per_task)
