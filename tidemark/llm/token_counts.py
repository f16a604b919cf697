"""Token counts of documents in flat token files without an index.

A file is a run of fixed-width ids; every document ends in the end-of-document id. Files are read in blocks
of bounded size. A block looks for its separators with one vectorised comparison, and a prefix scan over
the blocks of a file carries the last separator and the number of documents across block borders.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stored
from .common import quoted, text_bytes
from .files import open_folder

#: Ids in one block.
BLOCK_TOKENS = 8 << 20
_ENCODERS: dict[tuple[str, str], object] = {}


def byte_pair_encoder(ranks: str, pattern: str):
    """An encoder from a file of base64 tokens and ranks, without special tokens; kept by the worker."""
    if (ranks, pattern) not in _ENCODERS:
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        _ENCODERS[ranks, pattern] = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[ranks, pattern]


def write_token_files(
    documents: DataFrame, folder: str, ranks: str, pattern: str, end_id: int, dtype: str = "<u2",
    doc_id: str = "doc_id", text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Writes the documents of every task to one file; gives (path, tokens) and (path, position, doc_id).

    NULL texts are empty. Each attempt of a task names its own file, so one of a lost attempt is never read.
    """
    rows = documents.select(F.col(quoted(doc_id)).cast("long"), F.col(quoted(text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_pair_encoder(ranks, pattern)
        fs, local = open_folder(folder)
        fs.create_dir(local, recursive=True)
        name = f"{uuid.uuid4().hex}.tokens"
        path, position, tokens, out = f"{folder.rstrip('/')}/{name}", 0, 0, None
        last = np.array([end_id], dtype).tobytes()
        for batch in batches:
            for raw in text_bytes(batch.column(1)):
                out = out or fs.open_output_stream(f"{local}/{name}", compression=None)
                ids = encoder.encode_ordinary(raw.decode()) if raw else []
                out.write(np.array(ids, dtype).tobytes() + last)
                tokens += len(ids) + 1
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * n, pa.string()), pa.array(range(position, position + n), pa.int64()), batch.column(0), pa.nulls(n, pa.int64())],
                names=["path", "position", "doc_id", "tokens"],
            )
            position += n
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([tokens], pa.int64())],
                names=["path", "position", "doc_id", "tokens"],
            )

    found = stored(rows.mapInArrow(run, "path string, position long, doc_id long, tokens long"), "token-files")
    return found.where("tokens IS NOT NULL").select("path", "tokens"), found.where("tokens IS NULL").select("path", "position", "doc_id")


def scan_separators(files: DataFrame, end_id: int, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(path, block, ends): the places of the separators of every block, in ids from the file's start."""
    blocks = files.select(
        "path", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("tokens") - 1, F.lit(0)), F.lit(block_tokens).cast("long"))).alias("start")
    ).where("tokens > 0")
    width = np.dtype(dtype).itemsize
    n = blocks.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, tokens, start in zip(*(c.to_pylist() for c in batch.columns)):
                fs, local = open_folder(path)
                with fs.open_input_file(local) as file:
                    data = file.read_at(width * min(block_tokens, tokens - start), width * start)
                ends = np.flatnonzero(np.frombuffer(data, dtype) == end_id) + start
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([start], pa.int64()), pa.array([tokens], pa.int64()), pa.array([ends], pa.list_(pa.int64()))],
                    names=["path", "start", "tokens", "ends"],
                )

    return blocks.repartition(max(1, n)).mapInArrow(run, "path string, start long, tokens long, ends array<long>")


def token_counts(files: DataFrame, end_id: int, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(path, position, start, n_tokens, ended) of every document in token files (path, tokens).

    ``position`` counts the documents of a file from 0 and ``n_tokens`` leaves the separator out. Two
    separators in a row are an empty document. Ids after the last separator are a document with ``ended``
    false; an empty file has none. Each file is listed once.
    """
    blocks = stored(scan_separators(files, end_id, dtype, block_tokens), "separators")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(
        "path", "start", "tokens", "ends",
        F.coalesce(F.max(F.element_at("ends", F.when(F.size("ends") > 0, -1))).over(before), F.lit(-1)).alias("last"),
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("documents"),
        F.lead("start").over(Window.partitionBy("path").orderBy("start")).isNull().alias("final"),
    )
    rest = F.col("final") & (F.coalesce(F.element_at("ends", F.when(F.size("ends") > 0, -1)), F.col("last")) < F.col("tokens") - 1)
    ends = F.when(rest, F.concat("ends", F.array("tokens"))).otherwise(F.col("ends"))
    opened = carried.withColumn("ends", ends).withColumn("begins", F.concat(F.array("last"), F.expr("slice(ends, 1, greatest(size(ends) - 1, 0))")))
    docs = opened.select("path", "tokens", "documents", F.posexplode(F.arrays_zip("begins", "ends")).alias("i", "d")).where("d.ends IS NOT NULL")
    return docs.select(
        "path", (F.col("documents") + F.col("i")).alias("position"), (F.col("d.begins") + 1).alias("start"),
        (F.col("d.ends") - F.col("d.begins") - 1).alias("n_tokens"), (F.col("d.ends") < F.col("tokens")).alias("ended"),
    )
