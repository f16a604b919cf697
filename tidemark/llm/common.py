"""Helpers of the corpus operators: word splitting on bytes, and Arrow maps over one text column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .tokens import release

# ASCII upper case to lower case; every other ASCII character that is no letter or digit to a space.
WORD_TABLE = bytes(
    b if b >= 0x80 or chr(b).isdigit() or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)
#: White space that separates words in the space-split operators, as a Java and RE2 class.
SPACES = r"\x20\x09-\x0D"
#: Bytes of text that a task turns into Python objects at a time.
PART_BYTES = 4 << 20


def folded_words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and anything beyond ASCII, from UTF-8."""
    return text.translate(WORD_TABLE).split() if text else []


def spaced_words(text: bytes | None) -> list[bytes]:
    """Runs without ASCII white space, A-Z lower-cased, from UTF-8."""
    return text.lower().split() if text else []


def folded_word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end, in code points, of every word that ``folded_words`` finds."""
    raw = np.frombuffer(text, np.uint8)
    word = np.frombuffer(text.translate(WORD_TABLE), np.uint8) != 0x20
    edges = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return points[np.flatnonzero(edges == 1)], points[np.flatnonzero(edges == -1)]


def without(df: DataFrame, names: list[str]) -> list[str]:
    """The columns of ``df`` that do not clash with ``names`` (Spark compares without case)."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def aside(names: list[str]) -> tuple[list[Column], list[Column]]:
    """The columns ``names`` under names that no operator uses inside, and the same columns back under their own."""
    inner = [f"_kept_{i}" for i in range(len(names))]
    return [F.col(quoted(c)).alias(k) for c, k in zip(names, inner)], [F.col(k).alias(c) for c, k in zip(names, inner)]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return column.cast(pa.large_binary() if large else pa.binary()).to_pylist()


def parts(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``PART_BYTES`` of its text column each, so Python holds few texts at a time.

    A batch has so many rows whatever their length. A slice shares the memory of its batch.
    """
    rows = -(-batch.num_rows // max(1, -(-batch.column(text).nbytes // PART_BYTES)))
    for start in range(0, max(1, batch.num_rows), max(1, rows)):
        yield batch.slice(start, rows)


def map_texts(
    df: DataFrame,
    text: str,
    results: str,
    make: Callable[[], Callable[[list[bytes | None]], list]],
    keep: list[str] | None = None,
) -> DataFrame:
    """``df`` with columns computed from one text column, an Arrow batch at a time.

    ``make`` is called once per task and gives the function from the texts of a batch to the result
    columns, each row by itself. ``keep`` names the input columns that stay (default: all); a text that stays
    travels once. An input column with the name of a result column is replaced by it.
    """
    added = T.StructType.fromDDL(results)
    names = without(df, added.names)
    kept = names if keep is None else [c for c in keep if c in names]
    inward, outward = aside(kept)
    if stays := text in kept:
        # The column that the task reads is the one that stays.
        at = kept.index(text)
        del inward[at]
        outward[at] = F.col("_text").alias(text)
    source = df.select(*inward, F.col(quoted(text)).alias("_text"))
    n = len(inward) + stays
    schema = T.StructType(source.schema.fields[:n] + list(added.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        arrow = to_arrow_schema(added)
        work = make()
        for batch in batches:
            for part in parts(batch, -1):
                found = work(text_bytes(part.column(-1)))
                yield pa.RecordBatch.from_arrays(
                    part.columns[:n] + [
                        x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(found, arrow)
                    ],
                    names=schema.names,
                )

    return source.mapInArrow(run, schema).select(*outward, *added.names)
