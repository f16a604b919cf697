"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of the test items.

Texts are normalised to words (A-Z lower-cased, ASCII punctuation dropped) and scanned once. Matches
come back as word positions, which are mapped to code points of the original text.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.storage import stored
from .common import aside, folded_word_spans, folded_words, parts, quoted, text_bytes, without
from .phrases import PhraseAutomaton
from .tokens import release

WINDOW = 10
#: Bytes of item text in one automaton, which a worker holds in about 100 times that memory.
BLOCK_BYTES = 2 << 20

RESULTS = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"


def item_windows(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    """Every run of ``window`` words; fewer words are one window, none are none."""
    if not words:
        return []
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


def _items(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> tuple[DataFrame, int]:
    """The distinct items that have a text, and in how many blocks of about ``block_bytes`` they are scanned."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    return items, max(1, ceil(total / block_bytes))


def _collected(items: DataFrame) -> list[tuple[str | None, bytes]]:
    return [(r.item, r.text.encode()) for r in items.collect()]


def _by_blocks(rows: DataFrame, items: DataFrame, blocks: int, window: int) -> DataFrame:
    """What ``_scan`` gives for all items, with one block in memory at a time.

    Each block leaves a stored table of the rows it hits. They meet by a row number, for which the rows are
    stored once.
    """
    rows = stored(rows.withColumn("_number", F.monotonically_increasing_id()), "numbered")
    items = stored(items, "items")
    names = rows.columns[-6:-1]
    found = None
    for i in range(blocks):
        block = _collected(items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == i))
        hits = stored(_scan(rows.select("_number", *names), block, window, True, False).where("n_hit > 0").select("_number", "items", "spans"), "hits")
        found = hits if found is None else found.unionByName(hits)
    every = lambda name: F.flatten(F.collect_list(name)).alias(name)
    found = found.groupBy("_number").agg(every("items"), every("spans"))
    alone = [c for c in rows.columns if c not in ("_number", "items", "spans")]
    filled = [F.coalesce(found[c], rows[c]).alias(c) for c in ("items", "spans")]
    joined = rows.join(found, rows["_number"] == found["_number"], "left").select(*[rows[quoted(c)] for c in alone], *filled)
    return _scan(joined, [], window, False, True)


def _scan(rows: DataFrame, items: list[tuple[str | None, bytes]], window: int, first: bool, last: bool) -> DataFrame:
    """One block of items over rows that end in columns (_text, n_words, n_hit, items, spans).

    ``spans`` counts words until the ``last`` scan turns them into code points. Unless it is the ``first``, a
    scan adds to the items and spans that the rows have.
    """
    shared = rows.sparkSession.sparkContext.broadcast(items)
    schema = rows.schema
    arrow = to_arrow_schema(T.StructType(schema.fields[-4:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        automaton = PhraseAutomaton((w, item) for item, t in shared.value for w in item_windows(folded_words(t), window))
        for batch in (p for b in batches for p in parts(b, -5)):
            *kept, texts, _, _, old_items, old_spans = batch.columns
            before = [([], [])] * len(texts) if first else zip(old_items.to_pylist(), old_spans.to_pylist())
            results = []
            for raw, (ids, spans) in zip(text_bytes(texts), before):
                words = folded_words(raw)
                found = automaton.find(words)
                if found or not first:
                    ids = sorted({*ids, *(i for *_, named in found for i in named if i is not None)})
                    spans = merged([(x["start"], x["end"]) for x in spans] + [(a, b) for a, b, _ in found])
                    spans = [{"start": a, "end": b} for a, b in spans]
                n_hit = sum(x["end"] - x["start"] for x in spans)
                if last and spans:
                    starts, ends = folded_word_spans(raw)
                    spans = [{"start": int(starts[x["start"]]), "end": int(ends[x["end"] - 1])} for x in spans]
                results.append((len(words), n_hit, ids, spans))
            columns = list(zip(*results)) or [[]] * 4
            added = [pa.array(c, type=f.type) for c, f in zip(columns, arrow)]
            yield pa.RecordBatch.from_arrays([*kept, texts, *added], names=schema.names)

    return rows.mapInArrow(run, schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open spans; spans that touch become one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    keep: list[str] | None = None,
) -> DataFrame:
    """Documents with the words that lie in an occurrence of a benchmark window.

    Adds ``n_words``, ``n_hit`` (words inside a window), ``items`` (ids of items with an occurring
    window, as sorted distinct strings) and ``spans`` (runs of hit words, as code points of the text).
    ``keep`` names the columns that stay; columns with a result's name are replaced. NULL and empty
    texts have no words and no hits; an item without words never occurs; an item without an id hits but
    is not named; repeated rows each get their result. A benchmark of more than ``block_bytes`` is
    scanned in blocks, one after another over the same rows, each collected after the one before it has
    left a stored table of its hits; a single item is never split.
    """
    names = T.StructType.fromDDL(RESULTS).names
    kept = [c for c in without(documents, names) if keep is None or c in keep]
    inward, outward = aside(kept)
    if text in kept:
        # The column that is scanned is the one that stays.
        at = kept.index(text)
        del inward[at]
        outward[at] = F.col("_text").alias(text)
    empty = [F.lit(0).cast("long"), F.lit(0).cast("long"), F.array().cast("array<string>"), F.array().cast("array<struct<start: long, end: long>>")]
    rows = documents.select(
        *inward, F.col(quoted(text)).alias("_text"), *[c.alias(n) for c, n in zip(empty, names)]
    )
    items, blocks = _items(benchmark, item, item_text, block_bytes)
    rows = _scan(rows, _collected(items), window, True, True) if blocks == 1 else _by_blocks(rows, items, blocks, window)
    return rows.select(*outward, *names)
