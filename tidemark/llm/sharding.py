"""Sharding by extendible hashing, in built-in expressions only.

A shard is a prefix of the hash bits. The directory has one entry for every prefix of the global depth and
names the shard it belongs to; only shards above the byte limit are split, on their next bit.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import stored
from .common import aside, quoted, without

LIMIT_BYTES = 64 << 20
#: Bits of the hash. The first ones come from the key, so rows of a key stay together until their shard has
#: to be split beyond them; then the bits of the content part even the rows of one hot key.
KEY_BITS, CONTENT_BITS = 36, 24
BITS = KEY_BITS + CONTENT_BITS
#: Bits by which a round's directory is finer than evenly filled shards would need.
SPARE_BITS = 4

RESULTS = ["shard", "shard_bytes", "shard_rows", "oversized", "row_bytes"]


def hash_bits(key, content):
    """A number below 2^60 with the bits by which rows are dealt."""
    part = lambda c, n: F.conv(F.substring(F.md5(F.coalesce(c, F.lit(""))), 1, n // 4), 16, 10).cast("long")
    return F.shiftleft(part(key.cast("string"), KEY_BITS), CONTENT_BITS).bitwiseOR(part(content, CONTENT_BITS))


def _prefix(depth):
    return F.expr(f"shiftright(h, {BITS} - {depth})")


def _nodes(cells: DataFrame, low: int, high: int) -> DataFrame:
    """Bytes, rows and smallest and largest hash of every prefix of ``low`` to ``high`` bits."""
    each = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high))))
    return each.groupBy("depth", F.expr(f"shiftright(cell, {high} - depth)").alias("prefix")).agg(
        F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")
    )


def shard(df: DataFrame, key: str, content: str, limit_bytes: int = LIMIT_BYTES, keep: list[str] | None = None) -> DataFrame:
    """Rows with the shard they belong to; every shard's ``content`` has at most ``limit_bytes``.

    Adds ``shard`` (its hash prefix as bits; the empty string while all fits one shard), ``shard_bytes``,
    ``shard_rows``, ``row_bytes`` and ``oversized``, which is true only for a shard that no bit can split: one
    row above the limit, or copies of one row. NULL contents have 0 bytes, NULL keys hash like empty ones, and
    rows of an empty table have no shard. Input columns with a result's name are replaced, others keep theirs.

    Each round sums the bytes of the finest prefixes once, which is a small table, and derives the sums of
    all shorter ones from it, so the work doesn't depend on the number of splits. Another round looks only
    at rows of prefixes that are still too large.
    """
    inward, outward = aside([c for c in without(df, RESULTS) if keep is None or c in keep])
    text = F.col(quoted(content)).cast("string")
    rows = stored(
        df.select(
            *inward, hash_bits(F.col(quoted(key)), text).alias("h"),
            F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("row_bytes"),
        ),
        "hashed",
    )
    total = rows.agg(F.sum("row_bytes").alias("n")).first().n or 0
    low, done = 0, []
    high = min(BITS, max(0, ceil(log2(max(1, total / limit_bytes)))) + SPARE_BITS)
    while True:
        cells = stored(
            rows.groupBy(_prefix(high).alias("cell")).agg(
                F.sum("row_bytes").alias("bytes"), F.count("*").alias("n"), F.min("h").alias("least"), F.max("h").alias("most")
            ),
            "cells",
        )
        nodes = stored(_nodes(cells, low, high), "nodes")
        settled = (F.col("bytes") <= limit_bytes) | (F.col("least") == F.col("most"))
        open_ = nodes.where(~settled).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
        # A shard is a settled prefix below an open one.
        shards = (
            nodes.where(settled).withColumn("above", F.shiftright("prefix", 1))
            .join(open_.withColumn("below", F.lit(True)), ["depth", "above"], "left").where("below OR depth = 0")
        )
        shards = shards.select("depth", "prefix", F.col("bytes").alias("shard_bytes"), F.col("n").alias("shard_rows"))
        reach = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
        directory = stored(reach.join(shards, ["depth", "prefix"]).select("cell", "depth", "prefix", "shard_bytes", "shard_rows"), "directory")
        named = rows.withColumn("cell", _prefix(high)).join(directory, "cell", "left").drop("cell")
        left = nodes.where(F.col("depth") == high).where(~settled)
        found = named.where("depth IS NOT NULL")
        done.append(found)
        if high == BITS or left.isEmpty():
            break
        rows = stored(named.where("depth IS NULL").drop("depth", "prefix", "shard_bytes", "shard_rows"), "open-rows")
        largest = left.agg(F.max("bytes").alias("n")).first().n
        low, high = high, min(BITS, high + max(1, ceil(log2(largest / limit_bytes))) + SPARE_BITS)
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix"), F.col("depth").cast("int"), F.lit("0")))
    return result.select(
        *outward, "row_bytes", bits.alias("shard"), "shard_bytes", "shard_rows",
        (F.col("shard_bytes") > limit_bytes).alias("oversized"),
    )


def oracle(limit_bytes: int = LIMIT_BYTES) -> str:
    """DuckDB SQL for ``shard`` over documents by doc_id and text."""
    digest = lambda c, n: f"CAST('0x' || substr(md5({c}), 1, {n}) AS BIGINT)"
    return f"""
WITH hashed AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS row_bytes,
         ({digest("coalesce(CAST(doc_id AS VARCHAR), '')", KEY_BITS // 4)} << {CONTENT_BITS}) | {digest("coalesce(text, '')", CONTENT_BITS // 4)} AS h
  FROM documents
),
nodes AS (
  SELECT depth, h >> ({BITS} - depth) AS prefix, sum(row_bytes) AS bytes, count(*) AS n, min(h) = max(h) AS same
  FROM hashed, (SELECT unnest(range(0, 31)) AS depth) GROUP BY ALL
),
shards AS (
  SELECT * FROM nodes s WHERE (bytes <= {limit_bytes} OR same) AND (depth = 0 OR EXISTS (
    SELECT 1 FROM nodes p WHERE p.depth = s.depth - 1 AND p.prefix = s.prefix >> 1 AND p.bytes > {limit_bytes} AND NOT p.same))
)
SELECT d.doc_id, CAST(d.row_bytes AS BIGINT) AS row_bytes,
       CASE WHEN s.depth = 0 THEN '' ELSE right(lpad(bin(s.prefix), 64, '0'), s.depth) END AS shard,
       CAST(s.bytes AS BIGINT) AS shard_bytes, CAST(s.n AS BIGINT) AS shard_rows, s.bytes > {limit_bytes} AS oversized
FROM hashed d JOIN shards s ON s.prefix = d.h >> ({BITS} - s.depth)"""
