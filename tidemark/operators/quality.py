"""Guards and validations; each returns the offending rows, never an exception."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import has_any
from ..plans.storage import broadcast_if_small, stored

#: Example rows, some 100 bytes each, that may be broadcast.
EXAMPLES = 200_000


def boilerplate(
    df: DataFrame, threshold: int = 4, min_length: int = 60, id_cols: Sequence[str] = ("source", "source_id")
) -> DataFrame:
    """Summaries of ``min_length`` characters or more that ``threshold`` records share.

    Hashes are counted first with one example record each, so that shuffle carries no texts; the
    text is then fetched for the example of every repeated hash alone. The examples are broadcast when
    there are at most ``EXAMPLES``, which leaves the texts where they are; more are joined by a shuffle.
    """
    trimmed = F.regexp_replace(F.coalesce("summary", F.lit("")), r"(?U)^\s+|\s+\z", "")
    long = df.select(*id_cols, trimmed.alias("summary")).where(F.length("summary") >= min_length)
    hashed = long.withColumn("_hash", F.unhex(F.sha2(F.col("summary").cast("binary"), 256)))
    repeated = (
        hashed.groupBy("_hash")
        .agg(F.count("*").alias("records"), F.min(F.struct(*id_cols)).alias("_example"))
        .where(F.col("records") >= threshold)
        .select("_hash", "records", "_example.*")
    )
    repeated = broadcast_if_small(stored(repeated, "repeated"), EXAMPLES)
    examples = hashed.join(repeated, [*id_cols, "_hash"])
    return examples.dropDuplicates(["_hash"]).select("summary", "records")


def validate_snapshot(items: DataFrame, required: Sequence[str] = ("source", "source_id", "title", "url", "total_score")) -> DataFrame:
    """Violations of the snapshot contract: (scan_date, source, source_id, violation).

    Fields present, one category at least, scores within 0-100, known provenance, and one row
    per (source, source_id) within a scan. Keys and violations of each row are stored first, so the rows are
    computed once, however they are made.
    """
    types = dict(items.dtypes)
    rules: list[Column] = [F.when(F.col("scan_date").isNull(), F.lit("missing date"))]
    for c in required:
        blank = F.col(c).isNull() | (F.col(c) == "") if types[c] == "string" else F.col(c).isNull()
        rules.append(F.when(blank, F.lit(f"missing {c}")))
    rules.append(F.when(~has_any(F.col("categories")), F.lit("no category")))
    rules.append(F.when(~F.col("total_score").between(0, 100), F.lit("score out of range")))
    rules.append(F.when(~F.col("provenance").isin("live", "curated"), F.lit("unknown provenance")))
    keys = ["scan_date", "source", "source_id"]
    checked = stored(items.select(*keys, F.array_compact(F.array(*rules)).alias("_found")), "checked")
    per_row = checked.select(*keys, F.explode("_found").alias("violation"))
    repeated = checked.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return per_row.unionByName(repeated.select(*keys, F.lit("duplicate item").alias("violation")))


def _key_sorted(value: Column, kind: T.DataType) -> Column:
    """``value`` with the fields of structs and the keys of maps in order, at every depth."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        inner = F.struct(*[_key_sorted(value[f.name], f.dataType).alias(f.name) for f in fields])
        return F.when(value.isNotNull(), inner)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _key_sorted(x, kind.elementType))
    if isinstance(kind, T.MapType):
        sorted_values = F.transform_values(value, lambda _, x: _key_sorted(x, kind.valueType))
        return F.map_from_entries(F.array_sort(F.map_entries(sorted_values), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
    return value


def payload_hash(columns: Sequence[str], schema: T.StructType | None = None) -> Column:
    """SHA-256 of the compact JSON of the columns, keys sorted.

    With the ``schema`` of the rows, keys of maps and nested structs are sorted too.
    """
    kinds = {f.name: f.dataType for f in schema.fields} if schema is not None else {}
    ordered = F.struct(*[_key_sorted(F.col(c), kinds.get(c, T.StringType())).alias(c) for c in sorted(columns)])
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}).cast("binary"), 256))


def with_payload_hash(df: DataFrame, columns: Sequence[str], out: str = "raw_payload_hash") -> DataFrame:
    return df.withColumn(out, payload_hash(columns, df.schema))


def unchanged_rows(old: DataFrame, new: DataFrame, keys: Sequence[str], hash_col: str = "raw_payload_hash") -> DataFrame:
    """Rows of ``new`` whose payload fingerprint is the one already stored."""
    return new.join(old.select(*keys, hash_col).distinct(), [*keys, hash_col], "left_semi")
