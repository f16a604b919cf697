"""Document lists: groups by an array field, reading time, dated order, neighbours, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import reading_minutes
from .ranks import with_neighbours
from .skew import join_counts


def group_by_array(df: DataFrame, col: str, id_cols: list[str], name: str = "group_name") -> DataFrame:
    """One row per (array value, document) with the size of the value's group.

    Groups stay rows: a value that most documents carry is never gathered into one list, and its
    rows are spread by ``id_cols`` when the sizes are joined.
    """
    long = df.withColumn(name, F.explode(F.array_distinct(col)))
    sizes = long.groupBy(name).agg(F.count("*").alias("group_size"))
    return join_counts(long, sizes, name, "group_size", id_cols)


def group_sizes(df: DataFrame, col: str, name: str = "group_name") -> DataFrame:
    """Sorted distinct values of an array column with their document counts."""
    long = df.select(F.explode(F.array_distinct(col)).alias(name))
    return long.groupBy(name).agg(F.count("*").alias("documents")).orderBy(name)


def reading_time(df: DataFrame, col: str, words_per_minute: int = 160, out: str = "read_time") -> DataFrame:
    return df.withColumn(out, reading_minutes(F.col(col), words_per_minute))


def listing(df: DataFrame, date_col: str = "date", tie: str = "position") -> DataFrame:
    """Documents newest first."""
    return df.orderBy(F.desc_nulls_last(date_col), F.desc(tie))


def neighbour_docs(df: DataFrame, key: Column, value: str) -> DataFrame:
    """Add the previous and next document in collection order (``key`` is unique and ascending)."""
    return with_neighbours(df, key, value)


def sorted_tags(df: DataFrame, col: str, out: str = "sorted_tags") -> DataFrame:
    """Tags of each document ordered regardless of case."""
    keyed = F.transform(F.col(col), lambda t: F.struct(F.lower(t).alias("low"), t.alias("tag")))
    return df.withColumn(out, F.transform(F.array_sort(keyed), lambda x: x["tag"]))
