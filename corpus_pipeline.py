"""A corpus from raw documents to packed training sequences, one stored stage after another."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard, packing, quality, toxicity
from tidemark.llm.common import quoted
from tidemark.llm.queries import TOXIC_FROM, table, toxicity_model
from tidemark.plans.storage import broadcast_if_small, scratch, stored


def _rows(docs: DataFrame) -> DataFrame:
    """All columns but the text as one beside it, so that no result column can clash with them and no text travels twice."""
    others = [F.col(quoted(c)) for c in docs.columns if c != "text"]
    return docs.select(F.struct(*others).alias("_row"), "text")


def _columns(docs: DataFrame) -> list[Column]:
    """The columns of ``docs`` from what ``_rows`` made of them."""
    return [F.col(quoted(c) if c == "text" else f"_row.{quoted(c)}").alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(_rows(docs), toxicity_model(spark, docs, sf_dir), keep=["_row", "text"])
    return scored.where(F.col("score") < TOXIC_FROM).select(*_columns(docs))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.apply_rules(_rows(docs)).where("kept").select(*_columns(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts, one row of the smallest id stays; rows without an id or without words stay.

    Where an id has several texts, each is judged by its own group.
    """
    every = stored(jaccard.grouped_sets(docs).where("doc_id IS NOT NULL").select("doc_id", "key", "grp"), "groups")
    rows = every.where("grp IS NOT NULL")
    first = stored(rows.groupBy("grp").agg(F.min(F.struct("doc_id", "key")).alias("f")).select("f.*"), "first")
    # Ids of one row, by far most of them, are kept or dropped by the id alone.
    several = stored(every.groupBy("doc_id").count().where("count > 1").select("doc_id"), "several")
    gone = stored(rows.join(first.select("doc_id"), "doc_id", "left_anti").select("doc_id").unionByName(several).distinct(), "gone")
    kept = docs.join(broadcast_if_small(gone, jaccard.BROADCAST_IDS), "doc_id", "left_anti").select(*[F.col(quoted(c)) for c in docs.columns])
    if several.isEmpty():
        return kept
    again = docs.join(broadcast_if_small(several, jaccard.BROADCAST_IDS), "doc_id", "left_semi")
    again = jaccard.set_keys(_rows(again), "text", "_key").withColumn("_id", F.col("_row.doc_id"))
    wordless = again.where(F.col("_key") == jaccard.NO_WORDS)
    named = again.where(F.col("_key") != jaccard.NO_WORDS).dropDuplicates(["_id", "_key"])
    named = named.join(first.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")), ["_id", "_key"], "left_semi")
    return kept.unionByName(named.select(*_columns(docs))).unionByName(wordless.select(*_columns(docs)))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scanned = decontaminate.decontaminate(_rows(docs), table(spark, sf_dir, "benchmark"), keep=["_row", "text"])
    return scanned.where("n_hit = 0").select(*_columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: The scores of compressed windows, the groups of similar sets and the ids of a tokenizer have no SQL form;
#: tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
