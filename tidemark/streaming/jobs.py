"""Streaming twins of the batch operators, over an append-only stream of dated rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.dates import hours_before
from ..operators.dedupe import first_by


def file_stream(spark: SparkSession, path: str, schema, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as a stream; naive timestamps are read as UTC instants.

    Event time must be a zoned timestamp, so the session zone has to be UTC.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(path)
    naive = [c for c, t in stream.dtypes if t == "timestamp_ntz"]
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else stream


def lookback(stream: DataFrame, ts: str, now: Column, live_hours: float = 48.0, curated_hours: float = 720.0, curated: Column | None = None) -> DataFrame:
    """Rows of the look-back window, with the watermark that lets state expire after it."""
    hours = F.lit(live_hours) if curated is None else F.when(curated, F.lit(curated_hours)).otherwise(F.lit(live_hours))
    longest = live_hours if curated is None else max(live_hours, curated_hours)
    return stream.withWatermark(ts, f"{int(longest)} hours").where(F.col(ts) >= hours_before(now, hours))


def unique_in_window(stream: DataFrame, keys: Sequence[str], ts: str, hours: float = 48.0) -> DataFrame:
    """The first sighting of each key, and a later one only after its state has expired.

    A key is forgotten once the watermark, ``hours`` behind the newest event, has passed ``hours`` beyond its
    sighting, and rows behind the watermark are dropped; ``report_once`` does neither.
    """
    return stream.withWatermark(ts, f"{int(hours)} hours").dropDuplicatesWithinWatermark(list(keys))


def daily_counts(stream: DataFrame, ts: str, value: str, hours: float = 48.0) -> DataFrame:
    """Counts per UTC day and value; rows up to ``hours`` behind the newest event still count.

    In append mode a day appears once its late rows are no longer accepted. In update mode, into
    ``replace_batches``, every day appears at once and ``latest_state`` gives its newest count.
    """
    counted = stream.withWatermark(ts, f"{int(hours)} hours").groupBy(F.window(ts, "1 day"), F.col(value)).agg(
        F.count("*").alias("count")
    )
    return counted.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), value, "count")


def report_once(stream: DataFrame, keys: Sequence[str], path: str, checkpoint: str) -> StreamingQuery:
    """Appends the values of ``keys`` that no earlier batch has, to a table that is the memory as well.

    Each batch is reduced to its distinct keys and anti-joined with the table, so no state is held between
    batches, no row is ever late, and files may come in any order. A batch that runs again replaces what it wrote.
    NULL is a key of its own. After ``lookback`` only keys of the window are reported.
    """
    run = _run_of(stream.sparkSession, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.select(*keys).distinct()
        try:
            known = batch.sparkSession.read.parquet(path)
        except AnalysisException:
            known = None  # the first batch
        if known is not None:
            known = known.where((F.col("run") != run) | (F.col("batch_id") != batch_id))
            known = known.select(*[F.col(k).alias(f"_known_{k}") for k in keys])
            fresh = fresh.join(known, [F.col(k).eqNullSafe(F.col(f"_known_{k}")) for k in keys], "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/run={run}/batch_id={batch_id}")

    writer = stream.writeStream.outputMode("append").foreachBatch(write)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def partial_counts(stream: DataFrame, ts: str, value: str, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch as counts per UTC day and value; ``daily_totals`` adds them up.

    Counts merge, so nothing is held between batches: a late row is one more count of its day, and every day is
    complete as soon as its last row is there. What another run writes for a day replaces that day.
    """
    day = F.date_format(F.window(ts, "1 day")["start"], "yyyy-MM-dd").alias("day")
    count = lambda batch: batch.groupBy(day, F.col(value)).agg(F.count("*").alias("count"))
    return replace_batches(stream, path, checkpoint, by=("day",), each=count)


def daily_totals(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(day, value, count) of a table of ``partial_counts``."""
    rows = current_rows(spark, path, ["day"])
    return rows.groupBy(F.col("day").cast("string").alias("day"), value).agg(F.sum("count").alias("count"))


def compact_counts(spark: SparkSession, path: str, value: str, to: str) -> None:
    """Writes the counts of each day and value, added up, to a new table of the same form."""
    rows = spark.read.parquet(path)
    newest = rows.groupBy("day").agg(F.max("run").alias("run"))
    summed = rows.join(newest, ["day", "run"], "left_semi").groupBy("day", value, "run").agg(F.sum("count").alias("count"))
    summed.withColumn("batch_id", F.lit(-1).cast("bigint")).write.partitionBy("day", "run", "batch_id").parquet(to)


def entity_state(stream: DataFrame, entity: str, score: str, ts: str) -> DataFrame:
    """Running observations, peak score, first and last sighting per entity (update mode)."""
    return stream.groupBy(entity).agg(
        F.count("*").alias("observations"),
        F.max(score).alias("score"),
        F.min(ts).alias("first_seen"),
        F.max(ts).alias("last_seen"),
    )


def append_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-mode file sink that works off what is there and stops."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _run_of(spark: SparkSession, checkpoint: str) -> int:
    """When the run with this progress folder began, in microseconds; a restarted run keeps its number."""
    marker = f"{checkpoint.rstrip('/')}-run"
    try:
        return spark.read.schema("run long").parquet(marker).first().run
    except AnalysisException:
        run = time.time_ns() // 1000
        spark.range(1).select(F.lit(run).alias("run")).coalesce(1).write.parquet(marker)
        return run


def replace_batches(
    stream: DataFrame, path: str, checkpoint: str, by: Sequence[str] = (), mode: str = "append",
    each: Callable[[DataFrame], DataFrame] = lambda batch: batch,
) -> StreamingQuery:
    """Idempotent dated sink: a batch that runs again replaces exactly its own partitions.

    Rows carry the run that wrote them. What a newer run writes for a value of ``by`` stands in place of all
    that older runs wrote for it, however the files fell into batches; read it with ``current_rows``. ``each`` is
    applied to every batch before it is written.
    """
    run = _run_of(stream.sparkSession, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        parts = [*by, "run", "batch_id"]
        (
            each(batch).withColumns({"run": F.lit(run), "batch_id": F.lit(batch_id).cast("bigint")})
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy(*parts).parquet(path)
        )

    writer = stream.writeStream.outputMode(mode).foreachBatch(write)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_rows(spark: SparkSession, path: str, by: Sequence[str]) -> DataFrame:
    """Rows of the newest run for each value of ``by`` in a ``replace_batches`` table.

    The runs come from the names of the partitions; there is one row per value, as per date.
    """
    rows = spark.read.parquet(path)
    newest = rows.groupBy(*by).agg(F.max("run").alias("run"))
    return rows.join(newest, [*by, "run"], "left_semi").drop("run", "batch_id")


def latest_state(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest row per key from an update-mode ``replace_batches`` table."""
    return first_by(spark.read.parquet(path), keys, [F.desc("run"), F.desc("batch_id")]).drop("run", "batch_id")


def compact_state(spark: SparkSession, path: str, keys: Sequence[str], to: str) -> None:
    """Writes the newest row per key to a new table of the same form, so that the log of updates can go."""
    first_by(spark.read.parquet(path), keys, [F.desc("run"), F.desc("batch_id")]).write.partitionBy("run", "batch_id").parquet(to)
