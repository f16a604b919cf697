"""Where jobs may keep intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which all executors share.

    Where it is unset, a temporary folder serves a session whose executors are threads of this
    process, as in tests. On a cluster such a folder would lose rows, so there it is an error.
    """
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set {SETTING} to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tidemark-"))
    return _LOCAL[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """The rows of ``df`` from a Parquet table in the shared folder.

    Later jobs neither recompute nor lose them, and read only the columns they need. The table
    belongs to the owner of the folder, who removes it with the folder.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``stored`` under the name that the scan uses for its steps."""
    return stored(df, "step")


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a stored table, marked for broadcast when a count finds at most ``rows``; else unmarked."""
    return F.broadcast(df) if df.count() <= rows else df
