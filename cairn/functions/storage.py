"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own where it is unset, in local mode only (tests): elsewhere other
    machines wouldn't see it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="cairn-")
    return _OWN[app]


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/cairn-{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: this cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt over as many tasks as a shuffle has, by ranges of the keys (the first column if none are given), so that neighbours stay
    together: what makes many rows of each row of a small file would run in the one task that reads it."""
    return df.repartitionByRange(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *(keys or df.columns[:1]))


#: Rows that a task makes many rows of each of, about.
ROWS = 4096


def together(df: DataFrame, by: str) -> DataFrame:
    """df dealt over tasks by an expression, before each row is made many: in so many tasks that what one makes is sorted within memory."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-df.count() // ROWS), 10_000), 1)
    return df.repartition(parts, F.expr(by))
