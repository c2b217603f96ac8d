"""A commit log beside a store of files: a batch counts once its row stands in the log.

A batch is a folder ``batch=<name>`` of the store.  Files of a write that failed belong to no
commit and are never read.  The log (``_log/commits``, which readers of the store's own files
pass over) has one small row per commit: its number, its kind (``append``, ``replace``,
``truncate``), the batch and the next free sequence number.  One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "commit long, kind string, batch string, next_seq long"


def log(spark: SparkSession, path: str) -> DataFrame | None:
    """The commits of a store, or nothing if it has no log."""
    try:
        return spark.read.schema(SCHEMA).json(f"{path}/_log/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def live_batches(spark: SparkSession, path: str) -> list[str] | None:
    """Folders that readers take, oldest first: those since the last ``replace`` or ``truncate``."""
    commits = log(spark, path)
    if commits is None:
        return None
    resets = F.max(F.when(F.col("kind") != "append", F.col("commit")))
    last = commits.agg(resets).first()[0] or 0
    rows = commits.filter((F.col("commit") >= last) & F.col("batch").isNotNull()).orderBy("commit", "batch").collect()
    return [f"{path}/batch={r.batch}" for r in rows]  # one name per append since the last compaction


def next_number(spark: SparkSession, path: str) -> int | None:
    """First free sequence number by the log; the store is not read."""
    commits = log(spark, path)
    return None if commits is None else int(commits.agg(F.max("next_seq")).first()[0] or 0)


def new_batch() -> str:
    return uuid.uuid4().hex


def commit(spark: SparkSession, path: str, kind: str, batch: str | None, next_seq: int) -> None:
    """Add one row; it appears as a whole file or not at all."""
    commits = log(spark, path)
    number = 1 if commits is None else int(commits.agg(F.max("commit")).first()[0] or 0) + 1
    row = spark.createDataFrame([(number, kind, batch, next_seq)], SCHEMA)
    row.coalesce(1).write.mode("append").json(f"{path}/_log/commits")
