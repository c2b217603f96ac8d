"""Bounded vector buffers per track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 1000
MIN_SAMPLES = 50


def _keep(rows: DataFrame, track: str, order: list[Column], capacity: int) -> DataFrame:
    # a bound on the rank: Spark keeps the best rows of each task before the shuffle
    w = Window.partitionBy(track).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max(1, capacity // 2)).drop("_r")


def vector_fifo(rows: DataFrame, seq: str = "seq", track: str = "track", capacity: int = CAPACITY) -> DataFrame:
    """The newest ``capacity / 2`` vectors of each track."""
    return _keep(rows, track, [F.desc(seq)], capacity)


def vector_reservoir(
    rows: DataFrame, seq: str = "seq", track: str = "track", capacity: int = CAPACITY, seed: int = 42
) -> DataFrame:
    """A uniform sample of ``capacity / 2`` vectors of each track.

    Each vector keeps a fixed random rank (an md5), and the lowest ranks stay, so
    the sample does not depend on how the stream is cut into batches.
    """
    rank = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(seq).cast("string")))
    return _keep(rows, track, [rank, F.col(seq)], capacity)


def buffer_ready(buffer: DataFrame, track: str = "track", min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Size and readiness of each track and of all together (``total``)."""
    sizes = buffer.groupBy(track).agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size")).select(F.lit("total").alias(track), "size")
    return sizes.unionByName(total).withColumn("is_ready", F.col("size") >= min_samples)


def buffer_flush(buffer: DataFrame, only: str | None = None, track: str = "track") -> DataFrame:
    """Snapshot of one track or of all; the buffer itself is left as it is."""
    return buffer if only is None else buffer.filter(F.col(track) == only)


def buffer_clear(buffer: DataFrame, only: str | None = None, track: str = "track") -> DataFrame:
    """The buffer without one track's vectors, or empty."""
    return buffer.filter(F.lit(False)) if only is None else buffer.filter(F.col(track) != only)
