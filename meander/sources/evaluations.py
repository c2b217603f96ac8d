"""The table of evaluation rows: frames with their drift metrics, one folder per day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meander.functions.columns import stable_id

COLUMNS = [
    "id", "trace_id", "rag_type", "timestamp", "js_divergence", "mmd_score",
    "wasserstein_distance", "is_drifted", "telemetry_frame",
]


def evaluations_append(rows: DataFrame, path: str) -> None:
    """Store rows that have all of ``COLUMNS``, one folder per day."""
    # rebalance: one set of files per day, large days split again by AQE
    dated = rows.select(*COLUMNS).withColumn("date", F.to_date("timestamp")).hint("rebalance", "date")
    dated.write.mode("append").partitionBy("date").parquet(path)


def _null() -> Column:
    return F.lit(None).cast("double")


def frames_append(frames: DataFrame, path: str) -> None:
    """Store raw frames (``trace_id, rag_type, timestamp, telemetry_frame``) without metrics."""
    evaluations_append(
        frames.withColumns(
            {
                "id": stable_id(F.col("trace_id"), F.col("timestamp")),
                "js_divergence": _null(), "mmd_score": _null(), "wasserstein_distance": _null(),
                "is_drifted": F.lit(False),
            }
        ),
        path,
    )


def with_window_metrics(frames: DataFrame, metrics: DataFrame, by: list[str]) -> DataFrame:
    """Give each frame the drift metrics of its window (equi-join on the window key)."""
    cols = ["js_divergence", "mmd_score", "wasserstein_distance", "is_drifted"]
    picked = metrics.select(*by, *[F.col(c) if c in metrics.columns else _null().alias(c) for c in cols])
    return frames.join(picked, by).withColumn("id", stable_id(F.col("trace_id"), F.col("timestamp")))


def evaluation_write(frames: DataFrame, metrics: DataFrame, by: list[str], path: str) -> None:
    evaluations_append(with_window_metrics(frames, metrics, by), path)


def drift_result_write(results: DataFrame, timestamp: Column, path: str) -> None:
    """Store window-level results as rows of kind ``custom`` with the result as payload."""
    payload = F.to_json(F.struct(*results.columns), {"ignoreNullFields": "false"})
    rows = results.select(
        stable_id(payload).alias("id"),
        stable_id(F.lit("trace"), payload).alias("trace_id"),
        F.lit("custom").alias("rag_type"),
        timestamp.alias("timestamp"),
        *[
            F.col(c).cast("double") if c in results.columns else _null().alias(c)
            for c in ("js_divergence", "mmd_score", "wasserstein_distance")
        ],
        F.coalesce(F.col("is_drifted"), F.lit(False)).alias("is_drifted"),
        payload.alias("telemetry_frame"),
    )
    evaluations_append(rows, path)


def read_evaluations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def history_truncate(spark: SparkSession, path: str) -> None:
    """Empty the table, keeping its schema."""
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def chunk_upsert(spark: SparkSession, chunks: DataFrame, path: str | None) -> DataFrame:
    """Rows of ``chunks`` whose content is not stored yet, first id per content.

    Contents are compared by ``digest``, a column of the result to be stored with it: the
    stored texts are not read again.  Copies collapse in a map-side aggregate, so a text
    repeated very often costs one row per task in the shuffle.
    """
    columns = [c for c in chunks.columns if c not in ("id", "content", "digest")]
    keyed = chunks.withColumn("digest", F.sha2("content", 256))
    first = F.min_by(F.struct("id", "content", *columns), F.col("id"))
    new = keyed.groupBy("digest").agg(first.alias("r")).select(
        "r.id", "r.content", *[f"r.{c}" for c in columns], "digest"
    )
    if path is None:
        return new
    return new.join(spark.read.parquet(path).select("digest"), "digest", "left_anti").select(*new.columns)
