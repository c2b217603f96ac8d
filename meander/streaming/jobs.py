"""The streaming jobs.  Each gives the rows its batch counterpart would."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meander.functions.runtime import cut_lineage
from meander.operators import alerts, buffer, series
from meander.schemas import FRAME, RAG_TYPES
from meander.streaming.fold import fold_stream

BATCH_FRAMES = 50
FLUSH_SECONDS = 5


def parse_messages(messages: DataFrame, payload: str = "value") -> DataFrame:
    """Messages with their frame struct (``frame``), null when the payload is no frame."""
    f = F.from_json(payload, FRAME)
    valid = (
        f["query"]["text"].isNotNull() & f["context"]["text_chunks"].isNotNull()
        & f["metadata"]["rag_type"].isin(RAG_TYPES) & f["output"]["generated_answer"].isNotNull()
    )
    return messages.withColumn("frame", F.when(valid, f))


def stream_frames_ingest(
    messages: DataFrame, path: str, timestamp: str = "timestamp", payload: str = "value",
    late: str = "1 hour", trigger: dict | None = None,
) -> StreamingQuery:
    """Store valid frames once per trace id and quarantine the rest.

    Frames repeated within the watermark delay are dropped.  Below ``path``:
    ``frames`` and ``rejected``, each with one folder per batch, overwritten when a
    batch is repeated.
    """
    parsed = parse_messages(messages, payload).withColumn("trace_id", F.coalesce("frame.trace_id", F.md5(payload)))
    once = parsed.withWatermark(timestamp, late).dropDuplicatesWithinWatermark(["trace_id"])

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        good = batch.filter(F.col("frame").isNotNull()).select(
            "trace_id", F.col("frame.metadata.rag_type").alias("rag_type"), timestamp, F.col(payload).alias("telemetry_frame")
        )
        bad = batch.filter(F.col("frame").isNull()).select(timestamp, F.col(payload).alias("payload"))
        good.write.mode("overwrite").parquet(f"{path}/frames/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{path}/rejected/batch={batch_id}")
        batch.unpersist()

    return (
        once.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**(trigger or {"processingTime": f"{FLUSH_SECONDS} seconds"}))
        .start()
    )


VECTOR_STATE = "seq long, track string, embedding array<double>"


def stream_buffer(
    vectors: DataFrame, path: str, strategy: str = "reservoir", capacity: int = buffer.CAPACITY, trigger: dict | None = None
) -> StreamingQuery:
    """Keep a bounded buffer per track; each batch outputs its sizes and readiness."""
    keep = {"reservoir": buffer.vector_reservoir, "fifo": buffer.vector_fifo}[strategy]

    def update(state, batch):
        new = keep(state.unionByName(batch.select("seq", "track", "embedding")), capacity=capacity)
        return new, buffer.buffer_ready(new)

    return fold_stream(vectors, update, VECTOR_STATE, path, trigger)


def stream_drift(
    vectors: DataFrame, baseline: DataFrame, path: str, capacity: int = buffer.CAPACITY,
    min_samples: int = buffer.MIN_SAMPLES, metric: str = "mmd", threshold: float = 0.15, trigger: dict | None = None,
    method: str = "pairs",
) -> StreamingQuery:
    """Score the buffered vectors of each ready track against its baseline table.

    ``baseline``: ``track, seq, embedding``.  With ``method="features"`` a batch compares the baseline with the buffer for
    the kernel's width, but not with itself.
    """
    from meander.operators.latent import latent_drift, tag_union

    def update(state, batch):
        new = buffer.vector_reservoir(state.unionByName(batch.select("seq", "track", "embedding")), capacity=capacity)
        new = cut_lineage(new)  # at most the buffer's capacity
        ready = buffer.buffer_ready(new, min_samples=min_samples).filter("is_ready AND track <> 'total'").select("track")
        both = tag_union(
            baseline.select("track", F.concat(F.lit("b"), "seq").alias("vec_id"), "embedding"),
            new.select("track", F.concat(F.lit("c"), "seq").alias("vec_id"), "embedding"),
        ).join(ready, "track", "left_semi")
        if ready.isEmpty():
            empty = new.sparkSession.createDataFrame(
                [], "track string, drift_score double, drift_detected boolean, n_samples_current long"
            )
            return new, empty
        scored = latent_drift(both, ["track"], metric, threshold, method=method)
        return new, scored.select("track", "drift_score", "drift_detected", "n_samples_current")

    return fold_stream(vectors, update, VECTOR_STATE, path, trigger)


SCORE_STATE = "metric_name string, ts double, seq long, score double"


def stream_adaptive_threshold(scores: DataFrame, path: str, window: int = 30, trigger: dict | None = None) -> StreamingQuery:
    """Rolling threshold per series; the last ``window - 1`` scores carry over.

    Batches arrive in time order within a series.
    """
    from pyspark.sql import Window

    cols = ["metric_name", "ts", "seq", "score"]

    def update(state, batch):
        tail = state.withColumn("_old", F.lit(True))
        rows = tail.unionByName(batch.select(*cols).withColumn("_old", F.lit(False)))
        out = series.adaptive_threshold(rows, ["metric_name"], window=window).filter("NOT _old").drop("_old")
        last = Window.partitionBy("metric_name").orderBy(F.desc("ts"), F.desc("seq"))
        new = rows.withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= window - 1).select(*cols)
        return new, out

    return fold_stream(scores, update, SCORE_STATE, path, trigger)


ALERT_STATE = "metric_name string, severity string, ts double, seq long"


def stream_alerts(rows: DataFrame, path: str, cooldown_s: float = alerts.COOLDOWN_S, trigger: dict | None = None) -> StreamingQuery:
    """Mark the alerts to send; the last alert sent per key carries over."""
    key = ["metric_name", "severity"]

    def update(state, batch):
        last = state.select(*key, F.col("ts").alias("_last"))
        fresh = batch.select(*key, "ts", "seq").join(last, key, "left")
        late = fresh.filter(F.col("ts") < F.col("_last")).drop("_last").withColumn("is_sent", F.lit(False))
        on_time = fresh.filter(F.col("_last").isNull() | (F.col("ts") >= F.col("_last"))).drop("_last")
        # the last alert sent goes first, so the cooldown counts from it
        rows = state.withColumns({"_old": F.lit(True), "_k": F.lit(0).cast("long")}).unionByName(
            on_time.withColumns({"_old": F.lit(False), "_k": F.col("seq") + 1})
        )
        marked = alerts.alert_suppress(rows, key, "ts", "_k", cooldown_s)
        sent = marked.filter("is_sent").groupBy(*key).agg(F.max_by(F.struct("ts", "seq"), F.struct("ts", "_k")).alias("m"))
        out = marked.filter("NOT _old").select(*key, "ts", "seq", "is_sent").unionByName(late)
        return sent.select(*key, "m.ts", "m.seq"), out

    return fold_stream(rows, update, ALERT_STATE, path, trigger)


def rollup_columns() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.max("score").alias("peak"),
    ]


def stream_rollups(
    scores: DataFrame, path: str, by: list[str], window: str = "1 day", slide: str | None = None,
    session_gap: str | None = None, late: str = "1 hour", trigger: dict | None = None,
) -> StreamingQuery:
    """Counts and means per event-time window; a window is written once it can no longer change."""
    marked = scores.withWatermark("timestamp", late)
    if session_gap:
        bucket = F.session_window("timestamp", session_gap)
    else:
        bucket = F.window("timestamp", window, slide) if slide else F.window("timestamp", window)
    out = marked.groupBy(bucket.alias("w"), *by).agg(*rollup_columns())
    flat = out.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "peak")
    return (
        flat.writeStream.outputMode("append").format("parquet")
        .option("path", f"{path}/output").option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**(trigger or {"processingTime": f"{FLUSH_SECONDS} seconds"}))
        .start()
    )
