"""Reads of the evaluation table: recent rows, time windows, payload fields, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meander.schemas import DRIFT_PAYLOAD, FRAME, RAG_TYPES


def payload_parse(rows: DataFrame, payload: str = "telemetry_frame", keep: list[str] = []) -> DataFrame:
    """Rows whose payload is a telemetry frame, with the frame as struct ``frame``."""
    parsed = rows.withColumn("frame", F.from_json(payload, FRAME, {"mode": "PERMISSIVE"}))
    f = F.col("frame")
    valid = (
        f["query"]["text"].isNotNull()
        & f["context"]["text_chunks"].isNotNull()
        & f["metadata"]["rag_type"].isin(RAG_TYPES)
        & f["output"]["generated_answer"].isNotNull()
    )
    return parsed.filter(valid).select(*keep, "frame")


def _parsed(rows: DataFrame) -> DataFrame:
    return payload_parse(rows, keep=["id", "trace_id", "rag_type", "timestamp"])


def recent_frames(evals: DataFrame, rag_type: str | None = None, limit: int = 100) -> DataFrame:
    """The newest ``limit`` rows, then only those that hold a frame."""
    rows = evals if rag_type is None else evals.filter(F.col("rag_type") == rag_type)
    return _parsed(rows.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit))


def _since(evals: DataFrame, cutoff: Column) -> DataFrame:
    """Rows from ``cutoff`` on; of a stored table only the day folders from its day on are read."""
    rows = evals.filter(F.col("timestamp") >= cutoff)
    return rows.filter(F.col("date") >= F.to_date(cutoff)) if "date" in evals.columns else rows


def frames_time_window(evals: DataFrame, now: Column, hours: int = 24, limit: int = 100) -> DataFrame:
    """The oldest ``limit`` rows of the last ``hours`` hours, oldest first."""
    cutoff = now - F.make_dt_interval(hours=F.lit(hours))
    rows = _since(evals, cutoff).orderBy("timestamp", "id").limit(limit)
    return _parsed(rows)


def sliding_baseline(evals: DataFrame, now: Column, hours: int = 24, limit: int = 100) -> DataFrame:
    """The baseline window used when no explicit baseline is given."""
    return frames_time_window(evals, now, hours, limit)


def _history_columns(with_size: bool) -> list[Column]:
    p = F.from_json("telemetry_frame", DRIFT_PAYLOAD)
    cols = [
        F.col("id"), F.col("trace_id"), F.col("rag_type"), F.col("timestamp"),
        F.col("js_divergence").alias("jsd_score"), F.col("mmd_score"),
        p["mmd_p_value"].alias("mmd_p_value"), p["max_component_kl"].alias("max_component_kl"),
        F.coalesce("is_drifted", F.lit(False)).alias("is_drifted"),
    ]
    if with_size:
        cols.append(F.coalesce(p["sample_size"], F.lit(0).cast("long")).alias("sample_size"))
    return [*cols, F.col("telemetry_frame").alias("metadata")]


def recent_history(evals: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    cutoff = now - F.make_dt_interval(hours=F.lit(hours))
    return _since(evals, cutoff).select(*_history_columns(True))


def latest_drift(evals: DataFrame) -> DataFrame:
    return evals.orderBy(F.desc("timestamp"), F.desc("id")).limit(1).select(*_history_columns(False))


def store_stats(evals: DataFrame) -> DataFrame:
    """Long table ``(stat, value)``: total, rows per kind, rows with graph or hop payloads."""
    doc = F.try_parse_json("telemetry_frame")
    part = lambda path: F.schema_of_variant(F.try_variant_get(doc, path, "variant"))
    flags = evals.select(
        "rag_type",
        part("$.context.graph_topology").startswith("OBJECT").alias("has_graph"),
        part("$.metadata.agent_hops").startswith("ARRAY").alias("has_hops"),
    )
    per_type = flags.groupBy("rag_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("has_graph").alias("graphs"),
        F.count_if("has_hops").alias("hops"),
    )
    totals = per_type.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("graphs"), F.lit(0)).alias("graphs"),
        F.coalesce(F.sum("hops"), F.lit(0)).alias("hops"),
    )
    row = lambda name, c: F.struct(F.lit(name).alias("stat"), F.col(c).alias("value"))
    summary = totals.select(
        F.inline(
            F.array(
                row("total_frames", "n"),
                row("frames_with_graph_payloads", "graphs"),
                row("frames_with_swarm_metadata", "hops"),
            )
        )
    )
    by_type = per_type.select(F.concat(F.lit("rag_type:"), "rag_type").alias("stat"), F.col("n").alias("value"))
    return summary.unionByName(by_type)


def dashboard_frames(frames: DataFrame) -> DataFrame:
    """Display columns of recent frames."""
    return frames.select(
        F.col("trace_id"),
        F.col("frame.metadata.rag_type").alias("rag_type"),
        F.col("timestamp"),
        F.col("frame.query.text").alias("query"),
        F.col("frame.output.confidence_score").alias("confidence"),
    )


def trend_band(trended: DataFrame, k: float = 2.0) -> DataFrame:
    """Upper and lower band of a rolling trend."""
    width = F.lit(float(k)) * F.col("rolling_std")
    return trended.withColumns(
        {"upper_band": F.col("rolling_mean") + width, "lower_band": F.col("rolling_mean") - width}
    )


def trend_analysis(
    evals: DataFrame, now: Column, by: list[str], hours: int = 24, window: int = 30
) -> DataFrame:
    """Every row with its rolling trend, its anomaly flag and whether it is recent history."""
    from meander.operators.series import trend, with_anomaly

    scores = evals.withColumnRenamed("js_divergence", "jsd_score")
    out = with_anomaly(trend(scores, by, ["timestamp", "id"], "jsd_score", window), "jsd_score")
    cutoff = now - F.make_dt_interval(hours=F.lit(hours))
    return out.withColumn("in_history", F.col("timestamp") >= cutoff)
