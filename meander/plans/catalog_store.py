"""Queries over history files and the evaluation table."""

from __future__ import annotations

from pyspark.sql import functions as F

from meander.functions.columns import epoch_seconds, rounded
from meander.functions.runtime import scratch_path
from meander.operators import series, store
from meander.plans import inputs
from meander.plans.inputs import EVALS_SQL, FRAME_NOW, HISTORY_SQL, POINTS_SQL
from meander.plans.registry import query
from meander.sources import evaluations as ev
from meander.sources import history as hs



def now():
    return F.to_timestamp_ntz(F.lit(FRAME_NOW))


METRICS_SQL = HISTORY_SQL + """, met AS (
  SELECT system, run_id, timestamp, seq, 0 AS pos, 'js_divergence' AS metric_name, js_value AS value,
         'DriftResult' AS kind, NULL AS m_run, 'r0' AS m_base, CASE WHEN seq % 2 = 0 THEN run_id END AS m_cur FROM hist
  UNION ALL
  SELECT system, run_id, timestamp, seq, 1, 'faithfulness', quality, 'QualityResult',
         CASE WHEN seq % 3 = 0 THEN run_id || 'q' END, NULL, NULL FROM hist)"""


def _flat_history(df):
    return df.select(
        "record_id", "run_id", "timestamp", "system_version", F.size("metrics").alias("n_metrics"),
        F.col("metadata")["pipeline_name"].alias("pipeline_name"), F.col("metadata")["tier"].alias("tier"),
    )


FLAT_SQL = """SELECT record_id, run_id, timestamp, system_version, 2 AS n_metrics, pipeline_name, tier FROM hist"""


@query("history_scan", "WITH " + HISTORY_SQL + FLAT_SQL.replace("FROM hist", "FROM hist"))
def _history_scan(spark, sf_dir):
    """Write JSON lines mixed with blank and malformed ones, then read them back."""
    path = scratch_path(spark, "lines")
    rows = inputs.history(spark, sf_dir)
    line = F.to_json(F.struct("record_id", "run_id", "timestamp", "system_version", "metrics", "metadata", "seq"))
    extra = F.when(F.col("seq") % 4 == 0, F.array(line, F.lit('{"run_id": broken'))).when(
        F.col("seq") % 4 == 1, F.array(line, F.lit(""))
    )
    rows.select(F.explode(F.coalesce(extra, F.array(line))).alias("value")).write.text(path)
    return _flat_history(hs.history_scan(spark, path))


@query("history_append", "WITH " + HISTORY_SQL + FLAT_SQL)
def _history_append(spark, sf_dir):
    path = scratch_path(spark, "history")
    rows = inputs.history(spark, sf_dir).drop("seq", "system")
    old = F.col("timestamp") < 852076800.0  # 1997-01-01
    hs.history_append(rows.filter(old), path)
    hs.history_append(rows.filter(~old), path, hs.next_seq(spark, path))
    return _flat_history(hs.history_scan(spark, path))


@query("history_compact", "WITH " + HISTORY_SQL + FLAT_SQL + " WHERE timestamp >= 852076800.0")
def _history_compact(spark, sf_dir):
    """Old records are stored and cleared, newer ones appended in two batches that become one."""
    path = scratch_path(spark, "history")
    rows = inputs.history(spark, sf_dir).drop("seq", "system")
    old, odd = F.col("timestamp") < 852076800.0, F.pmod(F.xxhash64("record_id"), F.lit(2)) == 1  # 1997-01-01
    hs.history_append(rows.filter(old), path)
    hs.history_clear(spark, path)
    hs.history_append(rows.filter(~old & odd), path)
    hs.history_append(rows.filter(~old & ~odd), path)
    hs.history_compact(spark, path)
    return _flat_history(hs.history_scan(spark, path))


@query("records_ingest_json", "WITH " + HISTORY_SQL + FLAT_SQL)
def _records_ingest_json(spark, sf_dir):
    """Files that each hold an array of a thousand records, ingested into a history."""
    source, path = scratch_path(spark, "arrays"), scratch_path(spark, "history")
    rows = inputs.history(spark, sf_dir).drop("system")
    one = F.struct(*[c for c in rows.columns])
    rows.groupBy(F.floor(F.col("seq") / 1000)).agg(
        F.to_json(F.collect_list(one)).alias("value")
    ).select("value").write.option("maxRecordsPerFile", 1).text(source)
    hs.history_append(hs.records_ingest_json(spark, source).drop("seq"), path)
    return _flat_history(hs.history_scan(spark, path))


@query("history_by_run", "WITH " + HISTORY_SQL + FLAT_SQL + " WHERE run_id = 'r7'")
def _history_by_run(spark, sf_dir):
    path = scratch_path(spark, "history")
    hs.history_append(inputs.history(spark, sf_dir).drop("seq", "system"), path)
    return _flat_history(hs.history_by_run(spark, path, "r7"))


@query("history_by_metric", "WITH " + HISTORY_SQL + FLAT_SQL + " WHERE seq % 5 <> 0")
def _history_by_metric(spark, sf_dir):
    """Every fifth record is stored without the metric that is asked for."""
    path = scratch_path(spark, "history")
    rows = inputs.history(spark, sf_dir)
    others = F.filter("metrics", lambda m: m["metric_name"] != "faithfulness")
    rows = rows.withColumn("metrics", F.when(F.col("seq") % 5 == 0, others).otherwise(F.col("metrics")))
    hs.history_append(rows.drop("seq", "system"), path)
    return _flat_history(hs.history_by_metric(spark, path, "faithfulness"))


@query(
    "metric_series",
    "WITH " + METRICS_SQL + """
SELECT system, metric_name, timestamp AS ts, seq, pos, value, coalesce(m_run, m_cur, run_id, '') AS run_id
FROM met WHERE metric_name = 'js_divergence'""",
)
def _metric_series(spark, sf_dir):
    return series.metric_series(inputs.history(spark, sf_dir), "js_divergence", ["system"])


@query(
    "run_id_resolve",
    "WITH " + METRICS_SQL + """
SELECT seq, pos, metric_name, coalesce(m_run, m_cur, run_id, '') AS run_id FROM met""",
)
def _run_id_resolve(spark, sf_dir):
    return series.metric_series(inputs.history(spark, sf_dir)).select("seq", "pos", "metric_name", "run_id")


@query(
    "metric_result_codec",
    "WITH " + METRICS_SQL + """
SELECT seq, kind AS type, metric_name, value, m_run AS run_id, m_base AS baseline_run_id, m_cur AS current_run_id FROM met""",
)
def _metric_result_codec(spark, sf_dir):
    from meander.operators.records import metric_from_json, metric_to_json

    flat = inputs.history(spark, sf_dir).select("seq", F.explode("metrics").alias("m"))
    coded = flat.select("seq", metric_to_json(F.col("m")).alias("text"))
    m = metric_from_json(F.col("text"))
    return coded.select("seq", m.alias("m")).select(
        "seq", F.col("m._type").alias("type"), "m.metric_name", "m.value", "m.run_id",
        "m.baseline_run_id", "m.current_run_id",
    )


def _stored(df):
    return df.select(
        "trace_id", "rag_type", epoch_seconds("timestamp").alias("ts"), "js_divergence", "mmd_score",
        "is_drifted", "telemetry_frame",
    )


@query(
    "frames_append",
    "WITH " + EVALS_SQL + """
SELECT trace_id, rag_type, epoch(timestamp) AS ts, CAST(NULL AS DOUBLE) AS js_divergence,
       CAST(NULL AS DOUBLE) AS mmd_score, false AS is_drifted, telemetry_frame FROM evals""",
)
def _frames_append(spark, sf_dir):
    path = scratch_path(spark, "evaluations")
    frames = inputs.evaluations(spark, sf_dir).select("trace_id", "rag_type", "timestamp", "telemetry_frame")
    ev.frames_append(frames, path)
    return _stored(ev.read_evaluations(spark, path))


WINDOW_SQL = EVALS_SQL + """, wm AS (
  SELECT rag_type, avg(js_divergence) AS js, avg(mmd_score) AS mmd, avg(js_divergence) > 0.5::DOUBLE AS d
  FROM evals GROUP BY 1)"""


def _window_metrics(evals):
    return evals.groupBy("rag_type").agg(
        F.avg("js_divergence").alias("js_divergence"), F.avg("mmd_score").alias("mmd_score"),
        (F.avg("js_divergence") > 0.5).alias("is_drifted"),
    )


@query(
    "evaluation_write",
    "WITH " + WINDOW_SQL + """
SELECT trace_id, rag_type, epoch(timestamp) AS ts, round(js, 6) AS js_divergence, round(mmd, 6) AS mmd_score,
       d AS is_drifted, telemetry_frame FROM evals JOIN wm USING (rag_type)""",
)
def _evaluation_write(spark, sf_dir):
    path = scratch_path(spark, "evaluations")
    evals = inputs.evaluations(spark, sf_dir)
    frames = evals.select("trace_id", "rag_type", "timestamp", "telemetry_frame")
    ev.evaluation_write(frames, _window_metrics(evals), ["rag_type"], path)
    out = _stored(ev.read_evaluations(spark, path))
    return out.withColumns(
        {"js_divergence": rounded(F.col("js_divergence")), "mmd_score": rounded(F.col("mmd_score"))}
    )


@query(
    "drift_result_write",
    "WITH " + WINDOW_SQL + """
SELECT rag_type AS source, 'custom' AS rag_type, round(js, 6) AS js_divergence, d AS is_drifted,
       round(mmd, 6) AS payload_mmd FROM wm""",
)
def _drift_result_write(spark, sf_dir):
    path = scratch_path(spark, "evaluations")
    results = _window_metrics(inputs.evaluations(spark, sf_dir)).withColumnRenamed("rag_type", "source")
    ev.drift_result_write(results, now(), path)
    doc = F.from_json("telemetry_frame", "source string, mmd_score double")
    return ev.read_evaluations(spark, path).select(
        doc["source"].alias("source"), "rag_type", rounded(F.col("js_divergence")).alias("js_divergence"),
        "is_drifted", rounded(doc["mmd_score"]).alias("payload_mmd"),
    )


@query("history_truncate", "SELECT 'after' AS state, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'before', count(*) FROM events")
def _history_truncate(spark, sf_dir):
    path = scratch_path(spark, "evaluations")
    frames = inputs.evaluations(spark, sf_dir).select("trace_id", "rag_type", "timestamp", "telemetry_frame")
    ev.frames_append(frames, path)
    before = ev.read_evaluations(spark, path).agg(F.count(F.lit(1)).alias("n"))
    before = spark.createDataFrame(before.collect(), before.schema)  # one number, kept past the truncation
    ev.history_truncate(spark, path)
    after = ev.read_evaluations(spark, path).agg(F.count(F.lit(1)).alias("n"))
    return before.select(F.lit("before").alias("state"), "n").union(after.select(F.lit("after"), "n"))


@query(
    "chunk_upsert",
    """WITH f AS (SELECT text AS content, min(CASE WHEN doc_id % 2 = 0 THEN doc_id END) AS stored, min(doc_id) AS any_id
  FROM documents GROUP BY 1)
SELECT coalesce(stored, any_id) AS id, md5(content) AS digest FROM f""",
)
def _chunk_upsert(spark, sf_dir):
    """Even documents are loaded first; odd ones only add contents not stored yet."""
    path = scratch_path(spark, "chunks")
    docs = inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    even = F.col("id") % 2 == 0
    ev.chunk_upsert(spark, docs.filter(even), None).write.parquet(path)
    ev.chunk_upsert(spark, docs.filter(~even), path).write.mode("append").parquet(path)
    return spark.read.parquet(path).select("id", F.md5("content").alias("digest"))


FRAME_SQL = EVALS_SQL + """, fr AS (
  SELECT *, CASE WHEN json_valid(telemetry_frame) THEN CAST(telemetry_frame AS JSON) END AS j FROM evals),
frames AS (SELECT *, json_extract_string(j, '$.query.text') AS query_text,
                  CAST(json_extract_string(j, '$.metadata.reflection_iterations') AS INTEGER) AS reflections,
                  CAST(json_extract_string(j, '$.output.confidence_score') AS DOUBLE) AS confidence
           FROM fr WHERE json_extract_string(j, '$.query.text') IS NOT NULL)"""
FRAME_COLS = "trace_id, rag_type, epoch(timestamp) AS ts, query_text, reflections"


def _frame_cols(df):
    return df.select(
        "trace_id", "rag_type", epoch_seconds("timestamp").alias("ts"),
        F.col("frame.query.text").alias("query_text"),
        F.col("frame.metadata.reflection_iterations").alias("reflections"),
    )


@query("payload_parse", "WITH " + FRAME_SQL + f"SELECT {FRAME_COLS} FROM frames")
def _payload_parse(spark, sf_dir):
    evals = inputs.evaluations(spark, sf_dir)
    return _frame_cols(store.payload_parse(evals, keep=["trace_id", "rag_type", "timestamp"]))


def _picked(where: str, order: str, limit: int) -> str:
    return f""", picked AS (SELECT id FROM evals {where} ORDER BY {order} LIMIT {limit})
SELECT {FRAME_COLS} FROM frames WHERE id IN (SELECT id FROM picked)"""


@query("recent_frames", "WITH " + FRAME_SQL + _picked("", "timestamp DESC, id DESC", 100))
def _recent_frames(spark, sf_dir):
    return _frame_cols(store.recent_frames(inputs.evaluations(spark, sf_dir)))


def _evaluation_table(spark, sf_dir):
    """The evaluation rows, stored by day and read back."""
    path = scratch_path(spark, "evaluations")
    rows = inputs.evaluations(spark, sf_dir).withColumn("wasserstein_distance", F.lit(None).cast("double"))
    ev.evaluations_append(rows, path)
    return ev.read_evaluations(spark, path)


LAST_DAY = "WHERE timestamp >= TIMESTAMP '2024-01-30 00:00:00'"


@query("frames_time_window", "WITH " + FRAME_SQL + _picked(LAST_DAY, "timestamp, id", 100))
def _frames_time_window(spark, sf_dir):
    return _frame_cols(store.frames_time_window(_evaluation_table(spark, sf_dir), now()))


@query("sliding_baseline", "WITH " + FRAME_SQL + _picked("WHERE timestamp >= TIMESTAMP '2024-01-24 00:00:00'", "timestamp, id", 100))
def _sliding_baseline(spark, sf_dir):
    return _frame_cols(store.sliding_baseline(_evaluation_table(spark, sf_dir), now(), hours=24 * 7))


HIST_COLS = """CAST(id AS BIGINT) AS id, trace_id, rag_type, epoch(timestamp) AS ts, js_divergence AS jsd_score, mmd_score,
 CAST(json_extract_string(j, '$.mmd_p_value') AS DOUBLE) AS mmd_p_value,
 CAST(json_extract_string(j, '$.max_component_kl') AS DOUBLE) AS max_component_kl, is_drifted"""


def _hist_out(df, *extra):
    return df.select(
        "id", "trace_id", "rag_type", epoch_seconds("timestamp").alias("ts"), "jsd_score", "mmd_score",
        "mmd_p_value", "max_component_kl", "is_drifted", *extra,
    )


@query(
    "recent_history",
    "WITH " + FRAME_SQL + f"""
SELECT {HIST_COLS}, coalesce(CAST(json_extract_string(j, '$.sample_size') AS BIGINT), 0) AS sample_size FROM fr {LAST_DAY}""",
)
def _recent_history(spark, sf_dir):
    return _hist_out(store.recent_history(_evaluation_table(spark, sf_dir), now()), "sample_size")


@query("latest_drift", "WITH " + FRAME_SQL + f" SELECT {HIST_COLS} FROM fr ORDER BY timestamp DESC, id DESC LIMIT 1")
def _latest_drift(spark, sf_dir):
    return _hist_out(store.latest_drift(inputs.evaluations(spark, sf_dir)))


@query(
    "store_stats",
    "WITH " + FRAME_SQL + """
SELECT 'total_frames' AS stat, count(*) AS value FROM fr UNION ALL
SELECT 'frames_with_graph_payloads', count(*) FROM fr WHERE json_type(j, '$.context.graph_topology') = 'OBJECT' UNION ALL
SELECT 'frames_with_swarm_metadata', count(*) FROM fr WHERE json_type(j, '$.metadata.agent_hops') = 'ARRAY' UNION ALL
SELECT 'rag_type:' || rag_type, count(*) FROM fr GROUP BY 1""",
)
def _store_stats(spark, sf_dir):
    return store.store_stats(inputs.evaluations(spark, sf_dir))


@query(
    "dashboard_frames",
    "WITH " + FRAME_SQL + """, picked AS (SELECT id FROM evals ORDER BY timestamp DESC, id DESC LIMIT 10)
SELECT trace_id, rag_type, epoch(timestamp) AS ts, query_text AS query, confidence FROM frames WHERE id IN (SELECT id FROM picked)""",
)
def _dashboard_frames(spark, sf_dir):
    out = store.dashboard_frames(store.recent_frames(inputs.evaluations(spark, sf_dir), limit=10))
    return out.select("trace_id", "rag_type", epoch_seconds("timestamp").alias("ts"), "query", "confidence")


TRENDED_SQL = POINTS_SQL + """, tr AS (
  SELECT metric_name, ts, seq, CASE WHEN count(value) OVER w = 30 THEN avg(value) OVER w END AS m,
         CASE WHEN count(value) OVER w = 30 THEN stddev_samp(value) OVER w END AS s
  FROM points WINDOW w AS (PARTITION BY metric_name ORDER BY ts, seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"""


@query(
    "dashboard_band",
    "WITH " + TRENDED_SQL + """
SELECT metric_name, ts, seq, round(m + 2.0::DOUBLE * s, 6) AS upper_band, round(m - 2.0::DOUBLE * s, 6) + 0.0::DOUBLE AS lower_band FROM tr""",
)
def _dashboard_band(spark, sf_dir):
    scores = inputs.points(spark, sf_dir).withColumnRenamed("value", "score")
    out = store.trend_band(series.trend(scores, ["metric_name"]))
    return out.select(
        "metric_name", "ts", "seq", rounded(F.col("upper_band")).alias("upper_band"),
        rounded(F.col("lower_band")).alias("lower_band"),
    )


@query(
    "trend_analysis",
    "WITH " + EVALS_SQL + """, w AS (
  SELECT *, CASE WHEN count(js_divergence) OVER w = 30 THEN avg(js_divergence) OVER w END AS rolling_mean,
         CASE WHEN count(js_divergence) OVER w = 30 THEN stddev_samp(js_divergence) OVER w END AS rolling_std
  FROM evals WINDOW w AS (PARTITION BY rag_type ORDER BY timestamp, id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT id, rag_type, epoch(timestamp) AS ts, js_divergence AS jsd_score, round(rolling_mean, 6) AS rolling_mean,
       round(rolling_std, 6) AS rolling_std,
       coalesce(rolling_std <> 0 AND js_divergence > rolling_mean + 2.0::DOUBLE * rolling_std, false) AS is_anomaly,
       timestamp >= TIMESTAMP '2024-01-30 00:00:00' AS in_history FROM w""",
)
def _trend_analysis(spark, sf_dir):
    out = store.trend_analysis(inputs.evaluations(spark, sf_dir), now(), ["rag_type"])
    return out.select(
        "id", "rag_type", epoch_seconds("timestamp").alias("ts"), "jsd_score",
        rounded(F.col("rolling_mean")).alias("rolling_mean"), rounded(F.col("rolling_std")).alias("rolling_std"),
        "is_anomaly", "in_history",
    )
