"""Streaming jobs run over the given tables, which arrive in three slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from meander.functions.columns import epoch_seconds, rounded
from meander.functions.runtime import scratch_path
from meander.operators import alerts as al
from meander.operators import buffer
from meander.plans import inputs
from meander.plans.catalog_divergence import VEC_SIDES_SQL
from meander.plans.catalog_topology import ALERT_SQL
from meander.plans.inputs import EVALS_SQL, POINTS_SQL
from meander.plans.registry import query
from meander.streaming import fold, jobs

NOW_ONLY = {"availableNow": True}
CUTS = [1704931200.0, 1705795200.0]  # 2024-01-11 and 2024-01-21


def arrive(spark, rows, slice_of, start):
    """Let ``rows`` arrive in three slices, running the job on each; returns the job's folder."""
    source, path = scratch_path(spark, "arriving"), scratch_path(spark, "job")
    for i in range(3):
        rows.filter(slice_of == i).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        start(stream, path).awaitTermination()
    return path


def time_slice(ts):
    return F.when(ts < CUTS[0], 0).when(ts < CUTS[1], 1).otherwise(2)


def _scores(spark, sf_dir):
    return inputs.points(spark, sf_dir).select("metric_name", "ts", "seq", F.col("value").alias("score"))


@query(
    "stream_adaptive_threshold",
    "WITH " + POINTS_SQL + """, t AS (
  SELECT metric_name, ts, seq, value AS score,
         CASE WHEN count(*) OVER w < 2 THEN 0.15::DOUBLE
              ELSE greatest(0.05::DOUBLE, least(0.5::DOUBLE, avg(value) OVER w + 2.0::DOUBLE * stddev_samp(value) OVER w)) END AS threshold
  FROM points WINDOW w AS (PARTITION BY metric_name ORDER BY ts, seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT metric_name, ts, seq, score, round(threshold, 6) AS threshold, score > threshold AS drift_detected FROM t""",
)
def _stream_adaptive_threshold(spark, sf_dir):
    path = arrive(
        spark, _scores(spark, sf_dir), time_slice(F.col("ts")),
        lambda s, p: jobs.stream_adaptive_threshold(s, p, trigger=NOW_ONLY),
    )
    out = fold.read_output(spark, path, f"{jobs.SCORE_STATE}, threshold double, drift_detected boolean")
    return out.drop("batch").withColumn("threshold", rounded(F.col("threshold")))


@query(
    "stream_alerts",
    "WITH RECURSIVE " + ALERT_SQL + """, od AS (
  SELECT *, row_number() OVER (PARTITION BY metric_name, severity ORDER BY ts, seq) AS n FROM al),
walk AS (
  SELECT metric_name, severity, n, seq, ts, ts AS last_sent, true AS is_sent FROM od WHERE n = 1
  UNION ALL
  SELECT o.metric_name, o.severity, o.n, o.seq, o.ts, CASE WHEN o.ts >= w.last_sent + 21600.0::DOUBLE THEN o.ts ELSE w.last_sent END,
         o.ts >= w.last_sent + 21600.0::DOUBLE
  FROM walk w JOIN od o ON o.metric_name = w.metric_name AND o.severity = w.severity AND o.n = w.n + 1)
SELECT metric_name, severity, seq, ts, is_sent FROM walk""",
)
def _stream_alerts(spark, sf_dir):
    p = inputs.points(spark, sf_dir).filter(F.col("value") > 0.5)
    rows = p.select(
        "metric_name", al.alert_severity(F.col("value"), F.lit(0.5), (F.col("user_id") % 100) / 1000.0).alias("severity"), "ts", "seq"
    )
    path = arrive(spark, rows, time_slice(F.col("ts")), lambda s, p: jobs.stream_alerts(s, p, 21600.0, NOW_ONLY))
    return fold.read_output(spark, path, f"{jobs.ALERT_STATE}, is_sent boolean").drop("batch")


def _messages(spark, sf_dir):
    """Frame messages; every fifth arrives twice, a few seconds apart."""
    e = inputs.evaluations(spark, sf_dir)
    copies = F.when(F.col("id") % 5 == 0, F.array(F.lit(0), F.lit(7))).otherwise(F.array(F.lit(0)))
    at = F.timestamp_micros((epoch_seconds("timestamp") * 1e6).cast("long"))
    return e.select(at.alias("timestamp"), F.col("telemetry_frame").alias("value"), F.explode(copies).alias("delay")).select(
        (F.col("timestamp") + F.make_dt_interval(secs=F.col("delay"))).alias("timestamp"), "value"
    )


def _ingest(spark, sf_dir):
    rows = _messages(spark, sf_dir)
    return arrive(
        spark, rows, time_slice(F.unix_micros("timestamp") / 1e6),
        lambda s, p: jobs.stream_frames_ingest(s, p, late="30 days", trigger=NOW_ONLY),
    )


@query("stream_frames_ingest", "WITH " + EVALS_SQL + " SELECT trace_id, rag_type FROM evals WHERE rag_type <> 'custom'")
def _stream_frames_ingest(spark, sf_dir):
    path = _ingest(spark, sf_dir)
    return spark.read.parquet(f"{path}/frames").select("trace_id", "rag_type")


@query("stream_reject", "WITH " + EVALS_SQL + " SELECT DISTINCT telemetry_frame AS payload FROM evals WHERE rag_type = 'custom'")
def _stream_reject(spark, sf_dir):
    path = _ingest(spark, sf_dir)
    return spark.read.parquet(f"{path}/rejected").select("payload").distinct()


# --- buffers: vectors arrive by id modulo 3 -------------------------------------

ARRIVAL_SQL = VEC_SIDES_SQL + """, arr AS (SELECT track, vec_id, (vec_id % 3) * 1000000000 + vec_id AS seq FROM vecs)"""
FIFO_SQL = ARRIVAL_SQL + """, fifo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY seq DESC) AS r FROM arr) WHERE r <= 100)"""
RESERVOIR_SQL = ARRIVAL_SQL + """, res AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY md5('42:' || seq), seq) AS r FROM arr) WHERE r <= 100)"""


def _arrivals(spark, sf_dir):
    v = inputs.tracked_vectors(spark, sf_dir)
    return v.select(((F.col("vec_id") % 3) * 1_000_000_000 + F.col("vec_id")).alias("seq"), "track", "embedding")


def _buffered(spark, sf_dir, strategy):
    rows = _arrivals(spark, sf_dir)
    path = arrive(
        spark, rows, F.floor(F.col("seq") / 1_000_000_000),
        lambda s, p: jobs.stream_buffer(s, p, strategy, 200, NOW_ONLY),
    )
    return path, fold.latest_state(spark, path, jobs.VECTOR_STATE)


@query("vector_fifo", "WITH " + FIFO_SQL + " SELECT track, seq FROM fifo")
def _vector_fifo(spark, sf_dir):
    return buffer.vector_fifo(_arrivals(spark, sf_dir), capacity=200).select("track", "seq")


@query("vector_reservoir", "WITH " + RESERVOIR_SQL + " SELECT track, seq FROM res")
def _vector_reservoir(spark, sf_dir):
    return buffer.vector_reservoir(_arrivals(spark, sf_dir), capacity=200).select("track", "seq")


@query("stream_fifo", "WITH " + FIFO_SQL + " SELECT track, seq FROM fifo")
def _stream_fifo(spark, sf_dir):
    return _buffered(spark, sf_dir, "fifo")[1].select("track", "seq")


@query("stream_reservoir", "WITH " + RESERVOIR_SQL + " SELECT track, seq FROM res")
def _stream_reservoir(spark, sf_dir):
    return _buffered(spark, sf_dir, "reservoir")[1].select("track", "seq")


@query(
    "buffer_ready",
    "WITH " + FIFO_SQL + """ SELECT track, count(*) AS size, count(*) >= 50 AS is_ready FROM fifo GROUP BY 1
UNION ALL SELECT 'total', count(*), count(*) >= 50 FROM fifo""",
)
def _buffer_ready(spark, sf_dir):
    return buffer.buffer_ready(buffer.vector_fifo(_arrivals(spark, sf_dir), capacity=200))


@query(
    "buffer_flush",
    "WITH " + FIFO_SQL + """ SELECT 'both' AS snapshot, track, seq FROM fifo UNION ALL
SELECT 'retrieval', track, seq FROM fifo WHERE track = 'retrieval' UNION ALL
SELECT 'cleared', track, seq FROM fifo WHERE track <> 'retrieval'""",
)
def _buffer_flush(spark, sf_dir):
    buf = buffer.vector_fifo(_arrivals(spark, sf_dir), capacity=200).select("track", "seq")
    tag = lambda df, name: df.select(F.lit(name).alias("snapshot"), "track", "seq")
    return tag(buffer.buffer_flush(buf), "both").unionByName(tag(buffer.buffer_flush(buf, "retrieval"), "retrieval")).unionByName(
        tag(buffer.buffer_clear(buf, "retrieval"), "cleared")
    )


@query("stream_drift")
def _stream_drift(spark, sf_dir):
    """Odd vectors stream in; even ones are the baseline table."""
    v = inputs.tracked_vectors(spark, sf_dir)
    rows = v.filter("is_current").select(F.col("vec_id").alias("seq"), "track", "embedding")
    base = v.filter("NOT is_current").select("track", F.col("vec_id").alias("seq"), "embedding")
    path = arrive(
        spark, rows, F.col("seq") % 3, lambda s, p: jobs.stream_drift(s, base, p, trigger=NOW_ONLY)
    )
    out = fold.read_output(spark, path, "track string, drift_score double, drift_detected boolean, n_samples_current long")
    return out.withColumn("drift_score", rounded(F.col("drift_score")))


# --- rollups: only windows closed by the watermark are written --------------------

CLOSED = "(SELECT max(epoch(ts)) - 3600 FROM events)"


def _rollup(spark, sf_dir, **kw):
    rows = inputs.points(spark, sf_dir).select(
        "metric_name", F.timestamp_micros((F.col("ts") * 1e6).cast("long")).alias("timestamp"), F.col("value").alias("score")
    )
    path = arrive(
        spark, rows, time_slice(F.unix_micros("timestamp") / 1e6),
        lambda s, p: jobs.stream_rollups(s, p, ["metric_name"], trigger=NOW_ONLY, **kw),
    )
    out = spark.read.parquet(f"{path}/output")
    return out.select(
        "metric_name", (F.unix_micros("start") / 1e6).alias("start"), (F.unix_micros("end") / 1e6).alias("end"),
        "n", rounded(F.col("mean")).alias("mean"), "peak",
    )


@query(
    "stream_rollups",
    "WITH " + POINTS_SQL + f"""
SELECT * FROM (
  SELECT metric_name, floor(ts / 86400) * 86400.0::DOUBLE AS start, floor(ts / 86400) * 86400.0::DOUBLE + 86400.0::DOUBLE AS "end", count(*) AS n,
         round(avg(value), 6) AS mean, max(value) AS peak FROM points GROUP BY 1, 2, 3) WHERE "end" <= {CLOSED}""",
)
def _stream_rollups(spark, sf_dir):
    return _rollup(spark, sf_dir, window="1 day")


@query(
    "stream_rollups_sliding",
    "WITH " + POINTS_SQL + f""", w AS (
  SELECT metric_name, value, (floor(ts / 43200) - k) * 43200.0::DOUBLE AS s FROM points, range(0, 2) g(k))
SELECT metric_name, s AS start, s + 86400.0::DOUBLE AS "end", count(*) AS n, round(avg(value), 6) AS mean, max(value) AS peak
FROM w GROUP BY 1, 2 HAVING s + 86400 <= {CLOSED}""",
)
def _stream_rollups_sliding(spark, sf_dir):
    return _rollup(spark, sf_dir, window="1 day", slide="12 hours")


@query(
    "stream_rollups_session",
    "WITH " + POINTS_SQL + f""", g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < 1800 THEN 0 ELSE 1 END AS fresh FROM points WINDOW w AS (PARTITION BY metric_name ORDER BY ts, seq)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY metric_name ORDER BY ts, seq) AS sid FROM g)
SELECT metric_name, min(ts) AS start, round(max(ts) + 1800, 6) AS "end", count(*) AS n, round(avg(value), 6) AS mean, max(value) AS peak
FROM s GROUP BY metric_name, sid HAVING max(ts) + 1800 <= {CLOSED}""",
)
def _stream_rollups_session(spark, sf_dir):
    return _rollup(spark, sf_dir, session_gap="30 minutes").withColumn("end", rounded(F.col("end")))
