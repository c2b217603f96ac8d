"""Queries over metric series and stored evaluation rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from meander.functions.columns import rounded
from meander.operators import series
from meander.plans import inputs
from meander.plans.inputs import POINTS_SQL
from meander.plans.registry import query

SHIFT_SQL = POINTS_SQL + """, num AS (
  SELECT *, row_number() OVER (PARTITION BY metric_name ORDER BY ts, seq) AS n FROM points),
blk AS (
  SELECT metric_name, (n - 1) // 3 AS block, avg(value) AS mean, min(ts) AS start_ts, max(ts) AS end_ts,
         string_agg(run_id, ',' ORDER BY n) AS runs
  FROM num GROUP BY 1, 2 HAVING count(*) = 3),
shift AS (
  SELECT c.metric_name, c.block, c.start_ts, c.end_ts, abs(c.mean - p.mean) AS magnitude,
         p.mean AS mean_previous, c.mean AS mean_current, c.runs
  FROM blk c JOIN blk p ON p.metric_name = c.metric_name AND p.block = c.block - 1
  WHERE abs(c.mean - p.mean) > 0.15::DOUBLE)"""


@query(
    "mean_shift_events",
    "WITH " + SHIFT_SQL + """
SELECT metric_name, block, start_ts, end_ts, round(magnitude, 6) AS magnitude,
       round(mean_previous, 6) AS mean_previous, round(mean_current, 6) AS mean_current, runs
FROM shift""",
)
def _mean_shift_events(spark, sf_dir):
    events = series.mean_shift_events(inputs.points(spark, sf_dir), ["metric_name"])
    return events.select(
        "metric_name", "block", "start_ts", "end_ts",
        rounded(F.col("magnitude")).alias("magnitude"),
        rounded(F.col("mean_previous")).alias("mean_previous"),
        rounded(F.col("mean_current")).alias("mean_current"),
        F.array_join("involved_run_ids", ",").alias("runs"),
    )


TREND_SQL = POINTS_SQL + """, scored AS (SELECT metric_name, ts, seq, value AS score FROM points),
trended AS (
  SELECT *, CASE WHEN count(score) OVER w = 30 THEN avg(score) OVER w END AS rolling_mean,
         CASE WHEN count(score) OVER w = 30 THEN stddev_samp(score) OVER w END AS rolling_std
  FROM scored
  WINDOW w AS (PARTITION BY metric_name ORDER BY ts, seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"""


def _scores(spark, sf_dir):
    return inputs.points(spark, sf_dir).select("metric_name", "ts", "seq", F.col("value").alias("score"))


@query(
    "trend",
    "WITH " + TREND_SQL + """
SELECT metric_name, ts, seq, score, round(rolling_mean, 6) AS rolling_mean,
       round(rolling_std, 6) AS rolling_std FROM trended""",
)
def _trend(spark, sf_dir):
    out = series.trend(_scores(spark, sf_dir), ["metric_name"])
    return out.select(
        "metric_name", "ts", "seq", "score",
        rounded(F.col("rolling_mean")).alias("rolling_mean"),
        rounded(F.col("rolling_std")).alias("rolling_std"),
    )


ANOMALY_SQL = TREND_SQL + """, flagged AS (
  SELECT *, coalesce(rolling_std <> 0 AND score > rolling_mean + 2.0::DOUBLE * rolling_std, false) AS is_anomaly,
         row_number() OVER (PARTITION BY metric_name ORDER BY ts DESC, seq DESC) AS back
  FROM trended)"""


@query(
    "anomaly_latest",
    "WITH " + ANOMALY_SQL + """
SELECT metric_name, ts, seq, score, round(rolling_mean, 6) AS rolling_mean,
       round(rolling_std, 6) AS rolling_std, is_anomaly FROM flagged WHERE back = 1""",
)
def _anomaly_latest(spark, sf_dir):
    out = series.anomaly_latest(_scores(spark, sf_dir), ["metric_name"])
    return out.select(
        "metric_name", "ts", "seq", "score",
        rounded(F.col("rolling_mean")).alias("rolling_mean"),
        rounded(F.col("rolling_std")).alias("rolling_std"), "is_anomaly",
    )


@query(
    "adaptive_threshold",
    "WITH " + POINTS_SQL + """, t AS (
  SELECT metric_name, ts, seq, value AS score,
         CASE WHEN count(*) OVER w < 2 THEN 0.15::DOUBLE
              ELSE greatest(0.05::DOUBLE, least(0.5::DOUBLE,
                   avg(value) OVER w + 2.0::DOUBLE * stddev_samp(value) OVER w)) END AS threshold
  FROM points
  WINDOW w AS (PARTITION BY metric_name ORDER BY ts, seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT metric_name, ts, seq, score, round(threshold, 6) AS threshold, score > threshold AS drift_detected
FROM t""",
)
def _adaptive_threshold(spark, sf_dir):
    out = series.adaptive_threshold(_scores(spark, sf_dir), ["metric_name"])
    return out.select(
        "metric_name", "ts", "seq", "score", rounded(F.col("threshold")).alias("threshold"), "drift_detected"
    )
