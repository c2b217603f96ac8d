"""Queries that compare two halves of the event table, per event type."""

from __future__ import annotations

from pyspark.sql import functions as F

from meander.functions.columns import rounded, to_doubles
from meander.operators import divergence as dv
from meander.plans import inputs
from meander.plans.inputs import SIDES_SQL
from meander.plans.registry import query

KEY = ["metric_name"]

FD_SQL = """, q AS (
  SELECT metric_name, count(*) AS n, min(x) AS lo, max(x) AS hi,
         quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM sides GROUP BY 1),
shape AS (
  SELECT metric_name, n, lo, hi,
         CASE WHEN n >= 2 AND q3 > q1 AND hi > lo
              THEN CAST(greatest(10, least(100, ceil((hi - lo) / (2.0::DOUBLE * (q3 - q1) / pow(n, 1.0::DOUBLE / 3.0::DOUBLE))))) AS INTEGER)
              ELSE 20 END AS bins
  FROM q)"""

HIST_SQL = FD_SQL + """, guess AS (
  SELECT s.metric_name, is_current, x, lo, hi, bins, (hi - lo) / bins AS step,
         least(floor((x - lo) / (hi - lo) * bins), bins - 1) AS g
  FROM sides s JOIN shape USING (metric_name)),
binned AS (
  SELECT metric_name, CAST(g - CAST(x < lo + g * step AS INTEGER)
         + CAST(x >= lo + (g + 1) * step AND g < bins - 1 AS INTEGER) AS INTEGER) AS bin,
         count(*) FILTER (NOT is_current) AS nb, count(*) FILTER (is_current) AS nc
  FROM guess GROUP BY 1, 2),
grid AS (
  SELECT metric_name, lo, hi, bins, CAST(b.bin AS INTEGER) AS bin
  FROM shape, LATERAL (SELECT unnest(range(0, bins)) AS bin) b),
filled AS (
  SELECT g.metric_name, g.bin, g.bins, (hi - lo) / g.bins AS step,
         CAST(coalesce(nb, 0) AS DOUBLE) AS nb, CAST(coalesce(nc, 0) AS DOUBLE) AS nc
  FROM grid g LEFT JOIN binned c ON c.metric_name = g.metric_name AND c.bin = g.bin),
dens AS (
  SELECT *, greatest(nb / (sum(nb) OVER w * step), 1e-12::DOUBLE) AS dp,
         greatest(nc / (sum(nc) OVER w * step), 1e-12::DOUBLE) AS dq
  FROM filled WINDOW w AS (PARTITION BY metric_name)),
hist AS (
  SELECT *, dp / sum(dp) OVER w AS p, dq / sum(dq) OVER w AS q
  FROM dens WINDOW w AS (PARTITION BY metric_name))"""


@query(
    "fd_bins",
    "WITH " + SIDES_SQL + FD_SQL + " SELECT metric_name, n, lo, hi, bins FROM shape",
)
def _fd_bins(spark, sf_dir):
    return dv.fd_bins(inputs.sides(spark, sf_dir), KEY)


@query(
    "shared_histogram",
    "WITH " + SIDES_SQL + HIST_SQL + """
SELECT metric_name, bin, bins, nb, nc, round(p, 6) AS p, round(q, 6) AS q FROM hist""",
)
def _shared_histogram(spark, sf_dir):
    h = dv.shared_histogram(inputs.sides(spark, sf_dir), KEY)
    return h.select("metric_name", "bin", "bins", "nb", "nc", rounded(F.col("p")).alias("p"), rounded(F.col("q")).alias("q"))


JS_SQL = HIST_SQL + """, js AS (
  SELECT metric_name, sqrt((sum(p * ln(p / ((p + q) / 2))) + sum(q * ln(q / ((p + q) / 2)))) / 2) AS js
  FROM hist GROUP BY 1)"""


@query(
    "jsd_hist_drift",
    "WITH " + SIDES_SQL + JS_SQL + """
SELECT metric_name, round(js, 6) AS js, js > 0.15::DOUBLE AS js_drifted FROM js""",
)
def _jsd_hist_drift(spark, sf_dir):
    out = dv.jsd_hist_drift(inputs.sides(spark, sf_dir), KEY)
    return out.select("metric_name", rounded(F.col("js")).alias("js"), "js_drifted")


@query(
    "jsd_bits",
    "WITH " + SIDES_SQL + HIST_SQL + """, c AS (
  SELECT metric_name, greatest(nb, 1e-12::DOUBLE) AS a, greatest(nc, 1e-12::DOUBLE) AS b FROM hist),
m AS (SELECT metric_name, a / sum(a) OVER w AS p, b / sum(b) OVER w AS q
      FROM c WINDOW w AS (PARTITION BY metric_name))
SELECT metric_name, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE,
       (sum(p * log2(p / ((p + q) / 2))) + sum(q * log2(q / ((p + q) / 2)))) / 2)), 6) AS jsd
FROM m GROUP BY 1""",
)
def _jsd_bits(spark, sf_dir):
    h = dv.shared_histogram(inputs.sides(spark, sf_dir), KEY)
    out = dv.jsd_bits(h, KEY, "nb", "nc")
    return out.select("metric_name", rounded(F.col("jsd")).alias("jsd"))


def kl_sql(source: str, keys: str) -> str:
    """KL of kernel estimates of rows ``keys, is_current, x`` in ``source``."""
    return f""", ks AS (
  SELECT {keys}, min(x) AS lo, max(x) AS hi,
         count(*) FILTER (NOT is_current) AS nb, count(*) FILTER (is_current) AS nc,
         stddev_samp(x) FILTER (NOT is_current) AS sb, stddev_samp(x) FILTER (is_current) AS sc
  FROM {source} GROUP BY ALL),
kh AS (SELECT *, (hi - lo) / 99 AS dx, pow(nb, -0.2::DOUBLE) * sb AS hb, pow(nc, -0.2::DOUBLE) * sc AS hc FROM ks),
kd AS (
  SELECT {keys}, i, any_value(dx) AS dx,
         sum(exp(-0.5::DOUBLE * pow((lo + i * dx - x) / hb, 2))) FILTER (NOT is_current) / any_value(nb * hb * sqrt(2 * pi())) AS p0,
         sum(exp(-0.5::DOUBLE * pow((lo + i * dx - x) / hc, 2))) FILTER (is_current) / any_value(nc * hc * sqrt(2 * pi())) AS q0
  FROM {source} JOIN kh USING ({keys}), range(0, 100) g(i) GROUP BY {keys}, i),
kl AS (
  SELECT {keys}, sum(greatest(p0, 1e-12::DOUBLE) * ln(greatest(p0, 1e-12::DOUBLE) / greatest(q0, 1e-12::DOUBLE))) * any_value(dx) AS kl
  FROM kd GROUP BY ALL)"""


@query(
    "kl_kde_1d",
    "WITH " + SIDES_SQL + kl_sql("sides", "metric_name") + """
SELECT metric_name, nb, nc, round(kl, 6) AS kl FROM kl JOIN ks USING (metric_name)""",
)
def _kl_kde_1d(spark, sf_dir):
    out = dv.kl_kde_1d(inputs.sides(spark, sf_dir), KEY)
    return out.select("metric_name", "nb", "nc", rounded(F.col("kl")).alias("kl"))


@query(
    "w1_1d",
    "WITH " + SIDES_SQL + """, c AS (
  SELECT metric_name, x, is_current, count(*) FILTER (NOT is_current) OVER w / CAST(count(*) FILTER (NOT is_current) OVER k AS DOUBLE) AS fb,
         count(*) FILTER (is_current) OVER w / CAST(count(*) FILTER (is_current) OVER k AS DOUBLE) AS fc,
         lead(x) OVER (PARTITION BY metric_name ORDER BY x, seq) - x AS dx,
         count(*) FILTER (NOT is_current) OVER k AS nb, count(*) FILTER (is_current) OVER k AS nc
  FROM sides WINDOW w AS (PARTITION BY metric_name ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    k AS (PARTITION BY metric_name))
SELECT metric_name, any_value(nb) AS nb, any_value(nc) AS nc, round(sum(dx * abs(fb - fc)), 6) AS w1
FROM c GROUP BY 1""",
)
def _w1_1d(spark, sf_dir):
    out = dv.w1_1d(inputs.sides(spark, sf_dir), KEY)
    return out.select("metric_name", "nb", "nc", rounded(F.col("w1")).alias("w1"))


VEC_SIDES_SQL = """vecs AS (
  SELECT CASE WHEN label < 5 THEN 'retrieval' ELSE 'generation' END AS track, vec_id,
         vec_id % 2 = 1 AS is_current, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)"""


@query(
    "component_kl_drift",
    "WITH " + VEC_SIDES_SQL + """, coords AS (
  SELECT track, is_current, unnest(range(1, 65)) AS component, unnest(embedding) AS x FROM vecs)"""
    + kl_sql("coords", "track, component") + """
SELECT track, round(max(kl), 6) AS max_kl, round(avg(kl), 6) AS mean_kl, max(kl) > 0.5::DOUBLE AS kl_drifted
FROM kl GROUP BY 1""",
)
def _component_kl_drift(spark, sf_dir):
    out = dv.component_kl(inputs.tracked_vectors(spark, sf_dir), ["track"])
    return out.select(
        "track", rounded(F.col("max_kl")).alias("max_kl"), rounded(F.col("mean_kl")).alias("mean_kl"), "kl_drifted"
    )
