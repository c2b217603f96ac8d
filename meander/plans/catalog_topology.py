"""Queries over graphs, swarms, alerts and telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from meander.functions.columns import epoch_seconds, rounded
from meander.functions.runtime import cut_lineage
from meander.operators import alerts as al
from meander.operators import graph as gr
from meander.operators import policy
from meander.operators import swarm as sw
from meander.operators import telemetry as tm
from meander.plans import inputs
from meander.plans.inputs import POINTS_SQL
from meander.plans.registry import query

GRAPH_SQL = """ge AS (
  SELECT year(o_orderdate) * 12 + month(o_orderdate) AS win, 'n' || c_nationkey AS source, 's' || l_suppkey AS target
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey),
gn AS (SELECT win, source AS node FROM ge UNION SELECT win, target FROM ge),
de AS (SELECT DISTINCT win, source, target FROM ge WHERE source <> target),
pg AS (
  SELECT win, nodes, edges, CASE WHEN nodes < 2 THEN 0 ELSE edges / CAST(nodes * (nodes - 1) AS DOUBLE) END AS density
  FROM (SELECT win, count(*) AS nodes FROM gn GROUP BY 1) JOIN (SELECT win, count(*) AS edges FROM de GROUP BY 1) USING (win))"""


def retrieved_graph(spark, sf_dir):
    """Monthly graphs: customer nation to supplier, one edge per line item."""
    items = inputs.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = inputs.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = inputs.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    bought = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", month.alias("win"), F.concat(F.lit("n"), "c_nationkey").alias("source")
    )
    edges = (
        items.join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
        .select("win", "source", F.concat(F.lit("s"), "l_suppkey").alias("target"))
        .repartition("win", "target")  # a supplier's links of a month lie together: later counts per node shuffle less
        .distinct()
    )
    edges = cut_lineage(edges)  # one row per edge and month, read by every later step
    nodes = edges.select("win", F.col("source").alias("node")).union(edges.select("win", "target")).distinct()
    nodes = cut_lineage(nodes)
    return nodes, edges


def month_pairs(edges):
    wins = edges.select("win").distinct()
    return wins.select(F.col("win").alias("current"), (F.col("win") - 1).alias("baseline")).join(
        wins.select(F.col("win").alias("baseline")), "baseline"
    )


@query("pooled_graph", "WITH " + GRAPH_SQL + " SELECT win, nodes, edges, round(density, 6) AS density FROM pg")
def _pooled_graph(spark, sf_dir):
    out = gr.pooled_graph(*retrieved_graph(spark, sf_dir), ["win"])
    return out.select("win", "nodes", "edges", rounded(F.col("density")).alias("density"))


@query("edge_union", "WITH " + GRAPH_SQL + " SELECT DISTINCT source, target FROM de")
def _edge_union(spark, sf_dir):
    """Distinct edges of the odd and the even months together."""
    _, edges = retrieved_graph(spark, sf_dir)
    even = F.col("win") % 2 == 0
    return gr.edge_union(edges.filter(even), edges.filter(~even), by=[])


DELTA_SQL = GRAPH_SQL + """, dd AS (
  SELECT b.win AS baseline, c.win AS current, c.density - b.density AS density_delta, c.nodes - b.nodes AS node_count_delta
  FROM pg c JOIN pg b ON b.win = c.win - 1)"""


@query(
    "graph_density_delta",
    "WITH " + DELTA_SQL + " SELECT baseline, current, round(density_delta, 6) + 0.0::DOUBLE AS density_delta, node_count_delta FROM dd",
)
def _graph_density_delta(spark, sf_dir):
    nodes, edges = retrieved_graph(spark, sf_dir)
    out = gr.graph_density_delta(gr.pooled_graph(nodes, edges, ["win"]), month_pairs(edges), "win")
    return out.withColumn("density_delta", rounded(F.col("density_delta")))


@query(
    "laplacian_invariants",
    "WITH " + GRAPH_SQL + """, und AS (
  SELECT DISTINCT win, u, v FROM (SELECT win, source AS u, target AS v FROM de UNION ALL SELECT win, target, source FROM de)),
dg AS (SELECT win, u, count(*) AS d FROM und GROUP BY 1, 2),
cr AS (SELECT e.win, sum(1.0::DOUBLE / (a.d * b.d)) AS s FROM und e JOIN dg a ON a.win = e.win AND a.u = e.u
       JOIN dg b ON b.win = e.win AND b.u = e.v GROUP BY 1)
SELECT win, nodes, CAST(nodes AS DOUBLE) AS eigen_sum, round(nodes + s, 6) AS eigen_square_sum FROM pg JOIN cr USING (win)""",
)
def _laplacian_invariants(spark, sf_dir):
    out = gr.laplacian_invariants(*retrieved_graph(spark, sf_dir), ["win"])
    return out.withColumn("eigen_square_sum", rounded(F.col("eigen_square_sum")))


@query("graph_spectral_distance")
def _graph_spectral_distance(spark, sf_dir):
    nodes, edges = retrieved_graph(spark, sf_dir)
    out = gr.graph_spectral_distance(gr.spectra(nodes, edges, ["win"], edges_once=True), month_pairs(edges), "win")
    return out.withColumn("spectral_distance", rounded(F.col("spectral_distance")))


@query("graph_drift")
def _graph_drift(spark, sf_dir):
    nodes, edges = retrieved_graph(spark, sf_dir)
    out = gr.graph_drift(nodes, edges, month_pairs(edges), "win", edges_once=True)
    return out.withColumns(
        {"spectral_distance": rounded(F.col("spectral_distance")), "density_delta": rounded(F.col("density_delta"))}
    )


# --- swarms: conversations are traces, roles are agents ----------------------

SWARM_SQL = """hp AS (SELECT conv_id // 20 AS win, conv_id AS trace_id, turn AS pos, role AS agent FROM conversations),
tr AS (SELECT win, source, target, count(*) AS n FROM (
         SELECT win, lag(agent) OVER (PARTITION BY trace_id ORDER BY pos) AS source, agent AS target FROM hp)
       WHERE source IS NOT NULL GROUP BY 1, 2, 3),
en AS (SELECT win, -sum(p * ln(p)) + 0.0::DOUBLE AS entropy
       FROM (SELECT win, n / CAST(sum(n) OVER (PARTITION BY win, source) AS DOUBLE) AS p FROM tr) GROUP BY 1),
rf AS (SELECT win, avg(r) AS reflections FROM (
         SELECT win, trace_id, count(*) FILTER (agent = 'assistant') AS r FROM hp GROUP BY 1, 2) GROUP BY 1)"""


def swarm_tables(spark, sf_dir):
    hops = inputs.table(spark, sf_dir, "conversations").select(
        F.floor(F.col("conv_id") / 20).alias("win"), F.col("conv_id").alias("trace_id"),
        F.col("turn").alias("pos"), F.col("role").alias("agent"),
    )
    traces = hops.groupBy("win", "trace_id").agg(F.count_if(F.col("agent") == "assistant").alias("reflections"))
    return traces, hops


@query("agent_transitions", "WITH " + SWARM_SQL + " SELECT win, source, target, n FROM tr")
def _agent_transitions(spark, sf_dir):
    return sw.agent_transitions(swarm_tables(spark, sf_dir)[1], ["win"])


@query("agent_union", "SELECT DISTINCT role AS agent FROM conversations")
def _agent_union(spark, sf_dir):
    return sw.agent_union(swarm_tables(spark, sf_dir)[1])


@query("transition_entropy", "WITH " + SWARM_SQL + " SELECT win, round(entropy, 6) AS entropy FROM en")
def _transition_entropy(spark, sf_dir):
    out = sw.transition_entropy(sw.agent_transitions(swarm_tables(spark, sf_dir)[1], ["win"]), ["win"])
    return out.select("win", rounded(F.col("entropy")).alias("entropy"))


@query(
    "swarm_drift",
    "WITH " + SWARM_SQL + """, s AS (SELECT rf.win, coalesce(entropy, 0) AS e, reflections AS r FROM rf LEFT JOIN en ON en.win = rf.win)
SELECT b.win AS baseline, c.win AS current, round(c.e - b.e, 6) + 0.0::DOUBLE AS transition_entropy_delta,
       round(c.r - b.r, 6) + 0.0::DOUBLE AS avg_reflection_iterations_delta,
       abs(c.e - b.e) > 0.5::DOUBLE OR abs(c.r - b.r) > 1.0::DOUBLE AS is_swarm_drifted
FROM s c JOIN s b ON b.win = c.win - 1""",
)
def _swarm_drift(spark, sf_dir):
    traces, hops = swarm_tables(spark, sf_dir)
    out = sw.swarm_drift(traces, hops, month_pairs(hops), "win")
    return out.withColumns(
        {c: rounded(F.col(c)) for c in ("transition_entropy_delta", "avg_reflection_iterations_delta")}
    )


# --- alerts -------------------------------------------------------------------

ALERT_SQL = POINTS_SQL + """, al AS (
  SELECT metric_name, ts, seq, value, CASE WHEN value > 0.5::DOUBLE * 1.5::DOUBLE OR (user_id % 100) / 1000.0::DOUBLE < 0.01::DOUBLE
         THEN 'critical' ELSE 'warning' END AS severity
  FROM points WHERE value > 0.5::DOUBLE)"""


def _alerts(spark, sf_dir):
    p = inputs.points(spark, sf_dir).filter(F.col("value") > 0.5)
    return p.select(
        "metric_name", "ts", "seq", "value",
        al.alert_severity(F.col("value"), F.lit(0.5), (F.col("user_id") % 100) / 1000.0).alias("severity"),
    )


@query("alert_severity", "WITH " + ALERT_SQL + " SELECT metric_name, ts, seq, value, severity FROM al")
def _alert_severity(spark, sf_dir):
    return _alerts(spark, sf_dir)


@query(
    "alert_suppress",
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
def _alert_suppress(spark, sf_dir):
    out = al.alert_suppress(_alerts(spark, sf_dir), ["metric_name", "severity"], cooldown_s=21600.0)
    return out.select("metric_name", "severity", "seq", "ts", "is_sent")


@query(
    "alert_payload",
    "WITH " + POINTS_SQL + """, d AS (
  SELECT CAST(floor(ts / 86400) AS BIGINT) AS day, avg(value) AS js, max(value) FILTER (metric_name = 'error' AND value > 3.0::DOUBLE) AS mmd FROM points GROUP BY 1)
SELECT day, 'drift_alert' AS event, 'b' || day AS batch_id, js > 0.5::DOUBLE AS is_drifted, round(js, 6) AS js, round(coalesce(mmd, 0), 6) AS mmd,
       0.0::DOUBLE AS spectral FROM d""",
)
def _alert_payload(spark, sf_dir):
    p = inputs.points(spark, sf_dir)
    hot = (F.col("metric_name") == "error") & (F.col("value") > 3.0)
    d = p.groupBy(F.floor(F.col("ts") / 86400).alias("day")).agg(
        F.avg("value").alias("js_divergence"), F.max(F.when(hot, F.col("value"))).alias("mmd_score")
    )
    text = al.alert_payload(
        {c: F.col(c) for c in ("js_divergence", "mmd_score")}, F.concat(F.lit("b"), "day"), F.col("js_divergence") > 0.5
    )
    doc = F.from_json(
        text,
        "event string, is_drifted boolean, batch_id string, vector_drift struct<js_divergence:double,mmd_score:double>, "
        "graph_drift struct<spectral_distance:double>",
    )
    return d.select("day", doc.alias("d")).select(
        "day", "d.event", "d.batch_id", "d.is_drifted", rounded(F.col("d.vector_drift.js_divergence")).alias("js"),
        rounded(F.col("d.vector_drift.mmd_score")).alias("mmd"), F.col("d.graph_drift.spectral_distance").alias("spectral"),
    )


# --- telemetry -----------------------------------------------------------------

EDGES = "0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0"
BUCKET_SQL = f"""lt AS (SELECT event_type AS status, value / 10.0::DOUBLE AS s, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day FROM events),
bk AS (SELECT status, day, le, count(*) FILTER (s <= le) AS n
       FROM lt, (SELECT CAST(unnest([{EDGES}, 'inf'::DOUBLE]) AS DOUBLE) AS le) e GROUP BY 1, 2, 3)"""


def _latencies(spark, sf_dir):
    return inputs.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("status"), (F.col("value") / 10.0).alias("s"),
        F.floor(epoch_seconds("ts") / 86400).alias("day"),
    )


@query("latency_histogram", "WITH " + BUCKET_SQL + " SELECT status, day, CASE WHEN isinf(le) THEN -1.0::DOUBLE ELSE le END AS le, n FROM bk")
def _latency_histogram(spark, sf_dir):
    h = tm.latency_histogram(_latencies(spark, sf_dir), ["status", "day"], "s")
    return h.withColumn("le", F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le")))


@query(
    "histogram_quantile",
    "WITH " + BUCKET_SQL + """, w AS (
  SELECT *, coalesce(lag(le) OVER k, 0) AS lo, coalesce(lag(n) OVER k, 0) AS below, max(n) OVER (PARTITION BY status, day) AS total
  FROM bk WINDOW k AS (PARTITION BY status, day ORDER BY le)),
h AS (SELECT *, p * total AS rank FROM w, (SELECT unnest([0.5::DOUBLE, 0.9::DOUBLE, 0.95::DOUBLE]) AS p)),
f AS (SELECT *, row_number() OVER (PARTITION BY status, day, p ORDER BY le) AS i FROM h WHERE n >= rank)
SELECT status, day, p AS prob, round(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (rank - below) / (n - below) END, 6) AS value
FROM f WHERE i = 1""",
)
def _histogram_quantile(spark, sf_dir):
    h = tm.latency_histogram(_latencies(spark, sf_dir), ["status", "day"], "s")
    q = tm.histogram_quantile(h, ["status", "day"], [0.5, 0.9, 0.95])
    return q.withColumn("value", rounded(F.col("value")))


@query(
    "rate_5m",
    "WITH " + POINTS_SQL + """
SELECT metric_name, seq, round(count(*) OVER (PARTITION BY metric_name ORDER BY ts RANGE BETWEEN 300.0::DOUBLE PRECEDING AND CURRENT ROW) / 300.0::DOUBLE, 6) AS rate
FROM points""",
)
def _rate_5m(spark, sf_dir):
    out = tm.rate(inputs.points(spark, sf_dir), ["metric_name"])
    return out.select("metric_name", "seq", rounded(F.col("rate")).alias("rate"))


@query(
    "score_gauge_latest",
    """WITH p AS (SELECT user_id, event_type AS metric_name, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS b FROM events)
SELECT user_id, metric_name, value AS latest, round(avg(value) OVER (PARTITION BY user_id), 6) AS mean_latest FROM p WHERE b = 1""",
)
def _score_gauge_latest(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "events").select(
        "user_id", F.col("event_type").alias("metric_name"), "value", "ts", F.col("event_id").alias("seq")
    )
    out = tm.score_gauge_latest(rows, ["user_id"])
    return out.withColumn("mean_latest", rounded(F.col("mean_latest")))


@query(
    "outcome_counters",
    "WITH " + ALERT_SQL + """, acts AS (
  SELECT CASE WHEN value / 200.0::DOUBLE > 1.0::DOUBLE OR CAST(json_extract_string(props, '$.k') AS DOUBLE) NOT BETWEEN 1.0::DOUBLE AND 50.0::DOUBLE THEN 'blocked:parameter_bounds' ELSE 'approved:none' END AS labels FROM events)
SELECT 'drift_events' AS counter, severity AS labels, CAST(count(*) AS DOUBLE) AS value FROM al GROUP BY 2
UNION ALL SELECT 'optimization_actions', labels, CAST(count(*) AS DOUBLE) FROM acts GROUP BY 2
UNION ALL SELECT 'system_tokens', source, CAST(sum(n_chars) AS DOUBLE) FROM documents GROUP BY 2""",
)
def _outcome_counters(spark, sf_dir):
    from meander.plans.catalog_remediation import _actions

    acts = _actions(spark, sf_dir).withColumn("bad", policy.out_of_bounds(F.col("params")))
    docs = inputs.table(spark, sf_dir, "documents").select("source", "n_chars")
    one = F.lit(1)
    return tm.outcome_counters(
        {
            "drift_events": (_alerts(spark, sf_dir), [F.col("severity")], one),
            "optimization_actions": (
                acts,
                [F.when(F.col("bad"), "blocked").otherwise("approved"), F.when(F.col("bad"), "parameter_bounds")],
                one,
            ),
            "system_tokens": (docs, [F.col("source")], F.col("n_chars")),
        }
    )


@query(
    "benchmark_summary",
    """SELECT source, round(avg(quality), 3) AS avg_precision, round(avg(1 - toxic), 3) AS avg_faithfulness,
       round(avg(n_chars / 997.0::DOUBLE), 2) AS avg_latency_s, round(avg(n_chars), 0) AS avg_tokens
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
)
def _benchmark_summary(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    runs = docs.join(inputs.table(spark, sf_dir, "labels"), "doc_id", "left").select(
        "source", F.col("quality").alias("precision"), (1 - F.col("toxic")).alias("faithfulness"),
        (F.col("n_chars") / 997.0).alias("latency_s"), F.col("n_chars").alias("tokens"),
    )
    return tm.benchmark_summary(runs, ["source"])
