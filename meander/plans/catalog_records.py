"""Queries over run and frame records, component priors and window evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from meander.functions.columns import rounded
from meander.functions.runtime import scratch_path
from meander.operators import calibration as cal
from meander.operators import fusion, latent, records
from meander.operators.resampling import poisson_cuts
from meander.operators.swarm import swarm_drift
from meander.plans import evaluate as ev
from meander.plans import inputs
from meander.plans.catalog_divergence import VEC_SIDES_SQL
from meander.plans.catalog_topology import SWARM_SQL, month_pairs, retrieved_graph, swarm_tables
from meander.plans.inputs import RUNS_SQL
from meander.plans.registry import query
from meander.sources import evaluations
from meander.sources import history as hs

BY = ["track"]


@query(
    "run_validate",
    "WITH " + RUNS_SQL + r"""
SELECT run_id, CASE WHEN NOT regexp_matches(query, '[^\s\p{Z}]') THEN 'query must not be empty'
  WHEN n_docs = 0 THEN 'retrieved_docs must not be empty'
  WHEN n_ids IS NOT NULL AND n_ids <> n_docs THEN 'retrieved_doc_ids length must match retrieved_docs length'
  WHEN n_embs IS NOT NULL AND n_embs <> n_docs THEN 'retrieved_embeddings length must match retrieved_docs length' END AS reject_reason
FROM runs""",
)
def _run_validate(spark, sf_dir):
    good, bad = records.run_validate(inputs.runs(spark, sf_dir))
    return good.select("run_id", F.lit(None).cast("string").alias("reject_reason")).unionByName(
        bad.select("run_id", "reject_reason")
    )


@query(
    "run_to_frame",
    "WITH " + RUNS_SQL + """
SELECT run_id AS trace_id, timestamp AS ts, CASE name WHEN 'NaiveRAG' THEN 'naive' WHEN 'agenticrag' THEN 'agentic'
       WHEN 'GraphRAG' THEN 'graph_rag' ELSE 'custom' END AS rag_type, md5(query) AS query_digest, CAST(n_docs AS INTEGER) AS n_chunks,
       coalesce(toxic, 0) AS reflections, CAST(n_chars AS DOUBLE) AS latency_ms, CASE WHEN quality <> 0 THEN CAST(quality AS DOUBLE) END AS confidence,
       CAST(n_chars / 997.0::DOUBLE AS DOUBLE) AS precision, '{}' AS token_usage FROM runs""",
)
def _run_to_frame(spark, sf_dir):
    runs = inputs.runs(spark, sf_dir)
    f = records.run_to_frame(F.create_map(F.lit("precision"), F.col("n_chars") / 997.0))
    f = runs.select(f.alias("f")).select("f.*")
    return f.select(
        "trace_id", (F.unix_micros("timestamp") / 1e6).alias("ts"), F.col("metadata.rag_type").alias("rag_type"),
        F.md5("query.text").alias("query_digest"), F.size("context.text_chunks").alias("n_chunks"),
        F.col("metadata.reflection_iterations").alias("reflections"), "metadata.latency_ms",
        F.col("output.confidence_score").alias("confidence"),
        F.col("metadata.extra")["precision"].cast("double").alias("precision"),
        F.col("metadata.extra")["token_usage"].alias("token_usage"),
    )


def _responses(spark, sf_dir):
    runs = inputs.runs(spark, sf_dir)
    return runs.select(
        "doc_id", "query", F.col("retrieved_docs").alias("retrieved_contexts"), F.col("answer").alias("generated_answer"),
        F.coalesce("query_embedding", F.array().cast("array<double>")).alias("query_embedding"),
        (F.col("doc_id") % 3).cast("int").alias("reflection_iterations"),
        ((F.col("doc_id") % 10) / 10.0).alias("final_confidence"),
        F.map_filter(
            F.create_map(
                F.lit("pipeline_name"), F.when(F.col("doc_id") % 2 == 0, F.col("system_info.name")),
                F.lit("model"), F.lit(""), F.lit("lang"), F.col("lang"),
            ),
            lambda _, v: v.isNotNull(),
        ).alias("metadata"),
    )


@query(
    "response_to_run",
    "WITH " + RUNS_SQL + """
SELECT run_id, md5(query) AS query_digest, CAST(n_docs AS INTEGER) AS n_docs, label >= 8 AND label IS NOT NULL AS has_embedding,
       CASE WHEN doc_id % 2 = 0 THEN name END AS name, CASE WHEN doc_id % 2 = 0 THEN '' END AS model,
       CASE WHEN doc_id % 2 = 0 THEN 'default' END AS retriever, CASE WHEN doc_id % 2 = 0 THEN '0.0.0' END AS version,
       CAST(doc_id % 3 AS INTEGER) AS reflections, (doc_id % 10) / 10.0::DOUBLE AS confidence, lang FROM runs""",
)
def _response_to_run(spark, sf_dir):
    r = records.response_to_run(_responses(spark, sf_dir), F.concat(F.lit("r"), F.col("doc_id")), F.lit(0.0))
    m, s = F.col("metadata"), F.col("system_info")
    return r.select(
        "run_id", F.md5("query").alias("query_digest"), F.size("retrieved_docs").alias("n_docs"),
        F.col("query_embedding").isNotNull().alias("has_embedding"), s["name"].alias("name"), s["model"].alias("model"),
        s["retriever"].alias("retriever"), s["version"].alias("version"),
        m["reflection_iterations"].cast("int").alias("reflections"), m["final_confidence"].cast("double").alias("confidence"),
        m["lang"].alias("lang"),
    )


@query(
    "run_to_response",
    "WITH " + RUNS_SQL + """
SELECT run_id, md5(query) AS query_digest, CAST(n_docs AS INTEGER) AS n_contexts, CAST(CASE WHEN label >= 8 THEN 64 ELSE 0 END AS INTEGER) AS width,
       coalesce(toxic, 0) AS reflections, CAST(coalesce(quality, 0) AS DOUBLE) AS confidence, timestamp AS ts, name,
       n_chars AS latency FROM runs""",
)
def _run_to_response(spark, sf_dir):
    r = records.run_to_response(inputs.runs(spark, sf_dir))
    m = F.col("metadata")
    return r.select(
        m["run_id"].alias("run_id"), F.md5("query").alias("query_digest"), F.size("retrieved_contexts").alias("n_contexts"),
        F.size("query_embedding").alias("width"), F.col("reflection_iterations").alias("reflections"),
        F.col("final_confidence").alias("confidence"), m["timestamp"].cast("double").alias("ts"),
        F.get_json_object(m["system_info"], "$.name").alias("name"), m["latency_ms"].cast("long").alias("latency"),
    )


PICK_SQL = """SELECT run_id, CASE WHEN label >= 8 THEN 'query' WHEN label >= 5 THEN 'answer' ELSE 'retrieved' END AS origin,
       round(list_sum(embedding), 6) + 0.0::DOUBLE AS total FROM runs WHERE embedding IS NOT NULL"""


def _picked(df, vec):
    total = F.aggregate(vec, F.lit(0.0), lambda a, x: a + x)
    origin = F.when(F.col("label") >= 8, "query").when(F.col("label") >= 5, "answer").otherwise("retrieved")
    return df.filter(F.size(vec) > 0).select("run_id", origin.alias("origin"), rounded(total).alias("total"))


@query("embedding_pick_runs", "WITH " + RUNS_SQL + PICK_SQL)
def _embedding_pick_runs(spark, sf_dir):
    return _picked(inputs.runs(spark, sf_dir), records.embedding_pick_runs())


@query("embedding_pick_frames", "WITH " + RUNS_SQL + PICK_SQL)
def _embedding_pick_frames(spark, sf_dir):
    framed = inputs.runs(spark, sf_dir).select("run_id", "label", records.run_to_frame().alias("frame"))
    return _picked(framed, records.embedding_pick_frames())


@query(
    "dim_check",
    "WITH " + RUNS_SQL + """, v AS (SELECT source, doc_id % 2 = 1 AS c, CAST(CASE WHEN doc_id % 41 = 0 THEN 63 ELSE 64 END AS INTEGER) AS w FROM runs WHERE embedding IS NOT NULL),
g AS (SELECT source, min(w) FILTER (NOT c) AS baseline_min, max(w) FILTER (NOT c) AS baseline_max, min(w) FILTER (c) AS current_min, max(w) FILTER (c) AS current_max FROM v GROUP BY 1)
SELECT *, NOT coalesce(baseline_min = baseline_max AND baseline_min = current_min AND current_min = current_max AND baseline_min > 0, false) AS dim_mismatch FROM g""",
)
def _dim_check(spark, sf_dir):
    r = inputs.runs(spark, sf_dir).select(F.col("system_version").alias("source"), "doc_id", records.embedding_pick_runs().alias("v"))
    short = F.when(F.col("doc_id") % 41 == 0, F.slice("v", 1, 63)).otherwise(F.col("v"))
    v = r.filter(F.col("v").isNotNull()).select("source", (F.col("doc_id") % 2 == 1).alias("is_current"), short.alias("embedding"))
    return records.dim_check(v, ["source"])


@query("tag_union", "SELECT vec_id, vec_id % 2 = 1 AS is_current, CASE WHEN label < 5 THEN 'retrieval' ELSE 'generation' END AS track FROM embeddings")
def _tag_union(spark, sf_dir):
    v = inputs.tracked_vectors(spark, sf_dir)
    keep = ["vec_id", "track"]
    return latent.tag_union(v.filter("NOT is_current").select(*keep), v.filter("is_current").select(*keep))


# --- vector lines ---------------------------------------------------------------


@query(
    "vector_source",
    "WITH " + VEC_SIDES_SQL + """
SELECT CASE WHEN is_current THEN track ELSE 'retrieval' END AS track, round(list_sum(embedding), 6) + 0.0::DOUBLE AS total FROM vecs""",
)
def _vector_source(spark, sf_dir):
    """Lines of the even rows carry no track; a third of the lines are followed by junk."""
    from meander.sources.vectors import vector_source

    path = scratch_path(spark, "vectors")
    line = F.to_json(F.struct(F.col("embedding").alias("vector"), F.when(F.col("is_current"), F.col("track")).alias("track")))
    junk = F.when(F.col("vec_id") % 3 == 0, F.array(line, F.lit('{"vector": null}'))).otherwise(F.array(line))
    inputs.tracked_vectors(spark, sf_dir).select(F.explode(junk).alias("value")).write.text(path)
    v = vector_source(spark, path)
    return v.select("track", rounded(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)).alias("total"))


# --- component priors --------------------------------------------------------------

SCORES_SQL = """sc AS (SELECT user_id, avg(value) FILTER (event_type = 'click') / 100.0::DOUBLE AS r,
                   avg(value) FILTER (event_type = 'view' AND user_id % 4 <> 0) / 100.0::DOUBLE AS g FROM events GROUP BY 1),
nd AS (SELECT * FROM (VALUES ('vector_index', 'retrieval', 0.0::DOUBLE), ('embedding_model', 'retrieval', 0.0::DOUBLE),
       ('prompt_template', 'generation', 0.0::DOUBLE), ('llm_router', 'generation', 0.0::DOUBLE)) t(node_id, node_type, p))
SELECT user_id, node_id, node_type, coalesce(greatest(p, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 2.0::DOUBLE * CASE node_type WHEN 'retrieval' THEN r ELSE g END)), 6)), p) AS prior_failure_prob
FROM sc, nd WHERE r IS NOT NULL OR g IS NOT NULL"""


def _track_scores(spark, sf_dir):
    e = inputs.table(spark, sf_dir, "events")
    track = F.when(F.col("event_type") == "click", "retrieval").when(
        (F.col("event_type") == "view") & (F.col("user_id") % 4 != 0), "generation"
    )
    return e.select("user_id", track.alias("track"), "value").filter("track IS NOT NULL").groupBy("user_id", "track").agg(
        (F.avg("value") / 100.0).alias("score")
    )


@query("fusion_priors", "WITH " + SCORES_SQL)
def _fusion_priors(spark, sf_dir):
    return fusion.fusion_priors(_track_scores(spark, sf_dir), fusion.default_nodes(spark), ["user_id"])


@query("fusion_dual_track", "WITH " + SCORES_SQL)
def _fusion_dual_track(spark, sf_dir):
    s = _track_scores(spark, sf_dir)
    pick = lambda t: s.filter(F.col("track") == t).select("user_id", "score")
    return fusion.fusion_dual_track(pick("retrieval"), pick("generation"), fusion.default_nodes(spark), ["user_id"])


# --- run pairs ------------------------------------------------------------------------

PAIR_SQL = RUNS_SQL + """, prs AS (
  SELECT b.doc_id // 2 AS pair_id, b.run_id AS baseline_run_id, c.run_id AS current_run_id,
         list_distance(b.embedding, c.embedding) AS d, c.quality, c.toxic, c.name
  FROM runs b JOIN runs c ON c.doc_id = b.doc_id + 1 AND b.doc_id % 2 = 0
  WHERE b.embedding IS NOT NULL AND c.embedding IS NOT NULL),
pj AS (SELECT *, CASE WHEN d < 1e-12::DOUBLE THEN 0.0::DOUBLE ELSE round(sqrt(ln(2.0::DOUBLE)), 6) END AS js FROM prs)"""


def _pairs(spark, sf_dir):
    r = inputs.runs(spark, sf_dir)
    runs = r.select(
        "run_id", records.embedding_pick_runs().alias("embedding"), "timestamp", "system_version",
        F.col("system_info.name").alias("pipeline_name"),
        F.map_filter(
            F.create_map(
                F.lit("faithfulness"), F.col("metadata")["final_confidence"].cast("double"),
                F.lit("relevance"), F.col("metadata")["reflection_iterations"].cast("double"),
            ),
            lambda _, v: v.isNotNull(),
        ).alias("scores"),
    ).filter(F.col("embedding").isNotNull())
    even = r.filter(F.col("doc_id") % 2 == 0)
    pairs = even.select(
        F.floor(F.col("doc_id") / 2).alias("pair_id"), F.col("run_id").alias("baseline_run_id"),
        F.concat(F.lit("r"), F.col("doc_id") + 1).alias("current_run_id"),
    )
    return pairs, runs


@query("run_pair_drift", "WITH " + PAIR_SQL + " SELECT pair_id, baseline_run_id, current_run_id, js, js > 0.15::DOUBLE AS js_drifted FROM pj")
def _run_pair_drift(spark, sf_dir):
    return ev.run_pair_drift(*_pairs(spark, sf_dir)).withColumn("js", rounded(F.col("js")))


@query(
    "evaluate_pair",
    "WITH " + PAIR_SQL + """
SELECT current_run_id AS run_id, baseline_run_id, name AS pipeline_name, 'js_divergence' AS metric_name, 'DriftResult' AS type, js AS value FROM pj
UNION ALL SELECT current_run_id, baseline_run_id, name, 'faithfulness', 'QualityResult', CAST(quality AS DOUBLE) FROM pj WHERE quality IS NOT NULL
UNION ALL SELECT current_run_id, baseline_run_id, name, 'relevance', 'QualityResult', CAST(toxic AS DOUBLE) FROM pj WHERE toxic IS NOT NULL""",
)
def _evaluate_pair(spark, sf_dir):
    path = scratch_path(spark, "history")
    hs.history_append(ev.evaluate_pair(*_pairs(spark, sf_dir)), path)
    m = hs.history_scan(spark, path).select("run_id", "metadata", F.explode("metrics").alias("m"))
    return m.select(
        "run_id", F.col("metadata")["baseline_run_id"].alias("baseline_run_id"),
        F.col("metadata")["pipeline_name"].alias("pipeline_name"), "m.metric_name", F.col("m._type").alias("type"),
        rounded(F.col("m.value")).alias("value"),
    )


# --- window evaluations ------------------------------------------------------------------

THRESH_SQL = """d AS (
  SELECT event_type, user_id, avg(value) / 100.0::DOUBLE AS js, avg(value) / 150.0::DOUBLE AS mmd, max(value) / 200.0::DOUBLE AS kl FROM events GROUP BY 1, 2)
SELECT event_type, user_id, js > (CASE WHEN user_id % 3 = 0 THEN 0.5::DOUBLE ELSE 0.15::DOUBLE END)
       OR mmd > (CASE WHEN user_id % 3 = 0 THEN 0.4::DOUBLE ELSE 0.1::DOUBLE END) OR kl > (CASE WHEN user_id % 3 = 0 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END) AS is_drifted FROM d"""


@query("is_drifted", "WITH " + THRESH_SQL)
def _is_drifted(spark, sf_dir):
    d = inputs.table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(
        (F.avg("value") / 100.0).alias("js"), (F.avg("value") / 150.0).alias("mmd"), (F.max("value") / 200.0).alias("kl")
    )
    own = F.col("user_id") % 3 == 0  # calibrated users
    d = d.withColumns(
        {"js_threshold": F.when(own, 0.5), "mmd_threshold": F.when(own, 0.4), "kl_threshold": F.when(own, 0.9)}
    )
    return d.select("event_type", "user_id", ev.is_drifted("js", "mmd", "kl").alias("is_drifted"))


def _round_all(df, names):
    return df.withColumns({c: rounded(F.col(c)) for c in names})


@query("vector_drift_runs")
def _vector_drift_runs(spark, sf_dir):
    """First and second half of the runs of every language."""
    r = inputs.runs(spark, sf_dir)
    v = r.select("lang", "doc_id", (F.col("doc_id") % 2 == 1).alias("is_current"), records.embedding_pick_runs().alias("embedding"))
    out = ev.vector_drift(v.filter(F.size("embedding") > 0), ["lang"], id_col="doc_id")
    return _round_all(out, ["js_divergence", "mmd_score", "p_value"])


@query("vector_drift_frames")
def _vector_drift_frames(spark, sf_dir):
    f = inputs.runs(spark, sf_dir).select("doc_id", records.run_to_frame().alias("frame"))
    v = f.select(
        F.col("frame.metadata.rag_type").alias("rag_type"), "doc_id", (F.col("doc_id") % 2 == 1).alias("is_current"),
        records.embedding_pick_frames().alias("embedding"),
    )
    out = ev.vector_drift(v.filter(F.size("embedding") > 0), ["rag_type"], id_col="doc_id")
    return _round_all(out, ["js_divergence", "mmd_score", "p_value"])


@query("evaluate_by_type")
def _evaluate_by_type(spark, sf_dir):
    """Newest 50 frames of one kind against the newest 50 of another."""
    f = inputs.runs(spark, sf_dir).select("doc_id", "timestamp", records.run_to_frame().alias("frame"))
    v = f.select("doc_id", "timestamp", F.col("frame.metadata.rag_type").alias("kind"), records.embedding_pick_frames().alias("embedding"))
    v = v.filter(F.size("embedding") > 0)
    newest = lambda kind: v.filter(F.col("kind") == kind).orderBy(F.desc("timestamp"), F.desc("doc_id")).limit(50)
    both = latent.tag_union(newest("naive"), newest("agentic")).withColumn("pair", F.lit("naive>agentic"))
    return _round_all(ev.vector_drift(both, ["pair"], id_col="doc_id"), ["js_divergence", "mmd_score", "p_value"])


@query("comprehensive_drift")
def _comprehensive_drift(spark, sf_dir):
    out = ev.comprehensive_drift(inputs.tracked_vectors(spark, sf_dir), BY)
    return _round_all(out, ["js_divergence", "mmd_score", "mmd_p_value", "max_component_kl", "mean_component_kl"])


def _month(c):
    """The 80 months of the orders (1995-01 to 2001-08), dealt out by id."""
    return (F.lit(23941) + F.pmod(c, F.lit(80))).cast("int")


def _monthly(spark, sf_dir):
    """Monthly windows: retrieved graphs, and vectors and conversations dealt to the same months."""
    nodes, edges = retrieved_graph(spark, sf_dir)
    v = inputs.tracked_vectors(spark, sf_dir)
    vectors = v.select(_month(F.col("vec_id")).alias("win"), "vec_id", "embedding")
    traces, hops = (df.withColumn("win", _month(F.col("trace_id"))) for df in swarm_tables(spark, sf_dir))
    return vectors, nodes, edges, traces, hops, month_pairs(edges)


@query("evaluate_frames")
def _evaluate_frames(spark, sf_dir):
    out = ev.evaluate_frames(*_monthly(spark, sf_dir), edges_once=True)
    return _round_all(
        out, ["js_divergence", "mmd_score", "spectral_distance", "density_delta", "transition_entropy_delta", "avg_reflection_iterations_delta"]
    )


@query("evaluation_job")
def _evaluation_job(spark, sf_dir):
    """Calibrated monthly evaluation of all frames: stored rows per window and the alert of the drifted ones."""
    path = scratch_path(spark, "evaluations")
    evals = inputs.evaluations(spark, sf_dir)
    frames = evals.select(
        _month(F.xxhash64("trace_id")).alias("win"), "trace_id", "rag_type", "timestamp", "telemetry_frame"
    )
    alerts = ev.evaluation_job(frames, *_monthly(spark, sf_dir), path, edges_once=True)
    stored = evaluations.read_evaluations(spark, path).select(
        "js_divergence", "is_drifted", _month(F.xxhash64("trace_id")).alias("current")
    )
    per = stored.groupBy("current").agg(
        F.count(F.lit(1)).alias("frames"), rounded(F.max("js_divergence")).alias("js_divergence"),
        F.max("is_drifted").alias("is_drifted"),
    )
    return per.join(alerts.select("current", "alert"), "current", "left")


@query(
    "swarm_drift_calibrated",
    "WITH " + SWARM_SQL + """, s AS (SELECT rf.win, coalesce(entropy, 0) AS e, reflections AS r FROM rf LEFT JOIN en ON en.win = rf.win),
tc AS (SELECT DISTINCT win, trace_id FROM hp),
sp AS (SELECT win, g.r AS rep, trace_id, row_number() OVER (PARTITION BY win, g.r ORDER BY md5(g.r || ':' || trace_id), trace_id)
         > count(*) OVER (PARTITION BY win, g.r) // 2 AS c FROM tc, range(1, 21) g(r)),
tx AS (SELECT win, rep, c, lag(agent) OVER (PARTITION BY rep, c, trace_id ORDER BY pos) AS a, agent AS t FROM hp JOIN sp USING (win, trace_id)),
ct AS (SELECT win, rep, c, a, t, count(*) AS n FROM tx WHERE a IS NOT NULL GROUP BY ALL),
ep AS (SELECT win, rep, c, -sum(p * ln(p)) AS e
       FROM (SELECT win, rep, c, n / CAST(sum(n) OVER (PARTITION BY win, rep, c, a) AS DOUBLE) AS p FROM ct) GROUP BY 1, 2, 3),
de AS (SELECT win, rep, coalesce(max(e) FILTER (c), 0) - coalesce(max(e) FILTER (NOT c), 0) AS d FROM ep GROUP BY 1, 2),
th AS (SELECT win, avg(d) + 2.0::DOUBLE * stddev_pop(d) AS x FROM de GROUP BY 1)
SELECT b.win AS baseline, c.win AS current, round(c.e - b.e, 6) + 0.0::DOUBLE AS transition_entropy_delta,
       round(coalesce(x, 0.5), 6) + 0.0::DOUBLE AS swarm_entropy_threshold,
       abs(c.e - b.e) > coalesce(x, 0.5) OR abs(c.r - b.r) > 1.0::DOUBLE AS is_swarm_drifted
FROM s c JOIN s b ON b.win = c.win - 1 LEFT JOIN th ON th.win = b.win""",
)
def _swarm_drift_calibrated(spark, sf_dir):
    """Swarm drift of following windows, each with the limit of its own baseline window."""
    traces, hops = swarm_tables(spark, sf_dir)
    limits = cal.split_half_swarm(hops, traces, by=["win"]).withColumnRenamed("threshold", "swarm_entropy_threshold")
    out = ev.with_limits(swarm_drift(traces, hops, month_pairs(hops), "win"), limits, "win")
    over = F.abs("transition_entropy_delta") > F.col("swarm_entropy_threshold")
    return out.select(
        "baseline", "current", rounded(F.col("transition_entropy_delta")).alias("transition_entropy_delta"),
        rounded(F.col("swarm_entropy_threshold")).alias("swarm_entropy_threshold"),
        (over | (F.abs("avg_reflection_iterations_delta") > ev.REFLECTION_LIMIT)).alias("is_swarm_drifted"),
    )


for _metric in ("mmd", "swd", "jsd"):

    def _latent(spark, sf_dir, metric=_metric):
        out = latent.latent_drift(inputs.tracked_vectors(spark, sf_dir), BY, metric)
        return out.withColumn("drift_score", rounded(F.col("drift_score"))).drop("explained_variance_ratio")

    query(f"latent_drift_{_metric}" if _metric != "mmd" else "latent_drift")(_latent)

    def _dual(spark, sf_dir, metric=_metric):
        out = latent.latent_dual_track(inputs.tracked_vectors(spark, sf_dir), metric)
        return out.withColumn("drift_score", rounded(F.col("drift_score")))

    query(f"latent_dual_track_{_metric}" if _metric != "mmd" else "latent_dual_track")(_dual)


@query("latent_drift_events")
def _latent_drift_events(spark, sf_dir):
    res = latent.latent_drift(inputs.tracked_vectors(spark, sf_dir), BY, "swd", threshold=0.01)
    out = latent.latent_drift_events(res)
    return out.select("track", "metric_name", "start_ts", "end_ts", rounded(F.col("magnitude")).alias("magnitude"))


@query("component_kl_pca")
def _component_kl_pca(spark, sf_dir):
    out = latent.component_kl_pca(inputs.tracked_vectors(spark, sf_dir), BY)
    return _round_all(out, ["max_kl", "mean_kl"])


BASE_SQL = """base AS (
  SELECT CASE WHEN label < 5 THEN 'retrieval' ELSE 'generation' END AS track, vec_id, CAST(embedding[1] AS DOUBLE) AS x
  FROM embeddings WHERE vec_id % 2 = 0)"""

#: Resamples as counts, from the same 16 bits of an md5 per row and replicate.
RESAMPLE_SQL = f""", drawn AS (
  SELECT track, r, x, len(list_filter({poisson_cuts(1.0)}, lambda c: u >= c)) AS w FROM (
    SELECT track, x, r, CAST('0x' || substr(md5('c:' || (r // 8) || ':' || vec_id), 1 + 4 * CAST(r % 8 AS INTEGER), 4) AS INTEGER) AS u
    FROM base, range(0, 1000) g(r))),
uni AS (SELECT track, r, x FROM drawn UNION ALL SELECT track, r, x FROM drawn, LATERAL (SELECT unnest(range(0, w))) t),
q AS (
  SELECT track, r, count(*) AS n, min(x) AS lo, max(x) AS hi, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3
  FROM uni GROUP BY ALL),
shape AS (
  SELECT track, r, lo, hi, CASE WHEN n >= 2 AND q3 > q1 AND hi > lo
    THEN CAST(greatest(10, least(100, ceil((hi - lo) / (2.0::DOUBLE * (q3 - q1) / pow(n, 1.0::DOUBLE / 3.0::DOUBLE))))) AS INTEGER)
    ELSE 20 END AS bins
  FROM q),
guess AS (
  SELECT d.track, d.r, x, w, lo, bins, (hi - lo) / bins AS step, least(floor((x - lo) / (hi - lo) * bins), bins - 1) AS g
  FROM drawn d JOIN shape s ON s.track = d.track AND s.r = d.r),
binned AS (
  SELECT track, r, any_value(bins) AS bins, any_value(step) AS step, count(*) AS nb, sum(w) AS nc,
    CAST(g - CAST(x < lo + g * step AS INTEGER) + CAST(x >= lo + (g + 1) * step AND g < bins - 1 AS INTEGER) AS INTEGER) AS bin
  FROM guess GROUP BY track, r, bin),
filled AS (
  SELECT h.track, h.r, h.step, coalesce(b.nb, 0) AS nb, coalesce(b.nc, 0) AS nc
  FROM (SELECT track, r, step, unnest(range(0, bins)) AS bin FROM (SELECT DISTINCT track, r, bins, step FROM binned)) h
  LEFT JOIN binned b ON b.track = h.track AND b.r = h.r AND b.bin = h.bin),
dens AS (
  SELECT track, r, greatest(nb / (sum(nb) OVER w * step), 1e-12::DOUBLE) AS dp, greatest(nc / (sum(nc) OVER w * step), 1e-12::DOUBLE) AS dq
  FROM filled WINDOW w AS (PARTITION BY track, r)),
mass AS (
  SELECT track, r, dp / sum(dp) OVER w AS p, dq / sum(dq) OVER w AS q FROM dens WINDOW w AS (PARTITION BY track, r)),
scored AS (
  SELECT track, r, sqrt(greatest(0.0::DOUBLE, (sum(p * ln(p / ((p + q) / 2))) + sum(q * ln(q / ((p + q) / 2)))) / 2)) AS js
  FROM mass GROUP BY ALL)"""


@query("bootstrap_thresholds")
def _bootstrap_thresholds(spark, sf_dir):
    base = inputs.tracked_vectors(spark, sf_dir).filter("NOT is_current")
    out = cal.bootstrap_thresholds(base, BY)
    return out.withColumn("threshold", rounded(F.col("threshold")))


@query(
    "bootstrap_js_axis",
    "WITH " + BASE_SQL + RESAMPLE_SQL + """
SELECT track, count(*) AS replicates, round(avg(js), 6) AS mean_js, round(avg(js) + 3.0::DOUBLE * stddev_pop(js), 6) AS threshold
FROM scored GROUP BY track""",
)
def _bootstrap_js_axis(spark, sf_dir):
    """The calibration of the histogram distance on a fixed axis, the first coordinate."""
    base = inputs.tracked_vectors(spark, sf_dir).filter("NOT is_current")
    scores = cal.bootstrap_js(base, BY, principal=False)
    return scores.groupBy("track").agg(
        F.count("score").alias("replicates"), rounded(F.avg("score")).alias("mean_js"),
        rounded(F.avg("score") + F.lit(3.0) * F.stddev_pop("score")).alias("threshold"),
    )


@query("split_half_thresholds")
def _split_half_thresholds(spark, sf_dir):
    base = inputs.tracked_vectors(spark, sf_dir).filter("NOT is_current")
    out = cal.split_half_thresholds(base, BY)
    return out.withColumn("threshold", rounded(F.col("threshold")))


@query(
    "split_half_swarm",
    """WITH hp AS (SELECT conv_id AS trace_id, turn AS pos, role AS agent FROM conversations),
tr AS (SELECT DISTINCT trace_id FROM hp),
sp AS (SELECT r AS rep, trace_id, row_number() OVER (PARTITION BY r ORDER BY md5(r || ':' || trace_id), trace_id) > (SELECT count(*) // 2 FROM tr) AS c
       FROM tr, range(1, 21) g(r)),
tx AS (SELECT rep, c, lag(agent) OVER (PARTITION BY rep, c, trace_id ORDER BY pos) AS s, agent AS t FROM hp JOIN sp USING (trace_id)),
ct AS (SELECT rep, c, s, t, count(*) AS n FROM tx WHERE s IS NOT NULL GROUP BY ALL),
en AS (SELECT rep, c, -sum(p * ln(p)) AS e FROM (SELECT rep, c, n / CAST(sum(n) OVER (PARTITION BY rep, c, s) AS DOUBLE) AS p FROM ct) GROUP BY 1, 2),
de AS (SELECT rep, coalesce(max(e) FILTER (c), 0) - coalesce(max(e) FILTER (NOT c), 0) AS d FROM en GROUP BY 1)
SELECT 'swarm_entropy_threshold' AS metric, count(*) AS replicates, round(avg(d) + 2.0::DOUBLE * stddev_pop(d), 6) + 0.0::DOUBLE AS threshold FROM de""",
)
def _split_half_swarm(spark, sf_dir):
    traces, hops = swarm_tables(spark, sf_dir)
    out = cal.split_half_swarm(hops.drop("win"), traces)
    return out.withColumn("threshold", rounded(F.col("threshold")))


@query("split_half_graph")
def _split_half_graph(spark, sf_dir):
    """The months' graphs are the payloads that are split."""
    out = cal.split_half_graph(*retrieved_graph(spark, sf_dir), "win")
    return out.withColumn("threshold", rounded(F.col("threshold")))
