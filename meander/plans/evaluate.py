"""Window evaluations that combine vector, graph and swarm drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meander.functions.runtime import cut_lineage
from meander.operators import calibration, mmd
from meander.operators.alerts import alert_payload
from meander.operators.divergence import jsd_hist_drift
from meander.operators.graph import graph_drift
from meander.operators.latent import component_kl_pca, vector_jsd
from meander.operators.records import dim_check
from meander.operators.swarm import swarm_drift
from meander.sources.evaluations import evaluation_write

# fixed values: static safety thresholds
JS_THRESHOLD, MMD_THRESHOLD, KL_THRESHOLD = 0.15, 0.1, 0.5
LIMITS = {
    "vector_jsd_threshold": JS_THRESHOLD, "vector_mmd_threshold": MMD_THRESHOLD,
    "graph_spectral_threshold": 0.5, "swarm_entropy_threshold": 0.5,
}
DENSITY_LIMIT, REFLECTION_LIMIT = 0.1, 1.0


def is_drifted(js: str, mmd_score: str, kl: str, js_limit="js_threshold", mmd_limit="mmd_threshold", kl_limit="kl_threshold"):
    """Any score above its limit; missing limits fall back to the static ones."""
    over = lambda s, t, d: F.coalesce(F.col(s) > F.coalesce(F.col(t), F.lit(d)), F.lit(False))
    return over(js, js_limit, JS_THRESHOLD) | over(mmd_score, mmd_limit, MMD_THRESHOLD) | over(kl, kl_limit, KL_THRESHOLD)


def vector_drift(
    vectors: DataFrame, by: list[str], js_threshold: float = JS_THRESHOLD, mmd_threshold: float = MMD_THRESHOLD,
    replicates: int = 100, id_col: str = "vec_id", vec: str = "embedding", side: str = "is_current",
    method: str = "pairs",
) -> DataFrame:
    """``js_divergence, mmd_score, is_drifted`` per key.

    Zeros when a side is missing or widths differ; the kernel test is skipped
    when a side has a single row.  ``method`` is that of the kernel test (``pairs`` or ``features``).
    """
    checks = dim_check(vectors, by, vec, side)
    counts = vectors.groupBy(*by).agg(F.count_if(~F.col(side)).alias("_nb"), F.count_if(F.col(side)).alias("_nc"))
    status = cut_lineage(checks.select(*by, "dim_mismatch").join(counts, by))
    good = vectors.join(status.filter("NOT dim_mismatch").select(*by), by, "left_semi")
    tested = vectors.join(status.filter("NOT dim_mismatch AND _nb >= 2 AND _nc >= 2").select(*by), by, "left_semi")
    js = vector_jsd(good, by, js_threshold, vec, side)
    test = mmd.mmd_permutation_test(tested, by, replicates, mmd_threshold, id_col, vec, side, method=method)
    return (
        status.select(*by).join(js, by, "left").join(test, by, "left")
        .select(
            *by,
            F.coalesce("js", F.lit(0.0)).alias("js_divergence"),
            F.coalesce("mmd", F.lit(0.0)).alias("mmd_score"),
            "p_value",
            (F.coalesce("js_drifted", F.lit(False)) | F.coalesce("mmd_drifted", F.lit(False))).alias("is_drifted"),
        )
    )


def comprehensive_drift(
    vectors: DataFrame, by: list[str], replicates: int = 100,
    id_col: str = "vec_id", vec: str = "embedding", side: str = "is_current", method: str = "pairs",
) -> DataFrame:
    """Histogram distance, kernel test and per-component KL, with each verdict."""
    js = vector_jsd(vectors, by, JS_THRESHOLD, vec, side)
    test = mmd.mmd_permutation_test(vectors, by, replicates, MMD_THRESHOLD, id_col, vec, side, method=method)
    kl = component_kl_pca(vectors, by, 10, KL_THRESHOLD, vec, side)
    return js.join(test, by).join(kl, by).select(
        *by, F.col("js").alias("js_divergence"), "js_drifted",
        F.col("mmd").alias("mmd_score"), F.col("p_value").alias("mmd_p_value"), "mmd_drifted",
        F.col("max_kl").alias("max_component_kl"), F.col("mean_kl").alias("mean_component_kl"),
        F.col("kl_drifted").alias("per_component_drifted"),
        (F.col("js_drifted") | F.col("mmd_drifted") | F.col("kl_drifted")).alias("is_drifted"),
    )


def run_pair_drift(pairs: DataFrame, runs: DataFrame, threshold: float = JS_THRESHOLD) -> DataFrame:
    """Histogram distance between the single vectors of two runs.

    ``pairs``: ``pair_id, baseline_run_id, current_run_id``; ``runs``: ``run_id,
    embedding``.  The first component of two points is the line through them, so
    their positions are 0 and their distance.
    """
    b = runs.select(F.col("run_id").alias("baseline_run_id"), F.col("embedding").alias("_b"))
    c = runs.select(F.col("run_id").alias("current_run_id"), F.col("embedding").alias("_c"))
    both = pairs.join(b, "baseline_run_id").join(c, "current_run_id").filter(F.size("_b") == F.size("_c"))
    squares = F.zip_with("_b", "_c", lambda x, y: (x - y) * (x - y))
    dist = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v))
    points = both.withColumn("_d", dist).select(
        "pair_id",
        F.inline(F.array(F.struct(F.lit(False).alias("is_current"), F.lit(0.0).alias("x")),
                         F.struct(F.lit(True).alias("is_current"), F.col("_d").alias("x")))),
    )
    js = jsd_hist_drift(points, ["pair_id"], threshold=threshold)
    return both.select("pair_id", "baseline_run_id", "current_run_id").join(js, "pair_id")


def evaluate_pair(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """History records of run pairs: one drift metric and the current run's quality scores.

    ``runs`` also carries ``scores`` (map), ``pipeline_name``, ``system_version``
    and ``timestamp``.
    """
    drift = run_pair_drift(pairs, runs)
    cur = runs.select(F.col("run_id").alias("current_run_id"), "scores", "pipeline_name", "system_version", "timestamp")
    none, no_meta = F.lit(None).cast("string"), F.create_map().cast("map<string,string>")

    def metric(kind, name, value, meta, run_id=none, base=none, current=none):
        return F.struct(
            kind.alias("_type"), name.alias("metric_name"), value.alias("value"), meta.alias("metadata"),
            run_id.alias("run_id"), base.alias("baseline_run_id"), current.alias("current_run_id"),
        )

    info = F.create_map(F.lit("is_drifted"), F.col("js_drifted").cast("string"), F.lit("method"), F.lit("jensen_shannon"))
    first = metric(F.lit("DriftResult"), F.lit("js_divergence"), F.col("js"), info,
                   base=F.col("baseline_run_id"), current=F.col("current_run_id"))
    rest = F.transform(
        F.array_sort(F.map_entries("scores")),
        lambda e: metric(F.lit("QualityResult"), e["key"], e["value"], no_meta, run_id=F.col("current_run_id")),
    )
    return drift.join(cur, "current_run_id").select(
        F.concat(F.lit("pair-"), F.col("pair_id").cast("string")).alias("record_id"),
        F.col("current_run_id").alias("run_id"), "timestamp", "system_version",
        F.concat(F.array(first), rest).alias("metrics"),
        F.map_filter(
            F.create_map(F.lit("baseline_run_id"), F.col("baseline_run_id"), F.lit("pipeline_name"), F.col("pipeline_name")),
            lambda _, v: v.isNotNull(),
        ).alias("metadata"),
    )


def with_limits(results: DataFrame, limits: DataFrame | None, by: str, static: dict[str, float] | None = None) -> DataFrame:
    """Give each window pair the limits of its baseline window, one column per name of ``LIMITS``.

    ``limits``: ``by`` and any of those columns, one row per window.  Missing rows, columns and values fall back to
    ``static``, then to ``LIMITS``.
    """
    defaults = {**LIMITS, **(static or {})}
    found = [c for c in LIMITS if limits is not None and c in limits.columns]
    if found:
        results = results.join(limits.select(F.col(by).alias("baseline"), *found), "baseline", "left")
    return results.withColumns(
        {c: F.coalesce(F.col(c), F.lit(defaults[c])) if c in found else F.lit(defaults[c]) for c in LIMITS}
    )


def calibrated_limits(
    vectors: DataFrame, traces: DataFrame, hops: DataFrame, by: str = "win", k: float = 2.0, iterations: int = 20,
    id_col: str = "vec_id",
) -> DataFrame:
    """Vector and swarm limits of every window from half splits of its own rows, one row per window.

    A window with too few vectors or without hops has nulls there.
    """
    names = ["vector_jsd_threshold", "vector_mmd_threshold"]
    vec = calibration.split_half_thresholds(vectors, [by], k, iterations, id_col=id_col)
    vec = vec.groupBy(by).pivot("metric", names).agg(F.first("threshold"))
    swarm = calibration.split_half_swarm(hops, traces, k, iterations, [by])
    return vec.join(swarm.select(by, F.col("threshold").alias("swarm_entropy_threshold")), by, "full")


def evaluate_frames(
    vectors: DataFrame, nodes: DataFrame, edges: DataFrame, traces: DataFrame, hops: DataFrame, pairs: DataFrame,
    by: str = "win", thresholds: dict[str, float] | None = None, replicates: int = 100, id_col: str = "vec_id",
    limits: DataFrame | None = None, method: str = "pairs", edges_once: bool = False,
) -> DataFrame:
    """Vector, graph and swarm drift of every ``(baseline, current)`` window pair.

    ``vectors``: ``by, id, embedding`` per window.  ``limits`` are calibrated values per baseline window (see
    ``calibrated_limits``), ``thresholds`` values for all windows; missing ones keep their static defaults.
    ``edges_once``: no edge repeats within a window.
    """
    key = F.concat_ws(">", F.col("baseline").cast("string"), F.col("current").cast("string")).alias("pair")
    tagged = pairs.select(key, "baseline", "current")
    side = lambda role, flag: tagged.select("pair", F.col(role).alias(by)).join(vectors, by).select(
        "pair", id_col, "embedding", F.lit(flag).alias("is_current")
    )
    stacked = side("baseline", False).unionByName(side("current", True))
    vec = vector_drift(stacked, ["pair"], replicates=replicates, id_col=id_col, method=method)
    graph = graph_drift(nodes, edges, pairs, by, edges_once=edges_once)
    swarm = swarm_drift(traces, hops, pairs, by)
    out = tagged.join(vec, "pair", "left").join(graph, ["baseline", "current"], "left").join(swarm, ["baseline", "current"], "left")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    scores = out.select(
        "baseline", "current",
        zero("js_divergence"), zero("mmd_score"), zero("spectral_distance"), zero("density_delta"),
        F.coalesce("node_count_delta", F.lit(0)).alias("node_count_delta"),
        zero("transition_entropy_delta"), zero("avg_reflection_iterations_delta"), "p_value",
    )
    over = lambda score, limit: F.abs(score) > F.col(limit)
    judged = with_limits(scores, limits, by, thresholds).withColumns(
        {
            "is_vector_drifted": over("js_divergence", "vector_jsd_threshold")
            | over("mmd_score", "vector_mmd_threshold") | F.coalesce(F.col("p_value") < 0.05, F.lit(False)),
            "is_graph_drifted": over("spectral_distance", "graph_spectral_threshold")
            | (F.abs("density_delta") > DENSITY_LIMIT),
            "is_swarm_drifted": over("transition_entropy_delta", "swarm_entropy_threshold")
            | (F.abs("avg_reflection_iterations_delta") > REFLECTION_LIMIT),
        }
    )
    return judged.withColumn(
        "is_drifted", F.col("is_vector_drifted") | F.col("is_graph_drifted") | F.col("is_swarm_drifted")
    ).drop("p_value", *LIMITS)


def evaluation_job(
    frames: DataFrame, vectors: DataFrame, nodes: DataFrame, edges: DataFrame, traces: DataFrame, hops: DataFrame,
    pairs: DataFrame, path: str, by: str = "win", replicates: int = 100, id_col: str = "vec_id", method: str = "pairs",
    edges_once: bool = False,
) -> DataFrame:
    """Calibrate on each baseline window, evaluate its pair, store a row per current frame, return the alerts.

    ``frames``: ``by`` and the columns of ``frames_append``.  The stored rows carry their window's metrics; the result
    has ``baseline, current, alert`` for the drifted pairs.
    """
    limits = cut_lineage(calibrated_limits(vectors, traces, hops, by, id_col=id_col))
    results = cut_lineage(
        evaluate_frames(vectors, nodes, edges, traces, hops, pairs, by, None, replicates, id_col, limits, method, edges_once)
    )
    evaluation_write(frames, results.withColumnRenamed("current", by), [by], path)
    scores = [c for c in results.columns if c not in ("baseline", "current")]
    alert = alert_payload({c: F.col(c) for c in scores}, F.col("current").cast("string"), F.col("is_drifted"))
    return results.filter("is_drifted").select("baseline", "current", alert.alias("alert"))
