"""Drift of embeddings in a latent space fitted on the baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meander.functions.runtime import cut_lineage
from meander.operators import mmd
from meander.operators.divergence import component_kl, jsd_bits, jsd_hist_drift
from meander.operators.kde import kde_density
from meander.operators.pca import pca_fit, pca_project
from meander.operators.sliced import seeded_directions, sliced_wasserstein

METRICS = ("mmd", "swd", "jsd")


def tag_union(baseline: DataFrame, current: DataFrame, side: str = "is_current") -> DataFrame:
    """Both windows stacked, tagged by side."""
    return baseline.withColumn(side, F.lit(False)).unionByName(current.withColumn(side, F.lit(True)))


def _score(proj: DataFrame, by: list[str], metric: str, id_col: str, side: str, fit_rows: DataFrame | None, width: int, method: str) -> DataFrame:
    if metric == "mmd":
        return mmd.mmd_rbf(proj, by, None, id_col, "proj", side, method=method).withColumnRenamed("mmd", "drift_score")
    if metric == "swd":
        return sliced_wasserstein(proj, by, seeded_directions(width), "proj", side).withColumnRenamed("swd", "drift_score")
    density = kde_density(proj, by, id_col, "proj", side, fit_rows)
    return jsd_bits(density, by).withColumnRenamed("jsd", "drift_score")


def latent_drift(
    vectors: DataFrame, by: list[str], metric: str = "mmd", threshold: float = 0.15, k: int = 5,
    id_col: str = "vec_id", vec: str = "embedding", side: str = "is_current", method: str = "pairs",
) -> DataFrame:
    """Project on the baseline's components, score the two sides, compare with the threshold.

    One row per key with the component count and their explained-variance ratios; a key with rows on one side only
    has no score and no drift.
    ``id_col`` is unique within a key.  ``method`` is that of the kernel discrepancy (``pairs`` or ``features``).
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, got {metric!r}")
    cur = F.col(side)
    model = cut_lineage(pca_fit(vectors.filter(~cur), by, k, vec))  # one row per key
    info = model.select(*by, "n", F.col("ratio").alias("explained_variance_ratio"))
    width = info.select(F.max(F.size("explained_variance_ratio"))).first()[0]
    proj = pca_project(vectors.select(*by, id_col, side, vec), model, by, vec).drop(vec)
    proj = cut_lineage(proj)  # k numbers per row, read by every pass of the metric
    score = _score(proj, by, metric, id_col, side, None, width, method)
    sizes = vectors.groupBy(*by).agg(
        F.count_if(~cur).alias("n_samples_baseline"), F.count_if(cur).alias("n_samples_current")
    )
    return (
        sizes.join(score, by, "left").join(info.drop("n"), by, "left")
        .withColumns(
            {
                "metric_used": F.lit(metric), "threshold": F.lit(float(threshold)),
                "drift_detected": F.coalesce(F.col("drift_score") > F.lit(float(threshold)), F.lit(False)),
                "pca_components": F.size("explained_variance_ratio"),
            }
        )
    )


def latent_dual_track(
    vectors: DataFrame, metric: str = "mmd", threshold: float = 0.15, k: int = 5,
    id_col: str = "vec_id", vec: str = "embedding", side: str = "is_current", track: str = "track",
    method: str = "pairs",
) -> DataFrame:
    """One space fitted on both tracks' baselines; a score per track and a unified one.

    With ``jsd`` every track is compared with the density of the combined baseline.
    """
    model = cut_lineage(pca_fit(vectors.filter(~F.col(side)), [], k, vec))
    width = len(model.select("ratio").first()["ratio"])
    proj = cut_lineage(pca_project(vectors.select(track, id_col, side, vec), model, [], vec).drop(vec))
    rows = proj.withColumn(track, F.explode(F.array(F.col(track), F.lit("unified"))))
    base = proj.filter(~F.col(side)).select("proj")
    keyed_base = base.withColumn(track, F.explode(F.array(F.lit("retrieval"), F.lit("generation"), F.lit("unified"))))
    score = _score(rows, [track], metric, id_col, side, keyed_base if metric == "jsd" else None, width, method)
    sizes = rows.groupBy(track).agg(
        F.count_if(~F.col(side)).alias("n_samples_baseline"), F.count_if(F.col(side)).alias("n_samples_current")
    )
    return score.join(sizes, track).withColumns(
        {
            "metric_used": F.lit(metric), "threshold": F.lit(float(threshold)),
            "drift_detected": F.col("drift_score") > F.lit(float(threshold)), "pca_components": F.lit(width),
        }
    )


def latent_drift_events(results: DataFrame, timestamp: Column | None = None) -> DataFrame:
    """Drift events of the detected results, named after their metric."""
    ts = F.lit(0.0) if timestamp is None else F.coalesce(timestamp, F.lit(0.0))
    return results.filter("drift_detected").withColumns(
        {
            "metric_name": F.concat(F.lit("latent_"), "metric_used"),
            "start_ts": ts, "end_ts": ts, "magnitude": F.col("drift_score"),
        }
    )


def vector_jsd(
    vectors: DataFrame, by: list[str], threshold: float = 0.15, vec: str = "embedding", side: str = "is_current"
) -> DataFrame:
    """Histogram distance of both sides on the first component of their union."""
    model = cut_lineage(pca_fit(vectors, by, 1, vec))
    proj = pca_project(vectors.select(*by, side, vec), model, by, vec).drop(vec)
    return jsd_hist_drift(proj.withColumn("x", F.col("proj")[0]), by, "x", side, threshold)


def component_kl_pca(
    vectors: DataFrame, by: list[str], k: int = 10, threshold: float = 0.5, vec: str = "embedding", side: str = "is_current"
) -> DataFrame:
    """KL per principal component of the baseline (at most ``k``)."""
    model = cut_lineage(pca_fit(vectors.filter(~F.col(side)), by, k, vec))
    return component_kl(pca_project(vectors.select(*by, side, vec), model, by, vec), by, "proj", side, threshold)
