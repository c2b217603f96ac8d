"""Multivariate Gaussian kernel densities of two samples on shared points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meander.operators.pca import second_moments

GRID_POINTS = 1000


def shared_grid(rows: DataFrame, by: list[str], id_col: str, vec: str, points: int = GRID_POINTS) -> DataFrame:
    """Up to ``points`` rows of both samples per key, chosen by a hash of their id.

    The pick is the ``points`` smallest hashes; Spark keeps only those per task
    before the shuffle.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(0), F.col(id_col)), F.col(id_col))
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= points).select(
        *by, F.col(id_col).alias("point_id"), F.col(vec).alias("point")
    )


def kde_density(
    rows: DataFrame, by: list[str], id_col: str = "vec_id", vec: str = "proj", side: str = "is_current",
    fit_rows: DataFrame | None = None, points: int = GRID_POINTS,
) -> DataFrame:
    """Densities ``p`` (baseline) and ``q`` (current) at the shared points per key.

    ``fit_rows`` may give another baseline sample (``by, vec``) for ``p``.  The
    grid and the two covariances are small and ship in the task closure: at most
    ``points`` rows per key; sample rows stream past them and only kernel sums
    are shuffled.  A sample without a usable covariance has density 0.
    """
    base = rows.filter(~F.col(side)).select(*by, vec) if fit_rows is None else fit_rows.select(*by, vec)
    sample = base.withColumn(side, F.lit(False)).unionByName(rows.filter(F.col(side)).select(*by, vec, side))

    models = {}
    moments = second_moments(sample, [*by, side], vec).toPandas()
    for key, part in moments.groupby([*by, side]):
        size = int(part["j"].max()) + 1
        g = np.zeros((size, size))
        g[part["i"], part["j"]] = part["v"]
        g = g + np.triu(g, 1).T
        n, d = g[0, 0], size - 1
        if n < 2:
            continue
        mean = g[0, 1:] / n
        cov = (g[1:, 1:] - n * np.outer(mean, mean)) / (n - 1) * n ** (-2.0 / (d + 4))
        try:
            chol = np.linalg.cholesky(cov)
        except np.linalg.LinAlgError:
            continue
        scale = n * (2.0 * np.pi) ** (d / 2) * np.prod(np.diag(chol))
        models[key if isinstance(key, tuple) else (key,)] = (np.linalg.inv(chol).T, scale)

    grid_rows = shared_grid(rows, by, id_col, vec, points)
    grid = {}
    pdf = grid_rows.toPandas().sort_values([*by, "point_id"])
    for key, part in pdf.groupby(by):
        key = key if isinstance(key, tuple) else (key,)
        grid[key] = (part["point_id"].to_numpy(), np.vstack(part["point"].to_numpy()).astype(float))

    id_type = rows.schema[id_col].dataType.simpleString()
    fields = [f"{b} {rows.schema[b].dataType.simpleString()}" for b in by]
    schema = ", ".join([*fields, f"point_id {id_type}", f"{side} boolean", "part double"])

    def run(batches):
        totals: dict = {}
        for batch in batches:
            for key, part in batch.groupby([*by, side], sort=False):
                if key not in models:
                    continue
                white, scale = models[key]
                at = grid[key[:-1]][1] @ white
                x = np.vstack(part[vec].to_numpy()).astype(float) @ white
                d = (at * at).sum(1)[:, None] - 2.0 * (at @ x.T) + (x * x).sum(1)[None, :]
                totals[key] = totals.get(key, 0.0) + np.exp(-0.5 * np.maximum(d, 0.0)).sum(1) / scale
        for key, sums in totals.items():
            yield pd.DataFrame(
                {**dict(zip(by, key)), "point_id": grid[key[:-1]][0], side: bool(key[-1]), "part": sums}
            )

    parts = sample.mapInPandas(run, schema)
    density = parts.groupBy(*by, "point_id").agg(
        F.sum(F.when(~F.col(side), F.col("part"))).alias("p"), F.sum(F.when(F.col(side), F.col("part"))).alias("q")
    )
    return grid_rows.select(*by, "point_id").join(density, [*by, "point_id"], "left").na.fill(0.0, ["p", "q"])
