"""Principal components for many keys at once, and projection onto them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meander.functions.columns import null_safe_equal


def _fields(df: DataFrame, names: list[str]) -> list[str]:
    return [f"{b} {df.schema[b].dataType.simpleString()}" for b in names]


def second_moments(vectors: DataFrame, by: list[str], vec: str = "embedding") -> DataFrame:
    """Summed outer products of ``(1, x)`` per key as ``by, i, j, v`` (upper triangle).

    Each task adds up its own rows first; the shuffle carries one triangle per
    key and task.
    """

    def run(batches):
        totals: dict = {}
        for pdf in batches:
            groups = pdf.groupby(by, sort=False) if by else [((), pdf)]
            for key, part in groups:
                if not len(part):
                    continue
                x = np.vstack(part[vec].to_numpy()).astype(float)
                x = np.hstack([np.ones((len(x), 1)), x])
                key = key if isinstance(key, tuple) else (key,)
                totals[key] = totals.get(key, 0.0) + x.T @ x
        for key, g in totals.items():
            i, j = np.triu_indices(g.shape[0])
            out = pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": g[i, j]})
            for name, value in zip(by, key):
                out[name] = value
            yield out[[*by, "i", "j", "v"]]

    schema = ", ".join([*_fields(vectors, by), "i int, j int, v double"])
    parts = vectors.select(*by, vec).mapInPandas(run, schema)
    return parts.groupBy(*by, "i", "j").agg(F.sum("v").alias("v"))


def pca_fit(vectors: DataFrame, by: list[str], k: int = 5, vec: str = "embedding") -> DataFrame:
    """Model per key: ``by, n, mean, components, variance, ratio``.

    ``k`` is capped by rows and width.  The sign of a component makes its largest
    loading positive.  One task decomposes the width x width matrix of one key.
    """
    moments = second_moments(vectors, by, vec)
    keyed = moments if by else moments.withColumn("_all", F.lit(1))
    keys = by or ["_all"]

    def fit(pdf):
        size = int(pdf["j"].max()) + 1
        g = np.zeros((size, size))
        g[pdf["i"], pdf["j"]] = pdf["v"]
        g = g + np.triu(g, 1).T
        n = g[0, 0]
        mean = g[0, 1:] / n
        cov = (g[1:, 1:] - n * np.outer(mean, mean)) / max(n - 1, 1)
        values, vectors_ = np.linalg.eigh(cov)
        values, vectors_ = np.maximum(values[::-1], 0.0), vectors_[:, ::-1].T
        keep = min(k, int(n), size - 1)
        comps = vectors_[:keep]
        big = comps[np.arange(keep), np.abs(comps).argmax(1)]
        comps = comps * np.where(big < 0, -1.0, 1.0)[:, None]
        total = values.sum()
        ratio = values[:keep] / total if total > 0 else np.zeros(keep)
        return pd.DataFrame(
            {
                **{b: [pdf[b].iloc[0]] for b in by},
                "n": [int(n)], "mean": [mean.tolist()], "components": [comps.tolist()],
                "variance": [values[:keep].tolist()], "ratio": [ratio.tolist()],
            }
        )

    schema = ", ".join(
        [*_fields(vectors, by), "n long, mean array<double>, components array<array<double>>, variance array<double>, ratio array<double>"]
    )
    return keyed.groupBy(*keys).applyInPandas(fit, schema)


def pca_project(vectors: DataFrame, model: DataFrame, by: list[str], vec: str = "embedding", out: str = "proj") -> DataFrame:
    """Add the projection of each row onto its key's components.

    With keys, the model joins the rows.  Without keys it is one row of
    ``width x k`` numbers, shipped inside the task closure.
    """
    schema = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields if f.name != out
    ) + f", `{out}` array<double>"
    keep = [c for c in vectors.columns if c != out]

    if not by:
        row = model.select("mean", "components").first()
        mean, comps = np.array(row["mean"]), np.array(row["components"])

        def run(batches):
            for pdf in batches:
                if len(pdf):
                    x = np.vstack(pdf[vec].to_numpy()).astype(float)
                    yield pdf[keep].assign(**{out: list((x - mean) @ comps.T)})

        return vectors.mapInPandas(run, schema)

    joined = vectors.alias("v").join(
        model.select(*by, "mean", "components").alias("m"),
        null_safe_equal(_Q("v"), _Q("m"), by),
    ).select(*[F.col(f"v.{c}") for c in keep], F.col("m.mean").alias("_mean"), F.flatten("m.components").alias("_comps"))

    def run_keyed(batches):
        for pdf in batches:
            for _, part in pdf.groupby(by, sort=False, dropna=False):
                mean = np.asarray(part["_mean"].iloc[0])
                comps = np.asarray(part["_comps"].iloc[0]).reshape(-1, len(mean))
                x = np.vstack(part[vec].to_numpy()).astype(float)
                yield part[keep].assign(**{out: list((x - mean) @ comps.T)})

    return joined.mapInPandas(run_keyed, schema)


class _Q:
    def __init__(self, alias):
        self.alias = alias

    def __getitem__(self, name):
        return F.col(f"{self.alias}.{name}")
