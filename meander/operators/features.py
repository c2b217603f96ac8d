"""Linear-cost kernel discrepancy: distance between mean random Fourier features.

With frequencies drawn from the kernel's own spectrum, the mean cosines and sines of a side estimate its place in
the kernel's feature space.  Every labelling of the rows (observed or permuted) needs one weighted sum of features, so
the permutation test is a matrix product per batch; rows never meet each other.  The error of the squared
discrepancy falls with the root of the number of frequencies, whatever the number of rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meander.functions.ordering import GROUP_LIMIT
from meander.operators.blocks import side_sizes
from meander.operators.mmd import labelled, signs

COUNT = 256
#: Rows whose features are held at once, and keys whose sums a task holds before it sends them on.
SLICE, HELD = 2048, 32


@lru_cache(maxsize=4)
def frequencies(width: int, count: int = COUNT) -> np.ndarray:
    """``width x count`` normals from md5 digits, so that every task has the same ones and SQL can rebuild them."""

    def uniform(tag: str) -> float:
        return (int(hashlib.md5(tag.encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0

    return np.array([
        [np.sqrt(-2.0 * np.log(uniform(f"a:{j}:{i}"))) * np.cos(2.0 * np.pi * uniform(f"b:{j}:{i}"))
         for j in range(count)]
        for i in range(width)
    ])


def features(x: np.ndarray, gamma: float, count: int = COUNT) -> np.ndarray:
    """Cosines and sines of the rows of ``x``; every row has length 1."""
    angle = (x @ frequencies(x.shape[1], count)) * np.sqrt(2.0 * gamma)
    return np.hstack([np.cos(angle), np.sin(angle)]) / np.sqrt(count)


def feature_sums(
    vectors: DataFrame, by: list[str], gammas: dict | DataFrame, replicates: int = 0, id_col: str = "vec_id",
    vec: str = "embedding", side: str = "is_current", group_limit: int = GROUP_LIMIT, count: int = COUNT,
) -> DataFrame:
    """Estimated squared discrepancy per key and replicate (0 is the observed labelling).

    A task sums the signed features of its rows per key and labelling; only those sums are shuffled, so a key that
    holds a third of all rows costs no more than its share of the scan.  Keys with rows on one side only are left out.
    """
    rows, gammas, keys, attrs = labelled(vectors, by, gammas, replicates, id_col, vec, side, group_limit)
    per_key = side_sizes(rows, keys, F.col("side")).filter("nb > 0 AND nc > 0").join(gammas, keys)
    data = rows.join(per_key, keys).select(*keys, *attrs, "nb", "nc", "gamma", "embedding")
    fields = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def send(totals):
        for key, s in totals.items():
            labellings, width = s.shape
            yield pd.DataFrame({
                **{k: [v] * s.size for k, v in zip(keys, key)},
                "replicate": np.repeat(np.arange(labellings, dtype=np.int32), width),
                "i": np.tile(np.arange(width, dtype=np.int32), labellings), "s": s.ravel(),
            })

    def run(batches):
        totals: dict = {}
        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False):
                nb, nc, gamma = (part[c].iloc[0] for c in ("nb", "nc", "gamma"))
                for at in range(0, len(part), SLICE):
                    few = part.iloc[at:at + SLICE]
                    marks = signs(few["side"].to_numpy(bool), few["pos"] if replicates else None, nb, nc, replicates)
                    s = marks.T @ features(np.vstack(few["embedding"].to_numpy()).astype(float), gamma, count)
                    totals[key] = totals[key] + s if key in totals else s
                if len(totals) >= HELD:
                    yield from send(totals)
                    totals = {}
        yield from send(totals)

    sums = data.mapInPandas(run, f"{fields}, replicate int, i int, s double")
    total = sums.groupBy(*keys, "replicate", "i").agg(F.sum("s").alias("s"))
    return total.groupBy(*keys, "replicate").agg(F.sum(F.col("s") * F.col("s")).alias("mmd_sq")).select(
        *by, "replicate", "mmd_sq"
    )
