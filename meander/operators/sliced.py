"""Sliced Wasserstein distance: mean Wasserstein-1 over many directions."""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meander.functions.ordering import GROUP_LIMIT, fits
from meander.operators.divergence import w1_1d


def seeded_directions(width: int, count: int = 100, seed: int = 42) -> np.ndarray:
    """Unit columns from a seeded normal generator."""
    d = np.random.RandomState(seed).normal(0, 1, size=(width, count))
    norms = np.linalg.norm(d, axis=0)
    return d / np.where(norms == 0, 1.0, norms)


def hashed_directions(width: int, count: int = 100) -> np.ndarray:
    """Unit columns whose normals come from md5 digits, so that SQL can rebuild them."""

    def uniform(tag: str) -> float:
        return (int(hashlib.md5(tag.encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0

    d = np.array(
        [
            [
                np.sqrt(-2.0 * np.log(uniform(f"a:{j}:{i}"))) * np.cos(2.0 * np.pi * uniform(f"b:{j}:{i}"))
                for j in range(count)
            ]
            for i in range(width)
        ]
    )
    return d / np.linalg.norm(d, axis=0)


def sliced_wasserstein(
    vectors: DataFrame, by: list[str], directions: np.ndarray, vec: str = "embedding",
    side: str = "is_current", group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Mean over directions of the distance between the projected sides.

    While a key is small enough for one task, its values of one direction travel as arrays and meet in one group, 8 bytes
    each.  Larger keys become one value per row and direction, and every direction an ordinary keyed one-dimensional distance.
    """
    if fits(vectors, by, group_limit):
        per = _gathered(packed_projections(vectors, by, directions, vec, side), by)
        return per.groupBy(*by).agg(F.avg("w1").alias("swd"))
    fields = [f"{b} {vectors.schema[b].dataType.simpleString()}" for b in by]
    schema = ", ".join([*fields, f"{side} boolean", "direction int", "x double"])
    count = directions.shape[1]

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.vstack(pdf[vec].to_numpy()).astype(float) @ directions
            rep = pdf[[*by, side]].loc[pdf.index.repeat(count)].reset_index(drop=True)
            rep["direction"] = np.tile(np.arange(count, dtype=np.int32), len(pdf))
            rep["x"] = x.ravel()
            yield rep

    flat = vectors.select(*by, side, vec).mapInPandas(run, schema)
    # every direction of a key has the key's rows: too many here as well
    per = w1_1d(flat, [*by, "direction"], "x", side, 0)
    return per.groupBy(*by).agg(F.avg("w1").alias("swd"))


def packed_projections(vectors: DataFrame, by: list[str], directions: np.ndarray, vec: str, side: str) -> DataFrame:
    """``by, direction, base, current``: the projected values of each side, an array per batch of rows."""
    fields = [f"{b} {vectors.schema[b].dataType.simpleString()}" for b in by]
    schema = ", ".join([*fields, "direction int", "base array<double>", "current array<double>"])

    def run(batches):
        for pdf in batches:
            for key, part in pdf.groupby(by, sort=False, dropna=False) if by else [((), pdf)]:
                if not len(part):
                    continue
                x, current = np.vstack(part[vec].to_numpy()).astype(float) @ directions, part[side].to_numpy(dtype=bool)
                out = pd.DataFrame({"direction": np.arange(directions.shape[1], dtype=np.int32)})
                for number, (b, value) in enumerate(zip(by, key, strict=True)):
                    out.insert(number, b, [value] * len(out))
                yield out.assign(base=list(x[~current].T), current=list(x[current].T))

    # keys and sides that are null belong to no sample
    known = reduce(and_, [F.col(c).isNotNull() for c in [*by, side]])
    return vectors.select(*by, side, vec).filter(known).mapInPandas(run, schema)


def _gathered(packs: DataFrame, by: list[str]) -> DataFrame:
    """``by, direction, w1``: area between the distribution functions of both sides; null if a side is empty."""
    fields = [f"{b} {packs.schema[b].dataType.simpleString()}" for b in by]

    def area(pdf):
        b, c = (np.sort(np.concatenate(pdf[s].to_list())) for s in ("base", "current"))
        w1 = None
        if len(b) and len(c):
            x = np.sort(np.concatenate([b, c]))
            below = lambda side: np.searchsorted(side, x[:-1], side="right") / len(side)
            w1 = float((np.diff(x) * np.abs(below(b) - below(c))).sum())
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in by}, "direction": [pdf["direction"].iloc[0]], "w1": [w1]})

    return packs.groupBy(*by, "direction").applyInPandas(area, ", ".join([*fields, "direction int", "w1 double"]))
