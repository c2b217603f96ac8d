"""Pairwise vector work in blocks.

Rows are packed into blocks of about ``BLOCK_ROWS`` by a hash of their id; pairs
of blocks meet by an equi-join on block numbers, and a numpy kernel reduces each
pair of blocks to a few sums.  Row pairs never become rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 1024


def block_count(rows: int, block_rows: int = BLOCK_ROWS) -> int:
    return max(1, -(-rows // block_rows))


def packed(df: DataFrame, by: list[str], id_col: str, vec: str, blocks: int | Column, attrs: list[str]) -> DataFrame:
    """One row per ``by, block``: ids, flat values and attribute arrays in one order.

    ``blocks`` is the number of blocks; a column gives each key its own (``blocks`` in the result).
    ``id_col`` must be unique within ``by`` so that the hash spreads rows evenly.
    """
    item = F.struct(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v"), *attrs)
    number = F.lit(blocks) if isinstance(blocks, int) else blocks
    block = F.pmod(F.xxhash64(id_col), number).cast("int")
    grouped = df.groupBy(*by, block.alias("block")).agg(
        F.collect_list(item).alias("items"), F.max(number.cast("int")).alias("blocks")
    )
    pick = lambda name: F.transform("items", lambda x: x[name])
    return grouped.select(
        *by, "block", "blocks", F.size("items").alias("n"), pick("id").alias("ids"),
        F.flatten(pick("v")).alias("flat"), *[pick(a).alias(a) for a in attrs],
    )


def block_pairs(left: DataFrame, right: DataFrame, by: list[str], right_blocks: int | Column, upper: bool) -> DataFrame:
    """Every left block with every right block (or only ``right >= left`` when symmetric)."""
    start = F.col("block") if upper else F.lit(0)
    end = (F.lit(right_blocks) if isinstance(right_blocks, int) else right_blocks) - 1
    a = left.withColumn("_to", F.explode(F.sequence(start, end)))
    a = a.select(*by, "_to", *[F.col(c).alias(f"a_{c}") for c in left.columns if c not in by])
    b = right.select(*by, F.col("block").alias("_to"), *[F.col(c).alias(f"b_{c}") for c in right.columns if c not in by])
    return a.join(b, [*by, "_to"])


def matrix(flat, n: int) -> np.ndarray:
    return np.asarray(flat, dtype=float).reshape(n, -1)


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances by one matrix product; near-zero ones are redone exactly."""
    xx, yy = (x * x).sum(1)[:, None], (y * y).sum(1)[None, :]
    d = (-2.0 * x) @ y.T
    d += xx
    d += yy
    np.maximum(d, 0.0, out=d)
    if not d.size or d.min() >= 1e-9 * (xx.max() + yy.max()):
        return d
    near = d < 1e-9 * (xx + yy)
    if near.any():
        i, j = np.nonzero(near)
        diff = x[i] - y[j]
        d[i, j] = (diff * diff).sum(1)
    return d


def per_pair(pairs: DataFrame, kernel: Callable[[pd.Series], Iterator[tuple]], schema: str) -> DataFrame:
    """Run ``kernel`` on each block pair; it yields tuples of ``schema``."""
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                out = list(kernel(row))
                if out:
                    yield pd.DataFrame(out, columns=names)

    return pairs.mapInPandas(run, schema)


def side_sizes(df: DataFrame, by: list[str], side: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if(~side).alias("nb"), F.count_if(side).alias("nc"))
