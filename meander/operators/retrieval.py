"""Nearest chunks of query vectors by cosine distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meander.operators.blocks import BLOCK_ROWS, block_count, matrix, packed

SMALL_CELLS = 4_000_000  # numbers in a query set that may ship to every task (32 MB)
QUERY_TILE, CHUNK_TILE = 1024, 4096  # sides of a distance matrix (32 MB)
STRIPE_BLOCKS = 256  # chunk blocks that share one running result


def vector_topk(
    queries: DataFrame, chunks: DataFrame, k: int = 3, query_id: str = "query_id", chunk_id: str = "chunk_id",
    vec: str = "embedding", block_rows: int = BLOCK_ROWS, small_cells: int = SMALL_CELLS,
) -> DataFrame:
    """``query_id, chunk_id, distance, rank`` of the ``k`` nearest chunks per query.

    A query set of up to ``small_cells`` numbers ships to every task and the chunks
    stream past it unshuffled.  A larger one meets the chunks block by block.  Both
    keep a running best ``k`` per query, so the final ranking sees few rows: ``k`` per
    query and task, or per query and stripe of blocks.
    Distances count as equal within 1e-9, then the lower id wins.
    """
    q_type = queries.schema[query_id].dataType.simpleString()
    c_type = chunks.schema[chunk_id].dataType.simpleString()
    schema = f"query_id {q_type}, chunk_id {c_type}, distance double"
    rows, width = queries.agg(F.count(F.lit(1)), F.max(F.size(vec))).first()
    if rows * (width or 0) <= small_cells:
        best = _against_shipped(queries, chunks, k, query_id, chunk_id, vec, schema)
    else:
        best = _against_blocks(queries, chunks, k, query_id, chunk_id, vec, schema, rows, block_rows)
    w = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.full_like(m, np.nan), where=norms > 0)


def _nearest(q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ids of the ``k`` nearest rows of ``c`` for each row of ``q`` (unit vectors)."""
    order = np.argsort(ids, kind="stable")
    d = np.round(1.0 - q @ c[order].T, 9)
    if d.shape[1] > k:
        # only rows up to the k-th distance are put in order
        np.copyto(d, np.inf, where=np.isnan(d))
        row, col = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k])
        placed = np.lexsort((col, d[row, col], row))
        first = np.searchsorted(row, np.arange(len(q)))
        best = col[placed[first[:, None] + np.arange(k)]]
        near = np.take_along_axis(d, best, 1)
        return np.where(np.isinf(near), np.nan, near), ids[order][best]
    best = np.argsort(d, axis=1, kind="stable")[:, :k]  # undefined distances sort last
    return np.take_along_axis(d, best, 1), ids[order][best]


def _running(q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int, kept=None) -> tuple[np.ndarray, np.ndarray]:
    """``kept`` (distances, ids) brought up to date with the rows of ``c``, one tile of distances at a time."""
    tops = []
    for i in range(0, len(q), QUERY_TILE):
        part = slice(i, i + QUERY_TILE)
        top = None if kept is None else (kept[0][part], kept[1][part])
        for j in range(0, len(c), CHUNK_TILE):
            d, near = _nearest(q[part], c[j : j + CHUNK_TILE], ids[j : j + CHUNK_TILE], k)
            if top is not None:
                d, near = np.hstack([top[0], d]), np.hstack([top[1], near])
                best = np.lexsort((near, d), axis=1)[:, :k]
                d, near = np.take_along_axis(d, best, 1), np.take_along_axis(near, best, 1)
            top = d, near
        tops.append(top)
    return np.vstack([d for d, _ in tops]), np.vstack([near for _, near in tops])


def _table(query_ids, d: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
    out = pd.DataFrame(
        {"query_id": np.repeat(np.asarray(query_ids), d.shape[1]), "chunk_id": ids.ravel(), "distance": d.ravel()}
    )
    return out.dropna(subset=["distance"])


def _against_shipped(queries, chunks, k, query_id, chunk_id, vec, schema):
    q = queries.select(query_id, vec).toPandas()  # bounded by the caller's check
    q_ids = q[query_id].to_numpy()
    q_unit = _unit(np.vstack(q[vec].to_numpy()).astype(float)) if len(q) else np.zeros((0, 1))

    def run(batches):
        kept = None
        for pdf in batches:
            if not len(pdf) or not len(q_ids):
                continue
            unit = _unit(np.vstack(pdf[vec].to_numpy()).astype(float))
            kept = _running(q_unit, unit, pdf[chunk_id].to_numpy(), k, kept)
        if kept is not None:
            yield _table(q_ids, *kept)

    return chunks.select(chunk_id, vec).mapInPandas(run, schema)


def _against_blocks(queries, chunks, k, query_id, chunk_id, vec, schema, rows, block_rows):
    qb, cb = block_count(rows, block_rows), block_count(chunks.count(), block_rows)
    q = packed(queries.withColumnRenamed(query_id, "id"), [], "id", vec, qb, [])
    c = packed(chunks.withColumnRenamed(chunk_id, "id"), [], "id", vec, cb, [])
    return running_blocks(q.withColumn("others", F.lit(cb)), c.withColumn("others", F.lit(qb)), [], k, schema)


def running_blocks(q: DataFrame, c: DataFrame, by: list[str], k: int, schema: str) -> DataFrame:
    """Best ``k`` per query of each block of ``q`` against the blocks of ``c`` with the same ``by``.

    Both sides come from :func:`packed`, with the other side's number of blocks as ``others``.  Chunk
    blocks are dealt to stripes of ``STRIPE_BLOCKS``; a query block meets a stripe block by block and
    keeps one running result, so ``k`` rows per query and stripe leave the task, however many blocks
    the stripe holds.
    """
    on = [*by, "_block", "_stripe"]
    a = q.select(
        *by, F.col("block").alias("_block"),
        F.explode(F.sequence(F.lit(0), F.floor((F.col("others") - 1) / STRIPE_BLOCKS).cast("int"))).alias("_stripe"),
        F.col("n").alias("a_n"), F.col("ids").alias("a_ids"), F.col("flat").alias("a_flat"),
    )
    b = c.select(
        *by, F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("_block"),
        F.floor(F.col("block") / STRIPE_BLOCKS).cast("int").alias("_stripe"),
        F.col("n").alias("b_n"), F.col("ids").alias("b_ids"), F.col("flat").alias("b_flat"),
    )

    def run(batches):
        group = ids = unit = kept = None
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                key = tuple(row[: len(on)])  # a join by names puts its keys first
                if key != group:
                    if kept is not None:
                        yield _table(ids, *kept)
                    group, ids, kept = key, row.a_ids, None
                    unit = _unit(matrix(row.a_flat, row.a_n))
                kept = _running(unit, _unit(matrix(row.b_flat, row.b_n)), np.asarray(row.b_ids), k, kept)
        if kept is not None:
            yield _table(ids, *kept)

    # a sort-merge join lays the rows of one group together; were they apart, more rows would leave, the same ones in the end
    return a.join(b.hint("merge"), on).mapInPandas(run, schema)


def multi_query_topk(sub_queries: DataFrame, chunks: DataFrame, k: int = 3, **kw) -> DataFrame:
    """Contexts of a request made of several sub-queries, in sub-query order.

    ``sub_queries``: ``request_id, pos, query_id, embedding``.  Chunks found by
    several sub-queries stay repeated.
    """
    best = vector_topk(sub_queries, chunks, k, **kw)
    placed = best.join(sub_queries.select("request_id", "pos", "query_id"), "query_id")
    # k rows per sub-query of a request
    return placed.groupBy("request_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "rank", "chunk_id"))), lambda x: x["chunk_id"]
        ).alias("contexts")
    )
