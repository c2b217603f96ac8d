"""A stored inverted-list index over chunk vectors: cells as partition folders, searched by pruned reads.

``build_index`` puts every chunk into the cell of its nearest centroid and writes one folder per
cell.  ``search_index`` reads only the cells its queries ask for.  The exact search
(:func:`meander.operators.retrieval.vector_topk`) stays the default; the index trades recall for
reading less, and ``calibrate_probes`` measures that trade against the exact search.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meander.functions.runtime import cut_lineage
from meander.operators.blocks import BLOCK_ROWS
from meander.operators.retrieval import QUERY_TILE, SMALL_CELLS, _running, _table, _unit, vector_topk

MAX_CELLS = 4096  # centroids ship to every task
BLOCK_NUMBERS = 1 << 20  # of a block of queries (8 MB)
STRIPE_BLOCKS = 8  # chunks of a stripe, in blocks
OUTSIDE = -1  # the cell of vectors without a direction (null, empty, zero, not finite): never a result


def _directions(vectors) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the usable rows and the mask of these rows.

    The width is that of the first usable row; rows of another width are not usable.
    """
    rows = [None if v is None else np.asarray(v, dtype=float) for v in vectors]
    good = [r is not None and r.size > 0 and bool(np.isfinite(r).all()) and bool(r.any()) for r in rows]
    width = next((r.size for r, g in zip(rows, good, strict=True) if g), 0)
    mask = np.array([g and r.size == width for r, g in zip(rows, good, strict=True)], dtype=bool)
    unit = np.vstack([r for r, m in zip(rows, mask, strict=True) if m]) if mask.any() else np.zeros((0, width))
    return _unit(unit), mask


def _train(x: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    """Spherical k-means on a bounded sample; empty cells keep their centroid."""
    centers = np.unique(x, axis=0)
    centers = centers[np.linspace(0, len(centers) - 1, min(cells, len(centers))).astype(int)]
    for _ in range(rounds):
        own = np.argmax(x @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        moved = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centers)
        if np.array_equal(moved, centers):
            break
        centers = moved
    return centers


def build_index(
    chunks: DataFrame, path: str, cells: int | None = None, max_sample: int = 20_000, rounds: int = 10,
    chunk_id: str = "chunk_id", vec: str = "embedding",
) -> None:
    """Store ``chunks`` (their id and vector) by cell below ``path``; every row is stored.

    Centroids are fitted on at most ``max_sample`` rows, picked by a hash of their id; without
    ``cells`` there are about as many as the root of the row count, up to ``MAX_CELLS``.
    Rows without a direction lie in cell -1, which no search reads.
    """
    spark = chunks.sparkSession
    rows = chunks.select(F.col(chunk_id).alias("chunk_id"), F.col(vec).cast("array<double>").alias("embedding"))
    n = rows.count()
    u = F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30))
    bound = min(1.0, 3.0 * max_sample / max(n, 1))
    sample = rows.withColumn("_u", u).filter(F.col("_u") <= bound * (1 << 30)).orderBy("_u", "chunk_id").limit(max_sample)
    unit, _ = _directions(sample.toPandas()["embedding"])
    centers = _train(unit, cells or min(MAX_CELLS, max(1, math.isqrt(n))), rounds) if len(unit) else np.zeros((0, 1))

    def assign(batches):
        for pdf in batches:
            unit, mask = _directions(pdf["embedding"])
            cell = np.full(len(pdf), OUTSIDE, dtype=np.int32)
            if len(centers) and unit.shape[1] == centers.shape[1]:
                cell[mask] = np.concatenate([[], *(np.argmax(t @ centers.T, axis=1) for t in _tiles(unit))])
            yield pdf.assign(cell=cell)

    id_type = rows.schema["chunk_id"].dataType.simpleString()
    placed = rows.mapInPandas(assign, f"chunk_id {id_type}, embedding array<double>, cell int")
    rows.limit(0).write.mode("overwrite").parquet(f"{path}/schema")  # column types, also of an index without rows
    # rebalance: one set of files per cell, large cells split again by AQE
    placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/chunks")
    table = spark.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(centers)], "cell int, center array<double>"
    )
    counts = _stored(spark, path).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    table.join(counts, "cell", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).write.mode(
        "overwrite"
    ).parquet(f"{path}/centers")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(f"{path}/schema").schema.add("cell", "integer")
    return spark.read.schema(schema).parquet(f"{path}/chunks")


def _centers(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centers").orderBy("cell").toPandas()["center"]  # at most MAX_CELLS rows
    return np.vstack(rows.to_numpy()) if len(rows) else np.zeros((0, 1))


def _tiles(unit: np.ndarray):
    return (unit[i : i + QUERY_TILE] for i in range(0, len(unit), QUERY_TILE))


def _probed(queries: DataFrame, centers: np.ndarray, probes: int) -> DataFrame:
    """``query_id, embedding, cells``: the ``probes`` nearest cells of each query, nearest first; a vector stands once."""

    def run(batches):
        for pdf in batches:
            unit, mask = _directions(pdf["embedding"])
            if not len(centers) or unit.shape[1] != centers.shape[1]:
                continue
            some = pdf[mask]
            near = [np.argsort(-(t @ centers.T), axis=1, kind="stable")[:, :probes].astype(np.int32) for t in _tiles(unit)]
            yield some.assign(cells=[row for part in near for row in part])

    id_type = queries.schema["query_id"].dataType.simpleString()
    return queries.mapInPandas(run, f"query_id {id_type}, embedding array<double>, cells array<int>")


def search_index(
    queries: DataFrame, path: str, k: int = 3, probes: int = 8, query_id: str = "query_id", vec: str = "embedding",
    block_rows: int = BLOCK_ROWS, small_cells: int = SMALL_CELLS,
) -> DataFrame:
    """``query_id, chunk_id, distance, rank`` of the ``k`` nearest chunks in each query's ``probes`` nearest cells.

    Only the folders of cells that some query asks for are read.  With ``probes`` at least the
    number of cells the result is that of the exact search.  Few queries ship to the tasks and the
    cells stream past them; many are dealt to blocks that meet stripes of cells, see :func:`_blocks_past_stripes`.
    """
    spark = queries.sparkSession
    q = queries.select(F.col(query_id).alias("query_id"), F.col(vec).cast("array<double>").alias("embedding"))
    # stored once: read for the sizes and for the search
    probed = cut_lineage(_probed(q, _centers(spark, path), probes))
    asks = probed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("asks"))
    asks = asks.toPandas()  # at most MAX_CELLS rows
    width = probed.agg(F.max(F.size("embedding"))).first()[0] or 0
    stored = _stored(spark, path)
    chunks = stored.filter(F.col("cell").isin([int(c) for c in asks["cell"]]))
    types = [q.schema["query_id"].dataType.simpleString(), stored.schema["chunk_id"].dataType.simpleString()]
    schema = f"query_id {types[0]}, chunk_id {types[1]}, distance double"
    if int(asks["asks"].sum()) * width <= small_cells:
        best = _cells_past_queries(probed.withColumn("cell", F.explode("cells")).drop("cells"), chunks, k, schema)
    else:
        best = _blocks_past_stripes(probed, chunks, set(asks["cell"]), path, k, schema, block_rows, width)
    w = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _blocks_past_stripes(
    probed: DataFrame, chunks: DataFrame, wanted: set, path: str, k: int, schema: str, block_rows: int, width: int
) -> DataFrame:
    """Blocks of queries meet stripes of cells; ``k`` rows per query and stripe leave a task.

    A stripe is some ``STRIPE_BLOCKS * block_rows`` chunks of neighbouring cells, or a part of a larger cell.  Queries with near
    first cells share a block of up to ``BLOCK_NUMBERS`` numbers, so that one block asks for few stripes unless
    there are many probes.  A task holds one block and one stripe, however many cells a query asks for.
    """
    spark = probed.sparkSession
    centers = _centers(spark, path)
    line = _along(centers)  # cells in an order that keeps near ones together
    held = {r["cell"]: r["n"] for r in spark.read.parquet(f"{path}/centers").select("cell", "n").collect()}
    homes = {r["c"]: r["n"] for r in probed.groupBy(F.col("cells")[0].alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    stripes = _dealt([(c, held[c]) for c in line if c in wanted and held[c]], STRIPE_BLOCKS * block_rows)
    blocks = _dealt([(c, homes[c]) for c in line if c in homes], block_rows * max(1, BLOCK_NUMBERS // (block_rows * max(width, 1))))
    table = lambda dealt, name: spark.createDataFrame(
        [(int(c), first, parts) for c, (first, parts) in dealt.items()], f"cell int, _{name} int, _{name}_parts int"
    )
    part = lambda key, name: (F.col(f"_{name}") + F.pmod(F.xxhash64(key), F.col(f"_{name}_parts"))).cast("int")
    c = chunks.join(table(stripes, "stripe"), "cell").select(
        "chunk_id", "embedding", "cell", part("chunk_id", "stripe").alias("stripe")
    )
    q = probed.withColumn("cell", F.col("cells")[0]).join(table(blocks, "block"), "cell")
    q = q.select("query_id", "embedding", "cells", part("query_id", "block").alias("block"))

    def spread(batches):
        for pdf in batches:
            rows = []
            for at, cells in enumerate(pdf["cells"]):
                own: dict = {}
                for cell in cells:
                    first, parts = stripes.get(int(cell), (0, 0))
                    for stripe in range(first, first + parts):
                        own.setdefault(stripe, []).append(int(cell))
                rows += [(at, stripe, some) for stripe, some in own.items()]
                if len(rows) >= 1000:
                    yield _spread_rows(pdf, rows)
                    rows = []
            if rows:
                yield _spread_rows(pdf, rows)

    q = q.mapInPandas(spread, f"{schema.split(',')[0]}, embedding array<double>, cells array<int>, block int, stripe int")
    need = q.select(F.col("block").alias("_block"), F.col("stripe").alias("_stripe")).distinct()
    c = c.join(need, F.col("stripe") == F.col("_stripe")).select(
        "chunk_id", "embedding", "cell", F.col("_block").alias("c_block"), F.col("_stripe").alias("c_stripe")
    )

    def meet(asked, held):
        if not len(asked) or not len(held):
            return pd.DataFrame(columns=["query_id", "chunk_id", "distance"])
        unit, ids = _unit(np.vstack(asked["embedding"].to_numpy())), held["chunk_id"].to_numpy()
        kept = np.full((len(unit), k), np.nan), np.full((len(unit), k), ids[0])
        sizes = asked["cells"].map(len).to_numpy()
        row, cell = np.repeat(np.arange(len(unit)), sizes), np.concatenate(asked["cells"].to_numpy())
        own = held.groupby("cell").indices
        if (sizes == sizes.max()).all() and sizes.max() == len(np.unique(cell)):
            own = {None: np.arange(len(held))}  # every query asks for every cell here
        for c, at in own.items():
            rows = np.arange(len(unit)) if c is None else np.sort(row[cell == c])
            if len(rows):
                d, near = _running(
                    unit[rows], _unit(np.vstack(held["embedding"].to_numpy()[at])), ids[at], k, (kept[0][rows], kept[1][rows])
                )
                kept[0][rows], kept[1][rows] = d, near
        return _table(asked["query_id"].to_numpy(), *kept)

    return q.groupBy("block", "stripe").cogroup(c.groupBy("c_block", "c_stripe")).applyInPandas(meet, schema)


def _spread_rows(pdf: pd.DataFrame, rows: list) -> pd.DataFrame:
    at, stripe, cells = zip(*rows, strict=True)
    out = pdf.iloc[list(at)].assign(cells=list(cells), stripe=np.array(stripe, np.int32))
    return out[["query_id", "embedding", "cells", "block", "stripe"]]


def _along(centers: np.ndarray) -> list[int]:
    """Cells by their place on the centroids' main axis."""
    if len(centers) < 2:
        return list(range(len(centers)))
    moved = centers - centers.mean(0)
    return [int(i) for i in np.argsort(moved @ np.linalg.eigh(moved.T @ moved)[1][:, -1], kind="stable")]


def _dealt(sizes: list[tuple[int, int]], most: int) -> dict[int, tuple[int, int]]:
    """First number and count of the parts of each cell: cells share a part of up to ``most`` rows, a larger cell has several."""
    out, number, filled = {}, 0, 0
    for cell, n in sizes:
        if filled and filled + n > most:
            number, filled = number + 1, 0
        parts = -(-n // most)
        out[cell] = (number, parts)
        number, filled = (number, filled + n) if parts == 1 else (number + parts, 0)
    return out


def _cells_past_queries(probed: DataFrame, chunks: DataFrame, k: int, schema: str) -> DataFrame:
    q = probed.toPandas()  # bounded by the caller's check
    asked = {}
    for cell, part in q.groupby("cell", sort=False):
        asked[int(cell)] = (part["query_id"].to_numpy(), _unit(np.vstack(part["embedding"].to_numpy())))

    def run(batches):
        kept = {}
        for pdf in batches:
            for cell, part in pdf.groupby("cell", sort=False):
                unit = _unit(np.vstack(part["embedding"].to_numpy()))
                own = asked[int(cell)][1]
                kept[int(cell)] = _running(own, unit, part["chunk_id"].to_numpy(), k, kept.get(int(cell)))
        tables = [_table(asked[c][0], *best) for c, best in kept.items()]
        if tables:
            yield pd.concat(tables)

    return chunks.select("chunk_id", "embedding", "cell").mapInPandas(run, schema)


def calibrate_probes(
    queries: DataFrame, path: str, k: int = 3, recall: float = 0.95, sample: int = 64,
    query_id: str = "query_id", vec: str = "embedding",
) -> int:
    """Fewest probes that find ``recall`` of the exact neighbours of ``sample`` queries (picked by a hash of their id).

    One exact search of the sample; where a neighbour's cell stands in the query's order of cells says
    how many probes reach it.
    """
    spark = queries.sparkSession
    q = queries.select(F.col(query_id).alias("query_id"), F.col(vec).cast("array<double>").alias("embedding"))
    q = q.filter(F.size("embedding") > 0).orderBy(F.xxhash64("query_id"), "query_id").limit(sample)
    centers = _centers(spark, path)
    stored = _stored(spark, path).filter(F.col("cell") != OUTSIDE)
    true = vector_topk(q, stored, k).join(stored.select("chunk_id", "cell"), "chunk_id").select("query_id", "cell")
    hits = true.toPandas()  # k rows per sampled query
    own = q.toPandas()
    unit, mask = _directions(own["embedding"])
    if not len(hits):
        return 1
    place = np.argsort(np.argsort(-(unit @ centers.T), axis=1, kind="stable"), axis=1)
    at = {i: row for i, row in zip(own["query_id"][mask], place, strict=True)}
    ranks = np.sort([int(at[i][c]) for i, c in zip(hits["query_id"], hits["cell"], strict=True)])
    return int(ranks[max(0, math.ceil(recall * len(ranks)) - 1)]) + 1
