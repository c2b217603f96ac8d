"""Approximate nearest neighbours by cosine: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample of unit vectors (``max_sample``); every row is then put into its leaf.  A query
walks the tree through a priority queue of branches, nearest centre first, and visits leaves in that order.  How many
leaves it visits is calibrated: the exact neighbours of ``calibration`` queries are found by a scan over all rows, and
visits are widened until the tree finds ``recall`` of them.  Each query also goes on until its leaves hold enough rows.

Equal vectors are one candidate with its smallest ids, so a vector that a third of the rows share costs one row.
Leaves are dealt to shards of a bounded number of vectors (a large leaf to several), and shards meet portions of the
queries that visit them.

Vectors that are null, zero, hold null or non-finite parts, or have another length than most take no part; rows with a
null id neither.  Of repeated rows with one id and one vector, one counts.  Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meander.llm.common import materialised, sliced

SHARD = 2048
PORTION = 4096


@dataclass
class Tree:
    """``children[i]`` are node numbers, empty for a leaf; ``leaf[i]`` is the leaf's number or -1."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, units: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector: down the nearest centres."""
        out = np.zeros(len(units), np.int64)
        stack = [(0, np.arange(len(units)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            kids = self.children[node]
            c = self.centres[kids]
            near = ((c * c).sum(axis=1) - 2.0 * units[rows] @ c.T).argmin(axis=1)
            stack += [(kid, rows[near == i]) for i, kid in enumerate(kids)]
        return out

    def order(self, unit: np.ndarray):
        """Leaf numbers, best bin first."""
        far = (self.centres * self.centres).sum(axis=1) - 2.0 * self.centres @ unit
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.children[node]:
                for kid in self.children[node]:
                    heapq.heappush(queue, (float(far[kid]), kid))
            else:
                yield int(self.leaf[node])


def grow(units: np.ndarray, *, branching: int = 8, leaf_size: int = 64, rounds: int = 6, seed: int = 3) -> Tree:
    """k-means, then k-means within each cluster, down to about ``leaf_size`` rows."""
    rng = np.random.default_rng(seed)
    width = units.shape[1] if units.ndim == 2 else 1
    centres, children, leaf = [np.zeros(width)], [[]], [-1]
    todo, leaves = [(0, units)], 0
    while todo:
        node, rows = todo.pop()
        k = min(branching, len(rows) // max(leaf_size // 2, 1))
        near = None
        if len(rows) > leaf_size and k > 1:
            c = rows[rng.choice(len(rows), k, replace=False)]
            for _ in range(rounds):
                near = ((c * c).sum(axis=1) - 2.0 * rows @ c.T).argmin(axis=1)
                for i in range(k):
                    if (near == i).any():
                        c[i] = rows[near == i].mean(axis=0)
            near = ((c * c).sum(axis=1) - 2.0 * rows @ c.T).argmin(axis=1)
        if near is None or len(np.unique(near)) < 2:
            leaf[node] = leaves
            leaves += 1
            continue
        for i in np.unique(near):
            children[node].append(len(centres))
            centres.append(c[i])
            children.append([])
            leaf.append(-1)
            todo.append((len(centres) - 1, rows[near == i]))
    return Tree(np.array(centres), children, np.array(leaf))


def _matrix(column, width: int) -> np.ndarray:
    """A list column as doubles, one row each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, width)


def _safe(m: np.ndarray) -> np.ndarray:
    """Rows whose squares would overflow or vanish, scaled by a power of two (which changes no cosine); others as is."""
    top = np.abs(m).max(axis=1, initial=0.0)
    power = np.where((top > 1e120) | (top < 1e-120), np.frexp(top)[1], 0)
    return np.ldexp(m, -power[:, None]) if power.any() else m


def _unit(m: np.ndarray) -> np.ndarray:
    m = _safe(m)
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def valid(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, int]:
    """``vec_id, vec, k1, k2`` of the rows that take part, and their length."""
    vec = F.col(embedding)
    good = vec.isNotNull() & F.col(vec_id).isNotNull() & F.forall(
        vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ) & F.exists(vec, lambda x: x != 0)
    rows = vectors.where(good).select(F.col(vec_id).alias("vec_id"), vec.alias("vec"))
    common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    width = int(common[0]) if common else 0
    keyed = rows.where(F.size("vec") == width).withColumns(
        {"k1": F.xxhash64("vec"), "k2": F.xxhash64(F.lit(1), "vec")}
    )
    return keyed, width


def nearest(vectors: DataFrame, *, k: int = 5, every: int = 50, recall: float = 0.95, calibration: int = 64,
            max_sample: int = 20_000, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of every row whose id is divisible by ``every``, against all other rows."""
    rows, width = valid(vectors, vec_id, embedding)
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not width:
        return empty
    rows = materialised(rows, "vectors")
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", "k1", "k2").distinct()
    # a vector's k + 1 smallest ids are all that any query can return of it
    ranked = rows.select("vec_id", "k1", "k2").distinct().withColumn(
        "i", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
    ).where(F.col("i") <= k + 1)
    ids = ranked.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    vecs = rows.groupBy("k1", "k2").agg(F.first("vec").alias("vec"))
    asked = queries.select("k1", "k2").distinct().withColumn("asked", F.lit(True))
    distinct = vecs.join(ids, ["k1", "k2"]).join(asked, ["k1", "k2"], "left").withColumn(
        "asked", F.coalesce("asked", F.lit(False))
    )
    distinct = materialised(distinct, "distinct-vectors")

    n = distinct.count()
    u = F.pmod(F.col("k1"), F.lit(1 << 30)) / float(1 << 30)
    sample = distinct.where(u < max_sample / n).select("vec").limit(max_sample).toArrow()
    tree = grow(_unit(_matrix(sample.column(0), width)) if sample.num_rows else np.zeros((0, width)))
    shared = spark.sparkContext.broadcast(tree)  # at most max_sample / leaf_size * 2 leaves

    def place(batches):
        for batch in batches:
            leaf = shared.value.assign(_unit(_matrix(batch.column(2), width)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)],
                                             names=["k1", "k2", "vec", "ids", "asked", "leaf"])

    kind = distinct.schema["vec"].dataType.simpleString()
    schema = f"k1 long, k2 long, vec {kind}, ids array<long>, asked boolean, leaf long"
    placed = materialised(distinct.select("k1", "k2", "vec", "ids", "asked").mapInArrow(place, schema), "leaves")

    counts = np.zeros(tree.leaves, np.int64)
    for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():  # a row per leaf
        counts[r["leaf"]] = r["n"]
    first, blocks, shard, room = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, SHARD
    for leaf, m in enumerate(counts):
        if m > SHARD:
            first[leaf], blocks[leaf] = shard + 1, -(-m // SHARD)
            shard, room = shard + int(blocks[leaf]) + 1, SHARD
        else:
            if m > room:
                shard, room = shard + 1, SHARD
            first[leaf], room = shard, room - m

    visits = _calibrated(placed, tree, width, k, recall, calibration)
    n_asked = placed.where("asked").count()
    portions = max(1, -(-n_asked // PORTION))

    def ask(batches):
        """A row for each shard that a query visits, with the leaves it visits there."""
        for batch in sliced(batches, 512):
            out = []
            units = _unit(_matrix(batch.column(2), width))
            for k1, k2, unit, vec in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), units,
                                         batch.column(2).to_pylist(), strict=True):
                found, held = {}, 0
                for i, leaf in enumerate(shared.value.order(unit)):
                    if i >= visits and held > k:
                        break
                    held += counts[leaf]
                    for s in range(first[leaf], first[leaf] + blocks[leaf]):
                        found.setdefault(int(s), []).append(leaf)
                out += [(s, k1 % portions, k1, k2, vec, leaves) for s, leaves in found.items()]
            arrays = [pa.array([r[i] for r in out], t) for i, t in enumerate(
                [pa.int64()] * 4 + [batch.schema.field(2).type, pa.list_(pa.int64())])]
            yield pa.RecordBatch.from_arrays(arrays, names=["shard", "portion", "k1", "k2", "vec", "leaves"])

    asks = placed.where("asked").select("k1", "k2", "vec").mapInArrow(
        ask, f"shard long, portion long, k1 long, k2 long, vec {kind}, leaves array<long>"
    )
    deal = spark.createDataFrame(
        [(i, int(f), int(b)) for i, (f, b) in enumerate(zip(first, blocks, strict=True))],
        "leaf long, first long, blocks long",
    )  # a row per leaf
    stored = placed.join(F.broadcast(deal), "leaf").select(
        (F.col("first") + F.pmod(F.col("k2"), F.col("blocks"))).alias("shard"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(portions - 1).cast("long"))).alias("portion"),
        "leaf", "vec", "ids",
    )

    def meet(key, left, right):
        out = {name: [] for name in ("k1", "k2", "vec_id", "score")}
        if left.num_rows and right.num_rows:
            c, leaf = _safe(_matrix(left.column("vec"), width)), left.column("leaf").to_numpy()
            ids = left.column("ids").to_pylist()
            q = _safe(_matrix(right.column("vec"), width))
            unit_c, unit_q = _unit(c), _unit(q)
            visited = right.column("leaves").to_pylist()
            k1, k2 = right.column("k1").to_pylist(), right.column("k2").to_pylist()
            low = np.array([i[0] for i in ids])
            for i in range(len(q)):
                rows = np.flatnonzero(np.isin(leaf, visited[i]))
                near = unit_c[rows] @ unit_q[i]
                if len(rows) > k + 1:  # all that tie with the last one stay
                    rows = rows[near >= np.partition(near, -(k + 1))[-(k + 1)] - 1e-12]
                score = (c[rows] * q[i]).sum(axis=1) / np.sqrt((c[rows] ** 2).sum(axis=1) * (q[i] ** 2).sum())
                best = np.lexsort((low[rows], -score))
                pairs = sorted((-score[b], v) for b in best for v in ids[rows[b]])[: k + 1]
                out["k1"] += [k1[i]] * len(pairs)
                out["k2"] += [k2[i]] * len(pairs)
                out["vec_id"] += [v for _, v in pairs]
                out["score"] += [float(-s) for s, _ in pairs]
        return pa.table({"k1": pa.array(out["k1"], pa.int64()), "k2": pa.array(out["k2"], pa.int64()),
                         "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    met = stored.groupBy("shard", "portion").cogroup(asks.groupBy("shard", "portion")).applyInArrow(
        meet, "k1 long, k2 long, vec_id long, score double"
    )
    best = met.withColumn(
        "i", F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "vec_id"))
    ).where(F.col("i") <= k + 1)
    lists = best.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("i", "vec_id", "score"))).alias("found"))
    own = F.filter("found", lambda f: f["vec_id"] != F.col("query_id"))
    return queries.withColumnRenamed("vec_id", "query_id").join(lists, ["k1", "k2"]).select(
        "query_id", F.posexplode(F.slice(own, 1, k)).alias("place", "f")
    ).select(F.col("query_id").cast("long"), (F.col("place") + 1).cast("int").alias("rank"),
             F.col("f.vec_id").cast("long").alias("vec_id"), F.col("f.score").alias("score"))


def _calibrated(placed: DataFrame, tree: Tree, width: int, k: int, recall: float, calibration: int) -> int:
    """Leaf visits at which ``recall`` of the exact neighbours of the calibration queries are found."""
    picked = placed.where("asked").orderBy("k2", "k1").limit(calibration).select("k1", "k2", "vec").toArrow()
    if not picked.num_rows:
        return 1
    q, keys = _unit(_matrix(picked.column("vec"), width)), picked.column("k1").to_numpy()

    def scan(batches):
        score = np.zeros((len(q), 0))
        leaf = np.zeros((len(q), 0), np.int64)
        for batch in batches:
            s = q @ _unit(_matrix(batch.column(1), width)).T
            k1 = batch.column(0).to_numpy()
            s[keys[:, None] == k1[None, :]] = -np.inf  # not itself
            score = np.concatenate([score, s], axis=1)
            leaf = np.concatenate([leaf, np.broadcast_to(batch.column(2).to_numpy(), s.shape)], axis=1)
            if score.shape[1] > k:
                top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                score, leaf = np.take_along_axis(score, top, axis=1), np.take_along_axis(leaf, top, axis=1)
        which = np.repeat(np.arange(len(q)), score.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(score.ravel()), pa.array(leaf.ravel())],
                                         names=["q", "score", "leaf"])

    found = placed.select("k1", "vec", "leaf").mapInArrow(scan, "q long, score double, leaf long")
    w = Window.partitionBy("q").orderBy(F.desc("score"))
    exact = found.where(F.col("score") > float("-inf")).withColumn("i", F.row_number().over(w)).where(
        F.col("i") <= k).select("q", "leaf").collect()  # k rows for each calibration query
    place = [{leaf: i for i, leaf in enumerate(tree.order(u))} for u in q]
    needed = np.sort([place[r["q"]][r["leaf"]] for r in exact]) + 1
    visits = 1
    while needed.size and (needed <= visits).mean() < recall:
        visits += 1
    return visits
