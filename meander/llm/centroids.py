"""Centroid clustering in exact integers: Lloyd rounds, with PCA-rotated filtering of the centroids.

Every vector is stored once with its integers, its ``lead`` leading coordinates after a rotation by principal axes, and
the norm of what is left (the residual).  For a centroid treated the same way, the squared distance of the leading
coordinates plus the squared difference of the residual norms is a lower bound of the squared distance.  A round
computes these bounds for all centroids at once, takes the exact integer distance to the centroid with the least bound,
and verifies in integers all centroids whose bound does not exceed it.  Floating point only decides what is verified, with
a margin for its rounding, so results are exact and ties go to the smaller number.

Rounds are map tasks that send sums per centroid and component; the driver sees centroids (a bounded number), never
vectors but for the axes' sample.  The axes are fitted on at most ``max_sample`` vectors; any rotation gives the same result.

Kept are vectors with exactly ``width`` components, none null or non-finite; others have no row.  A component x counts as
floor(scale x), held to +-2^27 so that squared distances fit into 64 bits (|x| < 524,288 is exact at a scale of 256).
Repeated rows are vectors of their own; of those with one id the smaller components come first as start centroids.  A
vector without an id comes last as a start.  With fewer vectors than ``k`` there are fewer centroids; an empty
table gives an empty result.  A sum of distances beyond 64 bits is null.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meander.llm.common import materialised

HELD = 1 << 27
MARGIN = 1e-9  # of the squared norms: far above the rounding of a bound
CHUNK = 4096


def integers(vectors: DataFrame, *, width: int, scale: int, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id, ints`` of the vectors that take part."""
    col = F.col(embedding).cast("array<double>")
    odd = F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    held = F.transform(
        col, lambda x: F.greatest(F.lit(-float(HELD)), F.least(F.lit(float(HELD)), F.floor(x * scale).cast("double")))
    )
    return vectors.where(F.size(col) == width).where(~odd).select(
        F.col(vec_id).cast("long").alias("vec_id"), held.cast("array<int>").alias("ints")
    )


class Axes:
    """A centre and the orthonormal principal axes, leading ones first."""

    def __init__(self, sample: np.ndarray, width: int, lead: int):
        self.centre = sample.mean(axis=0) if len(sample) else np.zeros(width)
        values, vectors = np.linalg.eigh(np.cov((sample - self.centre).T)) if len(sample) > 1 else (None, np.eye(width))
        self.rotation = np.ascontiguousarray(vectors[:, ::-1])
        self.lead = min(lead, width)

    def place(self, ints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and the norm of the residual."""
        turned = (ints - self.centre) @ self.rotation
        rest = turned[:, self.lead :]
        return turned[:, : self.lead], np.sqrt((rest * rest).sum(axis=1))


def bounds(lead, rest, c_lead, c_rest) -> np.ndarray:
    """Lower bounds of all squared distances, less the margin."""
    norm, c_norm = (lead * lead).sum(axis=1)[:, None], (c_lead * c_lead).sum(axis=1)
    low = norm + c_norm - 2.0 * lead @ c_lead.T + (rest[:, None] - c_rest) ** 2
    return low - MARGIN * (norm + (rest * rest)[:, None] + c_norm + c_rest * c_rest + 1.0)


def nearest(ints, lead, rest, centroids, c_lead, c_rest) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller) and the exact squared distance."""
    rows = np.arange(len(ints))
    low = bounds(lead, rest, c_lead, c_rest)
    guess = low.argmin(axis=1)
    upper = ((ints - centroids[guess]) ** 2).sum(axis=1)
    exact = np.full(low.shape, np.iinfo(np.int64).max)
    exact[rows, guess] = upper
    alive = low <= upper[:, None]
    alive[rows, guess] = False
    i, j = np.nonzero(alive)
    for at in range(0, len(i), CHUNK):
        a, b = i[at : at + CHUNK], j[at : at + CHUNK]
        exact[a, b] = ((ints[a] - centroids[b]) ** 2).sum(axis=1)
    best = exact.argmin(axis=1)
    return best, exact[rows, best]


def _arrays(batch: pa.RecordBatch, width: int, axes: Axes):
    """Chunks of a batch as ``(first row, ints, lead, rest)``."""
    names = batch.schema.names
    flat = lambda name, n: batch.column(names.index(name)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
    ints, lead, rest = flat("ints", width), flat("lead", axes.lead), batch.column(names.index("rest")).to_numpy()
    for at in range(0, len(ints), CHUNK):
        cut = slice(at, at + CHUNK)
        yield at, ints[cut].astype(np.int64), lead[cut], rest[cut]


def placed(rows: DataFrame, axes: Axes, width: int) -> DataFrame:
    """``vec_id, ints, lead, rest``."""

    def run(batches):
        for batch in batches:
            ints = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            lead, rest = axes.place(ints)
            offsets = pa.array(np.arange(len(ints) + 1, dtype=np.int32) * axes.lead)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(lead.ravel())),
                 pa.array(rest)], names=["vec_id", "ints", "lead", "rest"])

    return rows.mapInArrow(run, "vec_id long, ints array<int>, lead array<double>, rest double")


def _sums(stored: DataFrame, centroids: np.ndarray, axes: Axes) -> DataFrame:
    """``cluster, place, total``: components' sums of every cluster, its number of vectors at place -1."""
    k, width = centroids.shape
    c_lead, c_rest = axes.place(centroids)

    def run(batches):
        sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, ints, lead, rest in _arrays(batch, width, axes):
                best, _ = nearest(ints, lead, rest, centroids, c_lead, c_rest)
                counts += np.bincount(best, minlength=k)
                for c in np.unique(best):
                    sums[c] += ints[best == c].sum(axis=0)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, width + 1), pa.int64()),
             pa.array(np.tile(np.arange(-1, width), len(used)), pa.int64()),
             pa.array(np.column_stack([counts[used], sums[used]]).ravel(), pa.int64())],
            names=["cluster", "place", "total"])

    out = stored.select("ints", "lead", "rest").mapInArrow(run, "cluster long, place long, total long")
    return out.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def _assigned(stored: DataFrame, centroids: np.ndarray, axes: Axes) -> DataFrame:
    width = centroids.shape[1]
    c_lead, c_rest = axes.place(centroids)

    def run(batches):
        for batch in batches:
            for at, ints, lead, rest in _arrays(batch, width, axes):
                best, far = nearest(ints, lead, rest, centroids, c_lead, c_rest)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(ints)), pa.array(best.astype(np.int32)), pa.array(far)],
                    names=["vec_id", "cluster", "distance"])

    return stored.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(
    vectors: DataFrame, *, k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: int = 2,
    lead: int = 16, max_sample: int = 20_000, vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """Per kept vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Start centroids are the ``k`` vectors with the smallest sha256 of ``<seed>:<vec_id>``; an empty cluster keeps its
    centroid.  ``k`` and ``width`` are bounded parameters: the driver and every task hold the centroids.
    """
    spark = vectors.sparkSession
    schema = ("vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = integers(vectors, width=width, scale=scale, vec_id=vec_id, embedding=embedding)
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    # written, not collected: collecting would send every partition's first rows to the driver
    starts = rows.select(by_hash.alias("h"), "ints").orderBy(F.col("h").asc_nulls_last(), "ints").limit(k)
    starts = materialised(starts, "starts").orderBy(F.col("h").asc_nulls_last(), "ints").collect()
    if not starts:
        return spark.createDataFrame([], schema)
    share = min(1.0, 2.0 * max_sample / rows.count())
    sample = rows.where(F.pmod(F.xxhash64("vec_id", "ints"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = materialised(sample.select("ints").limit(max_sample), "sample").collect()
    axes = Axes(np.array([r.ints for r in sample], np.float64).reshape(-1, width), width, lead)
    stored = materialised(placed(rows, axes, width), "placed-vectors")

    centroids = np.array([r.ints for r in starts], np.int64)
    for _ in range(rounds):
        found = {(r.cluster, r.place): int(r.total) for r in _sums(stored, centroids, axes).collect()}
        for c, place in found:
            if place >= 0:
                centroids[c, place] = found[c, place] // found[c, -1]
    out = materialised(_assigned(stored, centroids, axes), "assigned")
    totals = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    whole = sum(int(r.total) for r in totals)
    fits = lambda x: x if x < 1 << 63 else None
    told = [
        (r.cluster, fits(int(r.total)), fits(whole),
         hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest())
        for r in totals
    ]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(told), "cluster").select(  # at most k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def sql(*, k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: int = 2) -> str:
    """The same in DuckDB SQL (all distances in full)."""
    far = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT p.rid, p.vec_id, p.v, c.c, CAST({far} AS BIGINT) AS far FROM kept p CROSS JOIN c{i} c
  QUALIFY row_number() OVER (PARTITION BY p.rid ORDER BY far, c.c) = 1)""")
        if i < rounds:
            steps.append(f"""
s{i} AS (SELECT c, d, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM a{i})
  GROUP BY c, d),
m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY d) AS v FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN m{i} m ON o.c = m.c)""")
    return f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id,
    list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {width}
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v FROM (
    SELECT sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {k})),
{",".join(steps)}
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.far AS distance,
  CAST(sum(a.far) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.far) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.c = c.c"""
