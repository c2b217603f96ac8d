"""Queries over embeddings: tracks by label, odd ids against even ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from meander.functions.columns import rounded
from meander.functions.runtime import scratch_path
from meander.operators import chunk_index, mmd, retrieval, sliced
from meander.operators import pca as pc
from meander.plans import inputs
from meander.plans.catalog_divergence import VEC_SIDES_SQL
from meander.plans.registry import query

BY = ["track"]

DIST_SQL = VEC_SIDES_SQL + """, pr AS (
  SELECT a.track, a.vec_id AS i, b.vec_id AS j, a.is_current AS ci, b.is_current AS cj,
         pow(list_distance(a.embedding, b.embedding), 2) AS d
  FROM vecs a JOIN vecs b ON a.track = b.track)"""

GAMMA_SQL = DIST_SQL + """, gm AS (
  SELECT track, CASE WHEN sqrt(quantile_cont(d, 0.5)) < 1e-12::DOUBLE THEN 1.0::DOUBLE ELSE 1 / (2 * quantile_cont(d, 0.5)) END AS gamma
  FROM pr WHERE NOT ci AND cj GROUP BY 1)"""


@query("mmd_median_gamma", "WITH " + GAMMA_SQL + " SELECT track, round(gamma, 6) AS gamma FROM gm")
def _mmd_median_gamma(spark, sf_dir):
    v = inputs.tracked_vectors(spark, sf_dir)
    return mmd.median_gammas(v, BY).select("track", rounded(F.col("gamma")).alias("gamma"))


MMD_SQL = """
SELECT track, round({score}, 6) AS mmd FROM (
  SELECT track, sqrt(greatest(0.0::DOUBLE, avg(exp(-gamma * d)) FILTER (NOT ci AND NOT cj)
         + avg(exp(-gamma * d)) FILTER (ci AND cj) - 2 * avg(exp(-gamma * d)) FILTER (NOT ci AND cj))) AS m
  FROM pr JOIN gm USING (track) GROUP BY 1)"""


@query("mmd_rbf", "WITH " + GAMMA_SQL + MMD_SQL.format(score="least(1.0::DOUBLE, m)"))
def _mmd_rbf(spark, sf_dir):
    return mmd.mmd_rbf(inputs.tracked_vectors(spark, sf_dir), BY).select("track", rounded(F.col("mmd")).alias("mmd"))


MONITOR_SQL = DIST_SQL + """, md AS (
  SELECT track, quantile_cont(d, 0.5) AS med FROM pr WHERE (ci = cj AND d > 0) OR (NOT ci AND cj) GROUP BY 1),
sz AS (SELECT track, count(*) FILTER (NOT is_current) AS nb, count(*) FILTER (is_current) AS nc FROM vecs GROUP BY 1),
gm AS (
  SELECT track, nb, nc, 1 / (2 * CASE WHEN med > 0 THEN med / (2 * ln(greatest(nb, nc) + 1)) ELSE 1 END) AS gamma
  FROM md JOIN sz USING (track))"""


@query("mmd_monitor", "WITH " + MONITOR_SQL + MMD_SQL.format(score="m"))
def _mmd_monitor(spark, sf_dir):
    v = inputs.tracked_vectors(spark, sf_dir)
    sums = mmd.kernel_sums(v, BY, mmd.monitor_gammas(v, BY))
    return mmd.mmd_score(sums, BY, clip=False).select("track", rounded(F.col("mmd")).alias("mmd"))


LABELS_SQL = MONITOR_SQL + """, ps AS (
  SELECT track, vec_id, row_number() OVER (PARTITION BY track ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1 AS p FROM vecs),
st AS (
  SELECT track, nb, nc, r, (r * 104729) % (nb + nc) AS b,
         (SELECT min(a) FROM range(1, 4000) t(a) WHERE a >= 1 + (r * 7919) % (nb + nc - 1) AND gcd(a, nb + nc) = 1) AS a
  FROM sz, range(1, 101) g(r)),
lab AS (
  SELECT ps.track, vec_id, r, CASE WHEN (a * p + b) % (nb + nc) < nb THEN 1.0::DOUBLE / nb ELSE -1.0::DOUBLE / nc END AS s
  FROM ps JOIN st ON st.track = ps.track
  UNION ALL
  SELECT v.track, vec_id, 0, CASE WHEN is_current THEN -1.0::DOUBLE / nc ELSE 1.0::DOUBLE / nb END FROM vecs v JOIN sz ON sz.track = v.track)"""

VERDICT_SQL = """obs AS (SELECT track, m FROM sums WHERE r = 0),
fin AS (
  SELECT o.track, sqrt(o.m) AS mmd, avg(CASE WHEN s.m >= o.m THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p_value
  FROM obs o JOIN sums s ON s.track = o.track AND s.r > 0 GROUP BY o.track, o.m)
SELECT track, round(mmd, 6) AS mmd, round(p_value, 6) AS p_value, p_value < 0.05::DOUBLE OR mmd > 0.1::DOUBLE AS mmd_drifted FROM fin"""


@query(
    "mmd_permutation_test",
    "WITH " + LABELS_SQL + """,
sums AS (
  SELECT pr.track, x.r, greatest(0.0::DOUBLE, sum(x.s * y.s * exp(-gamma * d))) AS m
  FROM pr JOIN gm ON gm.track = pr.track JOIN lab x ON x.track = pr.track AND x.vec_id = i
  JOIN lab y ON y.track = pr.track AND y.vec_id = j AND y.r = x.r GROUP BY 1, 2),
""" + VERDICT_SQL,
)
def _mmd_permutation_test(spark, sf_dir):
    out = mmd.mmd_permutation_test(inputs.tracked_vectors(spark, sf_dir), BY)
    return out.select("track", rounded(F.col("mmd")).alias("mmd"), rounded(F.col("p_value")).alias("p_value"), "mmd_drifted")


WAVES_SQL = """, dirs AS (
  SELECT j, list(g ORDER BY i) AS u FROM (
    SELECT j, i, sqrt(-2 * ln((CAST('0x' || substr(md5('a:' || j || ':' || i), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))
           * cos(2 * pi() * (CAST('0x' || substr(md5('b:' || j || ':' || i), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE) AS g
    FROM range(0, 256) a(j), range(0, 64) b(i)) GROUP BY 1),
waves AS (
  SELECT v.track, vec_id, is_current, j, cos(t) AS c, sin(t) AS s FROM (
    SELECT v.track, vec_id, is_current, j, sqrt(2 * gamma) * list_inner_product(embedding, u) AS t
    FROM vecs v JOIN gm ON gm.track = v.track, dirs) v)"""


# the width is the median of all pairs, as in the SQL; only the statistic is linear
@query(
    "mmd_rbf_features",
    "WITH " + GAMMA_SQL + WAVES_SQL + """, gaps AS (
  SELECT track, j, avg(c) FILTER (NOT is_current) - avg(c) FILTER (is_current) AS gc,
         avg(s) FILTER (NOT is_current) - avg(s) FILTER (is_current) AS gs FROM waves GROUP BY 1, 2)
SELECT track, round(least(1.0::DOUBLE, sqrt(sum(gc * gc + gs * gs) / 256)), 6) AS mmd FROM gaps GROUP BY 1""",
)
def _mmd_rbf_features(spark, sf_dir):
    out = mmd.mmd_rbf(inputs.tracked_vectors(spark, sf_dir), BY, method="features")
    return out.select("track", rounded(F.col("mmd")).alias("mmd"))


@query(
    "mmd_permutation_features",
    "WITH " + LABELS_SQL + WAVES_SQL + """, parts AS (
  SELECT lab.track, r, j, sum(lab.s * c) AS pc, sum(lab.s * w.s) AS ps
  FROM lab JOIN waves w ON w.track = lab.track AND w.vec_id = lab.vec_id GROUP BY 1, 2, 3),
sums AS (SELECT track, r, sum(pc * pc + ps * ps) / 256 AS m FROM parts GROUP BY 1, 2),
""" + VERDICT_SQL,
)
def _mmd_permutation_features(spark, sf_dir):
    out = mmd.mmd_permutation_test(inputs.tracked_vectors(spark, sf_dir), BY, method="features")
    return out.select("track", rounded(F.col("mmd")).alias("mmd"), rounded(F.col("p_value")).alias("p_value"), "mmd_drifted")


SWD_SQL = VEC_SIDES_SQL + """, raw AS (
  SELECT j, i, sqrt(-2 * ln((CAST('0x' || substr(md5('a:' || j || ':' || i), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))
         * cos(2 * pi() * (CAST('0x' || substr(md5('b:' || j || ':' || i), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE) AS g
  FROM range(0, 100) a(j), range(0, 64) b(i)),
dirs AS (SELECT j, list(g / n ORDER BY i) AS u FROM (SELECT *, sqrt(sum(g * g) OVER (PARTITION BY j)) AS n FROM raw) GROUP BY 1),
px AS (SELECT track, j, is_current, list_inner_product(embedding, u) AS x, vec_id FROM vecs, dirs),
cdf AS (
  SELECT track, j, lead(x) OVER (PARTITION BY track, j ORDER BY x, vec_id) - x AS dx,
         count(*) FILTER (NOT is_current) OVER w / CAST(count(*) FILTER (NOT is_current) OVER k AS DOUBLE) AS fb,
         count(*) FILTER (is_current) OVER w / CAST(count(*) FILTER (is_current) OVER k AS DOUBLE) AS fc
  FROM px WINDOW w AS (PARTITION BY track, j ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                 k AS (PARTITION BY track, j)),
w1 AS (SELECT track, j, sum(dx * abs(fb - fc)) AS w FROM cdf GROUP BY 1, 2)
SELECT track, round(avg(w), 6) AS swd FROM w1 GROUP BY 1"""


@query("sliced_wasserstein", "WITH " + SWD_SQL)
def _sliced_wasserstein(spark, sf_dir):
    v = inputs.tracked_vectors(spark, sf_dir)
    out = sliced.sliced_wasserstein(v, BY, sliced.hashed_directions(64))
    return out.select("track", rounded(F.col("swd")).alias("swd"))


TOPK_SQL = """WITH d AS (
  SELECT q.vec_id AS query_id, c.vec_id AS chunk_id,
         round(list_cosine_distance(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9) AS distance
  FROM embeddings q JOIN embeddings c ON q.vec_id % 2 = 1 AND c.vec_id % 2 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS INTEGER) AS rank FROM d)
SELECT query_id, chunk_id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 3"""


@query("vector_topk", TOPK_SQL)
def _vector_topk(spark, sf_dir):
    out = retrieval.vector_topk(*_queries_and_chunks(spark, sf_dir))
    return out.select("query_id", "chunk_id", rounded(F.col("distance")).alias("distance"), "rank")


def _queries_and_chunks(spark, sf_dir):
    v = inputs.tracked_vectors(spark, sf_dir)
    q = v.filter("is_current").select(F.col("vec_id").alias("query_id"), "embedding")
    return q, v.filter("NOT is_current").select(F.col("vec_id").alias("chunk_id"), "embedding")


@query("vector_topk_all_cells", TOPK_SQL)
def _vector_topk_all_cells(spark, sf_dir):
    """A stored index searched in all of its cells finds what the exact search finds."""
    queries, chunks = _queries_and_chunks(spark, sf_dir)
    path = scratch_path(spark, "index")
    chunk_index.build_index(chunks, path)
    out = chunk_index.search_index(queries, path, probes=chunk_index.MAX_CELLS)
    return out.select("query_id", "chunk_id", rounded(F.col("distance")).alias("distance"), "rank")


@query("vector_topk_indexed")
def _vector_topk_indexed(spark, sf_dir):
    """As many cells per query as find 0.95 of the exact neighbours of a sample."""
    queries, chunks = _queries_and_chunks(spark, sf_dir)
    path = scratch_path(spark, "index")
    chunk_index.build_index(chunks, path)
    out = chunk_index.search_index(queries, path, probes=chunk_index.calibrate_probes(queries, path))
    return out.select("query_id", "chunk_id", rounded(F.col("distance")).alias("distance"), "rank")


@query(
    "multi_query_topk",
    """WITH d AS (
  SELECT q.vec_id AS query_id, c.vec_id AS chunk_id,
         round(list_cosine_distance(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9) AS distance
  FROM embeddings q JOIN embeddings c ON q.vec_id % 2 = 1 AND c.vec_id % 2 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM d)
SELECT query_id // 6 AS request_id, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY query_id, rank) AS contexts
FROM r WHERE rank <= 3 GROUP BY 1""",
)
def _multi_query_topk(spark, sf_dir):
    q, chunks = _queries_and_chunks(spark, sf_dir)
    sub = q.select(F.floor(F.col("query_id") / 6).alias("request_id"), F.col("query_id").alias("pos"), "query_id", "embedding")
    out = retrieval.multi_query_topk(sub, chunks)
    return out.select("request_id", F.array_join("contexts", ",").alias("contexts"))


@query("pca_fit")
def _pca_fit(spark, sf_dir):
    m = pc.pca_fit(inputs.tracked_vectors(spark, sf_dir).filter("NOT is_current"), BY)
    return m.select("track", "n", F.posexplode("ratio").alias("component", "ratio")).withColumn("ratio", rounded(F.col("ratio")))


@query("pca_project")
def _pca_project(spark, sf_dir):
    v = inputs.tracked_vectors(spark, sf_dir)
    p = pc.pca_project(v, pc.pca_fit(v.filter("NOT is_current"), BY), BY)
    return p.select("track", "vec_id", F.transform("proj", lambda x: F.round(x, 6)).alias("proj"))


@query("kde_density")
def _kde_density(spark, sf_dir):
    from meander.operators.kde import kde_density

    v = inputs.tracked_vectors(spark, sf_dir)
    p = pc.pca_project(v, pc.pca_fit(v.filter("NOT is_current"), BY), BY)
    return kde_density(p, BY)
