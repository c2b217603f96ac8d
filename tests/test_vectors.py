"""Vector kernels against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meander.operators import kde, latent, mmd, pca, retrieval, sliced
from meander.operators.divergence import jsd_bits

RNG = np.random.default_rng(11)
BASE, CUR = RNG.normal(0, 1, (37, 6)), RNG.normal(0.4, 1.2, (29, 6))
CUR[5] = BASE[3]  # an exact copy across sides
BASE[9] = BASE[8]  # and one within a side


@pytest.fixture(scope="module")
def vectors(spark):
    rows = []
    for k, shift in (("a", 0.0), ("b", 1.5)):
        rows += [(k, i, False, [float(x) for x in v]) for i, v in enumerate(BASE)]
        rows += [(k, 100 + i, True, [float(x) for x in v + shift]) for i, v in enumerate(CUR)]
    return spark.createDataFrame(rows, "k string, vec_id long, is_current boolean, embedding array<double>").repartition(5).cache()


def d2(x, y):
    return ((x[:, None] - y[None]) ** 2).sum(2)


def brute_mmd(x, y, gamma):
    k = lambda a, b: np.exp(-gamma * d2(a, b)).mean()
    return np.sqrt(max(k(x, x) + k(y, y) - 2 * k(x, y), 0))


def test_median_is_exact(vectors):
    got = mmd.median_gamma(vectors, ["k"], block_rows=8)
    for k, shift in (("a", 0.0), ("b", 1.5)):
        want = 1 / (2 * np.median(d2(BASE, CUR + shift)))
        assert got[(k,)] == pytest.approx(want, rel=1e-9)


def test_monitor_gamma(vectors):
    got = mmd.monitor_gamma(vectors, ["k"], block_rows=8)[("a",)]
    bb, cc = d2(BASE, BASE), d2(CUR, CUR)
    med = np.median(np.concatenate([bb[bb > 0], cc[cc > 0], d2(BASE, CUR).ravel()]))
    assert got == pytest.approx(1 / (2 * med / (2 * np.log(38))), rel=1e-9)


@pytest.mark.parametrize("block", [7, 16, 4096])
def test_mmd_does_not_depend_on_blocks(vectors, block):
    got = {r.k: r.mmd for r in mmd.mmd_rbf(vectors, ["k"], block_rows=block).collect()}
    for k, shift in (("a", 0.0), ("b", 1.5)):
        gamma = 1 / (2 * np.median(d2(BASE, CUR + shift)))
        assert got[k] == pytest.approx(min(1, brute_mmd(BASE, CUR + shift, gamma)), rel=1e-9)


def test_identical_sets_have_no_distance(spark):
    rows = [("k", i, i >= 20, [float(x) for x in BASE[i % 20]]) for i in range(40)]
    v = spark.createDataFrame(rows, "k string, vec_id long, is_current boolean, embedding array<double>")
    assert mmd.mmd_rbf(v, ["k"]).first().mmd == pytest.approx(0, abs=1e-6)
    assert sliced.sliced_wasserstein(v, ["k"], sliced.seeded_directions(6)).first().swd == pytest.approx(0, abs=1e-6)


def test_permutations_are_relabellings():
    for total in (2, 9, 66, 250):
        for a, b in mmd.permutation_steps(total, 20):
            assert sorted((a * i + b) % total for i in range(total)) == list(range(total))


def test_permutation_test(vectors):
    out = {r.k: r for r in mmd.mmd_permutation_test(vectors, ["k"], 100, block_rows=16).collect()}
    assert out["b"].p_value < 0.05 and out["b"].mmd_drifted
    assert 0 <= out["a"].p_value <= 1
    again = {r.k: r for r in mmd.mmd_permutation_test(vectors, ["k"], 100, block_rows=4096).collect()}
    assert out["a"].p_value == again["a"].p_value


def test_feature_estimate_is_close(vectors):
    gamma = 0.05
    got = {r.k: r.mmd for r in mmd.mmd_features(vectors, ["k"], gamma, 8192).collect()}
    assert got["b"] == pytest.approx(brute_mmd(BASE, CUR + 1.5, gamma), rel=0.1)


def brute_w1(a, b):
    both = np.sort(np.concatenate([a, b]))
    fa, fb = (np.searchsorted(np.sort(s), both, "right") / len(s) for s in (a, b))
    return np.sum(np.diff(both) * np.abs(fa - fb)[:-1])


@pytest.mark.parametrize("limit", [0, 10**6])
def test_sliced(vectors, limit):
    dirs = sliced.seeded_directions(6, 12)
    got = {r.k: r.swd for r in sliced.sliced_wasserstein(vectors, ["k"], dirs, group_limit=limit).collect()}
    want = np.mean([brute_w1(BASE @ u, CUR @ u) for u in dirs.T])
    assert got["a"] == pytest.approx(want, rel=1e-9)


def test_pca_matches_svd(vectors):
    m = pca.pca_fit(vectors.filter("NOT is_current AND k = 'a'"), [], 4).first()
    x = BASE - BASE.mean(0)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(m["mean"], BASE.mean(0))
    assert np.allclose(m["ratio"], (s**2 / (s**2).sum())[:4])
    comps = np.array(m["components"])
    assert np.allclose(np.abs((comps * vt[:4]).sum(1)), 1)
    assert all(c[np.abs(c).argmax()] > 0 for c in comps)


def test_keyed_and_plain_projection_agree(vectors):
    part = vectors.filter("k = 'b'")
    model = pca.pca_fit(part, [], 3)
    plain = {r.vec_id: r.proj for r in pca.pca_project(part, model, []).collect()}
    keyed = {r.vec_id: r.proj for r in pca.pca_project(part, pca.pca_fit(part, ["k"], 3), ["k"]).collect()}
    assert all(np.allclose(plain[i], keyed[i]) for i in plain)


def brute_density(sample, at):
    n, d = sample.shape
    cov = np.cov(sample.T) * n ** (-2 / (d + 4))
    inv = np.linalg.inv(cov)
    diff = at[:, None] - sample[None]
    e = np.exp(-0.5 * np.einsum("ijk,kl,ijl->ij", diff, inv, diff)).sum(1)
    return e / (n * np.sqrt(np.linalg.det(2 * np.pi * cov)))


def test_kde_density_and_bits(vectors):
    rows = vectors.filter("k = 'a'").withColumn("proj", F.slice("embedding", 1, 2))
    out = kde.kde_density(rows, ["k"]).orderBy("point_id").toPandas()
    at = np.vstack([BASE[:, :2], CUR[:, :2]])
    assert np.allclose(out["p"], brute_density(BASE[:, :2], at))
    assert np.allclose(out["q"], brute_density(CUR[:, :2], at))
    assert 0 <= jsd_bits(kde.kde_density(rows, ["k"]), ["k"]).first().jsd <= 1


@pytest.mark.parametrize("block, cells", [(5, 0), (4096, 0), (1, 10**6)])
def test_topk(spark, vectors, block, cells):
    rows = vectors.filter("k = 'a'")
    q = rows.filter("is_current").select(F.col("vec_id").alias("query_id"), "embedding")
    c = rows.filter("NOT is_current").select(F.col("vec_id").alias("chunk_id"), "embedding")
    got = {}
    for r in retrieval.vector_topk(q, c, 3, block_rows=block, small_cells=cells).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.chunk_id
    for i, v in enumerate(CUR):
        dist = np.round(1 - (BASE @ v) / np.linalg.norm(BASE, axis=1) / np.linalg.norm(v), 9)
        want = sorted(range(len(BASE)), key=lambda j: (dist[j], j))[:3]
        assert [got[100 + i][r] for r in (1, 2, 3)] == want


@pytest.mark.parametrize("metric", ["mmd", "swd", "jsd"])
def test_latent_drift_separates_shift(vectors, metric):
    out = {r.k: r for r in latent.latent_drift(vectors, ["k"], metric, k=3).collect()}
    assert out["b"].drift_score > out["a"].drift_score
    assert out["b"].drift_detected and out["a"].n_samples_baseline == 37 and out["a"].pca_components == 3


def test_unknown_metric(vectors):
    with pytest.raises(ValueError):
        latent.latent_drift(vectors, ["k"], "nope")


def test_small_keys_keep_their_own_blocks(spark):
    """Many small keys beside a large one: a pair of blocks for each small key, and the same scores."""
    rng = np.random.default_rng(4)
    rows = [("hot", i, i % 2 == 1, rng.normal(size=3).tolist()) for i in range(400)]
    rows += [(f"k{j}", i, i % 2 == 1, rng.normal(size=3).tolist()) for j in range(100) for i in range(6)]
    df = spark.createDataFrame(rows, "k string, vec_id long, is_current boolean, embedding array<double>")
    _, _, pairs = mmd._pairs(mmd._tagged(df, ["k"], "vec_id", "embedding", "is_current"), ["k"], 40, ["side"])
    counts = {r.k: r["count"] for r in pairs.groupBy("k").count().collect()}
    assert counts.pop("hot") == 55 and set(counts.values()) == {1} and len(counts) == 100
    one = {r.k: r.mmd for r in mmd.mmd_rbf(df, ["k"], block_rows=1000).collect()}
    many = {r.k: r.mmd for r in mmd.mmd_rbf(df, ["k"], block_rows=40).collect()}
    assert one == pytest.approx(many, rel=1e-9) and len(one) == 101


def test_running_nearest_in_tiles(monkeypatch):
    rng = np.random.default_rng(6)
    q, c = retrieval._unit(rng.normal(size=(23, 4))), retrieval._unit(rng.normal(size=(57, 4)))
    ids = rng.permutation(57)
    want = retrieval._nearest(q, c, ids, 3)
    monkeypatch.setattr(retrieval, "QUERY_TILE", 5)
    monkeypatch.setattr(retrieval, "CHUNK_TILE", 7)
    got = retrieval._running(q, c[:30], ids[:30], 3)
    got = retrieval._running(q, c[30:], ids[30:], 3, got)
    assert (got[1] == want[1]).all() and np.allclose(got[0], want[0])


def test_a_large_key_keeps_to_a_number_of_blocks(spark, monkeypatch):
    """Blocks grow with their key, so that its rows meet a fixed number of them; the statistic stays."""
    rng = np.random.default_rng(14)
    rows = [("a", i, i % 3 == 1, rng.normal(size=3).tolist()) for i in range(300)] + [("a", 300, True, [9.0, 9.0, 9.0])] * 2
    df = spark.createDataFrame(rows, "k string, vec_id long, is_current boolean, embedding array<double>")
    plain = mmd.mmd_rbf(df, ["k"]).first().mmd, mmd.monitor_gamma(df, ["k"])
    monkeypatch.setattr(mmd, "KEY_BLOCKS", 4)
    monkeypatch.setattr(mmd, "TILE_ROWS", 7)
    tagged = mmd._tagged(df, ["k"], "vec_id", "embedding", "is_current")
    assert mmd._pairs(tagged, ["k"], 10)[2].count() == 10  # pairs of 4 blocks instead of 31
    assert mmd.mmd_rbf(df, ["k"], block_rows=10).first().mmd == pytest.approx(plain[0], rel=1e-9)
    assert mmd.monitor_gamma(df, ["k"], block_rows=10) == pytest.approx(plain[1], rel=1e-12)


def test_projections_travel_packed(spark):
    """An array per key, direction and batch instead of a row per value; keys and sides that are null take no part."""
    rng = np.random.default_rng(19)
    rows = [(k, i, i % 3 == 1, rng.normal(size=4).tolist()) for i in range(120) for k in ("a", "b")]
    rows += [(None, 1, True, [1.0] * 4), ("a", 7, None, [50.0] * 4), ("a", 1, True, rows[2][3])]
    df = spark.createDataFrame(rows, "k string, vec_id long, is_current boolean, embedding array<double>").coalesce(2)
    d = sliced.seeded_directions(4, 6)
    packs = sliced.packed_projections(df, ["k"], d, "embedding", "is_current")
    assert packs.count() <= 2 * 2 * 6
    got = {r.k: r.swd for r in sliced.sliced_wasserstein(df, ["k"], d).collect()}
    spread = {r.k: r.swd for r in sliced.sliced_wasserstein(df, ["k"], d, group_limit=0).collect()}
    assert set(got) == {"a", "b"} and got == pytest.approx(spread, rel=1e-9)


@pytest.mark.parametrize("bracket", [4.0, 0.0, -1e6])
@pytest.mark.parametrize("within", [False, True])
def test_medians_by_one_pass_over_all_pairs(spark, monkeypatch, within, bracket):
    """A bracket from few pairs, one pass over all; a bracket without the median falls back to digits.  Ties count."""
    rng = np.random.default_rng(12)
    rows = [(k, i, bool(i % 3), [float(x) for x in (rng.integers(0, 3, 2) if k else rng.normal(size=2))]) for k in (0, 1) for i in range(150)]
    rows += [(2, i, True, [float(i), 0.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, id long, side boolean, embedding array<double>")
    monkeypatch.setattr(mmd, "BRACKET", bracket)
    monkeypatch.setattr(mmd, "TILE_ROWS", 8)
    monkeypatch.setattr(mmd, "NEAR_ROWS", 16)
    passes = []
    plain = mmd._met
    monkeypatch.setattr(mmd, "_met", lambda left, table, by, diagonal=False: passes.append(diagonal) or plain(left, table, by, diagonal))
    got = {r.k: r.median for r in mmd.median_table(df, ["k"], within, block_rows=20).collect()}
    want = {}
    for k in (0, 1, 2):
        x, s = np.array([r[3] for r in rows if r[0] == k]), np.array([r[2] for r in rows if r[0] == k])
        d = ((x[:, None] - x[None]) ** 2).sum(2)
        values = d[~s][:, s].ravel()
        if within:
            values = np.concatenate([values, *[d[s == side][:, s == side][d[s == side][:, s == side] > 0] for side in (False, True)]])
        if len(values):
            want[k] = np.median(values)
    assert got == pytest.approx(want, rel=1e-12) and set(got) == set(want)
    if bracket == 4.0 and within:
        assert passes.count(False) == 2  # that of the pairs nobody reads, and one over all pairs
