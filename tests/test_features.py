"""Kernel discrepancy by random features, and kernel widths without the driver."""

import hashlib

import numpy as np
import pytest

from meander.operators import features, latent, mmd
from meander.plans import evaluate
from tests.test_vectors import BASE, CUR, brute_mmd, d2, vectors  # noqa: F401


def sides(spark, n, shift, width=8, key="a", seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    x[n // 2:] += shift
    rows = [(key, i, i >= n // 2, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "k string, vec_id long, is_current boolean, embedding array<double>"), x[: n // 2], x[n // 2:]


@pytest.mark.parametrize("shift", [0.0, 0.3, 1.0])
def test_error_against_all_pairs(spark, shift):
    df, base, cur = sides(spark, 1000, shift)
    gamma = 1 / (2 * np.median(d2(base, cur)))
    got = mmd.mmd_rbf(df, ["k"], {("a",): gamma}, method="features").first().mmd
    # measured: 0.0002, 0.005 and 0.015
    assert abs(got - brute_mmd(base, cur, gamma)) < 0.05


def test_sums_equal_plain_numpy(vectors):  # noqa: F811
    gammas = {("a",): 0.05, ("b",): 0.2}
    got = {r.k: r.mmd_sq for r in features.feature_sums(vectors, ["k"], gammas).collect()}
    for key, shift in (("a", 0.0), ("b", 1.5)):
        gap = features.features(BASE, gammas[(key,)]).mean(0) - features.features(CUR + shift, gammas[(key,)]).mean(0)
        assert got[key] == pytest.approx(gap @ gap, rel=1e-9)


def test_every_replicate_equals_plain_numpy(vectors):  # noqa: F811
    """It is a permutation test of its own statistic; on samples without drift its p-value is not that of all pairs."""
    gamma, n = 0.1, len(BASE) + len(CUR)
    got = {(r.k, r.replicate): r.mmd_sq
           for r in features.feature_sums(vectors, ["k"], {("a",): gamma, ("b",): gamma}, 20).collect()}
    assert len(got) == 42
    ids = [*range(len(BASE)), *range(100, 100 + len(CUR))]
    order = sorted(range(n), key=lambda i: (hashlib.md5(str(ids[i]).encode()).hexdigest(), ids[i]))
    for key, shift in (("a", 0.0), ("b", 1.5)):
        z = features.features(np.vstack([BASE, CUR + shift]), gamma)[order]
        for r, (a, b) in enumerate(mmd.permutation_steps(n, 20), 1):
            one = (a * np.arange(n) + b) % n < len(BASE)
            gap = z[one].mean(0) - z[~one].mean(0)
            assert got[key, r] == pytest.approx(gap @ gap, rel=1e-9)


def test_verdicts_of_the_linear_test(vectors, spark):  # noqa: F811
    out = {r.k: r for r in mmd.mmd_permutation_test(vectors, ["k"], 100, method="features").collect()}
    assert out["a"].p_value < 0.05 and out["b"].p_value < 0.05  # both keys are shifted
    df, _, _ = sides(spark, 400, 0.0)
    same = mmd.mmd_permutation_test(df, ["k"], 100, method="features").first()
    assert same.p_value >= 0.05 and not same.mmd_drifted
    assert mmd.mmd_permutation_test(df.drop("k"), [], 20, method="features").count() == 1


def test_width_of_random_pairs_is_near_the_exact_one(spark):
    df, base, cur = sides(spark, 3000, 0.2)
    exact = mmd.median_gammas(df, ["k"]).first().gamma
    assert exact == pytest.approx(1 / (2 * np.median(d2(base, cur))), rel=1e-9)
    few = mmd.median_gammas(df, ["k"], block_rows=100, diagonal=True).first().gamma
    assert few == pytest.approx(exact, rel=0.02) and few != exact
    assert mmd.median_gammas(df, ["k"], block_rows=4096, diagonal=True).first().gamma == exact


def test_width_comes_from_all_pairs(spark):
    """A key of many blocks is measured with the exact width: no block stands for the whole."""
    df, base, cur = sides(spark, 1200, 0.2)
    exact = mmd.monitor_gammas(df, ["k"], block_rows=4096)
    bb, cc = d2(base, base), d2(cur, cur)
    med = np.median(np.concatenate([bb[bb > 0], cc[cc > 0], d2(base, cur).ravel()]))
    assert exact.first().gamma == pytest.approx(np.log(601) / med, rel=1e-9)
    want = mmd.mmd_permutation_test(df, ["k"], 20, gammas=exact, method="features").first()
    got = mmd.mmd_permutation_test(df, ["k"], 20, block_rows=50, method="features").first()
    assert got.mmd == pytest.approx(want.mmd, rel=1e-12) and got.p_value == want.p_value
    score = mmd.mmd_rbf(df, ["k"], {("a",): 1 / (2 * np.median(d2(base, cur)))}, method="features").first().mmd
    assert mmd.mmd_rbf(df, ["k"], block_rows=50, method="features").first().mmd == pytest.approx(score, rel=1e-9)


def test_many_keys_and_one_sided_ones(spark):
    rng = np.random.default_rng(8)
    data = {f"k{j}": rng.normal(size=(6, 3)) for j in range(300)}
    rows = [(k, i, i % 2 == 1, v.tolist()) for k, x in data.items() for i, v in enumerate(x)]
    rows += [("alone", i, False, [0.0, 1.0, float(i)]) for i in range(4)]
    df = spark.createDataFrame(rows, "k string, vec_id long, is_current boolean, embedding array<double>").repartition(3)
    for method in mmd.METHODS:
        got = {r.k: r.mmd for r in mmd.mmd_rbf(df, ["k"], method=method).collect()}
        assert len(got) == 301 and got["alone"] is None
        for k, x in data.items():
            gamma = 1 / (2 * np.median(d2(x[::2], x[1::2])))
            if method == "pairs":
                want = brute_mmd(x[::2], x[1::2], gamma)
            else:
                gap = features.features(x[::2], gamma).mean(0) - features.features(x[1::2], gamma).mean(0)
                want = np.sqrt(gap @ gap)
            assert got[k] == pytest.approx(min(1.0, want), rel=1e-6, abs=1e-9)


def test_composites_take_the_method(vectors):  # noqa: F811
    exact = {r.k: r for r in latent.latent_drift(vectors, ["k"]).collect()}
    for r in latent.latent_drift(vectors, ["k"], method="features").collect():
        assert abs(r.drift_score - exact[r.k].drift_score) < 0.1
    for run in (evaluate.vector_drift, evaluate.comprehensive_drift):
        got = {r.k: r.is_drifted for r in run(vectors, ["k"], replicates=50, method="features").collect()}
        assert got["b"]
    with pytest.raises(ValueError):
        mmd.mmd_rbf(vectors, ["k"], method="nope")
