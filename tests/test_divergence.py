"""Scalar divergences against direct numpy definitions."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meander.operators import divergence as dv


def sample(spark, base, cur):
    rows = [("k", False, float(x)) for x in base] + [("k", True, float(x)) for x in cur]
    return spark.createDataFrame(rows, "k string, is_current boolean, x double")


def np_js(base, cur):
    both = np.concatenate([base, cur])
    iqr = np.subtract(*np.percentile(both, [75, 25]))
    bins = int(np.clip(np.ceil(np.ptp(both) / (2 * iqr / len(both) ** (1 / 3))), 10, 100)) if iqr > 0 else 20
    edges = (both.min(), both.max())
    p, q = (np.clip(np.histogram(s, bins, edges, density=True)[0], 1e-12, None) for s in (base, cur))
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    return np.sqrt((np.sum(p * np.log(p / m)) + np.sum(q * np.log(q / m))) / 2)


def np_kl(base, cur):
    grid = np.linspace(min(base.min(), cur.min()), max(base.max(), cur.max()), 100)

    def kde(s):
        h = len(s) ** -0.2 * s.std(ddof=1)
        z = (grid[:, None] - s[None]) / h
        return np.clip(np.exp(-0.5 * z * z).sum(1) / (len(s) * h * np.sqrt(2 * np.pi)), 1e-12, None)

    p, q = kde(base), kde(cur)
    return np.sum(p * np.log(p / q)) * (grid[1] - grid[0])


@pytest.fixture(scope="module")
def pair():
    rng = np.random.default_rng(3)
    return rng.normal(0, 1, 500), rng.normal(0.6, 1, 400)


@pytest.mark.parametrize("limit", [0, 10**6])
def test_js_and_w1(spark, pair, limit):
    df = sample(spark, *pair)
    assert dv.jsd_hist_drift(df, ["k"], group_limit=limit).first().js == pytest.approx(np_js(*pair), abs=1e-10)
    both = np.sort(np.concatenate(pair))
    fa, fb = (np.searchsorted(np.sort(s), both, "right") / len(s) for s in pair)
    want = np.sum(np.diff(both) * np.abs(fa - fb)[:-1])
    assert dv.w1_1d(df, ["k"], group_limit=limit).first().w1 == pytest.approx(want, rel=1e-9)


def test_kl(spark, pair):
    assert dv.kl_kde_1d(sample(spark, *pair), ["k"]).first().kl == pytest.approx(np_kl(*pair), rel=1e-9)
    assert dv.kl_kde_1d(sample(spark, pair[0], pair[0]), ["k"]).first().kl == pytest.approx(0, abs=1e-6)
    assert dv.kl_kde_1d(sample(spark, [1.0, 1.0], [1.0, 1.0]), ["k"]).first().kl == 0.0


def test_js_is_symmetric(spark, pair):
    a = dv.jsd_hist_drift(sample(spark, *pair), ["k"]).first().js
    b = dv.jsd_hist_drift(sample(spark, pair[1], pair[0]), ["k"]).first().js
    assert a == pytest.approx(b, abs=1e-10)


def test_flat_samples(spark):
    df = sample(spark, [2.0] * 60, [2.0] * 40)
    r = dv.fd_bins(df, ["k"]).first()
    assert (r.n, r.bins) == (100, 20)
    assert dv.fd_bins(df.limit(1), ["k"]).first().bins == 20
    assert dv.jsd_hist_drift(df, ["k"]).first().js == pytest.approx(0)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    base=st.lists(st.integers(-50, 50), min_size=2, max_size=40),
    cur=st.lists(st.integers(-50, 50), min_size=2, max_size=40),
)
def test_bounds(spark, base, cur):
    df = sample(spark, base, cur)
    js = dv.jsd_hist_drift(df, ["k"]).first().js
    assert 0 <= js <= np.sqrt(np.log(2)) + 1e-9
    h = dv.shared_histogram(df, ["k"])
    assert h.agg(F.sum("nb")).first()[0] in (len(base), 0)
    bits = dv.jsd_bits(h, ["k"]).first().jsd
    assert 0 <= bits <= 1
    mean_gap = abs(np.mean(base) - np.mean(cur))
    assert dv.w1_1d(df, ["k"]).first().w1 >= mean_gap - 1e-9
