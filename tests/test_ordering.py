"""Ordered primitives: the spread plan must equal the one-task plan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meander.functions.ordering import drop_halo, framed, numbered, order_statistics, running_sums


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    # one key owns two thirds of the rows, and many rows share a timestamp
    data = [("hot" if rng.random() < 0.66 else f"k{i % 5}", float(rng.integers(0, 40)), i, float(rng.normal())) for i in range(900)]
    data += [(None, 1.0, 1000 + i, 0.5) for i in range(7)]
    return spark.createDataFrame(data, "k string, ts double, seq long, v double").repartition(6).cache()


def collected(df, *cols):
    return sorted(df.select(*cols).collect(), key=str)


def test_running_sums_spread_equals_plain(rows):
    sums = {"rn": F.lit(1).cast("long"), "total": F.floor(F.col("v") * 100)}
    plain = running_sums(rows, ["k"], ["ts", "seq"], sums)
    spread = running_sums(rows, ["k"], ["ts", "seq"], sums, group_limit=0)
    assert collected(plain, "k", "seq", "rn", "total") == collected(spread, "k", "seq", "rn", "total")


def test_numbered_is_dense(rows):
    out = numbered(rows, ["k"], ["ts", "seq"], "rn", group_limit=10)
    stats = out.groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("rn").alias("d"), F.min("rn").alias("a"), F.max("rn").alias("z"))
    assert all(r.n == r.d == r.z and r.a == 1 for r in stats.collect())


@pytest.mark.parametrize("chunk", [7, 30, 1000])
def test_framed_windows_survive_chunking(rows, chunk):
    def rolling(limit):
        df, w = framed(rows, ["k"], ["ts", "seq"], 6, limit, chunk)
        last = w.rowsBetween(-6, 0)
        return drop_halo(df.withColumn("m", F.round(F.avg("v").over(last), 9)).withColumn("p", F.lag("v").over(w)))

    assert collected(rolling(10**9), "k", "seq", "m", "p") == collected(rolling(0), "k", "seq", "m", "p")


@pytest.mark.parametrize("limit", [0, 10**9])
def test_order_statistics_match_numpy(rows, limit):
    out = {r.k: r for r in order_statistics(rows, ["k"], "v", [0.25, 0.5, 0.9], group_limit=limit).collect()}
    pdf = rows.toPandas()
    for k, part in pdf.groupby("k"):
        want = np.percentile(part["v"], [25, 50, 90])
        assert np.allclose([out[k].q0, out[k].q1, out[k].q2], want)
        assert out[k].n == len(part)


def test_heavy_ties_stay_exact(spark):
    df = spark.createDataFrame([("a", 1.0)] * 300 + [("a", float(i)) for i in range(2, 100)], "k string, v double")
    r = order_statistics(df, ["k"], "v", [0.5, 0.8], group_limit=0).first()
    want = np.percentile([1.0] * 300 + list(range(2, 100)), [50, 80])
    assert np.allclose([r.q0, r.q1], want)
