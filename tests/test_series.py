"""Literal cases for series, thresholds and histories."""

import math

import pytest
from pyspark.sql import functions as F

from meander.functions.runtime import scratch_path
from meander.operators import series
from meander.sources import history as hs


def points(spark, values, name="m"):
    rows = [(name, float(i + 1), i, v, f"r{i + 1}") for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "metric_name string, ts double, seq long, value double, run_id string")


STEP = [0.11, 0.12, 0.10, 0.31, 0.35, 0.33]


@pytest.mark.parametrize("limit", [0, 10**6])
def test_step_gives_one_event(spark, limit):
    out = series.mean_shift_events(points(spark, STEP), ["metric_name"], group_limit=limit).collect()
    assert len(out) == 1
    e = out[0]
    assert (e.start_ts, e.end_ts, e.involved_run_ids) == (4.0, 6.0, ["r4", "r5", "r6"])
    assert e.magnitude == pytest.approx(0.33 - 0.11, abs=1e-6)


def test_short_series_gives_none(spark):
    assert series.mean_shift_events(points(spark, [0.2, 0.9, 0.2, 0.9]), ["metric_name"]).count() == 0


def test_trailing_partial_block_is_ignored(spark):
    assert series.mean_shift_events(points(spark, [0.1] * 6 + [9.0, 9.0]), ["metric_name"]).count() == 0


def scores(spark, values):
    return points(spark, values).withColumnRenamed("value", "score")


def last_threshold(spark, values, **kw):
    out = series.adaptive_threshold(scores(spark, values), ["metric_name"], **kw)
    return out.orderBy(F.desc("ts")).first()


@pytest.mark.parametrize(
    "values, want",
    [
        # mean 0.1, sample variance 6 * 0.02^2 / 9, two deviations on top
        ([0.08, 0.10, 0.12] * 3 + [0.10], 0.1 + 2 * math.sqrt(6 * 0.02**2 / 9)),
        # too few, no spread, above the upper and below the lower bound
        ([0.8], 0.15), ([0.07] * 11, 0.07), ([0.7] * 25, 0.50), ([0.002] * 25, 0.05),
    ],
)
def test_adaptive_threshold(spark, values, want):
    assert last_threshold(spark, values).threshold == pytest.approx(want, abs=1e-5)


@pytest.mark.parametrize("limit", [0, 10**6])
def test_adaptive_threshold_forgets_old_scores(spark, limit):
    r = last_threshold(spark, [0.45] * 30 + [0.1] * 30, group_limit=limit)
    assert r.threshold == pytest.approx(0.1)


def test_trend_null_until_full_and_anomaly(spark):
    values = [0.1 + 0.01 * i for i in range(35)]
    t = series.trend(scores(spark, values), ["metric_name"]).orderBy("ts").collect()
    assert [r.rolling_mean is None for r in t] == [True] * 29 + [False] * 6
    assert t[-1].rolling_mean == pytest.approx(sum(values[5:]) / 30)
    spike = series.anomaly_latest(scores(spark, [0.1, 0.11] * 20 + [0.9]), ["metric_name"]).first()
    flat = series.anomaly_latest(scores(spark, [0.1] * 40), ["metric_name"]).first()
    few = series.anomaly_latest(scores(spark, [0.1] * 5 + [9.0]), ["metric_name"]).first()
    assert spike.is_anomaly and not flat.is_anomaly and not few.is_anomaly


def test_null_in_window_gives_null(spark):
    values = [0.1] * 10 + [None] + [0.1] * 25
    t = series.trend(scores(spark, values), ["metric_name"]).orderBy("ts").collect()
    assert all(r.rolling_mean is None for r in t)


def test_history_skips_malformed_and_blank(spark, tmp_path):
    good = '{"record_id":"a","run_id":"r1","timestamp":1.0,"metrics":[{"_type":"DriftResult","metric_name":"js","value":0.2,"current_run_id":"c1"}],"metadata":{"x":"1","system_info":{"model":"m"}}}'
    (tmp_path / "h.jsonl").write_text(good + "\n\n{broken\n" + good.replace('"a"', '"b"') + "\n")
    df = hs.history_scan(spark, str(tmp_path))
    assert sorted(r.record_id for r in df.collect()) == ["a", "b"]
    assert hs.rejected_lines(spark, str(tmp_path)).count() == 1
    s = series.metric_series(df.withColumn("seq", F.lit(0)), "js").first()
    assert (s.value, s.run_id) == (0.2, "c1")
    assert df.first().metadata["system_info"] == '{"model":"m"}'


def test_append_keeps_order_numbers(spark):
    path = scratch_path(spark, "h")
    df = spark.createDataFrame(
        [("a", "r1", 5.0, None, [], {}), ("b", "r2", None, "v", [], {})], hs.HISTORY
    )
    hs.history_append(df, path)
    hs.history_append(df, path, hs.next_seq(spark, path))
    seqs = sorted(r.seq for r in hs.history_scan(spark, path).collect())
    assert len(set(seqs)) == 4
    assert math.isclose(hs.history_scan(spark, path).filter("timestamp IS NULL").count(), 2)
