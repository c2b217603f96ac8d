"""Factors and confidence by look-ups against scoring every pair."""

import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from meander.operators import attribution as at
from meander.operators import changes as ch

BY = ["system"]
EVENT = "system string, event_id string, metric_name string, start_ts double, end_ts double, magnitude double"
CHANGE = "system string, change_id string, run_id string, change_type string, ts double, seq long"


def tables(spark, seed):
    rng = random.Random(seed)
    changes, events = [], []
    for s in range(6):
        n = [1, 2, 7, 60, 300, 0][s]
        for i in range(n):
            ts = float(rng.randint(0, 64)) if s % 2 else rng.uniform(0, 1000)  # ties in every second stream
            kind = rng.choice(["model_update", "version_change", "config_change", "unknown", "other"])
            changes.append((f"s{s}", f"c{s}-{i}", f"r{i}", kind, ts, i))
        for e in range(7):
            start = rng.choice([-5.0, 0.0, 32.0, 64.0, 70.0, rng.uniform(0, 1000)])
            events.append((f"s{s}", f"e{s}-{e}", "m", start, start + rng.choice([0.0, 8.0, 300.0]), rng.choice([0.0, 0.4])))
    return spark.createDataFrame(events, EVENT), spark.createDataFrame(changes, CHANGE)


@pytest.mark.parametrize("slices, blocks, top, few", [(1 << 20, 1 << 13, 4, 4096), (16, 2, 4, 4096), (16, 2, 4, 3), (5, 100, 1, 0)])
def test_look_ups_equal_all_pairs(spark, monkeypatch, slices, blocks, top, few):
    monkeypatch.setattr(at, "FEW", few)
    monkeypatch.setattr(at, "PAIRS", 50)
    events, changes = tables(spark, top)
    best, sure = at.attribution_summary(events, changes, BY, top, slices, blocks)
    scores = ch.attribution_scores(ch.event_change_features(events, changes, BY), BY)
    cols = ["system", "event_id", "rank", "change_id", "run_id", "change_type", "ts", "seq", "type_weight", "time_delta",
            "in_window", "drift_magnitude", "score"]
    rows = lambda df, names: sorted(map(tuple, df.select(*names).collect()))
    assert rows(best, cols) == rows(ch.top_factors(scores, BY, top), cols)
    want = {(r.system, r.event_id): (r.num_factors, r.confidence) for r in ch.event_confidence(scores, BY).collect()}
    got = {(r.system, r.event_id): (r.num_factors, r.confidence) for r in sure.collect()}
    assert len(got) == 42 and got == {k: want.get(k, (0, 0.0)) for k in got}


def test_many_tied_changes(spark):
    """200,000 changes of one stream with ties; few score steps, counted by bisection."""
    n = 200_000
    kinds = F.element_at(F.array(*[F.lit(k) for k in ch.TYPE_WEIGHTS]), (F.pmod(F.xxhash64("id"), F.lit(4)) + 1).cast("int"))
    changes = spark.range(n).select(
        F.lit("s").alias("system"), F.concat(F.lit("c"), "id").alias("change_id"), F.lit("r").alias("run_id"),
        kinds.alias("change_type"), F.floor(F.col("id") / 7).cast("double").alias("ts"), F.col("id").alias("seq"))
    asked = [("s", f"e{i}", "m", s, e, 0.3) for i, (s, e) in enumerate([(100.0, 120.0), (20000.5, 20000.6), (28570.0, 30000.0)])]
    events = spark.createDataFrame(asked, EVENT)
    best, sure = at.attribution_summary(events, changes, BY, 4, slice_rows=1 << 16)
    rows = changes.toPandas()
    ts, weight = rows.ts.to_numpy(), rows.change_type.map(ch.TYPE_WEIGHTS).to_numpy()
    picks = {}
    for r in best.orderBy("event_id", "rank").collect():
        picks.setdefault(r.event_id, []).append(r.change_id)
    found = {r.event_id: r for r in sure.collect()}
    for _, event, _, start, end, _ in asked:
        inside = (ts >= start) & (ts <= end)
        away = np.where(inside, 0.0, np.minimum(np.abs(ts - start), np.abs(ts - end)))
        step = np.zeros(n, np.int64)
        for w in set(weight):
            for flag in (False, True):
                own = (weight == w) & (inside == flag)
                step[own] = at.units(away[own], away.max(), w, 1.0, flag)
        order = np.lexsort((rows.seq, ts, -step))[:4]
        assert picks[event] == list(rows.change_id.to_numpy()[order])
        assert found[event].num_factors == n
        assert found[event].confidence == round(step.max() / step.sum(), 4)


def test_units_round_like_the_decimal_text():
    delta = np.arange(0, 65).astype(float)
    got = at.units(delta, 64.0, 0.6, 1.0)
    for d, u in zip(delta, got, strict=True):
        raw = 0.4 * (1.0 - d / 64.0) + 0.3 * 0.6 + 0.3 * 1.0
        assert u == int((Decimal(repr(float(raw))) * 10_000).quantize(Decimal(1), ROUND_HALF_UP))


def test_bisection_equals_counting():
    rng = np.random.default_rng(1)
    ts = np.sort(rng.uniform(0, 50.0, 60_000))
    for left in (True, False):
        side = at.Side(ts, 50.0 if left else 0.0, left, 1e5, 0.3, 0.0)
        every = side.at(np.arange(side.n))
        assert side.n > (every[0] - every[-1] + 1) * side.n.bit_length()  # looked up
        assert side.total() == every.sum() and (np.diff(every) <= 0).all()
        assert list(side.count(np.unique(every))) == [int((every >= u).sum()) for u in np.unique(every)]


def test_changes_are_found_once(spark):
    """Scores, summary and names read stored changes: finding them again parses every record."""
    from meander.plans.remediate import remediate

    history = spark.createDataFrame(
        [("s", float(i), i, f"r{i}", f"v{i // 2}", {"pipeline_name": "p", "tier": str(i)}) for i in range(6)],
        "system string, timestamp double, seq long, run_id string, system_version string, metadata map<string,string>",
    )
    run = remediate(history, BY)
    run.__dict__["events"] = spark.createDataFrame([("s", "e", "m", 2.0, 3.0, 0.5)], EVENT)
    assert "from_json" in run.changes._jdf.queryExecution().toString()
    assert "from_json" not in run.factors._jdf.queryExecution().toString()
    assert run.factors.count() == run.changes.count() == 5
