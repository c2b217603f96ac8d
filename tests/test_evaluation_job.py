"""The calibrated window evaluation: limits per baseline window, verdicts, stored rows and alerts."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from meander.functions.runtime import scratch_path
from meander.plans import evaluate as ev
from meander.sources.evaluations import read_evaluations

SEED = 11


@pytest.fixture(scope="module")
def windows(spark):
    """Windows 1 and 2 alike, 3 with moved vectors, 4 with other hops."""
    rng = np.random.default_rng(SEED)
    vectors, nodes, edges, traces, hops, frames = [], [], [], [], [], []
    for win in (1, 2, 3, 4):
        for i in range(40):
            shift = 6.0 if win >= 3 else 0.0
            vectors.append((win, win * 100 + i, [float(x + shift) for x in rng.normal(size=4)]))
        nodes += [(win, n) for n in ("a", "b", "c")]
        edges += [(win, "a", "b"), (win, "b", "c")]
        for t in range(30):
            trace = win * 100 + t
            path = ["x", "y", "x", "y"] if win < 4 else ["x", "xyz"[t % 3], "x", "xyz"[(t + 1) % 3], "z"]
            traces.append((win, trace, 1))
            hops += [(win, trace, k, agent) for k, agent in enumerate(path)]
        frames += [(win, f"t{win}-{i}", "naive", "{}") for i in range(win)]
    make = spark.createDataFrame
    stamped = make(frames, "win int, trace_id string, rag_type string, telemetry_frame string").withColumn(
        "timestamp", F.lit("2024-05-01 00:00:00").cast("timestamp")
    )
    return stamped, (
        make(vectors, "win int, vec_id long, embedding array<double>"),
        make(nodes, "win int, node string"),
        make(edges, "win int, source string, target string"),
        make(traces, "win int, trace_id long, reflections int"),
        make(hops, "win int, trace_id long, pos int, agent string"),
        make([(1, 2), (2, 3), (3, 4)], "baseline int, current int"),
    )


def test_limits_per_window(spark):
    pairs = spark.createDataFrame([(1, 2, 0.2), (2, 3, 0.2), (3, 4, 0.2)], "baseline int, current int, js_divergence double")
    limits = spark.createDataFrame([(1, 0.1), (2, None)], "win int, vector_jsd_threshold double")
    got = {r.baseline: r for r in ev.with_limits(pairs, limits, "win", {"graph_spectral_threshold": 0.9}).collect()}
    assert [got[b].vector_jsd_threshold for b in (1, 2, 3)] == [0.1, 0.15, 0.15]
    assert {r.graph_spectral_threshold for r in got.values()} == {0.9}
    assert {r.swarm_entropy_threshold for r in got.values()} == {0.5}
    bare = ev.with_limits(pairs, None, "win").first()
    assert [bare[c] for c in ev.LIMITS] == list(ev.LIMITS.values())


def test_job(spark, windows):
    frames, parts = windows
    path = scratch_path(spark, "evaluations")
    alerts = {r.current: json.loads(r.alert) for r in ev.evaluation_job(frames, *parts, path).collect()}
    assert alerts[3]["vector_drift"]["js_divergence"] > 0.5
    assert alerts[4]["swarm_drift"]["transition_entropy_delta"] > 0.5
    assert alerts[3]["swarm_drift"]["transition_entropy_delta"] == 0
    assert all(a["is_drifted"] and a["batch_id"] == str(c) for c, a in alerts.items())
    stored = read_evaluations(spark, path).groupBy("is_drifted", F.substring("trace_id", 2, 1).alias("w")).count().collect()
    # the first window is nobody's current one
    assert {(r.w, r["count"]) for r in stored} == {("2", 2), ("3", 3), ("4", 4)}
    assert {int(r.w) for r in stored if r.is_drifted} == set(alerts)


def test_limits_decide(spark, windows):
    _, parts = windows
    high = spark.createDataFrame([(3, 1e9)], "win int, swarm_entropy_threshold double")
    got = {r.current: r.is_swarm_drifted for r in ev.evaluate_frames(*parts, replicates=20, limits=high).collect()}
    assert got == {2: False, 3: False, 4: False}
    static = {r.current: r.is_swarm_drifted for r in ev.evaluate_frames(*parts, replicates=20).collect()}
    assert static == {2: False, 3: False, 4: True}
