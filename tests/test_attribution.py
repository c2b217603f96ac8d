"""Change events, attribution, estimates, plans and guardrails on literal cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from meander.operators import attribution
from meander.operators import changes as ch
from meander.operators import counterfactual as cf
from meander.operators import fusion, policy, remediation
from meander.plans.remediate import remediate
from meander.schemas import HISTORY

BY = ["system"]


def history(spark, records):
    rows = []
    for i, r in enumerate(records):
        metric = ("DriftResult", "js_divergence", r.get("value", 0.0), {}, None, None, None)
        rows.append(("s", f"rec{i}", r["run"], r["ts"], r.get("version"), [metric], r.get("meta", {}), i))
    return spark.createDataFrame(rows, f"system string, {HISTORY}, seq long")


def change_types(spark, *records):
    recs = [{"run": f"r{i}", "ts": float(i), **r} for i, r in enumerate(records)]
    return [r.change_type for r in ch.change_events(history(spark, recs), BY).orderBy("ts", "seq").collect()]


INFO = lambda m: json.dumps({"model": m})


@pytest.mark.parametrize(
    "a, b, want",
    [
        ({"version": "1"}, {"version": "2"}, ["version_change"]),
        ({"meta": {"pipeline_name": "a"}}, {"meta": {"pipeline_name": "b"}}, ["model_update"]),
        ({"version": "1", "meta": {"pipeline_name": "a"}}, {"version": "2", "meta": {"pipeline_name": "b"}}, ["version_change"]),
        ({"version": "1", "meta": {"system_info": INFO("x")}}, {"version": "2", "meta": {"system_info": INFO("y")}}, ["model_update"]),
        ({"version": "1"}, {"version": "2", "meta": {"system_info": INFO("y")}}, ["version_change"]),
        ({}, {"meta": {"system_info": INFO("y")}}, ["unknown"]),
        ({"meta": {"k": "1"}}, {"meta": {"k": "2"}}, ["config_change"]),
        ({"meta": {"k": "1"}}, {"meta": {"k": "1"}}, []),
    ],
)
def test_change_type(spark, a, b, want):
    assert change_types(spark, a, b) == want


@pytest.mark.parametrize("limit", [0, 10**6])
def test_change_details_and_order(spark, limit):
    h = history(spark, [
        {"run": "r0", "ts": 1.0, "version": "a", "meta": {"k": "1", "gone": "x"}},
        {"run": "r1", "ts": 1.0, "version": "a", "meta": {"k": "2"}},
        {"run": "r2", "ts": 0.5, "version": "b", "meta": {"k": "1", "gone": "x"}},
    ])
    out = ch.change_events(h, BY, group_limit=limit).orderBy("ts", "seq").collect()
    assert [r.run_id for r in out] == ["r0", "r1"]
    assert out[1].details.metadata_diff["k"].asDict() == {"old": "1", "new": "2"}
    assert out[1].details.metadata_diff["gone"].asDict() == {"old": "x", "new": None}


def events(spark, start, end, magnitude=0.45):
    return spark.createDataFrame(
        [("s", "e", "js_divergence", float(start), float(end), magnitude)],
        "system string, event_id string, metric_name string, start_ts double, end_ts double, magnitude double",
    )


def test_feature_distances(spark):
    c = spark.createDataFrame(
        [("s", f"c{t}", f"r{t}", "config_change", float(t), t) for t in (5, 15, 25)],
        "system string, change_id string, run_id string, change_type string, ts double, seq long",
    )
    out = ch.event_change_features(events(spark, 10, 20), c, BY).orderBy("ts").collect()
    assert [r.time_delta for r in out] == [5, 0, 5]
    assert [r.in_window for r in out] == [False, True, False]


VALUES = [0.05, 0.05, 0.05, 0.30, 0.45, 0.50]


def test_plan_of_a_version_change(spark):
    h = history(spark, [
        {"run": f"r{i}", "ts": float(i), "version": "0.1.0" if i < 3 else "0.2.0", "value": v} for i, v in enumerate(VALUES)
    ])
    r = remediate(h, BY)
    e = r.events.first()
    assert (e.start_ts, e.end_ts, e.involved_run_ids) == (3.0, 5.0, ["r3", "r4", "r5"])
    changes = ch.change_events(h, BY)
    factors, att = ch.attribute_drift(events(spark, 3, 5), changes, BY)
    f = factors.first()
    assert (f.change_type, f.run_id, f.score) == ("version_change", "r3", 0.94)
    assert att.first().confidence == 0.94
    est = cf.estimates(events(spark, 3, 5), _series(spark, [(float(i), v) for i, v in enumerate(VALUES)]), BY)
    res = cf.counterfactuals(events(spark, 3, 5), cf.scenarios(factors, BY), est, BY).collect()
    assert [(x.counterfactual_metric, x.delta, x.confidence) for x in res] == [(0.05, 0.4, 0.94)]
    plan = r.plans.first()
    assert plan.top.action_type == "restore_version" and plan.num_recommendations == 1
    assert plan.summary.startswith("Top recommendation: restore previous version in run r3 (expected improvement: 0.3167)")


def test_event_without_changes_has_no_plan(spark):
    h = history(spark, [{"run": f"r{i}", "ts": float(i), "value": v} for i, v in enumerate(VALUES)])
    r = remediate(h, BY)
    assert r.attributions.first().confidence == 0.0
    assert r.plans.first().summary.startswith("No actionable recommendations")


def _series(spark, pts):
    return spark.createDataFrame([("s", t, i, v) for i, (t, v) in enumerate(pts)], "system string, ts double, seq long, value double")


@pytest.mark.parametrize("limit", [0, 10**6])
@pytest.mark.parametrize(
    "pts, start, method, alpha, want",
    [
        ([(0, 0.1), (1, 0.1), (2, 0.1)], 3, "mean", 0.3, 0.10),
        ([(0, 0.05), (1, 0.10), (2, 0.15), (3, 0.20)], 10, "ewma", 0.3, 0.12335),
        ([(0, 0.05), (1, 0.10), (2, 0.15), (3, 0.20)], 10, "ewma", 1.0, 0.20),
        ([(0, 0.10), (1, 0.15), (2, 0.20)], 3, "trend", 0.3, 0.25),
        ([(0, 0.10), (1, 0.20)], 2, "trend", 0.3, 0.13),
        ([(10, 0.3), (11, 0.5)], 5, "trend", 0.3, 0.4),
        ([(1, 0.1), (1, 0.2), (1, 0.6)], 3, "trend", 0.3, 0.3),
    ],
)
def test_estimates(spark, pts, start, method, alpha, want, limit):
    e = cf.estimates(events(spark, start, start + 1), _series(spark, [(float(t), v) for t, v in pts]), BY, alpha, limit).first()
    assert e[method] == pytest.approx(want, abs=1e-9)


def test_estimate_without_history(spark):
    assert cf.estimates(events(spark, 1, 2), _series(spark, [(0.0, 1.0)]).limit(0), BY).first().trend == 0.0


def test_scenarios_combine_top_three(spark):
    f = spark.createDataFrame(
        [("s", "e", f"c{i}", "config_change", float(i), i, 0.5 + i / 10) for i in range(4)],
        "system string, event_id string, change_id string, change_type string, ts double, seq long, score double",
    )
    out = cf.scenarios(f, BY).orderBy("pos").collect()
    assert [o.change_ids for o in out] == [["c3"], ["c2"], ["c1"], ["c3", "c2", "c1"]]
    assert out[3].confidence == pytest.approx(0.6) and out[3].description == "Remove all 3 top-ranked changes"


def test_last_scenario_wins(spark):
    actions = spark.createDataFrame([("s", "e", "c1", 1), ("s", "e", "c9", 2)], "system string, event_id string, change_id string, pos int")
    res = spark.createDataFrame(
        [("s", "e", 1, 0.4, 0.9, ["c1"]), ("s", "e", 2, 0.2, 0.5, ["c1", "c2"])],
        "system string, event_id string, pos int, delta double, confidence double, change_ids array<string>",
    )
    got = {r.change_id: (r.expected_improvement, r.confidence) for r in remediation.action_impact(actions, res, BY).collect()}
    assert got == {"c1": (0.2, 0.5), "c9": (0.0, 0.0)}


def acts(spark, rows):
    return spark.createDataFrame(
        [(i, "t", run, "c", float(ts), params) for i, (run, ts, params) in enumerate(rows)],
        "action_id long, action_type string, target_run_id string, change_id string, ts double, params map<string,double>",
    )


@pytest.mark.parametrize("limit", [0, 10**6])
def test_policy_replay(spark, limit):
    rows = [("r1", t, {}) for t in (0, 400, 800, 1200, 1600, 2000)] + [("r2", 0, {"top_k": 51.0}), ("r2", 100, {"other": 999.0})]
    out = {r.action_id: r.rule_violated for r in policy.policy_decide(acts(spark, rows), group_limit=limit).collect()}
    assert [out[i] for i in range(6)] == [None] * 5 + ["max_flapping"]
    assert (out[6], out[7]) == ("parameter_bounds", "cooldown_period")


def test_flapping_window_is_inclusive(spark):
    out = policy.policy_flapping(acts(spark, [("r", 0, {}), ("r", 3600, {}), ("r", 7201, {})])).orderBy("action_id").collect()
    assert [r.recent_actions for r in out] == [0, 1, 0]


@pytest.mark.parametrize("limit, rule", [(2, "max_flapping"), (5, None)])
def test_history_check(spark, limit, rule):
    new = acts(spark, [("r1", 0, {})]).withColumn("change_id", F.lit("other"))
    done = acts(spark, [("r1", 100, {}), ("r1", 200, {})]).withColumn("executed_at", F.col("ts"))
    out = policy.check_against_history(new, done, F.lit(1000.0), max_flapping=limit).first()
    assert out.rule_violated == rule and out.allowed == (rule is None)


def test_fusion(spark):
    s = spark.createDataFrame([("k", "retrieval", 0.8)], "key string, track string, score double")
    out = {r.node_id: r.prior_failure_prob for r in fusion.fusion_priors(s, fusion.default_nodes(spark), ["key"]).collect()}
    assert out == {"vector_index": 1.0, "embedding_model": 1.0, "prompt_template": 0.0, "llm_router": 0.0}


def test_track_actions(spark):
    res = spark.createDataFrame(
        [("s", e, 1, 0.3, 0.9, ["c"], t) for e, t in (("a", "retrieval"), ("b", "generation"), ("d", "unified"))]
        + [("s", "low", 1, 0.9, 0.5, ["c"], "retrieval")],
        "system string, event_id string, pos int, delta double, confidence double, change_ids array<string>, track string",
    )
    out = {r.event_id: r.action_type for r in remediation.select_action(res, BY, F.col("track")).collect()}
    assert out == {"a": "adjust_top_k", "b": "adjust_temperature", "d": "rollback_config"}


def test_interventions(spark):
    h = history(spark, [
        {"run": "r0", "ts": 0.0, "version": "1", "meta": {"pipeline_name": "a", "system_info": INFO("x"), "k": "1"}},
        {"run": "r1", "ts": 1.0, "version": "2", "meta": {"pipeline_name": "b", "system_info": INFO("y"), "k": "2"}},
        {"run": "r1", "ts": 2.0, "version": "2", "meta": {"pipeline_name": "b", "system_info": INFO("y"), "k": "2"}},
    ])
    c = ch.change_events(h, BY)
    cid = c.first().change_id
    iv = spark.createDataFrame(
        [("s", "undo", cid, "remove", None), ("s", "set", cid, "modify", {"k": "9"}), ("s", "x", "unknown", "remove", None)],
        "system string, scenario_id string, change_id string, action string, override map<string,string>",
    )
    out = {r.scenario_id: r for r in cf.intervention_apply(iv, c, h, BY).collect()}
    assert set(out) == {"undo", "set"}
    assert out["undo"].system_version == "1" and out["undo"].timestamp == 1.0
    assert out["undo"].metadata == {"pipeline_name": "a", "system_info": INFO("x").replace(" ", ""), "k": "1"}
    assert out["set"].metadata["k"] == "9" and out["set"].system_version == "2"


def test_long_stream_takes_the_earliest_of_equal_scores(spark):
    """200,000 changes a second apart and random ones with many ties, against all scores in numpy."""
    import numpy as np
    from pyspark.sql import functions as F

    n = 200_000
    even = spark.range(n).select(
        F.lit("even").alias("system"), F.concat(F.lit("c"), "id").alias("change_id"), F.lit("r").alias("run_id"),
        F.lit("config_change").alias("change_type"), F.col("id").cast("double").alias("ts"), F.col("id").alias("seq"),
    )
    tied = even.where("seq < 5000").withColumns({
        "system": F.lit("tied"), "ts": F.floor(F.col("seq") / 40).cast("double"),
        "change_type": F.element_at(F.array(F.lit("model_update"), F.lit("config_change"), F.lit("unknown")),
                                    (F.pmod(F.xxhash64("seq"), F.lit(3)) + 1).cast("int")),
    })
    c = even.unionByName(tied)
    ev = [("even", "a", "m", 150000.5, 150000.7, 0.3), ("tied", "b", "m", 60.0, 61.0, 0.0), ("tied", "d", "m", 500.0, 510.0, 0.2)]
    e = spark.createDataFrame(
        ev, "system string, event_id string, metric_name string, start_ts double, end_ts double, magnitude double")
    best, conf = attribution.attribution_summary(e, c, BY, 4)
    got = {k: [] for k in "abd"}
    for r in best.orderBy("event_id", "rank").collect():
        got[r.event_id].append(r.change_id)
    assert got["a"] == ["c149982", "c149983", "c149984", "c149985"]
    rows = c.toPandas()
    sure = {r.event_id: (r.num_factors, r.confidence) for r in conf.collect()}
    for system, event, _, start, end, size in ev:
        own = rows[rows.system == system]
        ts, kinds = own.ts.to_numpy(), own.change_type.map(ch.TYPE_WEIGHTS).to_numpy()
        inside = (ts >= start) & (ts <= end)
        away = np.where(inside, 0.0, np.minimum(np.abs(ts - start), np.abs(ts - end)))
        near = 1.0 - away / away.max()
        score = np.round(0.4 * np.where(inside, near * 0.5 + 0.5, near) + 0.3 * kinds + 0.3 * (size > 0) + 1e-12, 4)
        order = np.lexsort((own.seq, ts, -score))[:4]
        assert got[event] == list(own.change_id.to_numpy()[order])
        assert sure[event][0] == len(own)
        assert abs(sure[event][1] - score.max() / score.sum()) <= 1e-4


@pytest.mark.parametrize("limit", [cf.GROUP_LIMIT, 0])
def test_trend_of_a_long_stream_at_epoch_times(spark, limit):
    """The two-pass regression before an early and a late event, values far from zero."""
    n = 200_000
    i = np.arange(n)
    t, v = 1.7e9 + 0.25 * i, 1e6 + 0.25e-6 * i + np.sin(i.astype(float))
    rows = spark.range(n).select(
        F.lit("m").alias("metric_name"), (F.lit(1.7e9) + F.col("id") * 0.25).alias("ts"), F.col("id").alias("seq"),
        (F.lit(1e6) + F.col("id") * 0.25e-6 + F.sin(F.col("id").cast("double"))).alias("value"),
    )
    cuts = {"early": 20, "middle": n // 2, "late": n}
    starts = [("m", e, float(1.7e9 + 0.25 * c - 0.1)) for e, c in cuts.items()]
    events = spark.createDataFrame(starts, "metric_name string, event_id string, start_ts double")
    got = {r.event_id: r for r in cf.estimates(events, rows, ["metric_name"], group_limit=limit).collect()}
    for e, c in cuts.items():
        x, y = t[:c] - t[:c].mean(), v[:c] - v[:c].mean()
        want = v[:c].mean() + (x @ y) / (x @ x) * (1.7e9 + 0.25 * c - 0.1 - t[:c].mean())
        assert got[e].n_before == c
        assert abs(got[e].trend - want) <= 1e-12 * abs(want)
