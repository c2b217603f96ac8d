"""Queries from change history to remediation plans and guardrails."""

from __future__ import annotations

from pyspark.sql import functions as F

from meander.functions.columns import rounded
from meander.operators import changes as ch
from meander.operators import counterfactual as cf
from meander.operators import policy
from meander.operators import remediation as rm
from meander.plans import inputs
from meander.plans.inputs import HISTORY_SQL
from meander.plans.registry import query
from meander.plans.remediate import remediate

BY = ["system"]


def _text4(column: str) -> str:
    """SQL text of a number with at most 4 decimals."""
    fixed = f"CAST(CAST(round(CAST({column} AS DECIMAL(18, 6)), 4) AS DECIMAL(18, 4)) AS VARCHAR)"
    return f"regexp_replace({fixed}, '(\\.[0-9]+?)0+$', '\\1')"


CHANGES_SQL = HISTORY_SQL + """, lagged AS (
  SELECT *, lag(system_version) OVER w AS o_version, lag(pipeline_name) OVER w AS o_pipeline,
         lag(info_model) OVER w AS o_info, lag(tier) OVER w AS o_tier, lag(seq) OVER w AS o_seq
  FROM hist WINDOW w AS (PARTITION BY system ORDER BY timestamp, seq)),
chg AS (
  SELECT system, timestamp AS ts, seq, run_id, o_version, o_pipeline, o_tier, o_info, info_model,
         system_version, pipeline_name, tier,
         CASE WHEN o_info <> info_model THEN 'model_update'
              WHEN o_version <> system_version THEN 'version_change'
              WHEN o_pipeline <> pipeline_name THEN 'model_update'
              WHEN o_tier <> tier THEN 'config_change' ELSE 'unknown' END AS change_type
  FROM lagged WHERE o_seq IS NOT NULL AND (o_version <> system_version OR o_pipeline <> pipeline_name
       OR o_info IS DISTINCT FROM info_model OR o_tier <> tier))"""


@query(
    "change_events",
    "WITH " + CHANGES_SQL + """
SELECT system, ts, seq, run_id, change_type,
       CASE WHEN o_version <> system_version THEN o_version END AS old_version,
       CASE WHEN o_pipeline <> pipeline_name THEN o_pipeline END AS old_pipeline,
       CASE WHEN o_tier <> tier THEN o_tier || '>' || tier END AS tier_change,
       CASE WHEN o_info <> info_model THEN o_info || '>' || info_model END AS model_change FROM chg""",
)
def _change_events(spark, sf_dir):
    out = ch.change_events(inputs.history(spark, sf_dir), BY)
    pair = lambda m, k: F.concat(m[k]["old"], F.lit(">"), m[k]["new"])
    d = F.col("details")
    return out.select(
        "system", "ts", "seq", "run_id", "change_type",
        d["version"]["old"].alias("old_version"), d["pipeline"]["old"].alias("old_pipeline"),
        pair(d["metadata_diff"], "tier").alias("tier_change"), pair(d["system_info_diff"], "model").alias("model_change"),
    )


@query(
    "key_union_diff",
    "WITH " + CHANGES_SQL + """, kv AS (
  SELECT system, seq, 'model' AS key, o_info AS old, info_model AS new FROM lagged WHERE o_seq IS NOT NULL UNION ALL
  SELECT system, seq, 'tier', o_tier, tier FROM lagged WHERE o_seq IS NOT NULL)
SELECT system, seq, key, old, new FROM kv WHERE old IS DISTINCT FROM new""",
)
def _key_union_diff(spark, sf_dir):
    """Differing keys of the previous and the current configuration map of each record."""
    from meander.functions.ordering import drop_halo, framed

    m = F.col("metadata")
    conf = F.map_filter(
        F.create_map(F.lit("model"), F.get_json_object(m["system_info"], "$.model"), F.lit("tier"), m["tier"]),
        lambda _, v: v.isNotNull(),
    )
    rows = inputs.history(spark, sf_dir).select("system", "timestamp", "seq", conf.alias("conf"))
    rows, w = framed(rows, BY, ["timestamp", "seq"], 1)
    rows = drop_halo(rows.withColumn("prev", F.lag("conf").over(w))).filter(F.col("prev").isNotNull())
    out = rows.select("system", "seq", F.explode(ch.map_changes(F.col("prev"), F.col("conf"))).alias("key", "d"))
    return out.select("system", "seq", "key", "d.old", "d.new")


EVENTS_SQL = CHANGES_SQL + """, num AS (
  SELECT system, timestamp AS ts, seq, js_value AS value, run_id,
         row_number() OVER (PARTITION BY system ORDER BY timestamp, seq) AS n FROM hist),
blk AS (SELECT system, (n - 1) // 3 AS block, avg(value) AS mean, min(ts) AS start_ts, max(ts) AS end_ts
        FROM num GROUP BY 1, 2 HAVING count(*) = 3),
evt AS (SELECT c.system, c.block, c.start_ts, c.end_ts, abs(c.mean - p.mean) AS magnitude
        FROM blk c JOIN blk p ON p.system = c.system AND p.block = c.block - 1
        WHERE abs(c.mean - p.mean) > 0.15::DOUBLE),
feat AS (
  SELECT system, block, run_id, change_type, ts, seq, magnitude,
         CASE change_type WHEN 'model_update' THEN 1.0::DOUBLE WHEN 'version_change' THEN 0.8::DOUBLE
              WHEN 'config_change' THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS type_weight,
         ts BETWEEN start_ts AND end_ts AS in_window,
         CASE WHEN ts BETWEEN start_ts AND end_ts THEN 0.0::DOUBLE
              ELSE least(abs(ts - start_ts), abs(ts - end_ts)) END AS time_delta
  FROM evt JOIN chg USING (system)),
near AS (SELECT *, max(time_delta) OVER (PARTITION BY system, block) AS md FROM feat),
fac AS (
  SELECT *, CAST(round(CAST(CAST(0.4::DOUBLE * (CASE WHEN in_window THEN (CASE WHEN md > 0 THEN 1 - time_delta / md ELSE 1 END) * 0.5::DOUBLE + 0.5::DOUBLE
                                      WHEN md > 0 THEN 1 - time_delta / md ELSE 1 END)
                + 0.3::DOUBLE * type_weight + 0.3::DOUBLE * (CASE WHEN magnitude > 0 THEN 1 ELSE 0 END) AS VARCHAR) AS DECIMAL(38, 20)), 4) AS DOUBLE) AS score
  FROM near),
ranked AS (SELECT *, row_number() OVER (PARTITION BY system, block ORDER BY score DESC, ts, seq) AS rank FROM fac),
conf AS (
  SELECT system, block, count(*) AS num_factors,
         round(CASE WHEN count(*) = 1 THEN max(score) WHEN sum(score) = 0 THEN 0 ELSE max(score) / sum(score) END, 4) AS confidence
  FROM fac GROUP BY 1, 2)"""


def _run(spark, sf_dir):
    return remediate(inputs.history(spark, sf_dir), BY)


def _with_block(r, df):
    return df.join(r.events.select(*BY, "event_id", "block"), [*BY, "event_id"])


@query(
    "event_change_features",
    "WITH " + EVENTS_SQL + """
SELECT system, block, run_id, change_type, time_delta, in_window, type_weight, round(magnitude, 6) AS drift_magnitude FROM feat""",
)
def _event_change_features(spark, sf_dir):
    r = _run(spark, sf_dir)
    out = _with_block(r, ch.event_change_features(r.events, r.changes, BY))
    return out.select(
        "system", "block", "run_id", "change_type", "time_delta", "in_window", "type_weight",
        rounded(F.col("drift_magnitude")).alias("drift_magnitude"),
    )


@query(
    "attribution_scores",
    "WITH " + EVENTS_SQL + " SELECT system, block, run_id, change_type, score, CAST(rank AS BIGINT) AS rank FROM ranked",
)
def _attribution_scores(spark, sf_dir):
    r = _run(spark, sf_dir)
    out = _with_block(r, ch.rank_factors(r.factors, BY))
    return out.select("system", "block", "run_id", "change_type", "score", "rank")


@query("event_confidence", "WITH " + EVENTS_SQL + " SELECT system, block, num_factors, confidence FROM conf")
def _event_confidence(spark, sf_dir):
    r = _run(spark, sf_dir)
    conf = r.attributions.filter("num_factors > 0")
    return _with_block(r, conf).select("system", "block", "num_factors", "confidence")


@query(
    "attribute_drift",
    "WITH " + EVENTS_SQL + """
SELECT e.system, e.block, 'js_divergence' AS metric_name, coalesce(num_factors, 0) AS num_factors,
       coalesce(confidence, 0.0::DOUBLE) AS confidence
FROM evt e LEFT JOIN conf c ON c.system = e.system AND c.block = e.block""",
)
def _attribute_drift(spark, sf_dir):
    r = _run(spark, sf_dir)
    return _with_block(r, r.attributions).select("system", "block", "metric_name", "num_factors", "confidence")


ESTIMATES_SQL = EVENTS_SQL + """, pre AS (
  SELECT e.system, e.block, e.start_ts, n.ts, n.value,
         row_number() OVER (PARTITION BY e.system, e.block ORDER BY n.ts, n.seq) AS i,
         count(*) OVER (PARTITION BY e.system, e.block) AS n
  FROM evt e JOIN num n ON n.system = e.system AND n.ts < e.start_ts),
allm AS (SELECT system, avg(value) AS m FROM num GROUP BY 1),
est0 AS (
  SELECT system, block, any_value(n) AS n_before, avg(value) AS mean,
         sum(value * CASE WHEN i = 1 THEN pow(0.7::DOUBLE, n - 1) ELSE 0.3::DOUBLE * pow(0.7::DOUBLE, n - i) END) AS ewma,
         CASE WHEN any_value(n) >= 3 AND var_pop(ts) > 0
              THEN regr_slope(value, ts - start_ts) * 0 + regr_intercept(value, ts - start_ts) END AS line
  FROM pre GROUP BY 1, 2),
est AS (
  SELECT e.system, e.block, coalesce(n_before, 0) AS n_before, coalesce(mean, a.m, 0) AS mean, coalesce(ewma, a.m, 0) AS ewma,
         coalesce(CASE WHEN n_before < 3 THEN ewma WHEN line IS NULL THEN mean ELSE line END, a.m, 0) AS trend
  FROM evt e LEFT JOIN est0 s ON s.system = e.system AND s.block = e.block LEFT JOIN allm a ON a.system = e.system)"""


def _estimate(method):
    def run(spark, sf_dir):
        r = _run(spark, sf_dir)
        return _with_block(r, r.estimates).select("system", "block", "n_before", rounded(F.col(method)).alias("estimate"))

    return run


for _m in ("mean", "ewma", "trend"):
    query(
        f"estimate_{_m}",
        "WITH " + ESTIMATES_SQL + f" SELECT system, block, n_before, round({_m}, 6) AS estimate FROM est",
    )(_estimate(_m))


RESULTS_SQL = ESTIMATES_SQL + """, top AS (SELECT * FROM ranked WHERE rank <= 3),
scen AS (
  SELECT system, block, CAST(rank AS INTEGER) AS pos, run_id AS runs, 1 AS num_interventions, score AS confidence FROM top
  UNION ALL
  SELECT system, block, CAST(count(*) + 1 AS INTEGER), string_agg(run_id, ',' ORDER BY rank), CAST(count(*) AS INTEGER), min(score)
  FROM top GROUP BY 1, 2 HAVING count(*) > 1),
res AS (
  SELECT s.*, round(magnitude, 6) AS original_metric, round(trend, 6) AS counterfactual_metric,
         round(magnitude - trend, 6) + 0.0::DOUBLE AS delta
  FROM scen s JOIN evt e ON e.system = s.system AND e.block = s.block JOIN est t ON t.system = s.system AND t.block = s.block)"""


def _runs_of(r, df):
    """Replace change ids by the run ids of those changes, in order."""
    exploded = df.select("scenario_id", F.posexplode("change_ids").alias("i", "change_id"))
    names = exploded.join(r.brief_changes.select("change_id", "run_id"), "change_id").groupBy("scenario_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "run_id"))), lambda x: x["run_id"]), ",").alias("runs")
    )
    return df.join(names, "scenario_id")


@query("scenarios", "WITH " + RESULTS_SQL + " SELECT system, block, pos, runs, num_interventions, confidence FROM scen")
def _scenarios(spark, sf_dir):
    r = _run(spark, sf_dir)
    out = _with_block(r, _runs_of(r, r.scenarios))
    return out.select("system", "block", "pos", "runs", F.size("change_ids").alias("num_interventions"), "confidence")


@query(
    "counterfactuals",
    "WITH " + RESULTS_SQL + """
SELECT system, block, pos, runs, num_interventions, original_metric, counterfactual_metric, delta, confidence FROM res""",
)
def _counterfactuals(spark, sf_dir):
    r = _run(spark, sf_dir)
    out = _with_block(r, _runs_of(r, r.counterfactuals))
    return out.select(
        "system", "block", "pos", "runs", "num_interventions", "original_metric", "counterfactual_metric", "delta", "confidence"
    )


@query(
    "intervention_apply",
    "WITH " + CHANGES_SQL + """
SELECT 'undo' AS scenario_id, run_id, CASE WHEN o_version <> system_version THEN o_version ELSE system_version END AS system_version,
       o_pipeline AS pipeline_name, o_tier AS tier, CASE WHEN o_info IS NOT NULL AND info_model IS NOT NULL THEN o_info ELSE info_model END AS model
FROM chg UNION ALL
SELECT 'tier0', run_id, system_version, pipeline_name, '0', info_model FROM chg""",
)
def _intervention_apply(spark, sf_dir):
    """Undo every change in one scenario, override a field of it in another."""
    history = inputs.history(spark, sf_dir)
    changes = ch.change_events(history, BY)
    none = F.lit(None).cast(ch.FIELD_MAP)
    undo = changes.select("system", F.lit("undo").alias("scenario_id"), "change_id", F.lit("remove").alias("action"), none.alias("override"))
    over = changes.select(
        "system", F.lit("tier0").alias("scenario_id"), "change_id", F.lit("modify").alias("action"),
        F.create_map(F.lit("tier"), F.lit("0")).alias("override"),
    )
    out = cf.intervention_apply(undo.unionByName(over), changes, history, BY)
    m = F.col("metadata")
    return out.select(
        "scenario_id", "run_id", "system_version", m["pipeline_name"].alias("pipeline_name"),
        m["tier"].alias("tier"), F.get_json_object(m["system_info"], "$.model").alias("model"),
    )


ACTIONS_SQL = RESULTS_SQL + """, act AS (
  SELECT system, block, CAST(rank AS BIGINT) AS pos, run_id AS target_run_id, score AS factor_score,
         CASE change_type WHEN 'model_update' THEN 'revert_model' WHEN 'version_change' THEN 'restore_version' ELSE 'rollback_config' END AS action_type
  FROM ranked),
best AS (
  SELECT t.system, t.block, t.run_id, max_by(r.delta, r.pos) AS delta, max_by(r.confidence, r.pos) AS confidence
  FROM top t JOIN res r ON r.system = t.system AND r.block = t.block
       AND (r.runs = t.run_id OR r.num_interventions > 1) GROUP BY 1, 2, 3),
imp AS (
  SELECT a.*, coalesce(b.delta, 0) AS expected_improvement, coalesce(b.confidence, 0) AS confidence
  FROM act a LEFT JOIN best b ON b.system = a.system AND b.block = a.block AND b.run_id = a.target_run_id),
rec AS (
  SELECT *, row_number() OVER (PARTITION BY system, block ORDER BY expected_improvement DESC, confidence DESC, pos) AS priority
  FROM imp)"""


@query("remediation_actions", "WITH " + ACTIONS_SQL + " SELECT system, block, pos, action_type, target_run_id, factor_score FROM act")
def _remediation_actions(spark, sf_dir):
    r = _run(spark, sf_dir)
    out = _with_block(r, r.actions)
    return out.select("system", "block", "pos", "action_type", "target_run_id", "factor_score")


@query(
    "action_impact",
    "WITH " + ACTIONS_SQL + " SELECT system, block, pos, action_type, target_run_id, expected_improvement, confidence FROM imp",
)
def _action_impact(spark, sf_dir):
    r = _run(spark, sf_dir)
    return _with_block(r, r.recommendations).select(
        "system", "block", "pos", "action_type", "target_run_id", "expected_improvement", "confidence"
    )


@query(
    "recommendation_rank",
    "WITH " + ACTIONS_SQL + """
SELECT system, block, priority, action_type, target_run_id, expected_improvement, confidence FROM rec""",
)
def _recommendation_rank(spark, sf_dir):
    r = _run(spark, sf_dir)
    return _with_block(r, r.recommendations).select(
        "system", "block", "priority", "action_type", "target_run_id", "expected_improvement", "confidence"
    )


PLAN_SQL = ACTIONS_SQL + """, plan AS (
  SELECT e.system, e.block, e.start_ts, e.magnitude, count(r.pos) AS num_recommendations,
         max(CASE WHEN priority = 1 THEN action_type END) AS action_type,
         max(CASE WHEN priority = 1 THEN target_run_id END) AS target_run_id,
         max(CASE WHEN priority = 1 THEN expected_improvement END) AS improvement,
         max(CASE WHEN priority = 1 THEN confidence END) AS confidence
  FROM evt e LEFT JOIN rec r ON r.system = e.system AND r.block = e.block GROUP BY 1, 2, 3, 4)"""


@query(
    "optimization_plan",
    "WITH " + PLAN_SQL + """
SELECT system, block, num_recommendations, action_type, target_run_id, improvement, confidence,
       'Top recommendation: ' || CASE action_type WHEN 'revert_model' THEN 'revert model change'
            WHEN 'restore_version' THEN 'restore previous version' ELSE 'rollback configuration change' END
       || ' in run ' || target_run_id || ' (expected improvement: ' || """ + _text4("improvement") + """ || ')'
       || CASE WHEN confidence > 0 THEN ' confidence: ' || """ + _text4("confidence") + """ ELSE '' END AS summary
FROM plan WHERE num_recommendations > 0
UNION ALL SELECT system, block, 0, NULL, NULL, NULL, NULL, 'none' FROM plan WHERE num_recommendations = 0""",
)
def _optimization_plan(spark, sf_dir):
    r = _run(spark, sf_dir)
    t = F.col("top")
    return _with_block(r, r.plans).select(
        "system", "block", "num_recommendations", t["action_type"].alias("action_type"),
        t["target_run_id"].alias("target_run_id"), t["expected_improvement"].alias("improvement"),
        t["confidence"].alias("confidence"), F.when(t.isNull(), "none").otherwise(F.col("summary")).alias("summary"),
    )


@query(
    "remediate",
    "WITH " + PLAN_SQL + """
SELECT system, block, start_ts, round(magnitude, 6) AS magnitude, coalesce(c.confidence, 0.0::DOUBLE) AS attribution_confidence,
       num_recommendations, action_type, target_run_id, improvement
FROM plan LEFT JOIN conf c USING (system, block)""",
)
def _remediate(spark, sf_dir):
    r = _run(spark, sf_dir)
    plans = r.plans.select(
        *BY, "event_id", "num_recommendations", F.col("top.action_type").alias("action_type"),
        F.col("top.target_run_id").alias("target_run_id"), F.col("top.expected_improvement").alias("improvement"),
    )
    att = r.attributions.select(*BY, "event_id", F.col("confidence").alias("attribution_confidence"))
    ev = r.events.select(*BY, "event_id", "block", "start_ts", rounded(F.col("magnitude")).alias("magnitude"))
    return ev.join(plans, [*BY, "event_id"]).join(att, [*BY, "event_id"]).drop("event_id")


CAND_SQL = RESULTS_SQL + """, tracked AS (
  SELECT *, CASE block % 3 WHEN 0 THEN 'retrieval' WHEN 1 THEN 'generation' ELSE 'unified' END AS track FROM res),
cand AS (
  SELECT system, block, track, pos, delta, confidence, split_part(runs, ',', 1) AS run_id,
         CASE track WHEN 'retrieval' THEN 'adjust_top_k' WHEN 'generation' THEN 'adjust_temperature' ELSE 'rollback_config' END AS action_type,
         row_number() OVER (PARTITION BY system, block ORDER BY delta DESC, pos) AS rank
  FROM tracked WHERE confidence >= 0.7::DOUBLE)"""


def _tracked(r):
    """Scenario results with the track of their event and the run of their first change."""
    third = F.pmod(F.col("block"), F.lit(3))
    track = F.when(third == 0, "retrieval").when(third == 1, "generation").otherwise("unified")
    first = F.get("change_ids", F.lit(0))
    named = r.counterfactuals.join(
        r.changes.select(F.col("change_id").alias("_c"), "run_id"), first == F.col("_c")
    ).drop("_c")
    return _with_block(r, named).withColumn("track", track)


@query("candidate_actions", "WITH " + CAND_SQL + " SELECT system, block, track, action_type, run_id, delta, confidence, CAST(rank AS INTEGER) AS rank FROM cand")
def _candidate_actions(spark, sf_dir):
    out = rm.candidate_actions(_tracked(_run(spark, sf_dir)), BY, F.col("track"))
    return out.select("system", "block", "track", "action_type", "run_id", "delta", "confidence", "rank")


@query("select_action", "WITH " + CAND_SQL + " SELECT system, block, track, action_type, run_id, delta, confidence FROM cand WHERE rank = 1")
def _select_action(spark, sf_dir):
    out = rm.select_action(_tracked(_run(spark, sf_dir)), BY, F.col("track"))
    return out.select("system", "block", "track", "action_type", "run_id", "delta", "confidence")


# --- guardrails: every event is an action on its user's run ------------------

POLICY_SQL = """acts AS (
  SELECT event_id AS action_id, CASE event_type WHEN 'click' THEN 'adjust_top_k' WHEN 'view' THEN 'adjust_temperature'
              ELSE 'rollback_config' END AS action_type,
         'u' || user_id AS target_run_id, 'c' || (event_id % 2) AS change_id, epoch(ts) AS ts,
         value / 200.0::DOUBLE AS temperature, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS top_k
  FROM events),
cool AS (
  SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY action_type, target_run_id, change_id ORDER BY ts, action_id) < 21600.0::DOUBLE, false) AS in_cooldown
  FROM acts),
flap AS (
  SELECT *, count(*) OVER (PARTITION BY target_run_id ORDER BY ts RANGE BETWEEN 172800.0::DOUBLE PRECEDING AND CURRENT ROW) - 1 AS recent_actions
  FROM cool)"""


def _actions(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "adjust_top_k").when(
        F.col("event_type") == "view", "adjust_temperature"
    ).otherwise("rollback_config")
    from meander.functions.columns import epoch_seconds

    return inputs.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("action_id"), kind.alias("action_type"),
        F.concat(F.lit("u"), "user_id").alias("target_run_id"),
        F.concat(F.lit("c"), F.col("event_id") % 2).alias("change_id"),
        epoch_seconds("ts").alias("ts"),
        F.create_map(
            F.lit("temperature"), F.col("value") / 200.0,
            F.lit("top_k"), F.get_json_object("props", "$.k").cast("double"),
        ).alias("params"),
    )


@query(
    "policy_bounds",
    "WITH " + POLICY_SQL + """
SELECT action_id, 'temperature' AS param, temperature AS value, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM acts WHERE temperature > 1.0::DOUBLE
UNION ALL SELECT action_id, 'top_k', top_k, 1.0::DOUBLE, 50.0::DOUBLE FROM acts WHERE top_k < 1.0::DOUBLE OR top_k > 50.0::DOUBLE""",
)
def _policy_bounds(spark, sf_dir):
    return policy.policy_bounds(_actions(spark, sf_dir))


@query("policy_cooldown", "WITH " + POLICY_SQL + " SELECT action_id, in_cooldown FROM cool")
def _policy_cooldown(spark, sf_dir):
    return policy.policy_cooldown(_actions(spark, sf_dir), cooldown_s=21600.0).select("action_id", "in_cooldown")


@query("policy_flapping", "WITH " + POLICY_SQL + " SELECT action_id, recent_actions, recent_actions >= 5 AS is_flapping FROM flap")
def _policy_flapping(spark, sf_dir):
    return policy.policy_flapping(_actions(spark, sf_dir), window_s=172800.0).select("action_id", "recent_actions", "is_flapping")


@query(
    "policy_decide",
    "WITH " + POLICY_SQL + """, d AS (
  SELECT action_id, CASE WHEN temperature > 1.0::DOUBLE OR top_k < 1.0::DOUBLE OR top_k > 50.0::DOUBLE THEN 'parameter_bounds'
              WHEN in_cooldown THEN 'cooldown_period' WHEN recent_actions >= 5 THEN 'max_flapping' END AS rule_violated FROM flap)
SELECT action_id, rule_violated, rule_violated IS NULL AS allowed FROM d""",
)
def _policy_decide(spark, sf_dir):
    out = policy.policy_decide(_actions(spark, sf_dir), cooldown_s=21600.0, window_s=172800.0)
    return out.select("action_id", "rule_violated", "allowed")


@query(
    "policy_sequence",
    "WITH RECURSIVE " + POLICY_SQL + """, num AS (
  SELECT action_id, target_run_id, ts, action_type || ':' || change_id AS sig,
         temperature > 1.0::DOUBLE OR top_k < 1.0::DOUBLE OR top_k > 50.0::DOUBLE AS broken,
         row_number() OVER (PARTITION BY target_run_id ORDER BY ts, action_id) AS k FROM acts),
rec AS (
  SELECT DISTINCT target_run_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS action_id, CAST(NULL AS VARCHAR) AS rule_violated,
         CAST([] AS STRUCT(sig VARCHAR, t DOUBLE)[]) AS ok, CAST([] AS VARCHAR[]) AS bad FROM num
  UNION ALL
  SELECT target_run_id, k, action_id, rule_violated,
         CASE WHEN rule_violated IS NULL THEN list_append(ok, struct_pack(sig := sig, t := ts)) ELSE ok END,
         CASE WHEN rule_violated IS NULL THEN bad ELSE list_append(bad, sig) END
  FROM (
    SELECT n.target_run_id, n.k, n.action_id, n.sig, n.ts, r.ok, r.bad,
           CASE WHEN n.broken THEN 'parameter_bounds'
                WHEN list_contains(r.bad, n.sig) OR len(list_filter(r.ok, lambda x: x.sig = n.sig AND n.ts - x.t < 21600.0::DOUBLE)) > 0
                  THEN 'cooldown_period'
                WHEN len(r.bad) + len(list_filter(r.ok, lambda x: n.ts - x.t <= 172800.0::DOUBLE)) >= 5 THEN 'max_flapping' END AS rule_violated
    FROM rec r JOIN num n ON n.target_run_id = r.target_run_id AND n.k = r.k + 1))
SELECT action_id, rule_violated, rule_violated IS NULL AS allowed FROM rec WHERE k > 0""",
)
def _policy_sequence(spark, sf_dir):
    out = policy.policy_sequence(_actions(spark, sf_dir), cooldown_s=21600.0, window_s=172800.0)
    return out.select("action_id", "rule_violated", "allowed")


@query(
    "optimization_cycle",
    "WITH " + CAND_SQL + """, sel AS (SELECT * FROM cand WHERE rank = 1),
ex AS (SELECT system % 100 AS target, CASE block % 3 WHEN 0 THEN 'adjust_top_k' WHEN 1 THEN 'adjust_temperature' ELSE 'rollback_config' END AS action_type,
              run_id FROM ranked WHERE rank = 1 AND system % 2 = 0 AND block % 2 = 0),
done AS (SELECT DISTINCT * FROM ex), many AS (SELECT target FROM ex GROUP BY 1 HAVING count(*) >= 5),
chk AS (SELECT s.system, s.block, s.action_type, s.run_id,
               CASE WHEN d.run_id IS NOT NULL THEN 'cooldown_period' WHEN m.target IS NOT NULL THEN 'max_flapping' END AS rule_violated
        FROM sel s LEFT JOIN done d ON d.target = s.system % 100 AND d.action_type = s.action_type AND d.run_id = s.run_id
        LEFT JOIN many m ON m.target = s.system % 100)
SELECT e.system, e.block, CASE WHEN k.run_id IS NULL THEN 'no_action_needed' WHEN k.rule_violated IS NOT NULL THEN 'blocked_by_guardrail' ELSE 'approved' END AS status,
       k.action_type, k.run_id, k.rule_violated
FROM evt e LEFT JOIN chk k ON k.system = e.system AND k.block = e.block""",
)
def _optimization_cycle(spark, sf_dir):
    """One cycle per drift event; even systems executed the top actions of even blocks a minute ago."""
    from meander.plans.cycle import optimization_cycle

    r = _run(spark, sf_dir)
    results = _tracked(r)
    third = F.pmod(F.col("block"), F.lit(3))
    kind = F.when(third == 0, "adjust_top_k").when(third == 1, "adjust_temperature").otherwise("rollback_config")
    target = (F.col("system") % 100).cast("string")  # a hundred hosts of systems; flapping is counted per host
    top = r.best_factors.filter((F.col("rank") == 1) & (F.col("system") % 2 == 0))
    executed = _with_block(r, top).filter(F.col("block") % 2 == 0).select(
        kind.alias("action_type"), target.alias("target_run_id"), "change_id", F.lit(940.0).alias("executed_at")
    )
    out = optimization_cycle(r.events, results, BY, executed, F.lit(1000.0), target=target)
    return _with_block(r, out.drop("block")).select(
        "system", "block", "status", "action_type", "run_id", "rule_violated"
    )
