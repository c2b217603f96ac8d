"""From attributed factors to ranked remediation actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meander.functions.ordering import numbered

# fixed values: action and its wording per change type, and per drift track
ACTIONS = {
    "model_update": "revert_model",
    "config_change": "rollback_config",
    "version_change": "restore_version",
}
DESCRIPTIONS = {
    "revert_model": "Revert model change",
    "rollback_config": "Rollback configuration change",
    "restore_version": "Restore previous version",
}
TRACK_ACTIONS = {"retrieval": "adjust_top_k", "generation": "adjust_temperature"}
DEFAULT_ACTION = "rollback_config"
MIN_CONFIDENCE = 0.70


def _lookup(c: Column, table: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for key, value in table.items():
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out


def _text4(c: Column) -> Column:
    """Number with at most 4 decimals and no trailing zeros."""
    return F.regexp_replace(F.format_string("%.4f", F.round(c, 4)), r"(\.[0-9]+?)0+$", "$1")


def remediation_actions(ranked_factors: DataFrame, by: list[str]) -> DataFrame:
    """One action per factor, in factor order (``pos``)."""
    action = _lookup(F.col("change_type"), ACTIONS, DEFAULT_ACTION)
    return ranked_factors.select(
        *by, "event_id", F.col("rank").alias("pos"), action.alias("action_type"),
        F.col("run_id").alias("target_run_id"), "change_id",
        _lookup(action, DESCRIPTIONS, DESCRIPTIONS[DEFAULT_ACTION]).alias("description"),
        F.col("change_type").alias("factor_name"), F.col("score").alias("factor_score"),
    )


def action_impact(actions: DataFrame, results: DataFrame, by: list[str]) -> DataFrame:
    """Improvement and confidence of each action: the last scenario naming its change wins."""
    event = [*by, "event_id"]
    impact = (
        results.select(*event, "pos", "delta", "confidence", F.explode("change_ids").alias("change_id"))
        .groupBy(*event, "change_id")
        .agg(F.max_by(F.struct("delta", "confidence"), F.col("pos")).alias("_i"))
    )
    return actions.join(impact, [*event, "change_id"], "left").withColumns(
        {
            "expected_improvement": F.round(F.coalesce(F.col("_i.delta"), F.lit(0.0)), 6),
            "confidence": F.round(F.coalesce(F.col("_i.confidence"), F.lit(0.0)), 4),
        }
    ).drop("_i")


def recommendation_rank(impacts: DataFrame, by: list[str]) -> DataFrame:
    """``priority`` 1.. per event: improvement, then confidence, then factor order."""
    keyed = impacts.withColumns({"_a": -F.col("expected_improvement"), "_b": -F.col("confidence")})
    return numbered(keyed, [*by, "event_id"], ["_a", "_b", "pos"], "priority").drop("_a", "_b")


def optimization_plan(
    events: DataFrame, recommendations: DataFrame, attributions: DataFrame, by: list[str]
) -> DataFrame:
    """One plan per event: number of recommendations, the best one and a summary sentence.

    ``recommendations`` must hold each event's best one; the number is that of the
    event's factors.
    """
    event = [*by, "event_id"]
    order = F.struct(-F.col("expected_improvement"), -F.col("confidence"), F.col("pos"))
    best = recommendations.groupBy(*event).agg(
        F.min_by(
            F.struct("action_type", "target_run_id", "change_id", "description", "expected_improvement", "confidence"),
            order,
        ).alias("top"),
    )
    top = F.col("top")
    sentence = F.concat_ws(
        " ",
        F.concat(F.lit("Top recommendation: "), F.lower(top["description"])),
        F.when(top["target_run_id"] != "", F.concat(F.lit("in run "), top["target_run_id"])),
        F.concat(F.lit("(expected improvement: "), _text4(top["expected_improvement"]), F.lit(")")),
        F.when(top["confidence"] > 0, F.concat(F.lit("confidence: "), _text4(top["confidence"]))),
    )
    none = F.concat(
        F.lit("No actionable recommendations for drift event "), F.col("event_id"),
        F.lit(". No causal factors identified."),
    )
    counts = attributions.select(*event, F.col("num_factors").alias("num_recommendations"))
    return events.select(*event, "metric_name", "magnitude").join(counts, event, "left").join(best, event, "left").select(
        *event, "metric_name", F.col("magnitude").alias("drift_magnitude"),
        F.coalesce("num_recommendations", F.lit(0)).alias("num_recommendations"), "top",
        F.when(top.isNull(), none).otherwise(sentence).alias("summary"),
    )


def _track_action(results: DataFrame, track: Column, target: Column | None = None) -> DataFrame:
    action = _lookup(track, TRACK_ACTIONS, DEFAULT_ACTION)
    verb = F.when(track == "retrieval", "Adjust retrieval parameters").when(
        track == "generation", "Adjust generation parameters"
    ).otherwise("Rollback configuration")
    return results.withColumns(
        {
            "action_type": action,
            "target_run_id": F.lit("") if target is None else target,
            "change_id": F.coalesce(F.get("change_ids", F.lit(0)), F.lit("")),
            "description": F.format_string("%s to reduce drift (expected improvement: %.4f)", verb, "delta"),
        }
    )


def candidate_actions(
    results: DataFrame, by: list[str], track: Column, min_confidence: float = MIN_CONFIDENCE, target: Column | None = None
) -> DataFrame:
    """All scenarios confident enough, best improvement first (``rank`` per event).

    ``target`` is what an action acts on; flapping is counted per target, so without one all actions share a count.
    """
    ok = _track_action(results.filter(F.col("confidence") >= F.lit(float(min_confidence))), track, target)
    # at most top_k + 1 scenarios per event
    w = Window.partitionBy(*by, "event_id").orderBy(F.desc("delta"), "pos")
    return ok.withColumn("rank", F.row_number().over(w))


def select_action(
    results: DataFrame, by: list[str], track: Column, min_confidence: float = MIN_CONFIDENCE, target: Column | None = None
) -> DataFrame:
    """The best confident scenario of each event, as an action."""
    return candidate_actions(results, by, track, min_confidence, target).filter(F.col("rank") == 1).drop("rank")
