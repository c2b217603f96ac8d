"""One closed optimization cycle for every drift event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meander.operators.policy import COOLDOWN_S, FLAPPING_WINDOW_S, MAX_FLAPPING, check_against_history, policy_sequence
from meander.operators.remediation import MIN_CONFIDENCE, select_action


def optimization_cycle(
    events: DataFrame, results: DataFrame, by: list[str], executed: DataFrame, now: Column,
    min_confidence: float = MIN_CONFIDENCE, cooldown_s: float = COOLDOWN_S,
    window_s: float = FLAPPING_WINDOW_S, max_flapping: int = MAX_FLAPPING, target: Column | None = None,
    in_order: bool = False,
) -> DataFrame:
    """Select an action per event, check it, and report the status.

    ``results`` are counterfactuals with a ``track`` column; an event without a
    confident scenario needs no action.  Flapping is counted per ``target``.  All events are checked against
    ``executed`` at time ``now``; ``in_order`` runs the cycles one after another by ``now`` (then ``by`` and event id),
    so that each decision is part of the history of the next one (see ``policy_sequence``).
    """
    keys = [*by, "event_id"]
    picked = select_action(results, by, F.col("track"), min_confidence, target)
    if "params" not in picked.columns:
        picked = picked.withColumn("params", F.lit(None).cast("map<string,double>"))
    if in_order:
        timed = picked.withColumns({"cycle_at": now, "cycle": F.to_json(F.array(*[F.col(c).cast("string") for c in keys]))})
        checked = policy_sequence(timed, executed, "cycle_at", "cycle", cooldown_s, window_s, max_flapping)
        checked = checked.drop("cycle_at", "cycle")
    else:
        checked = check_against_history(picked, executed, now, cooldown_s, window_s, max_flapping)
    status = (
        F.when(F.col("allowed").isNull(), "no_action_needed")
        .when(F.col("allowed"), "approved")
        .otherwise("blocked_by_guardrail")
    )
    return events.select(*by, "event_id").join(checked, keys, "left").withColumn("status", status)
