"""Routing drift of agent swarms from hop rows ``(by..., trace_id, pos, agent)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meander.functions.ordering import GROUP_LIMIT, drop_halo, framed


def hops_of_frames(frames: DataFrame, by: list[str], trace_id: str = "trace_id", hops: str = "agent_hops") -> DataFrame:
    """Hop rows from a hop array per trace."""
    return frames.select(*by, F.col(trace_id).alias("trace_id"), F.posexplode(hops).alias("pos", "agent"))


def agent_transitions(hops: DataFrame, by: list[str], group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Counts of consecutive hops within a trace: ``by, source, target, n``."""
    rows, w = framed(hops, [*by, "trace_id"], ["pos"], 1, group_limit)
    rows = drop_halo(rows.withColumn("source", F.lag("agent").over(w)))
    return (
        rows.filter(F.col("source").isNotNull())
        .groupBy(*by, "source", F.col("agent").alias("target"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def agent_union(hops: DataFrame) -> DataFrame:
    """Distinct agents over all windows."""
    return hops.select("agent").distinct()


def transition_entropy(transitions: DataFrame, by: list[str]) -> DataFrame:
    """Summed entropy of the rows of the transition matrix, in nats."""
    out_of = transitions.groupBy(*by, "source").agg(F.sum("n").alias("_all"))
    p = F.col("n") / F.col("_all")
    return transitions.join(out_of, [*by, "source"]).groupBy(*by).agg((-F.sum(p * F.log(p)) + F.lit(0.0)).alias("entropy"))


def swarm_drift(
    traces: DataFrame, hops: DataFrame, pairs: DataFrame, by: str,
    entropy_threshold: float = 0.5, reflection_threshold: float = 1.0, group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Entropy and mean-reflection deltas of window pairs, with the verdict.

    ``traces``: ``by, trace_id, reflections``.  Traces with neither hops nor
    reflections are left out of the mean.
    """
    from meander.operators.graph import window_pairs

    active = hops.select(by, "trace_id").distinct().withColumn("_hops", F.lit(True))
    used = traces.join(active, [by, "trace_id"], "left").filter(
        F.col("_hops").isNotNull() | (F.coalesce("reflections", F.lit(0)) > 0)
    )
    means = used.groupBy(by).agg(F.avg(F.coalesce("reflections", F.lit(0))).alias("reflections"))
    entropy = transition_entropy(agent_transitions(hops, [by], group_limit), [by])
    summary = means.join(entropy, by, "full").na.fill(0.0, ["reflections", "entropy"])
    both = window_pairs(summary, pairs, by, ["reflections", "entropy"]).na.fill(0.0)
    out = both.select(
        "baseline", "current",
        (F.col("c_entropy") - F.col("b_entropy")).alias("transition_entropy_delta"),
        (F.col("c_reflections") - F.col("b_reflections")).alias("avg_reflection_iterations_delta"),
    )
    verdict = (F.abs("transition_entropy_delta") > F.lit(float(entropy_threshold))) | (
        F.abs("avg_reflection_iterations_delta") > F.lit(float(reflection_threshold))
    )
    return out.withColumn("is_swarm_drifted", verdict)
