"""Failure priors of system components from per-track drift scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the default component graph
DEFAULT_NODES = [
    ("vector_index", "retrieval", 0.0),
    ("embedding_model", "retrieval", 0.0),
    ("prompt_template", "generation", 0.0),
    ("llm_router", "generation", 0.0),
]
DEFAULT_EDGES = [
    ("vector_index", "embedding_model"),
    ("embedding_model", "prompt_template"),
    ("prompt_template", "llm_router"),
]
SENSITIVITY = 2.0


def default_nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_NODES, "node_id string, node_type string, prior_failure_prob double")


def default_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_EDGES, "source string, target string")


def failure_prob(score: Column, sensitivity: float = SENSITIVITY) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score * F.lit(float(sensitivity)))), 6)


def fusion_priors(scores: DataFrame, nodes: DataFrame, by: list[str], sensitivity: float = SENSITIVITY) -> DataFrame:
    """Prior of every node for every key: raised to the probability of its track's score.

    ``scores``: ``by, track, score``.  Each key gets the whole component graph;
    nodes whose track has no score keep their prior.
    """
    per_key = scores.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("track", "score"))).alias("_scores"))
    graph = nodes.agg(F.collect_list(F.struct("node_id", "node_type", "prior_failure_prob")).alias("_g")).first()["_g"]
    table = F.array(*[
        F.struct(F.lit(n["node_id"]).alias("node_id"), F.lit(n["node_type"]).alias("node_type"), F.lit(n["prior_failure_prob"]).alias("prior"))
        for n in graph  # the component graph of one deployment, a handful of nodes
    ])
    flat = per_key.select(*by, "_scores", F.inline(table))
    raised = failure_prob(F.col("_scores")[F.col("node_type")], sensitivity)
    return flat.select(
        *by, "node_id", "node_type",
        F.greatest(F.col("prior"), F.coalesce(raised, F.col("prior"))).alias("prior_failure_prob"),
    )


def fusion_dual_track(retrieval: DataFrame, generation: DataFrame, nodes: DataFrame, by: list[str], sensitivity: float = SENSITIVITY) -> DataFrame:
    """The same from two separate results (``by, score``); a key may miss either."""
    tagged = retrieval.select(*by, F.lit("retrieval").alias("track"), "score").unionByName(
        generation.select(*by, F.lit("generation").alias("track"), "score")
    )
    return fusion_priors(tagged, nodes, by, sensitivity)
