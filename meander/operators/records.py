"""Mapping and checking of run, frame and metric records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meander.schemas import METRIC


def metric_to_json(m: Column) -> Column:
    """Tagged JSON of a metric; only the fields its type owns are written."""
    common = [m[c].alias(c) for c in ("metric_name", "value", "metadata")]
    tag = m["_type"].alias("_type")
    options = {"ignoreNullFields": "false"}
    drift = F.struct(*common, m["baseline_run_id"].alias("baseline_run_id"), m["current_run_id"].alias("current_run_id"), tag)
    quality = F.struct(*common, m["run_id"].alias("run_id"), tag)
    plain = F.struct(*common, tag)
    return (
        F.when(m["_type"] == "DriftResult", F.to_json(drift, options))
        .when(m["_type"] == "QualityResult", F.to_json(quality, options))
        .otherwise(F.to_json(plain, options))
    )


def metric_from_json(text: Column) -> Column:
    """Wide metric struct; fields of other types are null."""
    return F.from_json(text, METRIC)


# fixed values: run kind by pipeline name, lowercased without its "rag" suffix
KINDS = {"naive": "naive", "agentic": "agentic", "graph": "graph_rag", "swarm": "swarm"}
SCHEMA_VERSION = "1.0"


def embedding_pick_frames(frame: str = "frame") -> Column:
    """Vector of a frame: query, else response, else first context vector.

    An empty list counts as present and ends the search; drop such rows with
    ``size > 0``.
    """
    f = F.col(frame)
    return F.coalesce(
        f["query"]["embedding"], f["output"]["response_embedding"], F.get(f["context"]["dense_embeddings"], F.lit(0))
    )


def embedding_pick_runs() -> Column:
    """Vector of a run: query, else answer, else first retrieved vector."""
    return F.coalesce("query_embedding", "answer_embedding", F.get("retrieved_embeddings", F.lit(0)))


def dim_check(vectors: DataFrame, by: list[str], vec: str = "embedding", side: str = "is_current") -> DataFrame:
    """Vector widths per key and whether the two sides can be compared."""
    width, cur = F.size(vec), F.col(side)
    agg = vectors.groupBy(*by).agg(
        F.min(F.when(~cur, width)).alias("baseline_min"), F.max(F.when(~cur, width)).alias("baseline_max"),
        F.min(F.when(cur, width)).alias("current_min"), F.max(F.when(cur, width)).alias("current_max"),
    )
    widths = [F.col(c) for c in ("baseline_min", "baseline_max", "current_min", "current_max")]
    same = (F.greatest(*widths) == F.least(*widths)) & (F.least(*widths) > 0)
    present = F.col("baseline_min").isNotNull() & F.col("current_min").isNotNull()
    return agg.withColumn("dim_mismatch", ~F.coalesce(present & same, F.lit(False)))


def run_reject_reason() -> Column:
    """First broken rule of a run, or null."""
    docs = F.coalesce(F.size("retrieved_docs"), F.lit(0))
    return (
        F.when(~F.coalesce(F.col("query").rlike(r"(?U)\S"), F.lit(False)), "query must not be empty")
        .when(F.col("retrieved_docs").isNull() | (docs == 0), "retrieved_docs must not be empty")
        .when(
            F.col("retrieved_doc_ids").isNotNull() & (F.size("retrieved_doc_ids") != docs),
            "retrieved_doc_ids length must match retrieved_docs length",
        )
        .when(
            F.col("retrieved_embeddings").isNotNull() & (F.size("retrieved_embeddings") != docs),
            "retrieved_embeddings length must match retrieved_docs length",
        )
    )


def run_validate(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, quarantined)`` runs; the latter carry ``reject_reason``."""
    marked = runs.withColumn("reject_reason", run_reject_reason())
    return marked.filter(F.col("reject_reason").isNull()).drop("reject_reason"), marked.filter(
        F.col("reject_reason").isNotNull()
    )


def _truthy_number(text: Column) -> Column:
    """Number in a metadata value; missing, zero and non-numeric values become null."""
    number = text.try_cast("double")
    return F.when(number != 0, number)


def run_to_frame(scores: Column | None = None) -> Column:
    """Telemetry frame of a run; scores and token usage go to the open field map."""
    name = F.regexp_replace(F.lower(F.coalesce(F.col("system_info")["name"], F.lit(""))), "rag$", "")
    kind = F.lit("custom")
    for key, value in KINDS.items():
        kind = F.when(name == key, F.lit(value)).otherwise(kind)
    meta = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    usage = F.create_map(F.lit("token_usage"), F.coalesce(meta["token_usage"], F.lit("{}")))
    extra = usage if scores is None else F.map_concat(F.map_filter(
        scores.cast("map<string,string>"), lambda k, _: k != "token_usage"), usage)
    return F.struct(
        F.col("run_id").alias("trace_id"),
        F.timestamp_micros((F.col("timestamp") * 1e6).cast("long")).alias("timestamp"),
        F.struct(F.col("query").alias("text"), F.col("query_embedding").alias("embedding")).alias("query"),
        F.struct(
            F.col("retrieved_docs").alias("text_chunks"), F.col("retrieved_embeddings").alias("dense_embeddings")
        ).alias("context"),
        F.struct(
            kind.alias("rag_type"),
            F.from_json(meta["agent_hops"], "array<string>").alias("agent_hops"),
            F.coalesce(_truthy_number(meta["reflection_iterations"]), F.lit(0)).cast("int").alias("reflection_iterations"),
            meta["latency_ms"].try_cast("double").alias("latency_ms"),
            extra.alias("extra"),
        ).alias("metadata"),
        F.struct(
            F.coalesce("answer", F.lit("")).alias("generated_answer"),
            F.col("answer_embedding").alias("response_embedding"),
            _truthy_number(meta["final_confidence"]).alias("confidence_score"),
        ).alias("output"),
    )


def _or(value: Column, default: str) -> Column:
    """The text, or the default when missing or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def response_to_run(responses: DataFrame, run_id: Column, timestamp: Column) -> DataFrame:
    """Legacy responses as runs; iterations and confidence move into the metadata."""
    meta = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    own = F.create_map(
        F.lit("reflection_iterations"), F.col("reflection_iterations").cast("string"),
        F.lit("final_confidence"), F.col("final_confidence").cast("string"),
    )
    kept = F.map_filter(meta, lambda k, _: ~k.isin("reflection_iterations", "final_confidence"))
    info = F.struct(
        _or(meta["pipeline_name"], "").alias("name"), _or(meta["model"], "").alias("model"),
        _or(meta["embedding_model"], "default").alias("embedding_model"),
        _or(meta["retriever"], "default").alias("retriever"), _or(meta["version"], "0.0.0").alias("version"),
    )
    return responses.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), run_id.alias("run_id"), "query",
        F.col("retrieved_contexts").alias("retrieved_docs"),
        F.lit(None).cast("array<string>").alias("retrieved_doc_ids"),
        F.lit(None).cast("array<array<double>>").alias("retrieved_embeddings"),
        F.when(F.size("query_embedding") > 0, F.col("query_embedding")).alias("query_embedding"),
        F.col("generated_answer").alias("answer"), F.lit(None).cast("array<double>").alias("answer_embedding"),
        F.when(F.map_contains_key(meta, "pipeline_name"), info).alias("system_info"),
        F.map_concat(kept, own).alias("metadata"), timestamp.alias("timestamp"),
        F.lit(None).cast("string").alias("system_version"),
    )


def run_to_response(runs: DataFrame) -> DataFrame:
    """Runs as legacy responses; run-only fields are folded into the metadata."""
    meta = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    folded = F.map_filter(
        F.create_map(
            F.lit("run_id"), F.col("run_id"), F.lit("schema_version"), F.col("schema_version"),
            F.lit("timestamp"), F.col("timestamp").cast("string"), F.lit("system_info"), F.to_json("system_info"),
        ),
        lambda _, v: v.isNotNull(),
    )
    taken = ["reflection_iterations", "final_confidence"]
    kept = F.map_filter(meta, lambda k, _: ~k.isin(taken) & ~F.array_contains(F.map_keys(folded), k))
    return runs.select(
        "query", F.col("retrieved_docs").alias("retrieved_contexts"),
        F.coalesce("answer", F.lit("")).alias("generated_answer"),
        F.coalesce("query_embedding", F.array().cast("array<double>")).alias("query_embedding"),
        F.coalesce(meta["reflection_iterations"].try_cast("int"), F.lit(0)).alias("reflection_iterations"),
        F.coalesce(meta["final_confidence"].try_cast("double"), F.lit(0.0)).alias("final_confidence"),
        F.map_concat(kept, folded).alias("metadata"),
    )
