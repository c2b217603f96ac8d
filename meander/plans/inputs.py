"""How the given tables stand in for the monitored system's records.

Each function reads whole tables; ``*_SQL`` is the same mapping as a SQL text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meander.functions.columns import epoch_seconds, to_doubles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- metric points: one series per event type ------------------------------

POINTS_SQL = """points AS (
  SELECT event_type AS metric_name, epoch(ts) AS ts, event_id AS seq,
         value / 97.0::DOUBLE AS value, CAST(event_id AS VARCHAR) AS run_id, user_id
  FROM events)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("metric_name"),
        epoch_seconds("ts").alias("ts"),
        F.col("event_id").alias("seq"),
        (F.col("value") / F.lit(97.0)).alias("value"),
        F.col("event_id").cast("string").alias("run_id"),
        "user_id",
    )


# 2024-01-16T00:00:00Z, the middle of the event table's month
SPLIT_TS = 1705363200.0

SIDES_SQL = POINTS_SQL + """, sides AS (
  SELECT metric_name, ts >= 1705363200.0::DOUBLE AS is_current, value AS x, seq FROM points)"""


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar samples of the first and second half of the month, per event type."""
    return points(spark, sf_dir).select(
        "metric_name",
        (F.col("ts") >= F.lit(SPLIT_TS)).alias("is_current"),
        F.col("value").alias("x"),
        "seq",
    )


# --- embeddings: two tracks by label, odd ids are the current window ---------


def tracked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.when(F.col("label") < 5, "retrieval").otherwise("generation").alias("track"),
        "vec_id",
        (F.col("vec_id") % 2 == 1).alias("is_current"),
        to_doubles("embedding").alias("embedding"),
    )


# --- evaluation rows: one per event, payload built from the event ------------

FRAME_NOW = "2024-01-31 00:00:00"

EVALS_SQL = """ev AS (
  SELECT event_id AS id, 't' || event_id AS trace_id,
         CASE event_type WHEN 'click' THEN 'naive' WHEN 'view' THEN 'agentic' WHEN 'purchase' THEN 'graph_rag'
              WHEN 'signup' THEN 'swarm' ELSE 'custom' END AS rag_type,
         ts AS timestamp, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CASE WHEN user_id % 10 <> 3 THEN value / 100.0::DOUBLE END AS js_divergence,
         value / 200.0::DOUBLE AS mmd_score, value > 50.0::DOUBLE AS is_drifted
  FROM events),
evals AS (
  SELECT id, trace_id, rag_type, timestamp, js_divergence, mmd_score, is_drifted, user_id,
    CASE WHEN rag_type = 'custom' AND user_id % 5 = 0 THEN 'not json {'
         WHEN rag_type = 'custom' THEN '{"mmd_p_value":' || CAST(k AS VARCHAR) || '.5,"max_component_kl":' || CAST(user_id AS VARCHAR)
              || '.25,"sample_size":' || CAST(k AS VARCHAR) || '}'
         ELSE '{"trace_id":"' || trace_id || '","query":{"text":"q' || CAST(user_id AS VARCHAR) || '"},"context":{"text_chunks":["c1","c2"]'
              || CASE WHEN rag_type = 'graph_rag' THEN ',"graph_topology":{"nodes":[{"id":"n' || CAST(k AS VARCHAR) || '"}],"edges":[]}' ELSE '' END
              || '},"metadata":{"rag_type":"' || rag_type || '"'
              || CASE WHEN rag_type IN ('swarm', 'agentic') THEN ',"agent_hops":["planner","a' || CAST(k AS VARCHAR) || '"]' ELSE '' END
              || ',"reflection_iterations":' || CAST(k AS VARCHAR) || '},"output":{"generated_answer":"a"'
              || CASE WHEN user_id % 3 = 0 THEN ',"confidence_score":0.' || CAST(k AS VARCHAR) ELSE '' END || '}}'
    END AS telemetry_frame
  FROM ev)"""


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(
        *[F.lit(v) for v in ("click", "naive", "view", "agentic", "purchase", "graph_rag", "signup", "swarm", "error", "custom")]
    )
    ev = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("t"), F.col("event_id")).alias("trace_id"),
        kinds[F.col("event_type")].alias("rag_type"),
        F.col("ts").alias("timestamp"),
        "user_id",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.when(F.col("user_id") % 10 != 3, F.col("value") / 100.0).alias("js_divergence"),
        (F.col("value") / 200.0).alias("mmd_score"),
        (F.col("value") > 50.0).alias("is_drifted"),
    )
    k, user, kind = F.col("k"), F.col("user_id"), F.col("rag_type")
    drift = F.concat(
        F.lit('{"mmd_p_value":'), k, F.lit('.5,"max_component_kl":'), user, F.lit('.25,"sample_size":'), k, F.lit("}")
    )
    graph = F.concat(F.lit(',"graph_topology":{"nodes":[{"id":"n'), k, F.lit('"}],"edges":[]}'))
    hops = F.concat(F.lit(',"agent_hops":["planner","a'), k, F.lit('"]'))
    frame = F.concat(
        F.lit('{"trace_id":"'), F.col("trace_id"), F.lit('","query":{"text":"q'), user,
        F.lit('"},"context":{"text_chunks":["c1","c2"]'),
        F.when(kind == "graph_rag", graph).otherwise(""),
        F.lit('},"metadata":{"rag_type":"'), kind, F.lit('"'),
        F.when(kind.isin("swarm", "agentic"), hops).otherwise(""),
        F.lit(',"reflection_iterations":'), k, F.lit('},"output":{"generated_answer":"a"'),
        F.when(user % 3 == 0, F.concat(F.lit(',"confidence_score":0.'), k)).otherwise(""),
        F.lit("}}"),
    )
    payload = (
        F.when((kind == "custom") & (user % 5 == 0), F.lit("not json {")).when(kind == "custom", drift).otherwise(frame)
    )
    return ev.withColumn("telemetry_frame", payload).drop("k")


# --- history records: one per order, one system per customer ------------------

HISTORY_SQL = """hist AS (
  SELECT o_custkey AS system, 'rec' || o_orderkey AS record_id, 'r' || o_orderkey AS run_id,
         epoch(o_orderdate) AS timestamp, o_orderkey AS seq, o_orderstatus AS system_version,
         o_orderpriority AS pipeline_name,
         'm' || (o_orderkey % 3) AS model, CASE WHEN o_orderkey % 7 <> 0 THEN 'm' || (o_orderkey % 3) END AS info_model,
         CAST(CAST(floor(o_totalprice / 100000.0::DOUBLE) AS INTEGER) AS VARCHAR) AS tier,
         o_totalprice / 499979.0::DOUBLE AS js_value, (o_orderkey % 100) / 100.0::DOUBLE AS quality
  FROM orders)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in the history schema plus ``system`` (the stream) and ``seq``."""
    key = F.col("o_orderkey")
    run = F.concat(F.lit("r"), key)
    none = F.lit(None).cast("string")
    no_meta = F.create_map().cast("map<string,string>")
    price = (F.col("o_totalprice") / 499979.0).alias("value")

    def metric(kind, name, value, run_id=none, base=none, cur=none):
        return F.struct(
            F.lit(kind).alias("_type"), F.lit(name).alias("metric_name"), value.alias("value"),
            no_meta.alias("metadata"), run_id.alias("run_id"),
            base.alias("baseline_run_id"), cur.alias("current_run_id"),
        )

    info = F.when(key % 7 != 0, F.to_json(F.struct(F.concat(F.lit("m"), key % 3).alias("model"))))
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("system"),
        F.concat(F.lit("rec"), key).alias("record_id"),
        run.alias("run_id"),
        epoch_seconds("o_orderdate").alias("timestamp"),
        key.alias("seq"),
        F.col("o_orderstatus").alias("system_version"),
        F.array(
            metric("DriftResult", "js_divergence", price, base=F.lit("r0"), cur=F.when(key % 2 == 0, run)),
            metric("QualityResult", "faithfulness", (key % 100) / 100.0, run_id=F.when(key % 3 == 0, F.concat(run, F.lit("q")))),
        ).alias("metrics"),
        F.map_filter(
            F.create_map(
                F.lit("pipeline_name"), F.col("o_orderpriority"),
                F.lit("system_info"), info,
                F.lit("tier"), F.floor(F.col("o_totalprice") / 100000.0).cast("int").cast("string"),
            ),
            lambda _, v: v.isNotNull(),
        ).alias("metadata"),
    )


# --- runs: one per document, vectors where the embedding table has the id -----

RUNS_SQL = """dl AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, string_split(d.text, chr(10)) AS lines,
         l.quality, l.toxic, e.label, CAST(e.embedding AS DOUBLE[]) AS embedding
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
runs AS (
  SELECT doc_id, 'r' || doc_id AS run_id, lines[1] AS query, lines[2:] AS docs, len(lines) - 1 AS n_docs,
         CASE WHEN quality = 0 THEN 1 WHEN quality = 1 THEN len(lines) - 1 END AS n_ids,
         CASE WHEN label < 5 THEN 1 END AS n_embs, label, embedding, quality, toxic, lang, source, n_chars,
         1700000000.0::DOUBLE + doc_id * 60.5::DOUBLE AS timestamp,
         CASE lang WHEN 'en' THEN 'NaiveRAG' WHEN 'de' THEN 'agenticrag' WHEN 'fr' THEN 'GraphRAG' ELSE 'Other' END AS name
  FROM dl)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), "label", to_doubles("embedding").alias("_v")
    )
    rows = docs.join(labels, "doc_id", "left").join(vectors, "doc_id", "left")
    lines = F.split("text", "\n")
    rest = F.slice(lines, F.lit(2), F.size(lines))
    number = lambda c: F.col(c).cast("string")
    name = F.when(F.col("lang") == "en", "NaiveRAG").when(F.col("lang") == "de", "agenticrag").when(
        F.col("lang") == "fr", "GraphRAG"
    ).otherwise("Other")
    null_vec = F.lit(None).cast("array<double>")
    return rows.select(
        "doc_id", F.lit("1.0").alias("schema_version"), F.concat(F.lit("r"), "doc_id").alias("run_id"),
        lines[0].alias("query"), rest.alias("retrieved_docs"),
        F.when(F.col("quality") == 0, F.array(F.lit("x"))).when(
            F.col("quality") == 1, F.transform(rest, lambda _, i: i.cast("string"))
        ).alias("retrieved_doc_ids"),
        F.when(F.col("label") < 5, F.array("_v")).alias("retrieved_embeddings"),
        F.when(F.col("label") >= 8, F.col("_v")).alias("query_embedding"),
        F.col("text").alias("answer"),
        F.when(F.col("label").between(5, 7), F.col("_v")).otherwise(null_vec).alias("answer_embedding"),
        F.struct(
            name.alias("name"), F.lit("m1").alias("model"), F.lit(None).cast("string").alias("embedding_model"),
            F.lit(None).cast("string").alias("retriever"), F.lit(None).cast("string").alias("version"),
        ).alias("system_info"),
        F.map_filter(
            F.create_map(
                F.lit("reflection_iterations"), number("toxic"), F.lit("final_confidence"), number("quality"),
                F.lit("latency_ms"), number("n_chars"),
            ),
            lambda _, v: v.isNotNull(),
        ).alias("metadata"),
        (F.lit(1700000000.0) + F.col("doc_id") * F.lit(60.5)).alias("timestamp"),
        F.col("source").alias("system_version"),
        "lang", "label", "n_chars",
    )
