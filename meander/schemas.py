"""Explicit schemas of the records the engine reads and writes."""

from __future__ import annotations

METRIC = (
    "struct<_type:string,metric_name:string,value:double,metadata:map<string,string>,"
    "run_id:string,baseline_run_id:string,current_run_id:string>"
)

HISTORY = (
    "record_id string, run_id string, timestamp double, system_version string, "
    f"metrics array<{METRIC}>, metadata map<string,string>"
)

GRAPH = (
    "struct<nodes:array<struct<id:string>>,"
    "edges:array<struct<source:string,target:string,`from`:string,`to`:string>>>"
)

FRAME = (
    "trace_id string, timestamp string, "
    "query struct<text:string,embedding:array<double>>, "
    "context struct<text_chunks:array<string>,dense_embeddings:array<array<double>>,"
    f"graph_topology:{GRAPH}>, "
    "metadata struct<rag_type:string,agent_hops:array<string>,reflection_iterations:int,"
    "latency_ms:double,extra:map<string,string>>, "
    "output struct<generated_answer:string,response_embedding:array<double>,confidence_score:double>"
)

DRIFT_PAYLOAD = "mmd_p_value double, max_component_kl double, sample_size long"

VECTOR_LINE = "vector array<double>, track string"

# fixed value: the kinds of system a frame can come from
RAG_TYPES = ["naive", "agentic", "graph_rag", "swarm", "custom"]
