"""The registered calibration query runs the operator's own numbers of replicates, and ends."""

import __spark_entry__ as spec


def test_replicates_are_not_cut(spark):
    rows = spec.queries()["bootstrap_thresholds"](spark, "/root/testdata/sf0.001").collect()
    sizes = {r.track: r["count"] for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where(
        "vec_id % 2 = 0").selectExpr("if(label < 5, 'retrieval', 'generation') AS track").groupBy("track").count().collect()}
    want = {(t, m): n for t, size in sizes.items() for m, n in (
        ("js_divergence", 1000), ("mmd_score", 100), ("per_component_kl", 10 * min(1000, size // 2)))}
    assert {(r.track, r.metric): r.replicates for r in rows} == want
    assert all(0 < r.threshold < 5 for r in rows)
