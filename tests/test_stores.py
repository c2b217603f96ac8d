"""Stored tables: reads of a period skip the folders outside it, and contents are stored once."""

import datetime as dt

from pyspark.sql import functions as F

from meander.functions.runtime import scratch_path
from meander.operators import store
from meander.schemas import HISTORY
from meander.sources import evaluations as ev
from meander.sources import history as hs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_evaluation_window_reads_its_days(spark):
    path = scratch_path(spark, "evaluations")
    rows = [(f"i{d}", f"t{d}", "naive", dt.datetime(2024, 3, 1 + d, 6), 0.1, 0.2, None, False, "{}") for d in range(20)]
    types = ["string"] * 3 + ["timestamp_ntz"] + ["double"] * 3 + ["boolean", "string"]
    schema = ", ".join(f"{c} {t}" for c, t in zip(ev.COLUMNS, types, strict=True))
    ev.evaluations_append(spark.createDataFrame(rows, schema), path)
    recent = store.recent_history(ev.read_evaluations(spark, path), F.to_timestamp_ntz(F.lit("2024-03-20 12:00:00")), 48)
    assert {r.id for r in recent.collect()} == {"i18", "i19"}
    assert "PartitionFilters: [isnotnull(date" in plan(recent) and ">= 2024-03-18" in plan(recent)


def test_history_period_and_lookups(spark):
    path = scratch_path(spark, "history")
    day = 86400.0
    metric = "named_struct('_type', 'DriftResult', 'metric_name', if(id % 4 = 0, 'rare', 'common'), 'value', 1.0D)"
    rows = spark.range(200).selectExpr(
        "concat('rec', id) AS record_id", "concat('r', id % 10) AS run_id", "CAST(id AS DOUBLE) * 86400.0D AS timestamp",
        f"to_json(named_struct('metrics', array({metric}))) AS m",
    )
    rows = rows.withColumn("metrics", F.from_json("m", HISTORY)["metrics"]).drop("m")
    hs.history_append(rows, path)
    assert hs.history_by_run(spark, path, "r3").count() == 20
    assert hs.history_by_metric(spark, path, "rare").count() == 50
    part = hs.history_scan(spark, path, since=60 * day, until=70 * day)
    assert {r.record_id for r in part.collect()} == {f"rec{i}" for i in range(60, 71)}
    assert "PartitionFilters: [" in plan(part) and "PartitionFilters: []" not in plan(part)
    assert hs.history_by_run(spark, path, "r3", since=100 * day).count() == 10


def test_chunks_are_stored_once(spark):
    path = scratch_path(spark, "chunks")
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, content string")
    ev.chunk_upsert(spark, first, None).write.parquet(path)
    more = spark.createDataFrame([(4, "b"), (6, "c"), (5, "c"), (7, "")], "id long, content string")
    ev.chunk_upsert(spark, more, path).write.mode("append").parquet(path)
    assert sorted((r.id, r.content) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "b"), (5, "c"), (7, "")]
