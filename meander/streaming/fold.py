"""Streams that carry a small table from one micro-batch to the next.

State is an ordinary table, one folder per batch id.  A batch reads the folder of
the batch before it and writes its own with overwrite, so a repeated batch gives
the same result, and the update is a normal DataFrame query that spreads over the
cluster however few keys there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

Update = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def _folder(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id}"


def _exists(spark, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def fold_stream(
    stream: DataFrame, update: Update, state_schema: str, path: str, trigger: dict | None = None
) -> StreamingQuery:
    """Run ``update(state, batch) -> (new_state, output)`` for every micro-batch.

    Below ``path``: ``state``, ``output`` (partitioned by batch) and ``checkpoint``.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _folder(f"{path}/state", batch_id - 1)
        if batch_id:
            if not _exists(spark, before):
                raise FileNotFoundError(f"state of batch {batch_id - 1} is gone: {before}")
            state = spark.read.schema(state_schema).parquet(before)
        else:
            state = spark.createDataFrame([], state_schema)
        batch = batch.persist()  # read by both writes
        new_state, output = update(state, batch)
        output.write.mode("overwrite").parquet(_folder(f"{path}/output", batch_id))
        new_state.write.mode("overwrite").parquet(_folder(f"{path}/state", batch_id))
        batch.unpersist()

    return (
        stream.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .start()
    )


def read_output(spark, path: str, schema: str) -> DataFrame:
    """All output rows so far."""
    return spark.read.schema(f"{schema}, batch int").parquet(f"{path}/output")


def latest_state(spark, path: str, schema: str) -> DataFrame:
    """The state after the last finished batch."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/state")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [
        int(s.getPath().getName().split("=")[1])
        for s in fs.listStatus(folder)
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
    ]
    return spark.read.schema(schema).parquet(_folder(f"{path}/state", max(done)))
