"""Shared pieces of the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meander.functions.runtime import scratch_path

#: A word: a run of anything but the ASCII white space characters (fixed value).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: evaluated once, no lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def few_rows(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """Actions inside it scan and hand to Python at most ``rows`` rows at a time; the session's settings come back after.

    By default 4,096 and 10,000 rows of whole texts are held at once by each task.
    """
    names = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch")
    own = {name: spark.conf.get(name, None) for name in names}
    try:
        for name in names:
            held = int(spark.conf.get(name))
            spark.conf.set(name, min(rows, held) if held > 0 else rows)
        yield
    finally:
        for name, value in own.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def id_hash(doc_id: str | Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most ``rows`` rows, so that Python objects of few texts are alive at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def pieces(raw: bytes, separator: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """``raw`` in pieces of about ``size`` bytes, cut only in front of a ``separator``, so that no word is cut."""
    at, cut = 0, re.compile(separator)
    while at < len(raw):
        found = cut.search(raw, at + size) if at + size < len(raw) else None
        end = found.start() if found else len(raw)
        yield raw[at:end]
        at = end
