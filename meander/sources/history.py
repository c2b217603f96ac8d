"""Evaluation history stored as JSON lines, partitioned by month, with a commit log.

A folder of lines without a log is read as it is; the first append takes it over.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meander.schemas import HISTORY
from meander.sources import commits

_BAD = "_bad"


def _month(timestamp: Column) -> Column:
    return F.date_format(F.timestamp_seconds(timestamp), "yyyy-MM")


def _stored_lines(spark: SparkSession, path: str) -> DataFrame:
    batches = commits.live_batches(spark, path)
    if batches is None:
        return spark.read.text(path)
    if not batches:
        return spark.createDataFrame([], "value string, month string")
    return spark.read.option("basePath", path).text(batches)


def _parsed_lines(spark: SparkSession, path: str, since: float | None = None, until: float | None = None) -> DataFrame:
    """Each non-blank line with its record; ``rec._bad`` holds the text of malformed ones.

    Month folders that lie outside ``since`` to ``until`` are not read.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    lines = _stored_lines(spark, path)
    if "month" in lines.columns:
        month = F.substring(F.col("month").cast("string"), 1, 7)
        if since is not None:
            lines = lines.filter(month >= _month(F.lit(float(since))))
        if until is not None:
            lines = lines.filter(month <= _month(F.lit(float(until))))
    lines = lines.filter(F.trim("value") != "")
    return lines.select("value", F.from_json("value", f"{HISTORY}, seq long, {_BAD} string", options).alias("rec"))


def history_scan(
    spark: SparkSession, path: str, since: float | None = None, until: float | None = None
) -> DataFrame:
    """Well-formed records; blank and malformed lines are left out.

    ``since`` and ``until`` (epoch seconds, both inclusive) keep records by their timestamp.
    """
    good = _parsed_lines(spark, path, since, until).filter(F.col("rec").isNotNull() & F.col(f"rec.{_BAD}").isNull())
    rows = good.select("rec.*").drop(_BAD)
    if since is not None:
        rows = rows.filter(F.col("timestamp") >= F.lit(float(since)))
    if until is not None:
        rows = rows.filter(F.col("timestamp") <= F.lit(float(until)))
    return rows


def history_by_run(spark: SparkSession, path: str, run_id: str, **period) -> DataFrame:
    """The stored records of one run."""
    return history_scan(spark, path, **period).filter(F.col("run_id") == run_id)


def history_by_metric(spark: SparkSession, path: str, metric_name: str, **period) -> DataFrame:
    """The stored records that hold the metric."""
    return history_scan(spark, path, **period).filter(
        F.exists("metrics", lambda m: m["metric_name"] == metric_name)
    )


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """The malformed lines, for counting or repair."""
    bad = F.col("rec").isNull() | F.col(f"rec.{_BAD}").isNotNull()
    return _parsed_lines(spark, path).filter(bad).select(F.col("value").alias("line"))


def records_ingest_json(spark: SparkSession, path: str) -> DataFrame:
    """Files that each hold one record or an array of records."""
    reader = spark.read.schema(f"{HISTORY}, seq long, {_BAD} string").option("multiLine", True)
    rows = reader.option("columnNameOfCorruptRecord", _BAD).json(path)
    return rows.filter(F.col(_BAD).isNull()).drop(_BAD)


def history_append(records: DataFrame, path: str, next_seq: int | None = None) -> None:
    """Append records; ``seq`` keeps the append order within equal timestamps.

    Numbers go on from the log, or from ``next_seq`` if that is higher.  They grow with input order
    and need no shuffle; the highest one is read from the new batch alone.  Readers see all of an
    append or, until its commit stands in the log, nothing of it.
    """
    spark = records.sparkSession
    logged = commits.next_number(spark, path)
    if logged is None:
        logged = _take_over(spark, path)
    start = max(logged, next_seq or 0)
    numbered = records.withColumn("seq", F.lit(start) + F.monotonically_increasing_id())
    batch = commits.new_batch()
    month = _month(F.coalesce("timestamp", F.lit(0.0)))
    # rebalance: one set of files per month, large months split again by AQE
    rows = numbered.withColumn("month", month).hint("rebalance", "month")
    rows.write.partitionBy("month").json(f"{path}/batch={batch}")
    last = spark.read.schema("seq long").json(f"{path}/batch={batch}").agg(F.max("seq")).first()[0]
    commits.commit(spark, path, "append", batch, start if last is None else int(last) + 1)


def _take_over(spark: SparkSession, path: str) -> int:
    """Copy lines stored without a log, malformed ones too, into a first batch; returns the next number."""
    try:
        first = _first_free(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    _rewrite(spark, path, first)
    return first


def _rewrite(spark: SparkSession, path: str, next_seq: int) -> None:
    month = _month(F.coalesce("rec.timestamp", F.lit(0.0)))
    lines = _parsed_lines(spark, path).select("value", month.alias("month")).hint("rebalance", "month")
    batch = commits.new_batch()
    lines.write.partitionBy("month").text(f"{path}/batch={batch}")
    commits.commit(spark, path, "replace", batch, next_seq)


def history_compact(spark: SparkSession, path: str) -> None:
    """Rewrite all live batches as one, so that the log's list of folders stays short; readers see the same records."""
    _rewrite(spark, path, next_seq(spark, path))


def history_clear(spark: SparkSession, path: str) -> None:
    """Empty the history by one row in the log; numbers go on."""
    commits.commit(spark, path, "truncate", None, next_seq(spark, path))


def next_seq(spark: SparkSession, path: str) -> int:
    """First free sequence number of a stored history; without a log its lines are read."""
    logged = commits.next_number(spark, path)
    return _first_free(spark, path) if logged is None else logged


def _first_free(spark: SparkSession, path: str) -> int:
    return int(history_scan(spark, path).agg(F.max("seq")).first()[0] or 0) + 1
