"""Metric time series: extraction, rolling statistics, mean-shift events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meander.functions.columns import clip, stable_id
from meander.functions.ordering import GROUP_LIMIT, drop_halo, framed, known, numbered


def resolve_run_id(metric: str = "metric", record_run_id: str = "run_id"):
    """The metric's own run, else its current run, else the record's, else ''."""
    return F.coalesce(
        F.col(f"{metric}.run_id"), F.col(f"{metric}.current_run_id"), F.col(record_run_id), F.lit("")
    )


def metric_series(history: DataFrame, metric_name: str | None = None, by: list[str] = []) -> DataFrame:
    """One row per stored metric: ``by, metric_name, ts, seq, pos, value, run_id``.

    ``(ts, seq, pos)`` is the series order; records without a timestamp sort at 0.
    """
    flat = history.select(
        *by, "timestamp", "seq", "run_id", F.posexplode("metrics").alias("pos", "metric")
    )
    if metric_name is not None:
        flat = flat.filter(F.col("metric.metric_name") == metric_name)
    return flat.select(
        *by,
        F.col("metric.metric_name").alias("metric_name"),
        F.coalesce("timestamp", F.lit(0.0)).alias("ts"),
        "seq",
        "pos",
        F.col("metric.value").cast("double").alias("value"),
        resolve_run_id().alias("run_id"),
    )


def mean_shift_events(
    series: DataFrame,
    by: list[str],
    order: list[str] = ["ts", "seq"],
    window: int = 3,
    threshold: float = 0.15,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Events where the mean of a block of ``window`` points leaves the previous block's.

    Blocks are plain groups of ``window`` rows.  While every series fits one task
    the numbering, the blocks and their comparison share a single shuffle; beyond
    that all three work on slices of a series.
    """
    limit = known(series, by, group_limit)
    rows = numbered(series, by, order, "_n", limit)
    rows = rows.withColumn("block", F.floor((F.col("_n") - 1) / window))
    blocks = (
        rows.groupBy(*by, "block")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.avg("value").alias("mean_current"),
            F.min("ts").alias("start_ts"),
            F.max("ts").alias("end_ts"),
            F.collect_list(F.struct("_n", "run_id")).alias("_runs"),  # ``window`` entries
        )
        .filter(F.col("_rows") == window)
    )
    blocks, w = framed(blocks, by, ["block"], 1, limit)
    blocks = drop_halo(blocks.withColumn("mean_previous", F.lag("mean_current").over(w)))
    magnitude = F.abs(F.col("mean_current") - F.col("mean_previous"))
    return blocks.filter(magnitude > F.lit(float(threshold))).select(
        *by,
        stable_id(*[F.col(b) for b in by], F.col("block")).alias("event_id"),
        "block",
        "start_ts",
        "end_ts",
        magnitude.alias("magnitude"),
        "mean_previous",
        "mean_current",
        F.transform(F.array_sort("_runs"), lambda r: r["run_id"]).alias("involved_run_ids"),
    )


def trend(
    scores: DataFrame,
    by: list[str],
    order: list[str] = ["ts", "seq"],
    value: str = "score",
    window: int = 30,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Rolling mean and sample deviation; null until ``window`` non-null values."""
    rows, w = framed(scores, by, order, window - 1, group_limit)
    last = w.rowsBetween(-(window - 1), 0)
    full = F.count(value).over(last) == window
    out = rows.withColumns(
        {
            "rolling_mean": F.when(full, F.avg(value).over(last)),
            "rolling_std": F.when(full, F.stddev_samp(value).over(last)),
        }
    )
    return drop_halo(out)


def with_anomaly(trended: DataFrame, value: str = "score", std_multiplier: float = 2.0) -> DataFrame:
    """Flag each row above ``mean + k * std`` of its own window."""
    usable = F.col("rolling_std").isNotNull() & (F.col("rolling_std") != 0)
    limit = F.col("rolling_mean") + F.lit(float(std_multiplier)) * F.col("rolling_std")
    return trended.withColumn("is_anomaly", F.coalesce(usable & (F.col(value) > limit), F.lit(False)))


def anomaly_latest(
    scores: DataFrame,
    by: list[str],
    order: list[str] = ["ts", "seq"],
    value: str = "score",
    window: int = 30,
    std_multiplier: float = 2.0,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """The anomaly flag of the newest row of every series."""
    flagged = with_anomaly(trend(scores, by, order, value, window, group_limit), value, std_multiplier)
    newest = F.struct(*order)
    picked = F.max_by(F.struct(*order, value, "rolling_mean", "rolling_std", "is_anomaly"), newest)
    return flagged.groupBy(*by).agg(picked.alias("p")).select(*by, "p.*")


def adaptive_threshold(
    scores: DataFrame,
    by: list[str],
    order: list[str] = ["ts", "seq"],
    value: str = "score",
    base: float = 0.15,
    z: float = 2.0,
    window: int = 30,
    lo: float = 0.05,
    hi: float = 0.50,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Threshold ``mean + z * std`` of the last ``window`` scores, this one included."""
    rows, w = framed(scores, by, order, window - 1, group_limit)
    last = w.rowsBetween(-(window - 1), 0)
    raw = F.avg(value).over(last) + F.lit(float(z)) * F.stddev_samp(value).over(last)
    out = rows.withColumn(
        "threshold", F.when(F.count(value).over(last) < 2, F.lit(float(base))).otherwise(clip(raw, lo, hi))
    )
    out = out.withColumn("drift_detected", F.col(value) > F.col("threshold"))
    return drop_halo(out)
