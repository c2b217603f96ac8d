"""Rates, latency histograms, gauges and counters over telemetry rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meander.functions.ordering import GROUP_LIMIT, running_sums

# fixed values: upper bucket edges in seconds
EVALUATION_EDGES = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0]
WRITE_EDGES = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def latency_histogram(rows: DataFrame, by: list[str], seconds: str, edges: list[float] = EVALUATION_EDGES) -> DataFrame:
    """Cumulative counts per upper edge: ``by, le, n``; the last edge is infinity."""
    aggs = [F.count_if(F.col(seconds) <= F.lit(float(e))).alias(f"b{i}") for i, e in enumerate(edges)]
    counts = rows.groupBy(*by).agg(*aggs, F.count(seconds).alias("all"))
    pairs = [F.struct(F.lit(float(e)).alias("le"), F.col(f"b{i}").alias("n")) for i, e in enumerate(edges)]
    pairs.append(F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("n")))
    return counts.select(*by, F.inline(F.array(*pairs)))


def histogram_quantile(hist: DataFrame, by: list[str], probs: list[float]) -> DataFrame:
    """Quantiles by linear interpolation inside the bucket: ``by, prob, value``.

    The first bucket starts at 0; a quantile in the infinite bucket is the
    largest finite edge.
    """
    w = Window.partitionBy(*by).orderBy("le")  # one row per bucket
    b = hist.withColumns(
        {
            "_lo": F.coalesce(F.lag("le").over(w), F.lit(0.0)),
            "_below": F.coalesce(F.lag("n").over(w), F.lit(0).cast("long")),
            "_total": F.max("n").over(Window.partitionBy(*by)),
        }
    ).withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    rank = F.col("prob") * F.col("_total")
    hit = (F.col("n") >= rank) & ((F.col("_below") < rank) | (F.col("_lo") == 0.0))
    inside = F.col("_lo") + (F.col("le") - F.col("_lo")) * (rank - F.col("_below")) / (F.col("n") - F.col("_below"))
    value = F.when(F.col("le") == float("inf"), F.col("_lo")).otherwise(inside)
    first = F.min_by(value, F.col("le"))
    return b.filter(hit & (F.col("_total") > 0)).groupBy(*by, "prob").agg(first.alias("value"))


def rate(
    rows: DataFrame, by: list[str], ts: str = "ts", seq: str = "seq", seconds: float = 300.0,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Rows per second over the trailing window, at every row.

    Each row enters the ordered stream of its key and leaves it again when the
    window has passed; the running balance is the count in the window.
    """
    enter = rows.select(*by, F.col(ts).alias("_t"), F.lit(0).alias("_x"), F.col(seq).alias("_s"))
    leave = rows.select(*by, (F.col(ts) + F.lit(float(seconds))).alias("_t"), F.lit(1).alias("_x"), F.col(seq).alias("_s"))
    cum = running_sums(
        enter.unionByName(leave), by, ["_t", "_x", "_s"],
        {"_open": F.when(F.col("_x") == 0, 1).otherwise(-1).cast("long")}, group_limit,
    )
    now = cum.filter("_x = 0").select(*by, F.col("_s").alias(seq), (F.col("_open") / F.lit(float(seconds))).alias("rate"))
    return rows.join(now, [*by, seq])


def score_gauge_latest(scores: DataFrame, by: list[str], kind: str = "metric_name", order: list[str] = ["ts", "seq"], value: str = "value") -> DataFrame:
    """Latest value per metric kind, beside the mean of the latest values."""
    latest = scores.groupBy(*by, kind).agg(F.max_by(value, F.struct(*order)).alias("latest"))
    mean = latest.groupBy(*by).agg(F.avg("latest").alias("mean_latest"))
    return latest.join(mean, by)


def outcome_counters(counters: dict[str, tuple[DataFrame, list[Column], Column]]) -> DataFrame:
    """Named counters over result tables: ``counter, labels, value``."""
    parts = [
        df.groupBy(F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("none")) for c in labels]).alias("labels"))
        .agg(F.sum(amount).cast("double").alias("value"))
        .select(F.lit(name).alias("counter"), "labels", "value")
        for name, (df, labels, amount) in counters.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def benchmark_summary(runs: DataFrame, by: list[str]) -> DataFrame:
    """Mean quality, latency and tokens per system."""
    return runs.groupBy(*by).agg(
        F.round(F.avg("precision"), 3).alias("avg_precision"),
        F.round(F.avg("faithfulness"), 3).alias("avg_faithfulness"),
        F.round(F.avg("latency_s"), 2).alias("avg_latency_s"),
        F.round(F.avg("tokens"), 0).alias("avg_tokens"),
    )
