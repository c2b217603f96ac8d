"""Configuration changes in evaluation histories and their attribution to drift events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meander.functions.columns import stable_id
from meander.functions.ordering import GROUP_LIMIT, drop_halo, framed, numbered

# fixed values: weight of each change type, and of the three score parts
TYPE_WEIGHTS = {"model_update": 1.0, "version_change": 0.8, "config_change": 0.6, "unknown": 0.3}
WEIGHT_TIME, WEIGHT_TYPE, WEIGHT_MAGNITUDE = 0.4, 0.3, 0.3

FIELD_MAP = "map<string,string>"
RESERVED = ["pipeline_name", "system_info"]


def map_changes(old: Column, new: Column) -> Column:
    """``key -> (old, new)`` for every key of either map whose values differ."""
    pairs = F.map_zip_with(old, new, lambda _, a, b: F.struct(a.alias("old"), b.alias("new")))
    return F.map_filter(pairs, lambda _, v: ~v["old"].eqNullSafe(v["new"]))


def change_events(
    history: DataFrame,
    by: list[str],
    order: list[str] = ["ts", "seq"],
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """At most one change per step between consecutive records of a stream.

    Compares version, pipeline name, system info and the remaining metadata with
    the previous record.  The system info is a JSON object in ``metadata``.
    """
    meta = F.coalesce("metadata", F.create_map().cast(FIELD_MAP))
    flat = history.select(
        *by,
        F.coalesce("timestamp", F.lit(0.0)).alias("ts"),
        "seq",
        F.col("run_id"),
        F.struct(
            F.col("system_version").alias("version"),
            meta["pipeline_name"].alias("pipeline"),
            F.from_json(meta["system_info"], FIELD_MAP).alias("info"),
            F.map_filter(meta, lambda k, _: ~k.isin(RESERVED)).alias("meta"),
        ).alias("sig"),
    )
    rows, w = framed(flat, by, order, 1, group_limit)
    rows = drop_halo(rows.withColumn("prev", F.lag("sig").over(w)))
    p, c = F.col("prev"), F.col("sig")
    empty = F.create_map().cast(FIELD_MAP)
    both_info = p["info"].isNotNull() & c["info"].isNotNull()
    info_diff = map_changes(F.coalesce(p["info"], empty), F.coalesce(c["info"], empty))
    info_changed = F.when(both_info, F.size(info_diff) > 0).otherwise(p["info"].isNotNull() | c["info"].isNotNull())
    rows = rows.filter(p.isNotNull()).withColumns(
        {
            "_version": ~p["version"].eqNullSafe(c["version"]),
            "_pipeline": ~p["pipeline"].eqNullSafe(c["pipeline"]),
            "_info": info_changed,
            "_info_diff": F.when(both_info, info_diff).otherwise(F.map_filter(info_diff, lambda k, v: F.lit(False))),
            "_meta_diff": map_changes(p["meta"], c["meta"]),
        }
    )
    has_meta = F.size("_meta_diff") > 0
    base = F.when(F.col("_version"), F.lit("version_change")).when(F.col("_pipeline"), F.lit("model_update"))
    # a readable system-info difference outranks a version change
    upgraded = F.col("_info") & both_info
    kind = (
        F.when(upgraded, F.lit("model_update"))
        .when(base.isNotNull(), base)
        .when(has_meta, F.lit("config_change"))
        .otherwise(F.lit("unknown"))
    )
    changed = F.col("_version") | F.col("_pipeline") | F.col("_info") | has_meta
    side = lambda flag, field: F.when(
        F.col(flag), F.struct(p[field].alias("old"), c[field].alias("new"))
    )
    return rows.filter(changed).select(
        *by,
        stable_id(*[F.col(b) for b in by], F.col("run_id"), F.col("ts"), kind).alias("change_id"),
        "ts", "seq", "run_id",
        kind.alias("change_type"),
        F.struct(
            side("_version", "version").alias("version"),
            side("_pipeline", "pipeline").alias("pipeline"),
            F.when(F.col("_info"), F.col("_info_diff")).alias("system_info_diff"),
            F.when(has_meta, F.col("_meta_diff")).alias("metadata_diff"),
        ).alias("details"),
    )


def type_weight(change_type: Column) -> Column:
    weight = F.lit(TYPE_WEIGHTS["unknown"])
    for name, value in TYPE_WEIGHTS.items():
        weight = F.when(change_type == name, F.lit(value)).otherwise(weight)
    return weight


def event_change_features(events: DataFrame, changes: DataFrame, by: list[str]) -> DataFrame:
    """Features of every change in the event's own stream: distance to the window and type weight.

    The result is by definition one row per event and change of a stream; the
    join is an equi-join on the stream.  ``max_delta`` is the distance of the event's
    farthest change, which is the first or the last one of the stream.
    """
    ends = changes.groupBy(*by).agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    e = events.select(*by, "event_id", "start_ts", "end_ts", "magnitude").join(ends, by)
    c = changes.select(*by, "change_id", "run_id", "change_type", "ts", "seq")
    joined = e.join(c, by)
    inside = (F.col("ts") >= F.col("start_ts")) & (F.col("ts") <= F.col("end_ts"))
    away = F.least(F.abs(F.col("ts") - F.col("start_ts")), F.abs(F.col("ts") - F.col("end_ts")))
    return joined.select(
        *by, "event_id", "change_id", "run_id", "change_type", "ts", "seq",
        type_weight(F.col("change_type")).alias("type_weight"),
        F.when(inside, F.lit(0.0)).otherwise(away).alias("time_delta"),
        inside.alias("in_window"),
        F.col("magnitude").alias("drift_magnitude"),
        F.greatest(F.col("start_ts") - F.col("_first"), F.col("_last") - F.col("end_ts"), F.lit(0.0)).alias("max_delta"),
    )


def _score(max_delta: Column) -> Column:
    """Weighted score of one feature row, rounded to 4 digits."""
    near = F.when(max_delta > 0, F.lit(1.0) - F.col("time_delta") / max_delta).otherwise(F.lit(1.0))
    near = F.when(F.col("in_window"), near * 0.5 + 0.5).otherwise(near)
    size = F.when(F.col("drift_magnitude") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    raw = F.lit(WEIGHT_TIME) * near + F.lit(WEIGHT_TYPE) * F.col("type_weight") + F.lit(WEIGHT_MAGNITUDE) * size
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4)


def attribution_scores(features: DataFrame, by: list[str]) -> DataFrame:
    """Scored features (all of one event share its magnitude, so that part is 1 or 0)."""
    return features.withColumn("score", _score(F.col("max_delta"))).drop("max_delta")


def rank_factors(scores: DataFrame, by: list[str]) -> DataFrame:
    """Add ``rank`` 1.. per event by score, earliest change first among equals."""
    keyed = scores.withColumn("_low", -F.col("score"))
    return numbered(keyed, [*by, "event_id"], ["_low", "ts", "seq"], "rank").drop("_low")


def top_factors(scores: DataFrame, by: list[str], top: int) -> DataFrame:
    """The ``top`` best ranks only; Spark drops the rest before the shuffle."""
    w = Window.partitionBy(*by, "event_id").orderBy(F.desc("score"), "ts", "seq")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def event_confidence(scores: DataFrame, by: list[str]) -> DataFrame:
    """Dominance of the top factor: its score alone, or its share of all scores."""
    agg = scores.groupBy(*by, "event_id").agg(
        F.count(F.lit(1)).alias("num_factors"), F.max("score").alias("top"), F.sum("score").alias("total")
    )
    conf = F.when(F.col("num_factors") == 1, F.col("top")).when(F.col("total") == 0, F.lit(0.0)).otherwise(
        F.col("top") / F.col("total")
    )
    return agg.select(*by, "event_id", "num_factors", F.round(conf, 4).alias("confidence"))


def attributions(events: DataFrame, confidence: DataFrame, by: list[str]) -> DataFrame:
    """One row per event; an event of a stream without changes has confidence 0."""
    return (
        events.select(*by, "event_id", "metric_name")
        .join(confidence, [*by, "event_id"], "left")
        .na.fill({"num_factors": 0, "confidence": 0.0})
    )


def attribute_drift(events: DataFrame, changes: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(factors, attributions)`` of all events: scored factors, and one row per event."""
    factors = attribution_scores(event_change_features(events, changes, by), by)
    return factors, attributions(events, event_confidence(factors, by), by)
