"""What-if estimates: scenarios that undo changes, and the metric expected without them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meander.functions.columns import stable_id
from meander.functions.ordering import GROUP_LIMIT, running_sums
from meander.operators.changes import FIELD_MAP, top_factors


def estimates(
    events: DataFrame,
    series: DataFrame,
    by: list[str],
    alpha: float = 0.3,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Mean, EWMA and trend of each event's metric strictly before the event starts.

    ``series`` holds ``by, ts, seq, value``.  Event starts are merged into the
    series as rows of weight zero, so the totals before each start come from one
    pass of running sums instead of a join of events with points.
    Without earlier points all three equal the mean of the whole series, or 0.
    """
    origin = series.groupBy(*by).agg(
        F.min("ts").alias("_t0"), F.avg("value").alias("all_mean")
    )
    points = series.select(*by, "ts", F.lit(1).alias("_kind"), "seq", F.lit("").alias("event_id"), "value")
    starts = events.select(
        *by, F.col("start_ts").alias("ts"), F.lit(0).alias("_kind"),
        F.lit(None).cast("long").alias("seq"), "event_id", F.lit(None).cast("double").alias("value"),
    )
    merged = points.unionByName(starts).join(origin.select(*by, "_t0", F.col("all_mean").alias("_v0")), by)
    is_point = F.col("_kind") == 1
    # the line is fitted to offsets: times from the first one (where every prefix starts), values from the mean
    t, v, w = F.col("ts") - F.col("_t0"), F.col("value"), F.col("value") - F.col("_v0")
    on = lambda c: F.when(is_point, c).otherwise(F.lit(0.0))
    cum = running_sums(
        merged, by, ["ts", "_kind", "seq", "event_id"],
        {
            "n": F.when(is_point, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")),
            "sv": on(v), "st": on(t), "stt": on(t * t), "sw": on(w), "stw": on(t * w),
        },
        group_limit,
    )
    probes = cum.filter(~is_point).withColumnRenamed("ts", "start_ts")

    # beyond `depth` points back a weight is below double precision
    depth = 1 if alpha >= 1 else max(1, math.ceil(math.log(1e-18) / math.log(1 - alpha)))
    wanted = probes.filter(F.col("n") > 0).select(
        *by, "event_id", F.col("n").alias("_n"),
        F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("n") - depth + 1), F.col("n"))).alias("_i"),
    )
    indexed = cum.filter(is_point).select(*by, F.col("n").alias("_i"), "value")
    keep = F.lit(1.0 - alpha)
    age = (F.col("_n") - F.col("_i")).cast("double")
    weight = F.when(F.col("_i") == 1, F.pow(keep, age)).otherwise(F.lit(alpha) * F.pow(keep, age))
    ewma = wanted.join(indexed, [*by, "_i"]).groupBy(*by, "event_id").agg(F.sum(weight * F.col("value")).alias("_ewma"))

    n = F.col("n").cast("double")
    mean = F.col("sv") / n
    spread = F.col("stt") - F.col("st") * F.col("st") / n
    slope = (F.col("stw") - F.col("st") * F.col("sw") / n) / spread
    line = mean + slope * (F.col("start_ts") - F.col("_t0") - F.col("st") / n)
    fit = F.when(F.col("n") < 3, F.col("_ewma")).when(F.abs(spread) < 1e-12, mean).otherwise(line)
    fallback = F.coalesce(F.col("all_mean"), F.lit(0.0))
    pick = lambda c: F.when(F.coalesce(F.col("n"), F.lit(0)) > 0, c).otherwise(fallback)
    return (
        events.select(*by, "event_id")
        .join(probes.drop("seq", "value", "_kind"), [*by, "event_id"], "left")
        .join(ewma, [*by, "event_id"], "left")
        .join(origin.select(*by, "all_mean"), by, "left")
        .select(
            *by, "event_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_before"),
            pick(mean).alias("mean"), pick(F.col("_ewma")).alias("ewma"), pick(fit).alias("trend"),
        )
    )


def scenarios(factors: DataFrame, by: list[str], top_k: int = 3) -> DataFrame:
    """One "remove" scenario per top factor, and a combined one when there are several.

    ``pos`` is the scenario's place within its event; the combined one is last.
    """
    event = [*by, "event_id"]
    top = top_factors(factors, by, top_k)
    single = top.select(
        *event, F.col("rank").alias("pos"), F.array("change_id").alias("change_ids"),
        F.col("score").alias("confidence"),
        F.format_string(
            "Remove change '%s' (score=%.4f, change_id=%s)", "change_type", "score", "change_id"
        ).alias("description"),
    )
    # at most top_k rows per event
    all_of = top.groupBy(*event).agg(
        F.count(F.lit(1)).alias("_n"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "change_id"))), lambda r: r["change_id"]
        ).alias("change_ids"),
        F.min("score").alias("confidence"),
    )
    combined = all_of.filter(F.col("_n") > 1).select(
        *event, (F.col("_n") + 1).cast("int").alias("pos"), "change_ids", "confidence",
        F.format_string("Remove all %d top-ranked changes", "_n").alias("description"),
    )
    out = single.unionByName(combined)
    return out.withColumn("scenario_id", stable_id(*[F.col(b) for b in by], F.col("event_id"), F.col("pos")))


def counterfactuals(
    events: DataFrame, scenario_rows: DataFrame, estimate_rows: DataFrame, by: list[str],
    method: str = "trend",
) -> DataFrame:
    """Magnitude against the estimate for each scenario.

    Undoing a change alters versions and metadata, never metric values, so every
    scenario of an event shares one estimate.
    """
    event = [*by, "event_id"]
    est = estimate_rows.select(*event, F.col(method).alias("_estimate"))
    joined = scenario_rows.join(events.select(*event, "magnitude"), event).join(est, event)
    return joined.select(
        *event, "scenario_id", "pos", "change_ids", "description",
        F.size("change_ids").alias("num_interventions"),
        F.round("magnitude", 6).alias("original_metric"),
        F.round("_estimate", 6).alias("counterfactual_metric"),
        (F.round(F.col("magnitude") - F.col("_estimate"), 6) + F.lit(0.0)).alias("delta"),
        F.round("confidence", 4).alias("confidence"),
    )


def _overlay(base: Column, extra: Column) -> Column:
    """Map ``base`` with the entries of ``extra`` written over it."""
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(extra), k))
    return F.map_concat(kept, extra)


def intervention_apply(
    interventions: DataFrame, changes: DataFrame, history: DataFrame, by: list[str]
) -> DataFrame:
    """Rewritten records per scenario.

    ``interventions``: ``by, scenario_id, change_id, action, override``.
    ``remove`` restores what the change replaced, ``modify`` writes the override
    over the metadata.  Only the first record of the change's run is rewritten;
    unknown changes do nothing.
    """
    targets = interventions.join(changes.select(*by, "change_id", F.col("run_id").alias("_run"), "details"), [*by, "change_id"])
    stamp = F.struct(F.coalesce("timestamp", F.lit(0.0)).alias("t"), F.col("seq").alias("s"))
    wanted = history.join(
        targets.select(*by, F.col("_run").alias("run_id")).distinct(), [*by, "run_id"], "left_semi"
    )
    first = wanted.groupBy(*by, "run_id").agg(
        F.min_by(F.struct("seq", "timestamp", "system_version", "metadata"), stamp).alias("rec")
    )
    rows = targets.join(first.withColumnRenamed("run_id", "_run"), [*by, "_run"])
    d, rec = F.col("details"), F.col("rec")
    empty = F.create_map().cast(FIELD_MAP)
    old = lambda m: F.transform_values(m, lambda _, v: v["old"])
    meta = F.coalesce(rec["metadata"], empty)
    undone = F.when(
        d["pipeline"].isNotNull(), _overlay(meta, F.create_map(F.lit("pipeline_name"), d["pipeline"]["old"]))
    ).otherwise(meta)
    info = F.coalesce(F.from_json(meta["system_info"], FIELD_MAP), empty)
    undone = F.when(
        d["system_info_diff"].isNotNull(),
        _overlay(undone, F.create_map(F.lit("system_info"), F.to_json(_overlay(info, old(d["system_info_diff"]))))),
    ).otherwise(undone)
    undone = F.when(d["metadata_diff"].isNotNull(), _overlay(undone, old(d["metadata_diff"]))).otherwise(undone)
    removing = F.col("action") == "remove"
    return rows.select(
        *by, "scenario_id", "change_id", F.col("_run").alias("run_id"),
        rec["seq"].alias("seq"), rec["timestamp"].alias("timestamp"),
        F.when(removing & d["version"].isNotNull(), d["version"]["old"]).otherwise(rec["system_version"]).alias("system_version"),
        F.when(removing, undone)
        .when(F.col("action") == "modify", _overlay(meta, F.coalesce("override", empty)))
        .otherwise(meta)
        .alias("metadata"),
    )
