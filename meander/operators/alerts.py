"""Alert severity, cooldown and payloads."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meander.functions.ordering import GROUP_LIMIT, drop_halo, framed, largest_group, running_sums
from meander.functions.runtime import cut_lineage

COOLDOWN_S = 300.0
ISLAND_LIMIT = 1_000_000


def alert_severity(js: Column, threshold: Column, p_value: Column | None = None) -> Column:
    """``critical`` well above the threshold or at p < 0.01, else ``warning``."""
    high = js > threshold * F.lit(1.5)
    if p_value is not None:
        high = high | F.coalesce(p_value < 0.01, F.lit(False))
    return F.when(high, F.lit("critical")).otherwise(F.lit("warning"))


def _islands(alerts: DataFrame, by: list[str], ts: str, seq: str, cooldown_s: float, group_limit: int) -> DataFrame:
    """Number runs of alerts whose gaps are below the cooldown.

    After a gap of at least the cooldown the next alert is always sent, so runs
    are independent of each other.
    """
    rows, w = framed(alerts, by, [ts, seq], 1, group_limit)
    gap = F.col(ts) - F.lag(ts).over(w)
    rows = drop_halo(rows.withColumn("_new", F.when(gap < F.lit(float(cooldown_s)), 0).otherwise(1)))
    return running_sums(rows, by, [ts, seq], {"_island": F.col("_new").cast("long")}, group_limit).drop("_new")


def alert_suppress(
    alerts: DataFrame, by: list[str], ts: str = "ts", seq: str = "seq", cooldown_s: float = COOLDOWN_S,
    group_limit: int = GROUP_LIMIT, island_limit: int = ISLAND_LIMIT,
) -> DataFrame:
    """Mark the alerts that are sent: at most one per key within the cooldown.

    The cooldown counts from the last alert sent.  Each run of close alerts is
    walked in one task while it is small; long runs follow "next allowed alert"
    links by doubling, see :func:`_follow_links`.
    """
    cols = alerts.columns
    rows = _islands(alerts, by, ts, seq, cooldown_s, group_limit)
    island = [*by, "_island"]
    if largest_group(rows, island) > island_limit:
        sent = _follow_links(rows, island, ts, seq, cooldown_s)
        return rows.join(sent.withColumn("is_sent", F.lit(True)), [*island, ts, seq], "left").na.fill(
            False, ["is_sent"]
        ).select(*cols, "is_sent")

    def walk(pdf):
        pdf = pdf.sort_values([ts, seq])
        flags, allowed = [], float("-inf")
        for t in pdf[ts]:
            ok = t >= allowed
            if ok:
                allowed = t + cooldown_s
            flags.append(ok)
        return pd.DataFrame(pdf[cols].assign(is_sent=flags))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in alerts.schema.fields) + ", is_sent boolean"
    return rows.groupBy(*island).applyInPandas(walk, schema)


def _follow_links(rows: DataFrame, island: list[str], ts: str, seq: str, cooldown_s: float) -> DataFrame:
    """Sent alerts of long runs.

    Every alert links to the first one at least the cooldown later.  Starting from
    the head of each run, the set of reached alerts doubles in depth per round.
    """
    data = rows.select(*island, F.col(ts).alias("_t"), F.col(seq).alias("_s"))
    # links: rank of an alert = number of alerts up to it; a probe at t + cooldown
    # counts the alerts strictly before it, and the next rank is the link
    probes = data.select(*island, (F.col("_t") + F.lit(float(cooldown_s))).alias("_t"), F.col("_s"), F.col("_t").alias("_from"))
    merged = data.select(*island, "_t", F.lit(1).alias("_k"), "_s", F.lit(None).cast("double").alias("_from")).unionByName(
        probes.select(*island, "_t", F.lit(0).alias("_k"), "_s", "_from")
    )
    ranked = cut_lineage(
        running_sums(merged, island, ["_t", "_k", "_s"], {"_n": F.col("_k").cast("long")}, group_limit=0)
    )
    place = ranked.filter("_k = 1").select(*island, F.col("_n").alias("at"), F.col("_t"), F.col("_s"))
    links = ranked.filter("_k = 0").select(*island, F.col("_from").alias("_t"), "_s", (F.col("_n") + 1).alias("to"))
    links = links.join(place, [*island, "_t", "_s"]).join(
        place.select(*island, F.col("at").alias("to")), [*island, "to"], "left_semi"
    ).select(*island, "at", "to")
    links = cut_lineage(links)
    reached = cut_lineage(place.filter("at = 1").select(*island, "at"))
    while not links.isEmpty():
        step = reached.join(links, [*island, "at"]).select(*island, F.col("to").alias("at"))
        reached = cut_lineage(reached.union(step).distinct())
        further = links.select(*island, F.col("at").alias("to"), F.col("to").alias("end"))
        links = cut_lineage(
            links.join(further, [*island, "to"]).select(*island, "at", F.col("end").alias("to"))
        )
    return place.join(reached, [*island, "at"]).select(*island, F.col("_t").alias(ts), F.col("_s").alias(seq))


def alert_payload(result: dict[str, Column], batch_id: Column, is_drifted: Column) -> Column:
    """Nested alert JSON; missing values become 0."""
    value = lambda name: F.coalesce(result.get(name, F.lit(None)).cast("double"), F.lit(0.0)).alias(name)
    return F.to_json(
        F.struct(
            F.lit("drift_alert").alias("event"),
            F.coalesce(is_drifted, F.lit(False)).alias("is_drifted"),
            batch_id.alias("batch_id"),
            F.struct(value("js_divergence"), value("mmd_score")).alias("vector_drift"),
            F.struct(value("spectral_distance"), value("density_delta")).alias("graph_drift"),
            F.struct(value("transition_entropy_delta"), value("avg_reflection_iterations_delta")).alias("swarm_drift"),
        ),
        {"ignoreNullFields": "false"},
    )
