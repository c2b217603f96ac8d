"""Guardrails on actions: parameter bounds, cooldown, flapping."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meander.functions.ordering import GROUP_LIMIT, drop_halo, framed, numbered, running_sums
from meander.functions.runtime import cut_lineage

# fixed values: allowed range of each known parameter
BOUNDS = {
    "temperature": (0.0, 1.0),
    "top_k": (1.0, 50.0),
    "reranker_cutoff": (0.0, 1.0),
    "retrieval_depth": (1.0, 20.0),
}
COOLDOWN_S = 300.0
MAX_FLAPPING = 5
FLAPPING_WINDOW_S = 3600.0
SIGNATURE = ["action_type", "target_run_id", "change_id"]


def out_of_bounds(params: Column, custom: dict[str, tuple[float, float]] | None = None) -> Column:
    """True when any known parameter of the map lies outside its range."""
    bounds = {**BOUNDS, **(custom or {})}
    broken = F.lit(False)
    for name, (lo, hi) in bounds.items():
        v = params[name]
        broken = broken | F.coalesce((v < F.lit(float(lo))) | (v > F.lit(float(hi))), F.lit(False))
    return broken


def policy_bounds(actions: DataFrame, custom: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """The broken parameters of each action: ``action_id, param, value, lo, hi``."""
    bounds = {**BOUNDS, **(custom or {})}
    table = F.create_map(
        *[x for k, (lo, hi) in bounds.items() for x in (F.lit(k), F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")))]
    )
    flat = actions.select("action_id", F.explode("params").alias("param", "value")).withColumn("b", table[F.col("param")])
    return flat.filter((F.col("value") < F.col("b.lo")) | (F.col("value") > F.col("b.hi"))).select(
        "action_id", "param", "value", "b.lo", "b.hi"
    )


def policy_cooldown(
    actions: DataFrame, ts: str = "ts", seq: str = "action_id", cooldown_s: float = COOLDOWN_S,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Flag actions whose signature ran less than ``cooldown_s`` seconds before.

    Only the nearest earlier action of the signature decides, so one row of look
    back is enough.
    """
    rows, w = framed(actions, SIGNATURE, [ts, seq], 1, group_limit)
    since = F.col(ts) - F.lag(ts).over(w)
    return drop_halo(
        rows.withColumn("in_cooldown", F.coalesce(since < F.lit(float(cooldown_s)), F.lit(False)))
    )


def policy_flapping(
    actions: DataFrame, ts: str = "ts", seq: str = "action_id", window_s: float = FLAPPING_WINDOW_S,
    max_flapping: int = MAX_FLAPPING, group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Count earlier actions on the same target within the window.

    Each action enters the ordered stream of its target twice: as itself, and as
    a marker where it leaves the window.  The count in the window is the running
    number of entries minus exits, so a busy target needs no wide frame.
    """
    key = ["target_run_id"]
    enter = actions.select(*key, F.col(ts).alias("_at"), F.lit(0).alias("_exit"), F.col(seq).alias("_seq"))
    # an action still counts when exactly window_s old, so it leaves just after
    leave = actions.select(*key, (F.col(ts) + F.lit(float(window_s))).alias("_at"), F.lit(1).alias("_exit"), F.col(seq).alias("_seq"))
    cum = running_sums(
        enter.unionByName(leave), key, ["_at", "_exit", "_seq"],
        {"_open": F.when(F.col("_exit") == 0, F.lit(1)).otherwise(F.lit(-1)).cast("long")}, group_limit,
    )
    counts = cum.filter(F.col("_exit") == 0).select(*key, F.col("_seq").alias(seq), (F.col("_open") - 1).alias("recent_actions"))
    return actions.join(counts, [*key, seq]).withColumn("is_flapping", F.col("recent_actions") >= max_flapping)


def policy_decide(
    actions: DataFrame, ts: str = "ts", seq: str = "action_id",
    cooldown_s: float = COOLDOWN_S, window_s: float = FLAPPING_WINDOW_S, max_flapping: int = MAX_FLAPPING,
    custom_bounds: dict[str, tuple[float, float]] | None = None, group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """First violated rule of each action (bounds, cooldown, flapping), or allowed."""
    rows = policy_cooldown(actions, ts, seq, cooldown_s, group_limit)
    rows = policy_flapping(rows, ts, seq, window_s, max_flapping, group_limit)
    rule = (
        F.when(out_of_bounds(F.col("params"), custom_bounds), F.lit("parameter_bounds"))
        .when(F.col("in_cooldown"), F.lit("cooldown_period"))
        .when(F.col("is_flapping"), F.lit("max_flapping"))
    )
    return rows.withColumn("rule_violated", rule).withColumn("allowed", rule.isNull())


def check_against_history(
    actions: DataFrame, executed: DataFrame, now: Column,
    cooldown_s: float = COOLDOWN_S, window_s: float = FLAPPING_WINDOW_S, max_flapping: int = MAX_FLAPPING,
    custom_bounds: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Decide new actions at time ``now`` against a table of executed ones.

    The executed actions are reduced per signature and per target first, so the
    joins meet one row per key.
    """
    age = now - F.col("executed_at")
    last = executed.filter(age < F.lit(float(cooldown_s))).select(*SIGNATURE).distinct().withColumn("_cool", F.lit(True))
    recent = executed.filter(age <= F.lit(float(window_s))).groupBy("target_run_id").agg(F.count(F.lit(1)).alias("recent_actions"))
    rows = actions.join(last, SIGNATURE, "left").join(recent, ["target_run_id"], "left")
    params = F.coalesce("params", F.create_map().cast("map<string,double>"))
    rule = (
        F.when(out_of_bounds(params, custom_bounds), F.lit("parameter_bounds"))
        .when(F.col("_cool"), F.lit("cooldown_period"))
        .when(F.coalesce("recent_actions", F.lit(0)) >= max_flapping, F.lit("max_flapping"))
    )
    return rows.withColumn("rule_violated", rule).withColumn("allowed", rule.isNull()).drop("_cool")


def _running_before(rows: DataFrame, executed: DataFrame, key: str, length: float, closed: bool, name: str,
                    group_limit: int) -> DataFrame:
    """``seq, name``: how many executed actions of the row's ``key`` are at most ``length`` old (younger, if not closed)."""
    step = lambda df, at, kind, n, seq: df.select(
        key, at.alias("at"), F.lit(kind).alias("kind"), F.lit(n).cast("long").alias("step"), seq.alias("seq")
    )
    none, at = F.lit(None).cast(rows.schema["seq"].dataType), F.col("at")
    past = step(executed, at, 0, 1, none).unionByName(
        step(executed, at + F.lit(float(length)), 3 if closed else 1, -1, none))
    own = step(rows, at, 2, 0, F.col("seq"))
    cum = running_sums(own.unionByName(past), [key], ["at", "kind", "seq"], {name: F.col("step")}, group_limit)
    return cum.filter("kind = 2").select("seq", name)


def policy_sequence(
    actions: DataFrame, executed: DataFrame | None = None, ts: str = "ts", seq: str = "action_id",
    cooldown_s: float = COOLDOWN_S, window_s: float = FLAPPING_WINDOW_S, max_flapping: int = MAX_FLAPPING,
    custom_bounds: dict[str, tuple[float, float]] | None = None, group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """``actions`` plus ``rule_violated, allowed``, decided one after another: each decision enters the history of the next.

    An approved action counts from its own time, like the ``executed`` ones (``SIGNATURE`` and ``executed_at``) before
    it.  A blocked action stays in the history without a time: it blocks its signature and counts as recent from then
    on.  So a target with ``max_flapping`` blocked actions is closed, and before that at most ``max_flapping`` actions
    are approved in any window.  That bounds the rows of a target whose order matters, however many it has: only those go
    through a task one by one, the rest of a closed target is decided by joins on the signature.
    ``seq`` is unique; ties in time go by it.  Null parts of a signature equal each other.
    """
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    target, sig = part("target_run_id"), F.to_json(F.array(*[part(c) for c in SIGNATURE]))
    params = F.coalesce("params", F.create_map().cast("map<string,double>"))
    rows = actions.select(
        target.alias("target"), sig.alias("sig"), F.col(ts).cast("double").alias("at"), F.col(seq).alias("seq"),
        out_of_bounds(params, custom_bounds).alias("broken"),
    )
    rows = cut_lineage(numbered(rows, ["target"], ["at", "seq"], "k", group_limit))
    if executed is None:
        marked = rows.withColumns({"past": F.lit(0).cast("long"), "cool": F.lit(0).cast("long")})
    else:
        done = executed.select(target.alias("target"), sig.alias("sig"), F.col("executed_at").cast("double").alias("at"))
        marked = rows.join(
            _running_before(rows, done, "target", window_s, True, "past", group_limit), "seq"
        ).join(_running_before(rows, done, "sig", cooldown_s, False, "cool", group_limit), "seq")
    # a row with more before it than could be approved, and the blocked ones that close a target, is behind the close
    approved = max_flapping * (F.floor((F.col("at") - F.col("begin")) / F.lit(float(window_s))) + 1)
    begin = rows.groupBy("target").agg(F.min("at").alias("begin"))
    closed = rows.join(begin, "target").filter(F.col("k") - 1 > approved + max_flapping - 1)
    closed = closed.groupBy("target").agg(F.min("k").alias("closed"))
    marked = cut_lineage(marked.join(closed, "target", "left").withColumn(
        "open", F.coalesce(F.col("k") < F.col("closed"), F.lit(True))))

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        recent, last, blocked, bad, rules = [], {}, 0, set(), []
        for r in pdf.sort_values("k").itertuples(index=False):
            recent = [t for t in recent if r.at - t <= window_s]
            rule = None
            if r.broken:
                rule = "parameter_bounds"
            elif r.cool or r.sig in bad or r.at - last.get(r.sig, float("-inf")) < cooldown_s:
                rule = "cooldown_period"
            elif r.past + blocked + len(recent) >= max_flapping:
                rule = "max_flapping"
            if rule is None:
                recent.append(r.at)
                last[r.sig] = r.at
            else:
                blocked += 1
                bad.add(r.sig)
            rules.append((r.target, r.sig, r.seq, r.at, rule))
        return pd.DataFrame(rules, columns=["target", "sig", "seq", "at", "rule"])

    kind = rows.schema["seq"].dataType.simpleString()
    head = cut_lineage(marked.filter("open").groupBy("target").applyInPandas(
        decide, f"target string, sig string, seq {kind}, at double, rule string"))
    seen = head.groupBy("target", "sig").agg(
        F.max(F.col("rule").isNotNull()).alias("bad"), F.max(F.when(F.col("rule").isNull(), F.col("at"))).alias("last"))
    tail = marked.filter("NOT open")
    first = tail.groupBy("target", "sig").agg(F.min("k").alias("first"))
    cooling = (
        (F.col("cool") > 0) | F.coalesce("bad", F.lit(False)) | (F.col("k") > F.col("first"))
        | F.coalesce(F.col("at") - F.col("last") < F.lit(float(cooldown_s)), F.lit(False))
    )
    rest = tail.join(seen, ["target", "sig"], "left").join(first, ["target", "sig"]).select(
        "seq",
        F.when(F.col("broken"), "parameter_bounds").when(cooling, "cooldown_period").otherwise("max_flapping").alias("rule"),
    )
    rules = head.select("seq", "rule").unionByName(rest).withColumnsRenamed({"seq": seq, "rule": "rule_violated"})
    return actions.join(rules, seq).withColumn("allowed", F.col("rule_violated").isNull())
