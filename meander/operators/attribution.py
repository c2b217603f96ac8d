"""Best factors and confidence of drift events by look-ups in the ordered changes of their streams.

A change's score falls with its distance from the event's window and depends on nothing else but its type, so over the
changes of one type in time order it rises up to the window, is constant inside and falls behind it.  Rounded to four
digits it has few steps, and everything wanted follows from ranks: the sum of all scores is a count per step, found by
bisection; the best factors of a type are the first ones of the highest steps on either side.  The farthest change is the
first or last one of the stream.

Changes of a long stream are cut into slices and its events into blocks; every block meets every slice in one task that
holds both in order.  A task returns one row of counts and at most ``top`` factors per event, so neither pairs of events
and changes nor their scores become rows.  Streams with few changes are scored pair by pair inside the task, many at once.
"""

from __future__ import annotations

from collections import namedtuple
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meander.functions.runtime import cut_lineage
from meander.operators.changes import WEIGHT_MAGNITUDE, WEIGHT_TIME, WEIGHT_TYPE, top_factors, type_weight

SLICE = 1 << 20  # changes that meet a block of events in one task
BLOCK = 1 << 13  # events of a block
FEW = 1 << 12  # changes of a stream whose pairs with events a task builds, PAIRS at a time; look-ups for more
PAIRS = 1 << 18
UNIT = 10_000  # steps of a score

Event = namedtuple("Event", "start end magnitude farthest")


def units(delta, farthest, weight, size, inside=False) -> np.ndarray:
    """Scores in steps of 1 / UNIT; halves of a step are rounded up on the decimal text, as SQL does."""
    with np.errstate(divide="ignore", invalid="ignore"):
        near = np.where(np.asarray(farthest) > 0, 1.0 - delta / farthest, 1.0)
    near = np.where(inside, near * 0.5 + 0.5, near)
    raw = np.clip(WEIGHT_TIME * near + WEIGHT_TYPE * weight + WEIGHT_MAGNITUDE * size, 0.0, 1.0)
    scaled = raw * UNIT
    out = np.floor(scaled + 0.5).astype(np.int64)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        out[i] = int((Decimal(repr(float(raw[i]))) * UNIT).quantize(Decimal(1), ROUND_HALF_UP))
    return out


class Side:
    """Changes of one type on one side of a window; ``at(i)`` is the step of the i-th nearest."""

    def __init__(self, ts: np.ndarray, window: float, left: bool, *rest):
        self.ts, self.window, self.left, self.rest, self.n = ts, window, left, rest, len(ts)

    def at(self, i: np.ndarray) -> np.ndarray:
        t = self.ts[self.n - 1 - i] if self.left else self.ts[i]
        return units(np.abs(t - self.window), *self.rest)

    def count(self, steps: np.ndarray) -> np.ndarray:
        """How many changes have at least each step: bisection, as steps fall with the distance."""
        low, high = np.zeros(len(steps), np.int64), np.full(len(steps), self.n)
        while (open_ := low < high).any():
            middle = (low + high) // 2
            reached = open_ & (self.at(np.minimum(middle, self.n - 1)) >= steps)
            low = np.where(reached, middle + 1, low)
            high = np.where(open_ & ~reached, middle, high)
        return low

    def total(self) -> int:
        ends = self.at(np.array([0, self.n - 1]))
        if (ends[0] - ends[1] + 1) * self.n.bit_length() > self.n:
            return int(self.at(np.arange(self.n)).sum())  # fewer changes than look-ups
        return int(self.n * ends[1] + self.count(np.arange(ends[1] + 1, ends[0] + 1)).sum())

    def best(self, top: int) -> np.ndarray:
        """Time-ordered places that can be among the ``top`` best: earlier ones come first among equal steps."""
        if not self.left:
            return np.arange(min(top, self.n))
        nearest = np.arange(max(0, self.n - top), self.n)
        lowest = self.at(np.array([min(top, self.n) - 1]))  # step of the top-th nearest
        first = self.n - int(self.count(lowest)[0])
        return np.union1d(nearest, np.arange(first, min(first + top, self.n)))


def looked_up(event, types: dict, top: int):
    """``(count, units, best, picks)`` of one event; ``types``: weight to ordered times, sequence numbers and rows."""
    size = 1.0 if event.magnitude > 0 else 0.0
    count, total, best, picks = 0, 0, 0, []
    for weight, (ts, seq, rows) in types.items():
        start, end = np.searchsorted(ts, event.start, "left"), np.searchsorted(ts, event.end, "right")
        count += len(ts)
        rest = (event.farthest, weight, size)
        if end > start:
            step = int(units(np.zeros(1), *rest, True)[0])
            total += step * int(end - start)
            picks += [(-step, ts[i], seq[i], rows[i], 0.0, True) for i in range(int(start), int(min(end, start + top)))]
        for side, offset in (
            (Side(ts[:start], event.start, True, *rest), 0), (Side(ts[end:], event.end, False, *rest), end)
        ):
            if not side.n:
                continue
            total += side.total()
            places = side.best(top)
            delta = np.abs(side.ts[places] - side.window)
            for i, d, step in zip((places + offset).tolist(), delta, units(delta, *rest), strict=True):
                picks.append((-int(step), ts[i], seq[i], rows[i], float(d), False))
    picks = sorted(picks, key=lambda p: p[:3])[:top]
    best = -picks[0][0] if picks else 0
    return count, total, best, picks


def _summaries(events: DataFrame, changes: DataFrame, by: list[str], top: int, slice_rows: int, block_rows: int) -> DataFrame:
    stream = changes.groupBy(*by).agg(
        F.min("ts").alias("_first"), F.max("ts").alias("_last"), F.ceil(F.count(F.lit(1)) / slice_rows).alias("_slices")
    )
    asked = events.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("_blocks"))
    plan = stream.join(asked, by)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    text = F.lit(None).cast("string")
    farthest = F.greatest(F.col("start_ts") - F.col("_first"), F.col("_last") - F.col("end_ts"), F.lit(0.0))
    ev = events.join(plan, by).select(
        *by, F.pmod(F.xxhash64("event_id"), F.col("_blocks")).alias("_block"), every("_slices").alias("_slice"),
        F.lit(0).alias("_role"), F.col("event_id").alias("id"), text.alias("run_id"), text.alias("change_type"),
        F.col("start_ts").cast("double").alias("ts"), F.lit(0).cast("long").alias("seq"),
        F.col("end_ts").cast("double").alias("end"), F.col("magnitude").cast("double").alias("weight"),
        farthest.cast("double").alias("farthest"),
    )
    none = F.lit(None).cast("double")
    chg = changes.join(plan, by).select(
        *by, every("_blocks").alias("_block"), F.pmod(F.xxhash64("change_id"), F.col("_slices")).alias("_slice"),
        F.lit(1).alias("_role"), F.col("change_id").alias("id"), "run_id", "change_type", F.col("ts").cast("double").alias("ts"),
        F.col("seq").cast("long").alias("seq"), none.alias("end"), type_weight(F.col("change_type")).alias("weight"),
        none.alias("farthest"),
    )
    key = [*by, "_block", "_slice"]
    rows = ev.unionByName(chg).repartition(*key).sortWithinPartitions(*key, "_role", "ts", "seq")
    names = ["event_id", "count", "units", "best", "change_id", "run_id", "change_type", "ts", "seq", "type_weight",
             "time_delta", "in_window", "drift_magnitude", "score"]

    def output(cols, event, totals, pick_event, change, step, delta, inside):
        """Rows of the events' totals, then those of the picked factors (row numbers of ``cols``)."""
        n, m = len(event), len(pick_event)
        rows = np.concatenate([event, pick_event]).astype(np.int64)
        first = lambda values: pd.array(np.concatenate([values, np.zeros(m, np.int64)]), "Int64")
        frame = pd.DataFrame({b: cols[b][rows] for b in by} | {"event_id": cols["id"][rows]})
        for name, values in zip(("count", "units", "best"), totals, strict=True):
            frame[name] = first(values)
            frame.loc[n:, name] = pd.NA
        last = lambda values: np.concatenate([np.full(n, None, object), values])
        for name, c in (("change_id", "id"), ("run_id", "run_id"), ("change_type", "change_type"), ("ts", "ts"), ("seq", "seq"),
                        ("type_weight", "weight")):
            frame[name] = last(cols[c][change])
        frame["time_delta"], frame["in_window"] = last(delta), last(inside)
        frame["drift_magnitude"], frame["score"] = last(cols["weight"][pick_event]), last(step / UNIT)
        frame["seq"] = frame["seq"].astype("Int64")
        return frame[[*by, *names]]

    def paired(cols, event, begin, size):
        """Streams with few changes: their pairs, in memory only.  ``begin``, ``size``: changes of each event's stream."""
        of = np.repeat(np.arange(len(event)), size)
        offset = np.cumsum(size) - size
        change = np.arange(len(of)) - offset[of] + begin[of]
        e = event[of]
        ts, start, end = cols["ts"][change], cols["ts"][e], cols["end"][e]
        inside = (ts >= start) & (ts <= end)
        delta = np.where(inside, 0.0, np.minimum(np.abs(ts - start), np.abs(ts - end)))
        step = units(delta, cols["farthest"][e], cols["weight"][change], (cols["weight"][e] > 0).astype(float), inside)
        totals = (size, np.add.reduceat(step, offset), np.maximum.reduceat(step, offset))
        order = np.lexsort((cols["seq"][change], ts, -step, of))  # of is in order, so events stay where they are
        at = order[np.arange(len(of)) - offset[of] < top]
        return output(cols, event, totals, e[at], change[at], step[at], delta[at], inside[at])

    def ranked(cols, event, begin, end):
        """A stream with many changes: look-ups for each event."""
        weight = cols["weight"][begin:end]
        types = {}
        for w in np.unique(weight):
            at = np.flatnonzero(weight == w) + begin
            types[w] = (cols["ts"][at], cols["seq"][at], at)
        totals, picks = [], []
        for i in event:
            found = looked_up(Event(cols["ts"][i], cols["end"][i], cols["weight"][i], cols["farthest"][i]), types, top)
            totals.append(found[:3])
            picks += [(i, p[3], -p[0], p[4], p[5]) for p in found[3]]
        columns = [np.array(c) for c in zip(*picks, strict=True)]
        return output(cols, event, np.array(totals).T, *columns)

    def answered(cols, edge):
        """Whole groups: rows from ``edge[i]`` on, events first."""
        size = np.diff(np.append(edge, len(cols["_role"])))
        asked = np.add.reduceat(1 - cols["_role"], edge)
        found = size - asked
        few = (found > 0) & (asked > 0) & (found <= FEW)
        for i in np.flatnonzero((found > FEW) & (asked > 0)):
            cut = edge[i] + asked[i]
            yield ranked(cols, np.arange(edge[i], cut), cut, edge[i] + size[i])
        of = np.repeat(np.flatnonzero(few), asked[few])
        event = np.arange(len(of)) - np.repeat(np.cumsum(asked[few]) - asked[few], asked[few]) + edge[of]
        at = 0
        while at < len(of):  # about PAIRS pairs at a time
            upto = at + max(1, int(np.searchsorted(np.cumsum(found[of[at : at + PAIRS]]), PAIRS, "right")))
            own = of[at:upto]
            yield paired(cols, event[at:upto], (edge + asked)[own], found[own])
            at = upto

    def run(batches):
        held = []
        for pdf in batches:
            if not len(pdf):
                continue
            same = np.ones(len(pdf), bool)
            for c in key:
                values = pdf[c].to_numpy()
                same[1:] &= values[1:] == values[:-1]
                same[0] &= bool(held) and held[-1][c].iloc[-1] == values[0]
            edge = np.flatnonzero(~same)
            if not len(edge):  # all of the group at hand
                held.append(pdf)
                continue
            last = int(edge[-1])  # the last group may go on
            whole = pd.concat([*held, pdf.iloc[:last]]) if held else pdf.iloc[:last]
            if len(whole):
                yield from answered(*cut(whole, sum(len(h) for h in held), edge[:-1], bool(held)))
            held = [pdf.iloc[last:]]
        if held:
            yield from answered(*cut(pd.concat(held), 0, [], True))

    def cut(frame, shift, edge, going):
        """Columns, and the groups' first rows; ``going``: the first rows belong to a group begun before."""
        edge = np.asarray(edge, np.int64) + shift
        return {c: frame[c].to_numpy() for c in frame}, np.append(0, edge) if going else edge

    fields = ", ".join(f"`{b}` {events.schema[b].dataType.simpleString()}" for b in by)
    schema = (f"{fields}, event_id {events.schema['event_id'].dataType.simpleString()}, count long, units long, best long, "
              "change_id string, run_id string, change_type string, ts double, seq long, type_weight double, "
              "time_delta double, in_window boolean, drift_magnitude double, score double")
    return rows.mapInPandas(run, schema)


def attribution_summary(
    events: DataFrame, changes: DataFrame, by: list[str], top: int, slice_rows: int = SLICE, block_rows: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """``(best, attributions)``: the ``top`` factors of every event, and one row per event with its confidence.

    The same at any size.  Confidence is the top score's share of all scores, or the score of a single factor; an event of
    a stream without changes has no factor and confidence 0.
    """
    found = cut_lineage(_summaries(events, changes, by, top, slice_rows, block_rows))
    event = [*by, "event_id"]
    sums = found.where(F.col("count").isNotNull()).groupBy(*event).agg(
        F.sum("count").alias("num_factors"), F.sum("units").alias("_units"), F.max("best").alias("_best")
    )
    share = (F.col("_best") / UNIT) / (F.col("_units") / UNIT)
    confidence = F.when(F.col("num_factors") == 1, F.col("_best") / UNIT).when(F.col("_units") == 0, 0.0).otherwise(share)
    sure = sums.select(*event, "num_factors", F.round(confidence, 4).alias("confidence"))
    rows = events.select(*event, "metric_name").join(sure, event, "left").na.fill({"num_factors": 0, "confidence": 0.0})
    factors = found.where(F.col("change_id").isNotNull()).drop("count", "units", "best")
    return top_factors(factors, by, top), rows
