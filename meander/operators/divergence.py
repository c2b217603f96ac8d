"""Divergences between two samples of a scalar, for many keys at once.

Samples are rows ``(by..., side, x)`` where the boolean ``side`` is true for the
current window and false for the baseline.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meander.functions.ordering import GROUP_LIMIT, known, order_statistics, running_sums

EPS = 1e-12
DEFAULT_BINS = 20
MIN_BINS, MAX_BINS = 10, 100


def _bin_count(n: Column, lo: Column, hi: Column, q1: Column, q3: Column) -> Column:
    iqr, span = q3 - q1, hi - lo
    width = F.lit(2.0) * iqr / F.pow(n.cast("double"), F.lit(1.0 / 3.0))
    bins = F.greatest(F.lit(MIN_BINS), F.least(F.lit(MAX_BINS), F.ceil(span / width)))
    usable = (n >= 2) & (iqr > 0) & (span > 0)
    return F.when(usable, bins).otherwise(F.lit(DEFAULT_BINS)).cast("int")


def fd_bins(df: DataFrame, by: list[str], x: str = "x", group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Freedman-Diaconis bin count per key: ``by, n, lo, hi, bins``."""
    q = order_statistics(df, by, x, [0.25, 0.75], group_limit=group_limit)
    return q.select(
        *by, "n", "lo", "hi",
        _bin_count(F.col("n"), F.col("lo"), F.col("hi"), F.col("q0"), F.col("q1")).alias("bins"),
    )


def _bin_index() -> Column:
    """Bin of ``x``, corrected against the bin edges so each edge opens its bin."""
    span = F.col("hi") - F.col("lo")
    step = span / F.col("bins")
    guess = F.least(F.floor((F.col("x") - F.col("lo")) / span * F.col("bins")), F.col("bins") - 1)
    below = (F.col("x") < F.col("lo") + guess * step).cast("int")
    above = ((F.col("x") >= F.col("lo") + (guess + 1) * step) & (guess < F.col("bins") - 1)).cast("int")
    return (guess - below + above).cast("int")


def shared_histogram(
    df: DataFrame,
    by: list[str],
    x: str = "x",
    side: str = "is_current",
    shape: DataFrame | None = None,
    group_limit: int | None = GROUP_LIMIT,
) -> DataFrame:
    """Masses ``p`` (baseline) and ``q`` (current) over one shared set of bins.

    ``shape`` may bring precomputed ``by, lo, hi, bins``; otherwise both samples
    together decide.  A constant sample gives uniform masses.
    """
    data = df.select(*by, F.col(side).alias("_side"), F.col(x).alias("x")).filter(F.col("x").isNotNull())
    if shape is None:
        shape = fd_bins(data, by, "x", group_limit)
    shape = shape.select(*by, "lo", "hi", "bins")
    counts = (
        data.join(shape, by)
        .filter(F.col("hi") - F.col("lo") >= EPS)
        .withColumn("bin", _bin_index())
        .groupBy(*by, "bin")
        .agg(
            F.count_if(~F.col("_side")).cast("double").alias("nb"),
            F.count_if(F.col("_side")).cast("double").alias("nc"),
        )
    )
    grid = shape.select(*by, "lo", "hi", "bins", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    full = grid.join(counts, [*by, "bin"], "left").na.fill(0.0, ["nb", "nc"])
    w = Window.partitionBy(*by)  # at most MAX_BINS rows
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    flat = F.col("hi") - F.col("lo") < EPS
    mass = lambda c: F.greatest(F.col(c) / (F.sum(c).over(w) * width), F.lit(EPS))
    full = full.withColumn("_p", F.when(flat, F.lit(1.0)).otherwise(mass("nb")))
    full = full.withColumn("_q", F.when(flat, F.lit(1.0)).otherwise(mass("nc")))
    return full.select(
        *by, "bin", "bins", "nb", "nc",
        (F.col("_p") / F.sum("_p").over(w)).alias("p"),
        (F.col("_q") / F.sum("_q").over(w)).alias("q"),
    )


def _half_kl(a: str, log) -> Column:
    m = (F.col("p") + F.col("q")) / 2
    return F.sum(F.when(F.col(a) > 0, F.col(a) * log(F.col(a) / m)).otherwise(0.0))


def jsd_distance(masses: DataFrame, by: list[str]) -> DataFrame:
    """Square root of the Jensen-Shannon divergence in nats, from ``p`` and ``q``."""
    half = (_half_kl("p", F.log) + _half_kl("q", F.log)) / 2
    return masses.groupBy(*by).agg(F.sqrt(F.greatest(half, F.lit(0.0))).alias("js"))


def jsd_hist_drift(
    df: DataFrame,
    by: list[str],
    x: str = "x",
    side: str = "is_current",
    threshold: float = 0.15,
    shape: DataFrame | None = None,
    group_limit: int | None = GROUP_LIMIT,
) -> DataFrame:
    """Jensen-Shannon distance of two histograms on shared bins."""
    js = jsd_distance(shared_histogram(df, by, x, side, shape, group_limit), by)
    return js.withColumn("js_drifted", F.col("js") > F.lit(float(threshold)))


def jsd_bits(densities: DataFrame, by: list[str], p: str = "p", q: str = "q") -> DataFrame:
    """Jensen-Shannon divergence in bits, clipped to [0, 1], of two densities on one support."""
    clipped = densities.select(
        *by,
        F.greatest(F.col(p), F.lit(EPS)).alias("p"),
        F.greatest(F.col(q), F.lit(EPS)).alias("q"),
    )
    totals = clipped.groupBy(*by).agg(F.sum("p").alias("_sp"), F.sum("q").alias("_sq"))
    norm = clipped.join(totals, by).select(
        *by, (F.col("p") / F.col("_sp")).alias("p"), (F.col("q") / F.col("_sq")).alias("q")
    )
    half = (_half_kl("p", F.log2) + _half_kl("q", F.log2)) / 2
    return norm.groupBy(*by).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), half)).alias("jsd"))


KERNEL_ROWS = 4096  # rows whose kernels are built at a time
KERNEL_KEYS = 512  # sums a task holds before it passes them on


def _kernel_sums(rows: DataFrame, by: list[str], points: int) -> DataFrame:
    """``by, _side, sums``: kernels of ``x`` summed at ``points`` grid points from ``_lo`` in steps of ``_step``."""
    key = [*by, "_side"]

    def table(totals):
        out = pd.DataFrame(list(totals), columns=key)
        out["sums"] = list(totals.values())
        return out

    def run(batches):
        totals: dict = {}
        for batch in batches:
            for k, part in batch.groupby(key, sort=False):
                first = part.iloc[0]
                grid = first["_lo"] + np.arange(points) * first["_step"]
                x, sums = part["x"].to_numpy(dtype=float), np.zeros(points)
                for i in range(0, len(x), KERNEL_ROWS):
                    z = (grid - x[i : i + KERNEL_ROWS, None]) / first["_h"]
                    sums += np.exp(-0.5 * z * z).sum(axis=0)
                totals[k] = totals.get(k, 0.0) + sums
            if len(totals) >= KERNEL_KEYS:
                yield table(totals)
                totals = {}
        if totals:
            yield table(totals)

    fields = [f"`{b}` {rows.schema[b].dataType.simpleString()}" for b in key]
    return rows.select(*key, "x", "_lo", "_step", "_h").mapInPandas(run, ", ".join([*fields, "sums array<double>"]))


def kl_kde_1d(
    df: DataFrame, by: list[str], x: str = "x", side: str = "is_current", points: int = 100
) -> DataFrame:
    """KL(baseline || current) of two Gaussian kernel estimates on a shared grid.

    Every task adds up the kernels of its rows at the grid points, so the shuffle
    holds ``points`` rows per key and task.  Samples without spread give 0.
    """
    data = df.select(*by, F.col(side).alias("_side"), F.col(x).alias("x")).filter(F.col("x").isNotNull())
    one = lambda cond: F.when(cond, F.col("x"))
    cur, base = F.col("_side"), ~F.col("_side")
    scott = lambda n, s: F.pow(n.cast("double"), F.lit(-0.2)) * s
    stats = data.groupBy(*by).agg(
        F.min("x").alias("lo"),
        F.max("x").alias("hi"),
        F.count_if(base).alias("nb"),
        F.count_if(cur).alias("nc"),
        scott(F.count_if(base), F.stddev_samp(one(base))).alias("hb"),
        scott(F.count_if(cur), F.stddev_samp(one(cur))).alias("hc"),
    )
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    placed = data.join(stats.filter((F.col("hb") > 0) & (F.col("hc") > 0)), by).withColumns(
        {"_lo": F.col("lo"), "_step": step, "_h": F.when(F.col("_side"), F.col("hc")).otherwise(F.col("hb"))}
    )
    density = (
        _kernel_sums(placed, by, points)
        .select(*by, "_side", F.posexplode("sums").alias("_i", "_k"))
        .groupBy(*by, "_i")
        .agg(F.sum(F.when(base, F.col("_k"))).alias("kb"), F.sum(F.when(cur, F.col("_k"))).alias("kc"))
    )
    root = math.sqrt(2.0 * math.pi)
    scaled = lambda k, n, h: F.greatest(F.col(k) / (F.col(n) * F.col(h) * F.lit(root)), F.lit(EPS))
    terms = density.join(stats, by).select(
        *by, step.alias("dx"), scaled("kb", "nb", "hb").alias("p"), scaled("kc", "nc", "hc").alias("q")
    )
    kl = terms.groupBy(*by).agg((F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))) * F.max("dx")).alias("_kl"))
    flat = F.col("hi") - F.col("lo") < F.lit(1e-15)
    return stats.join(kl, by, "left").select(
        *by, "nb", "nc", F.when(flat, F.lit(0.0)).otherwise(F.coalesce("_kl", F.lit(0.0))).alias("kl")
    )


def component_kl(
    vectors: DataFrame,
    by: list[str],
    vec: str = "embedding",
    side: str = "is_current",
    threshold: float = 0.5,
) -> DataFrame:
    """KL of every coordinate; the largest and the mean per key."""
    coords = vectors.select(*by, side, F.posexplode(vec).alias("component", "x"))
    per = kl_kde_1d(coords, [*by, "component"], "x", side)
    out = per.groupBy(*by).agg(F.max("kl").alias("max_kl"), F.avg("kl").alias("mean_kl"))
    return out.withColumn("kl_drifted", F.col("max_kl") > F.lit(float(threshold)))


def w1_1d(
    df: DataFrame,
    by: list[str],
    x: str = "x",
    side: str = "is_current",
    group_limit: int | None = GROUP_LIMIT,
) -> DataFrame:
    """Wasserstein-1 distance: area between the two empirical distribution functions.

    Equal values merge first.  With ``D`` the running difference of the two
    distribution functions, the area is the sum of ``x * (|D before| - |D after|)``,
    which needs running counts only.
    """
    data = df.select(*by, F.col(side).alias("_side"), F.col(x).alias("x")).filter(F.col("x").isNotNull())
    limit = known(data, by, group_limit)
    if limit is None:
        data = data.repartition(*by)  # one shuffle serves the merge and the running counts
    counts = data.groupBy(*by, "x").agg(
        F.count_if(~F.col("_side")).alias("_b"), F.count_if(F.col("_side")).alias("_c")
    )
    totals = counts.groupBy(*by).agg(
        F.sum("_b").alias("nb"), F.sum("_c").alias("nc"), F.min("x").alias("_x0")
    )
    cum = running_sums(counts, by, ["x"], {"_cb": F.col("_b"), "_cc": F.col("_c")}, limit)
    gap = lambda b, c: F.abs(b / F.col("nb") - c / F.col("nc"))
    after = gap(F.col("_cb"), F.col("_cc"))
    before = gap(F.col("_cb") - F.col("_b"), F.col("_cc") - F.col("_c"))
    area = (F.col("x") - F.col("_x0")) * (before - after)
    return cum.join(totals, by).groupBy(*by).agg(
        F.max("nb").alias("nb"), F.max("nc").alias("nc"), F.sum(area).alias("w1")
    )
