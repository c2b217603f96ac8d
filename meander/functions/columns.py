"""Small column expressions used in many operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_seconds(ts: str | Column) -> Column:
    """``timestamp_ntz`` to epoch seconds, whatever the session time zone is."""
    c = F.col(ts) if isinstance(ts, str) else ts
    zero = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    return F.timestamp_diff("MICROSECOND", zero, c.cast("timestamp_ntz")) / F.lit(1e6)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c))


def rounded(c: Column, digits: int = 6) -> Column:
    """Round for output; adding zero turns ``-0.0`` into ``0.0``."""
    return F.round(c, digits) + F.lit(0.0)


def stable_id(*parts: Column) -> Column:
    """Deterministic identifier of a row from its identifying columns."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("|", *texts), 256)


def md5_unit(*parts: Column) -> Column:
    """Uniform number in (0, 1) from the first 8 hex digits of an md5."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def to_doubles(vec: str | Column) -> Column:
    c = F.col(vec) if isinstance(vec, str) else vec
    return c.cast("array<double>")


def null_safe_equal(left, right, names) -> Column:
    """Equi-join condition that also matches nulls."""
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])
