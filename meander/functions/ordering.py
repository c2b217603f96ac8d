"""Ordered computations that hold when one key owns a third of the rows.

``Window.partitionBy(key)`` sends a whole key to one task.  The functions here
keep that plan only while the largest key is known to be small; past the
limit the rows are range-partitioned by ``(key, order)`` instead, so a hot key
is spread over many tasks and only per-partition totals meet again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meander.functions.columns import null_safe_equal
from meander.functions.runtime import cut_lineage

GROUP_LIMIT = 2_000_000
CHUNK_ROWS = 100_000


def largest_group(df: DataFrame, by: list[str]) -> int:
    """Row count of the largest key (partial counts, one number back)."""
    row = df.groupBy(*by).count().agg(F.max("count")).first()
    return int(row[0] or 0)


def fits(df: DataFrame, by: list[str], group_limit: int | None) -> bool:
    """Whether every key is small enough for one task.

    ``None`` and 0 are answers already known: yes and no.
    """
    if group_limit is None:
        return True
    return group_limit > 0 and largest_group(df, by) <= group_limit


def known(df: DataFrame, by: list[str], group_limit: int | None) -> int | None:
    """Check once; pass the answer on as the ``group_limit`` of later steps on the same keys."""
    return None if fits(df, by, group_limit) else 0


def running_sums(
    df: DataFrame,
    by: list[str],
    order: list[str],
    sums: dict[str, Column],
    group_limit: int | None = GROUP_LIMIT,
) -> DataFrame:
    """Add inclusive running totals per ``by`` in ``order`` (which must be total)."""
    if fits(df, by, group_limit):
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: F.sum(c).over(w) for name, c in sums.items()})
    return _spread_running_sums(df, by, order, sums)


def _spread_running_sums(
    df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]
) -> DataFrame:
    ranged = df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id())
    ranged = cut_lineage(ranged.withColumns({f"_w_{n}": c for n, c in sums.items()}))
    segment = ["_part", *by]
    local = Window.partitionBy(*segment).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.withColumns({n: F.sum(f"_w_{n}").over(local) for n in sums})

    totals = ranged.groupBy(*segment).agg(*[F.sum(f"_w_{n}").alias(f"_t_{n}") for n in sums])
    # one row per key and partition: never more rows than partitions for one key
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*segment, *[F.sum(f"_t_{n}").over(earlier).alias(f"_o_{n}") for n in sums])

    joined = rows.alias("r").join(
        offsets.alias("o"), null_safe_equal(_Side("r"), _Side("o"), segment), "left"
    )
    keep = [F.col(f"r.{c}") for c in df.columns]
    out = [
        (F.col(f"r.{n}") + F.coalesce(F.col(f"o._o_{n}"), F.lit(0))).alias(n) for n in sums
    ]
    return joined.select(*keep, *out)


class _Side:
    """Qualified column access for a join condition built from names."""

    def __init__(self, alias: str):
        self.alias = alias

    def __getitem__(self, name: str) -> Column:
        return F.col(f"{self.alias}.{name}")


def numbered(
    df: DataFrame, by: list[str], order: list[str], name: str = "rn", group_limit: int | None = GROUP_LIMIT
) -> DataFrame:
    """``row_number`` per key as a running count."""
    return running_sums(df, by, order, {name: F.lit(1).cast("long")}, group_limit)


def framed(
    df: DataFrame,
    by: list[str],
    order: list[str],
    preceding: int,
    group_limit: int | None = GROUP_LIMIT,
    chunk_rows: int = CHUNK_ROWS,
) -> tuple[DataFrame, Window]:
    """Prepare row frames that look back at most ``preceding`` rows.

    Returns the rows and an ordered window spec.  Rows of a hot key are cut into
    chunks; each chunk also receives the last ``preceding`` rows of the one
    before it, marked ``_halo``, which the caller drops with :func:`drop_halo`
    after computing its windows.
    """
    if fits(df, by, group_limit):
        rows = df.withColumn("_halo", F.lit(False))
        return rows, Window.partitionBy(*by).orderBy(*order)

    size = max(chunk_rows, preceding)
    rows = _spread_running_sums(df, by, order, {"_rn": F.lit(1).cast("long")})
    own = F.floor((F.col("_rn") - 1) / size)
    in_tail = F.pmod(F.col("_rn") - 1, F.lit(size)) >= size - preceding
    rows = rows.withColumn(
        "_chunk", F.explode(F.when(in_tail, F.array(own, own + 1)).otherwise(F.array(own)))
    ).withColumn("_halo", F.col("_chunk") != own)
    return rows, Window.partitionBy(*by, "_chunk").orderBy("_rn")


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("_halo")).drop("_halo", "_chunk", "_rn")


def order_statistics(
    df: DataFrame,
    by: list[str],
    value: str,
    probs: list[float],
    group_limit: int | None = GROUP_LIMIT,
) -> DataFrame:
    """Exact linear-interpolation quantiles, with count, min and max, per key.

    Small keys use the built-in exact percentile.  Otherwise equal values are
    merged first (map-side) and ranks come from running counts, so neither a hot
    key nor a heavily repeated value lands in one task.
    """
    present = df.filter(F.col(value).isNotNull())
    if fits(present, by, group_limit):
        q = F.percentile(value, F.array(*[F.lit(float(p)) for p in probs]))
        agg = present.groupBy(*by).agg(
            F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), q.alias("_q")
        )
        return agg.select(*by, "n", "lo", "hi", *[F.col("_q")[i].alias(f"q{i}") for i in range(len(probs))])

    counts = present.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    stats = counts.groupBy(*by).agg(
        F.sum("_c").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")
    )
    cum = _spread_running_sums(counts, by, [value], {"_cum": F.col("_c")})
    joined = cum.alias("r").join(stats.alias("s"), null_safe_equal(_Side("r"), _Side("s"), by))
    aggs = []
    for i, p in enumerate(probs):
        pos = F.col("s.n").cast("double") - 1.0
        pos = pos * F.lit(float(p))
        low_rank, high_rank = F.floor(pos) + 1, F.ceil(pos) + 1
        covers = lambda rank: (F.col("r._cum") >= rank) & (F.col("r._cum") - F.col("r._c") < rank)
        v = F.col(f"r.{value}")
        aggs += [
            F.max(F.when(covers(low_rank), v)).alias(f"_l{i}"),
            F.max(F.when(covers(high_rank), v)).alias(f"_h{i}"),
            F.max(pos - F.floor(pos)).alias(f"_f{i}"),
        ]
    keys = [F.col(f"r.{b}").alias(b) for b in by]
    out = joined.groupBy(*keys).agg(
        F.max("s.n").alias("n"), F.max("s.lo").alias("lo"), F.max("s.hi").alias("hi"), *aggs
    )
    return out.select(
        *by, "n", "lo", "hi",
        *[
            (F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_f{i}")).alias(f"q{i}")
            for i in range(len(probs))
        ],
    )
