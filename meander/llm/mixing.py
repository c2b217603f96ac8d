"""Mixing sources to target weights by entropy balancing.

Document rates w stay as near to 1 as the token constraints allow: of all rates in [0, cap] that give each source
its target words, those with the least relative entropy are w = min(cap, exp(lambda * x)), x being a document's
size over its source's mean.  The convex dual has one lambda per source; distributed Newton steps, kept inside a
bracket, solve it on counts per source and size.  Rates then become whole copies: running totals of expected
copies are rounded along the sizes of a source, and what is left of the target goes to single documents of fitting
size.  All state is a table with a row per source or per source and size; the driver sees single numbers only.
Windows add up a source's sizes, so that a step is no join and a few small jobs solve it all; a source with more than
``group_limit`` different sizes (2,000,000 take 2 * 10^12 words) is added up by tasks of its parts and joined.

Null texts have size 0; a null source is a source of its own, last in order; repeated rows are documents of their
own; an empty table gives an empty mix.  Extra columns are ignored (``repeated`` keeps them).
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meander.functions.ordering import GROUP_LIMIT, known, numbered, running_sums
from meander.llm.common import WORD, materialised

GROUP_ROWS = 10_000


def source_key(source: str) -> Column:
    """A key that is never null and sorts by code point with null last."""
    return F.when(F.col(source).isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), F.col(source).cast("string")))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_targets(sources: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5,
                   cap: float = 2.0) -> DataFrame:
    """``src, source_size, target``: weights repeat over the sources in order, targets stop at ``cap`` times the size.

    Resharing what is above the caps raises one level t in target = min(cap * size, t * weight); each round is one
    aggregation over the sources.
    """
    ranked = numbered(sources.withColumn("all", F.lit(0)), ["all"], ["src"], "rank")
    weight = F.array(*[F.lit(float(w)) for w in weights])[((F.col("rank") - 1) % len(weights)).cast("int")]
    rows = materialised(
        ranked.select("src", "source_size", "n_docs", weight.alias("weight"),
                      (F.col("source_size") * F.lit(float(cap))).alias("most")), "mix-sources"
    )
    total, all_weight = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return rows.select("src", "source_size", "n_docs", F.lit(0.0).alias("target"), "most")
    wanted, level = share * total, share * total / all_weight
    while True:
        above = F.col("most") <= F.col("weight") * F.lit(level)
        fixed, free = rows.agg(
            F.sum(F.when(above, F.col("most")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))
        ).first()
        if not free:
            break
        higher = (wanted - fixed) / free
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    return rows.select("src", "source_size", "n_docs",
                       F.least("most", F.col("weight") * F.lit(level)).alias("target"), "most")


def _rate(cap: float) -> Column:
    tilt = F.least(F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("lam") * F.col("x")))), F.lit(cap))
    return F.when(F.col("full"), F.lit(cap)).otherwise(tilt)


def _with_totals(rows: DataFrame, group_limit: int | None, totals: dict[str, Column]) -> DataFrame:
    """``rows`` plus totals over their source: a window over its sizes, or a join where these are too many for a task.

    The window reads the sizes in their order, so a rerun adds doubles in the same order.
    """
    if group_limit is None:
        w = Window.partitionBy("src").orderBy("size")
        w = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return rows.withColumns({name: total.over(w) for name, total in totals.items()})
    sums = rows.groupBy(F.col("src").alias("s")).agg(*[total.alias(name) for name, total in totals.items()])
    return rows.join(sums, F.col("src") == F.col("s")).drop("s")


def balance(sizes: DataFrame, targets: DataFrame, cap: float = 2.0, tolerance: float = 1e-7,
            rounds: int = 25, group_limit: int | None = GROUP_LIMIT) -> DataFrame:
    """``sizes`` plus the columns of ``targets`` and the dual solution ``lam`` of each row's source.

    ``sizes``: ``src, size, n`` counts.  Every round takes three Newton steps; a step that leaves the bracket of the
    root is replaced by its middle.  The state stands beside each size of its source, so that a round is one small job.
    """
    big = 1e6
    group_limit = known(sizes, ["src"], group_limit)
    state = sizes.join(targets, "src").withColumns({
        "mean": F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1e-9)),
        "full": F.col("target") >= F.col("most") * (1 - 1e-12),
        "lam": F.lit(0.0), "low": F.lit(-big), "high": F.lit(big), "gap": F.lit(1.0),
    })
    columns = state.columns
    for _ in range(rounds):
        for _ in range(3):
            w = state.withColumn("x", F.col("size") / F.col("mean")).withColumn("w", _rate(cap))
            w = w.withColumn("words", F.col("n") * F.col("size") * F.col("w"))
            step = _with_totals(w, group_limit, {
                "got": F.sum("words"),
                "slope": F.sum(F.when(F.col("w") < cap, F.col("words") * F.col("x")).otherwise(0.0)),
            }).withColumn("over", F.col("got") - F.col("target"))
            step = step.withColumns({
                "low": F.when(F.col("over") < 0, F.col("lam")).otherwise(F.col("low")),
                "high": F.when(F.col("over") > 0, F.col("lam")).otherwise(F.col("high")),
                "gap": F.when(F.col("full") | (F.col("target") <= 0), 0.0)
                .otherwise(F.abs(F.col("over")) / F.col("target")),
            })
            newton = F.when(F.col("slope") > 0, F.col("lam") - F.col("over") / F.col("slope"))
            inside = newton.isNotNull() & (newton > F.col("low")) & (newton < F.col("high"))
            middle = (F.greatest("low", F.col("lam") - 64.0) + F.least("high", F.col("lam") + 64.0)) / 2
            middle = F.when(F.abs(middle - F.col("lam")) < 1e-300,
                            F.col("lam") + F.when(F.col("over") < 0, 1.0).otherwise(-1.0)).otherwise(middle)
            moved = F.when(F.col("gap") <= tolerance, F.col("lam")).when(inside, newton).otherwise(middle)
            state = step.withColumn("lam", moved).select(*columns)
        state = materialised(state, "mix-dual")
        if (gap := state.agg(F.max("gap")).first()[0] or 0.0) <= tolerance:
            break
    else:
        warnings.warn(f"after {rounds} rounds a source is {gap:.1e} of its target away from it", stacklevel=2)
    return state


def whole_copies(dual: DataFrame, cap: float = 2.0, passes: int = 6,
                 group_limit: int | None = GROUP_LIMIT) -> DataFrame:
    """``src, size, n, copies, rate, source_size, target``: whole copies per source and size, near each target."""
    group_limit = known(dual, ["src"], group_limit)
    rates = dual.withColumn("x", F.col("size") / F.col("mean")).withColumn("rate", _rate(cap))
    rates = rates.withColumn("expected", F.round(F.col("n") * F.col("rate"), 9)).withColumn("_down", -F.col("size"))
    run = running_sums(
        rates.select("src", "size", "n", "rate", "expected", "source_size", "target", "_down"), ["src"], ["_down"],
        {"sum": F.col("expected")}, group_limit,
    )
    upto, before = F.floor(F.col("sum") + 0.5), F.floor(F.col("sum") - F.col("expected") + 0.5)
    most = (F.col("n") * cap).cast("long")
    groups = run.select("src", "size", "n", "rate", "source_size", "target",
                        F.greatest(F.lit(0), F.least(most, upto - before)).cast("long").alias("copies"))
    groups = _with_totals(groups, group_limit, {"words": F.sum(F.col("copies") * F.col("size"))})
    left = F.col("target") - F.col("words")
    gap = F.abs(left)
    room = F.when(left > 0, most - F.col("copies")).otherwise(F.col("copies"))
    # the size whose copies, as many as fit or one too large, come nearest
    times = F.greatest(F.lit(1), F.least("room", F.floor(gap / F.nullif(F.col("size"), F.lit(0)))))
    fitting = F.when(
        (F.col("size") > 0) & (F.col("room") > 0) & (F.col("size") < 2 * gap),
        F.struct(F.abs(gap - F.col("times") * F.col("size")).alias("rest"), (-F.col("size")).alias("down"), "times"),
    )
    more = F.coalesce(F.col("best.times") * F.signum(left), F.lit(0)).cast("long")
    for i in range(passes):
        if group_limit is not None or i % 3 == 0:  # each window holds a source's sizes, so at most three in a row
            groups = materialised(groups, "mix-copies")
        rows = groups.withColumn("room", room).withColumn("times", times).withColumn("fitting", fitting)
        found = _with_totals(rows, group_limit, {"best": F.min("fitting")}).withColumn("more", more)
        chosen = F.coalesce(F.col("size") == -F.col("best.down"), F.lit(False))
        groups = found.withColumns({
            "copies": F.col("copies") + F.when(chosen, F.col("more")).otherwise(0),
            "words": F.col("words") - F.coalesce(F.col("best.down"), F.lit(0)) * F.col("more"),
        }).select(*groups.columns)
    return materialised(groups.drop("words"), "mix-copies")


def spread(sized: DataFrame, groups: DataFrame) -> DataFrame:
    """``sized`` plus ``copies, rate, source_size, target``: a group's copies go evenly to its documents, in the order of
    a hash.

    A group beyond ``GROUP_ROWS`` is cut into subgroups by the hash; each gets its share of the copies.
    """
    g = groups.select(F.col("src").alias("s"), F.col("size").alias("z"), "n", "copies", "rate", "source_size", "target")
    subs = F.ceil(F.col("n") / GROUP_ROWS)
    rows = sized.join(g, (F.col("src") == F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z")
    rows = rows.withColumn("sub", F.pmod(F.xxhash64("doc_id", "mark"), subs))
    counts = rows.groupBy("src", "size", "sub").agg(
        F.count(F.lit(1)).alias("here"), F.max("n").alias("_n"), F.max("copies").alias("_copies")
    )
    w = Window.partitionBy("src", "size").orderBy("sub").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("upto", F.sum("here").over(w))
    share = F.floor(F.col("_copies") * F.col("upto") / F.col("_n")) - F.floor(
        F.col("_copies") * (F.col("upto") - F.col("here")) / F.col("_n")
    )
    counts = counts.select(F.col("src").alias("s"), F.col("size").alias("z"), F.col("sub").alias("u"), "here",
                           share.alias("share"))
    ranked = rows.withColumn(
        "place", F.row_number().over(
            Window.partitionBy("src", "size", "sub").orderBy(F.xxhash64("mark", "doc_id"), "doc_id", "mark"))
    )
    joined = ranked.join(
        counts, (F.col("src") == F.col("s")) & (F.col("size") == F.col("z")) & (F.col("sub") == F.col("u"))
    )
    whole = F.floor(F.col("share") / F.col("here"))
    copies = whole + (F.col("place") <= F.col("share") - whole * F.col("here")).cast("long")
    return joined.withColumn("copies", copies.cast("long")).drop("s", "z", "u", "n", "sub", "here", "share", "place")


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2,
        doc_id: str = "doc_id", source: str = "source", text: str = "text",
        group_limit: int | None = GROUP_LIMIT) -> DataFrame:
    """Per document: ``doc_id, mark, size, source_size, target, copies, taken, rate`` (``mark`` is a hash of the text)."""
    sized = materialised(
        docs.select(
            F.col(doc_id).alias("doc_id"), source_key(source).alias("src"), word_count(F.col(text)).alias("size"),
            F.xxhash64(text).alias("mark"),
        ), "mix-sizes",
    )
    sizes = materialised(sized.groupBy("src", "size").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    sources = sizes.groupBy("src").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs")
    )
    targets = shared_targets(sources, weights, share, float(cap))
    group_limit = known(sizes, ["src"], group_limit)
    dual = balance(sizes, targets, float(cap), group_limit=group_limit)
    return spread(sized, whole_copies(dual, float(cap), group_limit=group_limit)).select(
        "doc_id", "mark", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
        "rate",
    )


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as its copies say, with the columns of ``docs``.

    Equal rows share their copies evenly, so their number over all of them is what the mix gives.
    """
    copies = mix(docs, **options)
    key, text, src = (options.get(c, c) for c in ("doc_id", "text", "source"))
    totals = copies.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list("copies")).alias("all"))
    # the row in one column, so that no name of it meets one of ours
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("id"), F.xxhash64(text).alias("mark"),
                       source_key(src).alias("src"))
    # a place among the rows of one id and text: one, unless rows are repeated
    place = F.row_number().over(Window.partitionBy("id", "mark").orderBy("src"))
    joined = rows.withColumn("nth", place).alias("r").join(
        totals.alias("t"), F.expr("r.id <=> t.doc_id AND r.mark = t.mark")
    )
    times = F.array_repeat(F.lit(1), F.element_at("t.all", F.col("r.nth")).cast("int"))
    return joined.select("r.row", F.explode(times).alias("copy")).select("row.*")
