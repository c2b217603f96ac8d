"""Secret scans by corpus-wide ownership frequency, in DataFrame functions only.

Every text is scanned with the base patterns (assignments, access keys, long hex runs) and a wider one for
mixed tokens.  The hash of each candidate is counted over the whole corpus by distinct repositories and
distinct owners: a value that many owners hold, or that one owner's very many repositories hold, is a copied example; one that
few hold looks live.  Base spans always stay and carry the verdict; wider candidates become spans only when they look
live.  Only hashes of the values are stored or shuffled.

Nulls and repeats: a null or empty text has no spans; a null owner or repository counts as one unnamed owner or
repository; repeated rows each get their own, equal result.  Extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meander.llm.common import materialised

# Fixed values of the base scan.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_VALUE_MIN = 6
KINDS = ["assign", "access", "hex", "mixed"]

#: The wider pattern: long runs of token characters; those with a digit and a letter of either case are kept.
MIXED = r"[A-Za-z0-9+/_-]{20,}"

_SPAN = "array<struct<start:int,kind:int,end:int,hash:string>>"
#: Spans are built and texts masked in runs of this many, so that cost grows with the number of spans, not its square.
RUN = 128


def _spans(text: Column, pattern: str, kind: int, keep=None, value_group: int = 0) -> Column:
    """Spans of all matches in code points: pieces between matches and the matches themselves alternate."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = matches if value_group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    steps = F.arrays_zip(
        F.split(text, pattern, -1).alias("piece"), matches.alias("hit"), values.alias("value")
    )

    def add(state: Column, step: Column) -> Column:
        start = state["at"] + F.length(step["piece"])
        end = start + F.length(step["hit"])
        span = F.struct(
            start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"),
            F.sha2(step["value"], 256).alias("hash"),
        )
        good = step["hit"].isNotNull()
        if keep is not None:
            good = good & keep(step["value"])
        return F.struct(
            F.coalesce(end, start).alias("at"),
            F.when(good, F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"),
        )

    def run_spans(bound: Column) -> Column:
        lengths = _runs(bound["steps"], lambda run, _: F.aggregate(
            run, F.lit(0), lambda n, s: n + F.length(s["piece"]) + F.coalesce(F.length(s["hit"]), F.lit(0))))
        return _let(F.struct(bound["steps"].alias("steps"), lengths.alias("lengths")), lambda b: F.flatten(_runs(
            b["steps"], lambda run, r: F.aggregate(
                run,
                F.struct(F.aggregate(F.slice(b["lengths"], F.lit(1), r), F.lit(0), lambda n, x: n + x).alias("at"),
                         F.array().cast(_SPAN).alias("found")),
                add, lambda state: state["found"]))))

    found = _let(F.struct(steps.alias("steps")), run_spans)
    # most texts have no match: they pay one pass of the pattern
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _runs(items: Column, body) -> Column:
    """``body(run, number)`` for each run of ``RUN`` items (one empty run if there are none)."""
    last = F.greatest(F.floor((F.size(items) - 1) / RUN).cast("int"), F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda r: body(F.slice(items, r * RUN + 1, F.lit(RUN)), r))


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", repository: str = "doc_id",
         owner: str = "source") -> DataFrame:
    """One narrow row per document: ``doc_id, text_key, owner, repository, base, wide`` (span arrays)."""
    t = F.coalesce(F.col(text), F.lit(""))
    wide = _spans(
        t, MIXED, 3, lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    )
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(t).alias("text_key"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"),
        F.array_sort(
            F.concat(
                _spans(t, ASSIGN, 0, lambda v: F.length(v) >= ASSIGN_VALUE_MIN, 2),
                _spans(t, ACCESS, 1),
                _spans(t, HEX, 2),
            )
        ).alias("base"),
        wide.alias("wide"),
    )
    return rows.withColumn(
        "wide",
        F.filter("wide", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))),
    )


def ownership(candidates: DataFrame) -> DataFrame:
    """``hash, n_repositories, n_owners, n_found`` over ``hash, owner, repository`` rows; every step pre-aggregates."""
    return (
        candidates.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
        .groupBy("hash").agg(
            F.sum("repositories").alias("n_repositories"),
            F.count(F.lit(1)).alias("n_owners"),
            F.sum("n").alias("n_found"),
        )
    )


def findings(docs: DataFrame, *, example_owners: int = 3, example_repositories: int = 50, doc_id: str = "doc_id", text: str = "text",
             repository: str = "doc_id", owner: str = "source") -> tuple[DataFrame, DataFrame]:
    """``(scanned, found)``.

    ``scanned`` has a row per document (see :func:`scan`).  ``found`` has a row per candidate: ``doc_id, text_key,
    kind, start, end, hash, n_repositories, n_owners, verdict``; verdict is ``example`` for a value held by
    ``example_owners`` owners or more, or by at least ``example_repositories`` repositories for each of its owners, else
    ``live``.  Code points, end exclusive.
    """
    scanned = materialised(
        scan(docs, doc_id=doc_id, text=text, repository=repository, owner=owner), "secret-scan"
    )
    rows = scanned.where(F.size("base") + F.size("wide") > 0).select(
        "doc_id", "text_key", "owner", "repository", F.explode(F.concat("base", "wide")).alias("span")
    ).select(
        "doc_id", "text_key", "owner", "repository", "span.kind", "span.start", "span.end",
        "span.hash",
    )
    found = rows.join(ownership(rows), "hash").select(
        "doc_id", "text_key", "kind", "start", "end", "hash", "n_repositories", "n_owners",
        F.when((F.col("n_owners") >= example_owners)
               | (F.col("n_repositories") >= F.col("n_owners") * example_repositories), "example")
        .otherwise("live").alias("verdict"),
    )
    return scanned, found


def document_spans(docs: DataFrame, **options) -> DataFrame:
    """A row per document: ``doc_id, text_key, base, extra, n_live, n_example`` with spans of ``start, kind, end``."""
    scanned, found = findings(docs, **options)
    per_doc = found.groupBy("doc_id", "text_key").agg(
        F.collect_set(
            F.when((F.col("kind") == 3) & (F.col("verdict") == "live"), F.struct("start", "kind", "end"))
        ).alias("extra"),
        # repeated rows repeat their findings: a span counts once
        F.size(F.collect_set(F.when(F.col("verdict") == "live", F.struct("start", "kind")))).alias("n_live"),
        F.size(F.collect_set(F.when(F.col("verdict") == "example", F.struct("start", "kind")))).alias("n_example"),
    )
    narrow = scanned.select(
        "doc_id", "text_key",
        F.transform(
            "base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
        ).alias("base"),
    )
    a, b = narrow.alias("a"), per_doc.alias("b")
    on = F.expr("a.doc_id <=> b.doc_id AND a.text_key = b.text_key")
    return a.join(b, on, "left").select(
        "a.doc_id", "a.text_key", "a.base",
        F.coalesce("b.extra", F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("extra"),
        F.coalesce("b.n_live", F.lit(0)).alias("n_live"), F.coalesce("b.n_example", F.lit(0)).alias("n_example"),
    )


def digest(spans: Column) -> Column:
    """``kind:start:end`` of spans in order of start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(
        ",",
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string")),
        ),
    )


def masked(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """``text`` with every span replaced by ``mark``; spans that overlap or touch become one mark."""
    def run_text(bound: Column, run: Column, r: Column) -> Column:
        # a run rewrites the text from where the runs before it end to where it ends itself
        begin = F.coalesce(F.array_max(F.slice(bound["ends"], F.lit(1), r)), F.lit(0))
        end = F.greatest(begin, F.coalesce(F.array_max(F.transform(run, lambda s: s["end"])), F.lit(0)))
        own = F.struct(begin.alias("begin"), F.substring(bound["text"], begin + 1, end - begin).alias("part"))

        def rewrite(local: Column) -> Column:
            def step(state: Column, s: Column) -> Column:
                gap = s["start"] > state["at"]
                fresh = gap | ((r == 0) & (F.length(state["out"]) == 0))
                piece = F.when(
                    gap, F.substring(local["part"], state["at"] - local["begin"] + 1, s["start"] - state["at"])
                ).otherwise("")
                return F.struct(
                    F.greatest(state["at"], s["end"]).alias("at"),
                    F.concat(state["out"], piece, F.when(fresh, mark).otherwise("")).alias("out"),
                )

            start = F.struct(local["begin"].alias("at"), F.lit("").alias("out"))
            return F.aggregate(run, start, step, lambda state: state["out"])

        return _let(own, rewrite)

    def whole(bound: Column) -> Column:
        tail = F.substring(bound["text"], F.coalesce(F.array_max(bound["ends"]), F.lit(0)) + 1, F.length(bound["text"]))
        return F.concat(F.array_join(_runs(bound["spans"], lambda run, r: run_text(bound, run, r)), ""), tail)

    ends = lambda b: _runs(
        b["spans"], lambda run, _: F.coalesce(F.array_max(F.transform(run, lambda s: s["end"])), F.lit(0)))
    return _let(
        F.struct(text.alias("text"), F.array_sort(spans).alias("spans")),
        lambda b: _let(F.struct(b["text"].alias("text"), b["spans"].alias("spans"), ends(b).alias("ends")), whole),
    )


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the secrets of ``text`` masked and ``n_chars`` brought up to date; all other columns stay.

    Masked are the base spans and the wider ones that look live.  Documents without secrets stay as they are.
    """
    spans = document_spans(docs, **options).where(F.size("base") + F.size("extra") > 0).select(
        "doc_id", "text_key", F.concat("base", "extra").alias("spans"),
    ).dropDuplicates(["doc_id", "text_key"])
    key, text = options.get("doc_id", "doc_id"), options.get("text", "text")
    # the row in one column, so that no name of it meets one of ours
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("id"),
                       F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("own"))
    joined = rows.alias("r").join(spans.alias("s"), F.expr("r.id <=> s.doc_id AND r.own = s.text_key"), "left")
    found, old = F.col("s.spans"), F.col("r.row")
    clean = F.when(found.isNull(), old[text]).otherwise(masked(old[text], found))
    out = joined.select("r.row", found.isNotNull().alias("changed"), clean.alias("clean"))
    made = {text: F.col("clean")}
    if "n_chars" in docs.columns:
        fresh = F.when(F.col("changed"), F.length("clean")).otherwise(F.col("row")["n_chars"])
        made["n_chars"] = fresh.cast(docs.schema["n_chars"].dataType)
    return out.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
