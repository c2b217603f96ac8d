"""Near-duplicate detection with MinHash: banding, signature check, exact check, connected components.

A document's set is its distinct five-word shingles (ASCII letters folded).  Equal sets are one class from the
start, found by a 128-bit digest, so copies cost one row each.  Every class has ``SKETCH`` minima of universal hash
functions; some of them make a band key, and classes that share a key of any band are candidates.  How many is derived
from the threshold (:func:`banding`): at 0.85 bands of 8, at 0.80 bands of 6.  A pair at the threshold misses all bands
with probability (1 - 0.85^8)^48 = 2e-7, or (1 - 0.8^6)^64 = 3e-9.

Candidates are linked to one pivot per bucket first, which is linear in the bucket.  Pairs are then checked on
their signatures, confirmed on their full sets, and joined to components.  A second pass takes up those buckets that
still hold several components, so a link between members other than the pivot is not lost: members of different
components meet block by block in numpy, and only pairs whose signatures agree become rows.

Null texts and texts without words have an empty set and are linked with nothing.  Rows with one id count as one
document; repeated rows are equal sets.  A null id is never the smallest of a group that has ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meander.llm.common import materialised, sliced
from meander.llm.components import components

SHINGLE = 5
SKETCH = 384  # minima; their low 16 bits make the signature check
MAX_ROWS = 32  # minima of a band at most
MISS = 3e-7  # probability that a pair at the threshold shares no band, at most
DEVIATIONS = 5.25  # of the signature estimate: how far below the threshold a pair is still checked in full
BUCKETS = 1 << 20
BLOCK = 1024  # members of a bucket that meet in one task at a time

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WORDS = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _rng.integers(1, 1 << 63, (SKETCH, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, (SKETCH, 1), dtype=np.uint64)
_KEY = _rng.integers(1, 1 << 63, MAX_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS = np.ones(64, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.append(np.uint64(1), np.full(2 * n, _STEP)), dtype=np.uint64)
    return _POWERS


_powers(256)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not text:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(text.encode().lower(), np.uint8)  # bytes.lower folds A-Z only
    word = ~_SPACE[raw]
    edge = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    starts = np.concatenate([[0], edge]) if word[0] else edge
    if not len(starts):
        return np.empty(0, np.uint64)
    raw, word = raw[starts[0] :], word[starts[0] :]
    starts = starts - starts[0]
    lengths = np.diff(np.append(starts, len(raw)))
    place = np.arange(len(raw)) - np.repeat(starts, lengths)
    values = np.where(word, _BYTE[raw] * _powers(int(lengths.max()))[place], np.uint64(0))
    w = _mix(np.add.reduceat(values, starts))
    n = max(1, len(w) - SHINGLE + 1)
    h = np.full(n, np.uint64(len(w) if len(w) < SHINGLE else 0), np.uint64)
    for j in range(min(SHINGLE, len(w))):
        h += w[j : j + n] * _WORDS[j]
    return np.unique(_mix(h))


def banding(percent: int) -> int:
    """Minima of a band: as many as keep a pair at ``percent`` in some band but for a probability of ``MISS``."""
    s = percent / 100
    fit = [r for r in range(1, MAX_ROWS + 1) if (1 - s**r) ** (SKETCH // r) <= MISS] if 0 < s <= 1 else []
    if not fit:
        raise ValueError(f"no banding of {SKETCH} minima finds pairs at {percent} percent")
    return max(fit)


def lowest(percent: int) -> float:
    """The signature estimate that a pair at ``percent`` stays above."""
    s = percent / 100
    return s - DEVIATIONS * (s * (1 - s) / SKETCH) ** 0.5


def minima(h: np.ndarray) -> np.ndarray:
    """The upper 32 bits of the least (a x + b) mod 2^64 for each function."""
    x = (h >> np.uint64(32))[None, :]
    out = np.empty(SKETCH, np.uint64)
    width = max(1, min(SKETCH, (1 << 15) // len(h)))
    for i in range(0, len(out), width):
        v = _A[i : i + width] * x
        v += _B[i : i + width]
        out[i : i + width] = v.min(axis=1)
    return out >> np.uint64(32)


def band_keys(m: np.ndarray, size: int) -> np.ndarray:
    """One key for each ``size`` minima; left-over ones have none."""
    bands = SKETCH // size
    rows = m[: bands * size].reshape(bands, size) * _KEY[:size]
    return _mix(rows.sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * _STEP).view(np.int64)


def signatures(docs: DataFrame, *, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, d1, d2`` (digest of the set), ``keys`` (of the bands), ``sketch``."""
    size = banding(percent)

    def run(batches):
        for batch in sliced(batches):
            sizes, d1, d2, keys, sketches = [], [], [], [], []
            for body in batch.column(1).to_pylist():
                h = shingles(body)
                sizes.append(len(h))
                d1.append(int(h.sum(dtype=np.uint64).view(np.int64)))
                d2.append(int(_mix(h ^ _STEP).sum(dtype=np.uint64).view(np.int64)))
                if len(h):
                    m = minima(h)
                    keys.append(band_keys(m, size))
                    sketches.append((m & np.uint64(0xFFFF)).astype("<u2").tobytes())
                else:
                    keys.append(None)
                    sketches.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                names=["doc_id", "n_shingles", "d1", "d2", "keys", "sketch"],
            )

    schema = "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>, sketch binary"
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, schema)


def _alike(percent: int):
    """Sizes that allow the similarity at all."""
    return F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * percent


def by_signature(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The ``u, v`` pairs whose signatures agree in at least the ``lowest`` part of their places."""
    low = lowest(percent)
    s = classes.select("rep", "sketch")
    joined = pairs.join(s.select(F.col("rep").alias("v"), F.col("sketch").alias("sv")), "v").join(
        s.select(F.col("rep").alias("u"), F.col("sketch").alias("su")), "u"
    )

    def run(batches):
        for batch in sliced(batches, 4096):
            if batch.num_rows:
                a, b = (
                    np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, SKETCH) for i in (2, 3)
                )
                good = pa.array((a == b).mean(axis=1) >= low)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)],
                                                 names=["u", "v"])

    return joined.select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def within_buckets(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``u, v`` pairs of different components in one bucket whose signatures agree, each from its first common band.

    ``members``: ``key, v, n`` (size), ``c`` (component), ``blocks`` (of the bucket).  Blocks of a bucket meet in pairs.
    """
    low = lowest(percent)
    wide = classes.select(F.col("rep").alias("v"), "keys", "sketch")
    block = F.pmod(F.xxhash64("v"), F.col("blocks"))
    rows = members.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "v", "n", "c"
    ).join(wide, "v").select("key", "lo", "hi", "own", "v", "n", "c", "keys", "sketch")
    rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def pairs(group):
        """Rows: (own, v, n, c, keys, sketch) of one pair of blocks."""
        key, lo, hi = group[0][:3]
        own, v, n, c = (np.array([r[i] for r in group], np.int64) for i in (3, 4, 5, 6))
        sketch = np.frombuffer(b"".join([r[8] for r in group]), "<u2").reshape(len(group), SKETCH)
        out = []
        for i in range(len(group)):
            fit = (v > v[i]) & (c != c[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
            if lo != hi:
                fit &= own != own[i]
            at = np.flatnonzero(fit)
            if len(at):
                near = at[(sketch[at] == sketch[i]).mean(axis=1) >= low]
                # a pair that shares an earlier band comes from there
                out += [(int(v[i]), int(v[j])) for j in near
                        if next(x for x, y in zip(group[i][7], group[j][7], strict=True) if x == y) == key]
        return out

    def run(batches):
        group = []
        for batch in sliced(batches, 1024):
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[:3] != group[0][:3]:
                    out += pairs(group)
                    group = []
                group.append(row)
            yield _pairs(out)
        if group:
            yield _pairs(pairs(group))

    return rows.mapInArrow(run, "u long, v long")


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["u", "v"]
    )


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, doc_id: str, text: str) -> DataFrame:
    """The ``u, v`` pairs whose full sets have ``100 * shared >= percent * union``.

    The texts of u's partners go to u, in portions of about a thousand, each with u's own text in front.  A filter of
    bounded size (hashed ids) keeps most other texts out of the shuffle.
    """
    # only nodes of more than a portion are looked up: a thousandth of the pairs at most
    wide = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / 1000).alias("portions")).where("portions > 1")
    placed = pairs.join(wide, "u", "left").withColumn(
        "portion", F.pmod(F.xxhash64("v"), F.coalesce("portions", F.lit(1)))
    )
    placed = materialised(placed.select("u", "v", "portion"), "placed-pairs")  # read three times below
    need = placed.select("u", "portion", F.lit(1).alias("role"), F.col("v").alias("id")).union(
        placed.select("u", "portion").distinct().select("u", "portion", F.lit(0).alias("role"), F.col("u").alias("id"))
    )
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")
    slots = need.select(slot(F.col("id")).alias("slot")).distinct()  # at most BUCKETS rows
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
    texts = texts.withColumn("slot", slot(F.col("id"))).join(F.broadcast(slots), "slot", "left_semi").drop("slot")
    rows = need.join(texts, "id").select("u", "portion", "role", "id", "text")
    rows = rows.repartition("u", "portion").sortWithinPartitions("u", "portion", "role")

    def run(batches: Iterator[pa.RecordBatch]):
        group, own = None, []
        for batch in sliced(batches):
            us, vs = [], []
            for u, portion, role, key, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != (u, portion):
                    group, own = (u, portion), []
                h = shingles(body)
                if role == 0:
                    own.append(h)
                    continue
                for mine in own:
                    shared = len(np.intersect1d(mine, h, assume_unique=True))
                    if 100 * shared >= percent * (len(mine) + len(h) - shared):
                        us.append(u)
                        vs.append(key)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, *, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id, kept``."""
    signed = materialised(signatures(docs, percent=percent, doc_id=doc_id, text=text), "signatures")
    digest = ["d1", "d2", "n_shingles"]
    groups = signed.where("n_shingles > 0").groupBy(*digest).agg(
        F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")
    )
    groups = materialised(groups, "classes")
    classes = groups.where("rep is not null")

    bands = classes.select("rep", F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("p"), F.count(F.lit(1)).alias("c"))
    shared = shared.where("c > 1").select("key", F.col("p.rep").alias("u"), F.col("p.n").alias("n_u"))
    members = materialised(
        bands.join(shared, "key").select("key", "u", "n_u", F.col("rep").alias("v"), F.col("n").alias("n_v")),
        "buckets",
    )
    stars = members.where("u <> v").where(_alike(percent)).select("u", "v").distinct()
    stars = materialised(stars, "stars")
    near = materialised(by_signature(stars, classes, percent), "candidates")
    links = materialised(confirmed(near, docs, percent, doc_id, text), "links")
    found = components(links)

    # buckets that still hold several components: their other pairs
    c = found.select(F.col("node").alias("v"), "component")
    labelled = members.join(c, "v", "left").select(
        "key", "v", F.col("n_v").alias("n"), F.coalesce("component", "v").alias("c")
    )
    open_keys = labelled.groupBy("key").agg(
        F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("m")
    ).where("low < high").select("key", F.ceil(F.col("m") / BLOCK).alias("blocks"))
    others = within_buckets(labelled.join(open_keys, "key"), classes, percent)
    more = materialised(others.distinct().join(stars, ["u", "v"], "left_anti"), "candidates")
    if not more.isEmpty():
        links = links.union(materialised(confirmed(more, docs, percent, doc_id, text), "links"))
        found = components(links)

    whole = groups.select(*digest, "rep").join(
        found.select(F.col("node").alias("rep"), "component"), "rep", "left"
    ).select(*digest, F.coalesce("component", "rep").alias("component_id"))
    rows = signed.select("doc_id", *digest).join(whole, digest, "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, *, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each group, the one with the smallest id; documents without words all stay.

    Rows with one id and different texts are documents of their own, so no text goes but for a near copy that stays; a row
    without an id is the one that stays only in a group without ids.  Of equal rows one stays.
    """
    # the row in one column, so that no name of it meets one of ours
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("body")
    )
    if rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL").isEmpty():
        # ids name the rows: the same result as below, and the texts are shuffled less
        found = near_duplicates(rows, percent=percent, doc_id="id", text="body")
        return rows.join(found.where("kept").select(F.col("doc_id").alias("id")), "id", "left_semi").select("row.*")
    rows = rows.withColumn("name", F.xxhash64("id", "body"))
    found = near_duplicates(rows, percent=percent, doc_id="name", text="body").select(
        F.col("doc_id").alias("name"), "n_shingles", "component_id"
    ).distinct()
    named = rows.select("name", "id").distinct().join(found, "name")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "name")).alias("first")
    stay = named.where("n_shingles > 0").groupBy("component_id").agg(first).select("first.name")
    one = rows.join(stay, "name", "left_semi").dropDuplicates(["name"])
    wordless = rows.join(named.where("n_shingles = 0").select("name"), "name", "left_semi")
    return one.unionByName(wordless).select("row.*")
