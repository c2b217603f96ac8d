"""Near-duplicates by SimHash and multi-index hashing.

A document's fingerprint takes the majority of every bit over the XXH64 values of its four-word shingles (repeats
count).  Equal fingerprints are one class from the start, so copies cost one row each.

Fingerprints at ``distance`` or fewer differing bits are found by multi-index hashing: the 64 bits are cut into
segments, each with a radius, so that radii plus one add up to ``distance + 1``.  Two linked fingerprints then lie within
the radius in some segment.  A fingerprint is written under its own segment value and under those of a small Hamming
ball around it, and all that meet under one value are verified on their complete 64 bits.  Radius 1 needs only the flips
of zero bits (the other one of a pair has that bit set), radius 2 all single flips (a pair meets half way).  How many
segments there are follows from the number of fingerprints; any layout finds the same links.

Members of one value are searched breadth first: each reached member is compared with those not reached yet, so a dense
group of near copies costs about one comparison per member and gives a spanning forest, never all pairs.  Values with
more than ``SPLIT`` members are dealt anew by segments of their other bits before they are searched.

Null texts and texts without words have fingerprint zero and are linked like any other.  Rows are documents of their
own: rows that share an id may have different fingerprints.  A null id never names a component that has ids; a component
without ids has a null name.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meander.llm.common import materialised, pieces, sliced
from meander.llm.components import components

SHINGLE = 4
SEED = 42
SPLIT = 1 << 16  # members of one value that are searched together; more are dealt anew
SHORT = 12  # groups of at most so many members are compared by shifts
TOGETHER = 1 << 20  # bytes of texts whose shingles are hashed together; a longer text goes in pieces

_PLACE = np.arange(8, dtype=np.int64) * 256
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_UNIT = np.uint64(1) << np.arange(64, dtype=np.uint64)
_SPREAD = _BITS.astype(np.uint8).view("<u8").ravel()  # of a byte, a byte per bit
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_FIRST = np.array([[int(_P1) + int(_P2) & 2**64 - 1], [int(_P2)], [0], [2**64 - int(_P1)]], np.uint64)


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    if not text:
        return 0
    counts = np.zeros(8 * 256, np.int64)
    digest, total, last, short = xxhash.xxh64_intdigest, 0, [], True
    for piece in pieces(text.encode().lower(), rb"[\x20\x09-\x0D]"):  # bytes.lower folds A-Z only
        words = last + piece.split()  # at ASCII white space
        if len(words) < SHINGLE:
            last = words
            continue
        short = False
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.append(0, ends[: -SHINGLE] + 1).tolist()
        values = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)]
        values = np.array(values, "<u8")
        counts += np.bincount((values.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=8 * 256)
        total += len(values)
        last = words[-(SHINGLE - 1) :]
    if short:
        return digest(b" ".join(last), SEED) if last else 0
    ones = (counts.reshape(8, 256) @ _BITS).ravel()
    return int(_UNIT[2 * ones > total].sum(dtype=np.uint64))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _mixed(lane: np.ndarray) -> np.ndarray:
    return _turn(lane * _P2, 31) * _P1


def digests(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XXH64 of stretches of ``raw`` (bytes, 8 of them behind the last stretch), those of like sizes together."""
    eight = np.ascontiguousarray(np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,)))  # the number at every byte
    four = np.uint64((1 << 32) - 1)
    key = ((size & 31) * 2 + (size >= 32)).astype(np.uint8)
    order = np.argsort(key, kind="stable")
    ends = np.cumsum(np.bincount(key, minlength=64))
    out = np.empty(len(start), np.uint64)
    for k in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
        own = order[ends[k - 1] if k else 0 : ends[k]]
        at, n = start[own], size[own]
        if k % 2:
            lanes = np.tile(np.full((4, 1), np.uint64(SEED)) + _FIRST, len(own))
            stripes = n >> 5
            for t in range(int(stripes.max())):
                more = np.flatnonzero(stripes > t)
                for i in range(4):
                    lanes[i, more] = _turn(lanes[i, more] + eight[at[more] + (32 * t + 8 * i)] * _P2, 31) * _P1
            h = _turn(lanes[0], 1) + _turn(lanes[1], 7) + _turn(lanes[2], 12) + _turn(lanes[3], 18)
            for i in range(4):
                h = (h ^ _mixed(lanes[i])) * _P1 + _P4
            at = at + 32 * stripes
        else:
            h = np.full(len(own), np.uint64(SEED) + _P5)
        h = h + n.astype(np.uint64)
        rest = k // 2
        for _ in range(rest // 8):
            h = _turn(h ^ _mixed(eight[at]), 27) * _P1 + _P4
            at = at + 8
        if rest & 4:
            h = _turn(h ^ ((eight[at] & four) * _P1), 23) * _P2 + _P3
            at = at + 4
        for _ in range(rest & 3):
            h = _turn(h ^ (raw[at].astype(np.uint64) * _P5), 11) * _P1
            at = at + 1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        out[own] = h ^ (h >> np.uint64(32))
    return out


def _together(texts: list[bytes]) -> np.ndarray:
    """Fingerprints of texts of at least ``SHINGLE`` words, in lower case with one space between words."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n" + bytes(8), np.uint8)
    stop = np.flatnonzero((raw[:-8] == 32) | (raw[:-8] == 10))  # where words end; no other white space is left
    begin = np.append(0, stop[:-1] + 1)
    last = np.flatnonzero(raw[stop] == 10)  # words that end a text
    words = np.diff(last, prepend=-1)
    # a word begins a shingle but for the last ones of each text
    first = np.ones(len(stop), bool)
    for i in range(SHINGLE - 1):
        first[last - i] = False
    first = np.flatnonzero(first)
    values = digests(raw, begin[first], stop[first + SHINGLE - 1] - begin[first])
    total = words - (SHINGLE - 1)
    edge = np.cumsum(total) - total
    # bits are added up as bytes of a number, of at most 255 shingles each, and these by text
    cut = [np.arange(a, a + n, 255) for a, n in zip(edge.tolist(), total.tolist(), strict=True)]
    some = np.add.reduceat(_SPREAD[values.astype("<u8").view(np.uint8).reshape(-1, 8)], np.concatenate(cut), axis=0)
    parts = np.array([len(c) for c in cut])
    ones = np.add.reduceat(some.view(np.uint8).reshape(-1, 64).astype(np.int64), np.cumsum(parts) - parts, axis=0)
    return np.where(2 * ones > total[:, None], _UNIT, np.uint64(0)).sum(axis=1, dtype=np.uint64)


def prints_of(texts: list[str | None]) -> np.ndarray:
    """The fingerprints of texts: the same as :func:`fingerprint` of each, with the shingles of many hashed together."""
    out = np.zeros(len(texts), np.uint64)
    at, held, size = [], [], 0

    def closed():
        if at:
            out[at] = _together(held)
        return [], [], 0

    for i, text in enumerate(texts):
        if not text:
            continue
        if len(text) > TOGETHER:
            out[i] = fingerprint(text)
            continue
        words = text.encode().lower().split()
        if len(words) < SHINGLE:
            out[i] = xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
            continue
        at.append(i)
        held.append(b" ".join(words))
        size += len(held[-1])
        if size > TOGETHER:
            at, held, size = closed()
    closed()
    return out


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, print`` per row; ``print`` is the fingerprint as a signed long."""

    def run(batches):
        for batch in sliced(batches):
            found = prints_of(batch.column(1).to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "print"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, print long")


def layout(bits: int, distance: int, parts: int) -> list[tuple[int, int, int]]:
    """``(offset, width, radius)`` of the segments: widths are even, radii plus one add up to ``distance + 1``."""
    radii = [(distance + 1) // parts - 1 + (i < (distance + 1) % parts) for i in range(parts)]
    widths = [bits // parts + (i < bits % parts) for i in range(parts)]
    return [(sum(widths[:i]), w, r) for i, (w, r) in enumerate(zip(widths, radii, strict=True))]


def _rows(width: int, radius: int) -> float:
    return 1 + (0, width / 2, width)[radius]


def cheapest(n: int, distance: int, bits: int = 64) -> list[tuple[int, int, int]]:
    """The layout with the fewest rows and chance meetings for ``n`` fingerprints."""
    if distance < 1:
        raise ValueError("distance is at least 1: equal fingerprints are one class already")
    fit = [layout(bits, distance, p) for p in range(max(2, -(-(distance + 1) // 3)), distance + 2)]

    def cost(segments):
        rows = [n * _rows(w, r) for _, w, r in segments]
        return sum(rows) + sum(0.02 * x * x / 2**w for x, (_, w, _) in zip(rows, segments, strict=True))

    return min(fit, key=cost)


def _keys(bits: Column, segments: list[tuple[int, int, int]]) -> Column:
    """The values a fingerprint is written under, tagged with their segment."""
    out = []
    for i, (offset, width, radius) in enumerate(segments):
        value = F.shiftrightunsigned(bits, offset).bitwiseAND(F.lit((1 << width) - 1))
        own = value.bitwiseOR(F.lit(i << 40))
        flips = F.array(*[F.lit(1 << b).cast("long") for b in range(width)])
        out.append(F.array(own))
        if radius == 1:
            free = F.filter(flips, lambda m, value=value: value.bitwiseAND(m) == 0)
            out.append(F.transform(free, lambda m, own=own: own.bitwiseOR(m)))
        elif radius == 2:
            out.append(F.transform(flips, lambda m, own=own: own.bitwiseXOR(m)))
    return F.concat(*out)


def _far(a: np.ndarray, b) -> np.ndarray:
    """Differing bits (counted on unsigned numbers: of signed ones numpy counts the absolute value)."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _forest(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that keep the components of all pairs within ``distance``: breadth first, each reached one is asked once."""
    links, rest = [], prints
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            own = queue.pop()
            near = _far(rest, own) <= distance
            if near.any():
                reached = rest[near]
                links += [(int(own), int(x)) for x in reached]
                queue += list(reached)
                rest = rest[~near]
    return links


def _met(rows: DataFrame, distance: int, limit: int | None) -> DataFrame:
    """``u, v`` links among the ``print`` rows of each ``key``; a key of over ``limit`` rows gives ``u = key, v = null``."""

    def links(key, prints):
        """Of whole runs of one key each."""
        us, vs = [], []
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(edge, len(key)))
        of = np.repeat(size, size)
        few = of <= SHORT
        k, p = key[few], prints[few]
        for step in range(1, SHORT):
            if len(k) <= step:
                break
            at = np.flatnonzero((k[step:] == k[:-step]) & (_far(p[step:], p[:-step]) <= distance))
            us.append(p[at])
            vs.append(p[at + step])
        for a, n in zip(edge[size > SHORT], size[size > SHORT], strict=True):
            found = np.array(_forest(prints[a : a + n], distance), np.int64).reshape(-1, 2)
            us.append(found[:, 0])
            vs.append(found[:, 1])
        u, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (us, vs))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def run(batches):
        key, parts, held, over = None, [], 0, False  # the run at the end of what was read

        def closed():
            if over:
                return pa.RecordBatch.from_arrays(
                    [pa.array([key], pa.int64()), pa.array([None], pa.int64())], names=["u", "v"])
            return links(np.full(held, key, np.int64), np.concatenate(parts))

        for batch in batches:
            k, p = (batch.column(i).to_numpy() for i in (0, 1))
            if not len(k):
                continue
            if key is not None:
                n = int(np.searchsorted(k, key, "right"))  # the run goes on
                held += n
                if limit is not None and held > limit:
                    over, parts = True, []
                if not over and n:
                    parts.append(p[:n].copy())
                k, p = k[n:], p[n:]
                if not len(k):
                    continue
                yield closed()
            cut = int(np.searchsorted(k, k[-1], "left"))
            if cut:
                size = np.diff(np.append(np.flatnonzero(np.append(True, k[1:cut] != k[: cut - 1])), cut))
                if limit is not None and size.max() > limit:  # only with a limit below an Arrow batch
                    start = 0
                    for n in size.tolist():
                        key, parts, held, over = int(k[start]), [p[start : start + n]], n, n > limit
                        yield closed()
                        start += n
                else:
                    yield links(k[:cut], p[:cut])
            key, parts, held = int(k[-1]), [p[cut:].copy()], len(k) - cut
            over = limit is not None and held > limit
        if key is not None:
            yield closed()

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def links(classes: DataFrame, *, distance: int = 4, split: int = SPLIT) -> DataFrame:
    """``u, v`` links whose components are those of all ``print`` pairs within ``distance``; prints are distinct."""
    segments = cheapest(classes.count(), distance)
    keyed = classes.select(F.explode(_keys(F.col("print"), segments)).alias("key"), "print")
    first = materialised(_met(keyed, distance, split), "links")
    out = first.where("v is not null")
    large = first.where("v is null").select(F.col("u").alias("key"))
    if large.isEmpty():
        return out
    # the other bits of the values' members, rotated to the low end, are cut into segments in turn
    members = keyed.join(large, "key")
    turned, finer = F.col("print"), F.lit(None).cast("array<long>")
    for i, (offset, width, _) in enumerate(segments):
        by = (offset + width) % 64
        turned = F.shiftrightunsigned("print", by).bitwiseOR(F.shiftleft("print", 64 - by)) if by else F.col("print")
        keys = _keys(turned, cheapest(split, distance, 64 - width))
        finer = F.when(F.shiftright("key", 40) == i, keys).otherwise(finer)
    again = members.select("key", "print", F.explode(finer).alias("sub"))
    again = again.select(F.xxhash64("key", "sub").alias("key"), "print")
    return out.union(materialised(_met(again, distance, None), "links"))


def near_duplicates(
    docs: DataFrame, *, distance: int = 4, split: int = SPLIT, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, fingerprint`` (16 hex digits), ``component_id`` (least id reachable)."""
    signed = materialised(fingerprints(docs, doc_id=doc_id, text=text), "prints")
    classes = materialised(signed.groupBy("print").agg(F.min("doc_id").alias("least")), "classes")
    found = components(links(classes, distance=distance, split=split))
    named = classes.join(found.select(F.col("node").alias("print"), "component"), "print", "left").select(
        "print", "least", F.coalesce("component", "print").alias("component")
    )
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    whole = named.join(least, "component").select("print", "component_id")
    return signed.join(whole, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )
