"""Document fingerprints: a homomorphic multiset hash.

Every paragraph (line) is hashed to a wide vector and the vectors of a document are added, each lane modulo a
power of two.  Sums do not depend on order, and a paragraph can be put in or taken out of a fingerprint by adding
or subtracting its vector.  A vector has two parts:

* identity, ``IDENTITY`` lanes modulo 2^64: the paragraph's BLAKE2b digest.  Equal multisets have equal sums.
* likeness, ``LANES`` lanes modulo 2^32: the paragraph's grams, each adding +1 or -1 to one lane.  Grams begin at
  word starts, and in words longer than a gram also where the content says so, at most ``WINDOW`` bytes apart: every
  byte of a word counts, also in texts without white space, and bytes put in move no other grams.  The cosine of
  two such sums estimates how much of their content two documents share, so that a changed word costs one
  paragraph its identity but hardly any likeness.

A fingerprint's text is the identity in hexadecimal, a dash and the likeness in base64.  Null texts count as
empty: the zero vector.  Repeated rows have equal fingerprints.
"""

from __future__ import annotations

import base64
import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meander.llm.common import sliced

IDENTITY = 8
LANES = 256
GRAM = 12  # bytes of a gram: the eight from its first byte on and the four behind them
WINDOW = 8  # of as many starts in a long word, the one with the least hash begins a gram
PREFIX = 256  # characters of a text that bounds a slice

_MIX1, _MIX2, _MIX3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def empty() -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(IDENTITY, np.uint64), np.zeros(LANES, np.uint32)


def plus(a, b):
    """The fingerprint of both multisets together."""
    return a[0] + b[0], a[1] + b[1]


def minus(a, b):
    """``a`` with the paragraphs of ``b`` taken out."""
    return a[0] - b[0], a[1] - b[1]


def _inside(eight: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Where further grams begin in the words longer than a gram; ``eight`` has the eight bytes from each place on.

    Of every ``WINDOW`` neighbouring places of a word the one with the least hash, a word's first place aside.
    """
    long = stop - start > GRAM
    start, size = start[long], (stop - start)[long]
    if not len(start):
        return start
    # words one behind the other, each with WINDOW - 1 empty places in front
    ends = np.cumsum(size + WINDOW - 1)
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    slots = np.repeat(ends - size, size) + step
    places = np.repeat(start, size) + step
    values = np.zeros(int(ends[-1]) + WINDOW - 1, np.uint64)
    mixed = eight[places] * _MIX1
    values[slots] = (mixed ^ (mixed >> np.uint64(31))) * _MIX2 | np.uint64(1)
    least, width = values, 1  # of WINDOW values from each slot on; 0 where the window leaves the word
    while width < WINDOW:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    most, width = least, 1  # of the windows that hold a slot
    while width < WINDOW:
        most = np.maximum(most[:-width], most[width:])
        width *= 2
    return places[(most[slots - WINDOW + 1] == values[slots]) & (step > 0)]


def fingerprint(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The sum over the paragraphs of UTF-8 ``text``; empty lines are no paragraphs."""
    paragraphs = [p for p in text.split(b"\n") if p]
    if not paragraphs:
        return empty()
    digests = b"".join([hashlib.blake2b(p, digest_size=8 * IDENTITY).digest() for p in paragraphs])
    identity = np.frombuffer(digests, "<u8").reshape(-1, IDENTITY).sum(axis=0, dtype=np.uint64)
    # grams lie within one paragraph: zeros stand behind each one
    body = np.frombuffer((b"\0" * GRAM).join(paragraphs) + b"\0" * GRAM, np.uint8)
    space = _SPACE[body] | (body == 0)
    first = ~space
    first[1:] &= space[:-1]
    at = np.flatnonzero(first)
    last = ~space
    last[:-1] &= space[1:]
    n = len(body) - 7
    eight = np.ndarray(n, "<u8", body, strides=(1,))
    at = np.concatenate([at, _inside(eight, at, np.flatnonzero(last) + 1)])
    low = eight[at]
    high = np.ndarray(n + 4, "<u4", body, strides=(1,))[np.minimum(at + 8, n + 3)].astype(np.uint64)
    mixed = (low * _MIX1) ^ (high * _MIX2)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX3
    slot = (mixed >> np.uint64(48)).astype(np.int64)
    counts = np.bincount(slot & (2 * LANES - 1), minlength=2 * LANES)
    return identity, (counts[:LANES] - counts[LANES:]).astype(np.uint32)


def to_text(f) -> str:
    return f[0].astype("<u8").tobytes().hex() + "-" + base64.b64encode(f[1].astype("<u4").tobytes()).decode()


def from_text(s: str) -> tuple[np.ndarray, np.ndarray]:
    head, _, tail = s.partition("-")
    return (np.frombuffer(bytes.fromhex(head), "<u8").astype(np.uint64),
            np.frombuffer(base64.b64decode(tail), "<u4").astype(np.uint32))


def likeness(a, b) -> float:
    """0 to 1: the cosine of the likeness lanes read as signed numbers; 1 for equal fingerprints."""
    x, y = a[1].view(np.int32).astype(np.float64), b[1].view(np.int32).astype(np.float64)
    if np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]):
        return 1.0
    size = float(x @ x) * float(y @ y)
    return min(1.0, max(0.0, float(x @ y) / size**0.5)) if size > 0 else 0.0


def edited(text: str, following: str) -> str:
    """``text`` whose last half is replaced by as many first code points of ``following`` (or all it has)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _bounds(docs: DataFrame, doc_id: str, text: str) -> tuple[list[bytes], np.ndarray]:
    """Where the slices of the order begin: texts for rows without an id, then ids.

    The least row of each range partition, one value per partition; of texts the first ``PREFIX`` characters.
    """
    key = F.col(doc_id).cast("long")
    ids = docs.where(key.isNotNull()).select(key.alias("id"), F.lit(None).cast("string").alias("head"))
    head = F.substring(F.coalesce(F.col(text), F.lit("")), 1, PREFIX)
    order = ids.union(docs.where(key.isNull()).select(F.lit(None).cast("long"), head))
    # a number of its own: the planner would merge partitions of bare ids, and with them the slices of texts
    slices = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = order.repartitionByRange(slices, "id", "head")
    least = ranged.groupBy(F.spark_partition_id()).agg(F.min(F.struct("id", "head")).alias("r")).select("r.*")
    rows = least.distinct().collect()
    return (sorted(r.head.encode() for r in rows if r.id is None),
            np.sort(np.array([r.id for r in rows if r.id is not None], dtype=np.int64)))


def with_next(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``slice, tail, id, text`` so that each row's next one in the order of ids lies in its slice.

    Slices are ranges of ids between ids that exist, and of texts for rows without an id.  A slice's first rows also
    go to the slice before as its tail, the first slice's to the last.  Null ids come first, equal ids in the order
    of their texts.
    """
    heads_of, bounds = _bounds(docs, doc_id, text)
    nameless, last = len(heads_of), max(len(heads_of) + len(bounds), 1)

    def place(batches):
        for batch in sliced(batches, 4096):
            ids, texts = batch.column(0), batch.column(1)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            values = ids.fill_null(0).to_numpy(zero_copy_only=False)
            where = np.maximum(nameless + np.searchsorted(bounds, values, "right") - 1, 0)
            heads = np.isin(values, bounds) & known
            first = {}  # slice of rows without an id: its least row that may be its first
            for i in np.flatnonzero(~known):
                body = texts[int(i)].as_py().encode()
                where[i] = k = max(bisect.bisect_right(heads_of, body) - 1, 0)
                if body.startswith(heads_of[k]) and (k not in first or body < first[k][0]):
                    first[k] = (body, i)
            heads[[i for _, i in first.values()]] = True
            rows = np.concatenate([np.arange(len(ids)), np.flatnonzero(heads)])
            to = np.concatenate([where, (where[heads] - 1) % last])
            tail = np.concatenate([np.zeros(len(ids), bool), np.ones(int(heads.sum()), bool)])
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(to), pa.array(tail), ids.take(take), texts.take(take)], names=["slice", "tail", "id", "text"]
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed = rows.mapInArrow(place, "slice long, tail boolean, id long, text string")
    return placed.repartition("slice").sortWithinPartitions("slice", "tail", "id", "text")


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its fingerprint, that of its edited text and how alike they and the next document's are."""

    def run(batches):
        held = None  # the row that waits for the one behind it: slice, id, text, fingerprint

        def finish(row, following, following_print):
            changed = edited(row[2], following)
            raw = changed.encode()
            new = fingerprint(raw)
            return (row[1], len(row[2]), hashlib.sha256(raw).hexdigest(), to_text(row[3]), to_text(new),
                    likeness(row[3], new), likeness(row[3], following_print))

        def table(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES
            )

        for batch in sliced(batches):
            out = []
            for part, tail, key, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is not None and held[0] != part:  # a slice that ends without a tail: it holds all rows
                    out.append(finish(held, head[0], head[1]))
                    held = None
                if tail and held is None:
                    continue  # only the first tail row is the next document
                own = fingerprint(body.encode())
                if held is None:
                    head = (body, own)
                else:
                    out.append(finish(held, body, own))
                held = None if tail else (part, key, body, own)
            if out:
                yield table(out)
        if held is not None:
            yield table([finish(held, head[0], head[1])])

    return with_next(docs, doc_id=doc_id, text=text).mapInArrow(run, _SCHEMA)


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")
