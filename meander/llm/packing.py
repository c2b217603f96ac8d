"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Lengths fall into reciprocal-capacity classes: class k holds lengths in (C/(k+1), C/k], and k pieces of a class
fill one bin.  Documents are cut freely: full sequences first, then the rest at the largest reciprocal below it
while its class would waste more than a tolerance, so pieces lie close under C/k.  Every task fills its bins by
itself; what it has left over in a class (fewer than k pieces) is numbered across tasks by running totals and
fills bins there; the last few pieces of all classes, a number bounded by C alone, share first-fit bins.

Null texts count as empty: one end token.  Repeated rows are documents of their own; then ``(doc_id, start)``
repeats too.  An empty table packs into nothing.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meander.llm.common import few_rows, materialised, sliced


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in a byte-level vocabulary: printable Latin-1 stands for itself."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Words of a byte-level vocabulary (fixed value, as the vocabulary file's own splitter has it).
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokens:
    """Ids of a byte-level vocabulary file, as little-endian 32-bit numbers.

    Merges by rank give the ids that the file's own library gives (a test holds them against each other), several
    times as fast.  Nothing is kept from one text to the next: looking words up in a cache takes longer than merging
    whole texts, and a process would hold the words of all the texts it has seen.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        stand = byte_alphabet()
        ranks = {bytes(stand[c] for c in word): n for word, n in model["model"]["vocab"].items() if word not in special}
        self.special = special
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            found = self.encoding.encode_to_numpy(text, allowed_special="all")
        else:
            found = self.encoding.encode_to_numpy(text, disallowed_special=())
        return found.astype("<u4", copy=False).tobytes()


_TOKENS: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


def cuts(length: int, capacity: int, tolerance: float) -> list[int]:
    """Piece lengths of a document: their sum is ``length``."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if capacity // k - rest <= tolerance * rest:
            out.append(rest)
            break
        piece = capacity // (k + 1)
        out.append(piece)
        rest -= piece
    return out


def pieces(docs: DataFrame, vocabulary: str, capacity: int, tolerance: float, end_id: int, doc_id: str,
           text: str) -> DataFrame:
    """Tokenised and cut documents with the bin and slot that their task gave them.

    A piece left over has minus the number of pieces that its task leaves over in its class as ``bin``, and its
    place among them (by id, start, checksum and length) as ``offset``.
    """

    def run(batches):
        worker = TaskContext.get().partitionId()
        enc, end = tokens(vocabulary), np.array([end_id], "<u4").tobytes()
        open_bins: dict[int, list] = {}
        n_bins = 0
        for batch in sliced(batches):
            out = []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (enc.ids(body) if body else b"") + end
                total, start = len(raw) // 4, 0
                for n in cuts(total, capacity, tolerance):
                    row = [key, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), total, capacity // n, worker,
                           -1, 0]
                    start += n
                    bin_ = open_bins.setdefault(row[5], [])
                    bin_.append(row)
                    if len(bin_) == row[5]:
                        at = 0
                        for r in bin_:
                            r[7], r[8], at = n_bins, at, at + r[2]
                        n_bins += 1
                        out += bin_
                        open_bins[row[5]] = []
            if out:
                yield _batch(out)
        for rows in open_bins.values():
            rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[3], r[2]))
            for at, r in enumerate(rows):
                r[7], r[8] = -len(rows), at
        if left := [r for rows in open_bins.values() for r in rows]:
            yield _batch(left)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "worker", "bin", "offset"]
    types = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def _batch(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names
        )

    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, worker int, "
              "bin long, offset long")
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, schema)


def first_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """``(bin, offset)`` of each length, longest first, in the first bin with room."""
    room: list[int] = []
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, free in enumerate(room) if free >= lengths[i]), len(room))
        if b == len(room):
            room.append(capacity)
        out[i] = (b, capacity - room[b])
        room[b] -= lengths[i]
    return out


def pack(docs: DataFrame, *, vocabulary: str, capacity: int = 1024, tolerance: float = 0.04, end_id: int = 0,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, class``.

    ``tolerance`` is the padding that a piece may cause, as a share of its length, before it is cut again.
    """
    with few_rows(docs.sparkSession):
        cut = materialised(pieces(docs, vocabulary, capacity, tolerance, end_id, doc_id, text), "packing")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    full = cut.where("bin >= 0").select(
        *columns, (F.col("worker").cast("long") * (1 << 36) + F.col("bin")).alias("sequence_id"), "offset", "class"
    )
    # left over: fewer than k pieces for each class k and task
    left = cut.where("bin < 0")
    by_class = Window.partitionBy("class")
    before = by_class.orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    n = -F.col("bin")
    counts = left.where("offset = 0").select(
        F.col("class").alias("c"), F.col("worker").alias("w"),
        F.coalesce(F.sum(n).over(before), F.lit(0)).alias("earlier"), F.sum(n).over(by_class).alias("total"),
    )
    numbered = left.join(counts, (F.col("class") == F.col("c")) & (F.col("worker") == F.col("w"))).withColumn(
        "at", F.col("earlier") + F.col("offset")
    )
    numbered = numbered.withColumn("shared", F.floor(F.col("at") / F.col("class"))).withColumn(
        "filled", F.col("shared") < F.floor(F.col("total") / F.col("class"))
    )
    base = 1 << 60
    in_bin = Window.partitionBy("class", "shared").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    shared = numbered.where("filled").select(
        *columns,
        (F.lit(base) + F.col("class").cast("long") * (1 << 40) + F.col("shared")).alias("sequence_id"),
        F.coalesce(F.sum("length").over(in_bin), F.lit(0)).alias("offset"), "class",
    )

    def rest(pdf):
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ignore_index=True)
        placed = first_fit(pdf["length"].tolist(), capacity)
        return pdf.assign(sequence_id=[2 * base + b for b, _ in placed], offset=[o for _, o in placed])

    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
              "class int")
    tail = numbered.where("not filled").select(*columns, F.lit(0).cast("long").alias("sequence_id"),
                                               F.lit(0).cast("long").alias("offset"), "class")
    last = tail.groupBy(F.lit(0).alias("all")).applyInPandas(lambda pdf: rest(pdf), schema)
    return full.unionByName(shared).unionByName(last)
