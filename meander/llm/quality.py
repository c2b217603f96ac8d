"""Quality classifier: a byte-level convolutional network in numpy.

A filter reads ``WIDTH`` bytes; as bytes are symbols, it is a table of 256 weights per place, so a convolution is a
sum of table rows.  Responses are rectified and max-pooled over chunks of ``CHUNK`` bytes that overlap by half and
together cover the whole document.  The mean and the maximum of each filter over all chunks feed one logistic
output.  Training is Adam on a bounded, class-balanced sample of labelled rows (``max_train``); the logit is then
shifted to the proportions of all labels.

Null and empty texts have one chunk of padding and so a score like any other.  Without both labels in training
the score is the share of label 1 (0.5 without any).  Repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meander.llm.common import sliced

FILTERS = 8
WIDTH = 6
CHUNK = 256


@dataclass
class Network:
    tables: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # 2 FILTERS: of the mean, of the maximum over chunks
    shift: float

    def score(self, text: str | None) -> float:
        f, _ = features(self, encode(text))
        return float(1.0 / (1.0 + np.exp(-(f @ self.out + self.shift))))


def encode(text: str | None) -> np.ndarray:
    """UTF-8 bytes, zeros up to whole half chunks (one chunk at least) and for the last filter's width."""
    raw = (text or "").encode()
    half = CHUNK // 2
    size = max(CHUNK, -(-len(raw) // half) * half)
    out = np.zeros(size + WIDTH - 1, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out


def responses(net: Network, data: np.ndarray) -> np.ndarray:
    """Filter responses at every byte, before rectification: places x FILTERS."""
    n = len(data) - WIDTH + 1
    total = net.tables[0].take(data[:n], axis=0)
    for j in range(1, WIDTH):
        total += net.tables[j].take(data[j : j + n], axis=0)
    return total


def features(net: Network, data: np.ndarray, places: bool = False):
    """``(mean and maximum over chunks, (chunk maxima, their places))``; long texts go block by block."""
    half, block = CHUNK // 2, 1 << 16
    n = len(data) - WIDTH + 1
    tops, where = [], []
    for start in range(0, n, block):
        stop = min(n, start + block)
        r = responses(net, data[start : stop + WIDTH - 1]).reshape(-1, half, FILTERS)
        if places:
            at = r.argmax(axis=1)
            where.append(at + start + half * np.arange(len(r))[:, None])
            tops.append(np.take_along_axis(r, at[:, None, :], axis=1)[:, 0])
        else:
            tops.append(r.max(axis=1))
    halves = np.concatenate(tops)
    left = halves[:-1] >= halves[1:]
    chunks = np.where(left, halves[:-1], halves[1:])
    pooled = np.maximum(chunks + net.bias, 0.0)
    f = np.concatenate([pooled.mean(axis=0), pooled.max(axis=0)])
    if not places:
        return f, None
    spots = np.concatenate(where)
    return f, (pooled, np.where(left, spots[:-1], spots[1:]))


def train(samples: list[tuple[np.ndarray, int]], *, epochs: int = 8, rate: float = 0.02, batch: int = 32,
          decay: float = 1e-4, seed: int = 5) -> Network:
    """Adam on the log loss; only the places of chunk maxima carry gradient."""
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.3, 2 * FILTERS), 0.0,
    )
    parts = lambda: [net.tables, net.bias, net.out, np.array([net.shift])]
    first, second = [np.zeros_like(p, float) for p in parts()], [np.zeros_like(p, float) for p in parts()]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(samples))
        for start in range(0, len(order), batch):
            grads = [np.zeros_like(p, float) for p in parts()]
            rows = order[start : start + batch]
            for i in rows:
                data, label = samples[i]
                f, (pooled, spots) = features(net, data, places=True)
                p = 1.0 / (1.0 + np.exp(-(f @ net.out + net.shift)))
                g = (p - label) / len(rows)
                grads[2] += g * f
                grads[3] += g
                # to the pooled values: an even part of the mean, and the chunk that holds the maximum
                d = np.repeat(g * net.out[None, :FILTERS] / len(pooled), len(pooled), axis=0)
                d[pooled.argmax(axis=0), np.arange(FILTERS)] += g * net.out[FILTERS:]
                d *= pooled > 0
                grads[1] += d.sum(axis=0)
                channel = np.broadcast_to(np.arange(FILTERS), spots.shape)
                for j in range(WIDTH):
                    np.add.at(grads[0][j], (data[spots + j], channel), d)
            step += 1
            speed = rate * (1.0 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            new = []
            for k, (value, grad) in enumerate(zip(parts(), grads, strict=True)):
                grad = grad + decay * value
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                new.append(value - speed * first[k] / (np.sqrt(second[k]) + 1e-8))
            net = Network(new[0].astype(np.float32), new[1].astype(np.float32), new[2], float(new[3][0]))
    return net


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        max_train: int = 1600, **options) -> Network:
    """Learn from ``labels`` (0 or 1 per id) of rows of ``docs``.

    At most ``max_train`` ids, half of each label, lowest hash first; only their texts are read to the driver.  An
    id with both labels counts as 1; of rows that share an id the smallest text is learned from.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(
        F.col(doc_id).alias("_id")).agg(F.max(label).alias("_label"))
    counts = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        share = np.clip((counts.get(1, 0) + 0.5) / (total + 1.0), 0.01, 0.99)
        return Network(np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros(FILTERS, np.float32),
                       np.zeros(2 * FILTERS), float(np.log(share / (1 - share))))
    order = [F.xxhash64(F.lit(3), "_id"), F.col("_id")]
    half = max_train // 2
    picks = known.where("_label = 0").orderBy(*order).limit(half).unionByName(
        known.where("_label = 1").orderBy(*order).limit(half))
    # at most max_train ids: small enough to ship whatever the size of docs
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(picks), "_id")
    found = rows.groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_label").alias("_label")).orderBy("_id").collect()
    net = train([(encode(r["_text"]), int(r["_label"])) for r in found], **options)
    ones = sum(int(r["_label"]) for r in found)
    if 0 < ones < len(found):
        net.shift += float(np.log(counts[1] / counts[0]) - np.log(ones / (len(found) - ones)))
    return net


def classify(docs: DataFrame, net: Network, keep: list[Column | str], *, text: str = "text",
             threshold: float = 0.3) -> DataFrame:
    """The columns ``keep`` plus ``score`` (probability of label 1) and ``predicted`` for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size
    kept = docs.select(*keep)
    names = kept.columns

    def run(batches):
        model = shared.value
        for batch in sliced(batches):
            scores = [model.score(body) for body in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(scores, pa.float64()),
                 pa.array([int(s >= threshold) for s in scores], pa.int32())],
                names=[*names, "score", "predicted"],
            )

    schema = kept.schema.add("score", "double").add("predicted", "integer")
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)
