"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Grams of one to three letters (case folded, everything else a space) are hashed to ``BUCKETS`` features.  Document
frequencies come from all training documents, in Spark.  The weights are learned with follow-the-regularised-leader
and elastic-net penalties on a bounded sample (``max_train``) spread over the languages, whole texts and short
windows of them; a temperature is then fitted on sampled documents that were kept back.

A text that is null or has no letter is ``und`` with score 0.  Without training rows every text is ``und``.
Repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meander.llm.common import sliced

BUCKETS = 1 << 15
SMALL_LANGS = 10_000  # languages whose rates may go to every task
_NO_LETTER = re.compile(r"[\W\d_]+")
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def letters(text: str | None) -> str | None:
    """Case-folded text with everything but letters as single spaces; None if it has no letter."""
    if not text:
        return None
    clean = _NO_LETTER.sub(" ", text.lower())
    return f" {clean} " if any(map(str.isalpha, clean)) else None


def grams(clean: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers and their counts."""
    c = np.frombuffer(clean.encode("utf-32-le"), "<u4").astype(np.uint64)
    one = c[1:-1] * _M1
    two = c[:-1] * _M2 + c[1:] * _M3
    three = two[:-1] * _M1 + c[2:] * _M2
    slots = [((h ^ (h >> np.uint64(31))) * _M3 >> np.uint64(49)).astype(np.int64) for h in (one, two, three)]
    counts = np.bincount(np.concatenate(slots), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1.0 + np.log(counts)) * idf[at]
    return x / np.sqrt(x @ x)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    """``langs`` in code point order; ``weights`` is BUCKETS x languages, mostly zeros."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def predict(self, text: str | None) -> tuple[str, float]:
        clean = letters(text) if self.langs else None
        if clean is None:
            return "und", 0.0
        at, counts = grams(clean)
        p = softmax((weighted(at, counts, self.idf) @ self.weights[at] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def document_frequencies(train: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many training texts each feature is, and how many texts there are; tasks add up before the shuffle."""

    def run(batches):
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in sliced(batches):
            for body in batch.column(0).to_pylist():
                if (clean := letters(body)) is not None:
                    df[grams(clean)[0]] += 1
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, BUCKETS)), pa.array(np.append(df[at], n))], names=["bucket", "df"]
        )

    rows = train.select(text).mapInArrow(run, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df"))
    table = rows.toPandas()  # at most BUCKETS + 1 rows
    out = np.zeros(BUCKETS + 1, np.int64)
    out[table["bucket"].to_numpy()] = table["df"].to_numpy()
    return out[:BUCKETS], int(out[BUCKETS])


def _sample(train: DataFrame, lang: str, text: str, max_train: int) -> list[tuple[str, str]]:
    """At most ``max_train`` (language, text) rows, each text once, in turn over the languages."""
    train = train.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = train.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    n = counts.count()
    fair = F.lit(float(max_train)) / F.lit(float(max(n, 1)))
    u = F.pmod(F.xxhash64(F.lit(7), "text"), F.lit(1 << 30)) / float(1 << 30)
    # languages rarer than the even share give all they have
    rates = counts.select("lang", F.least(F.lit(1.0), fair / F.col("n")).alias("rate"))
    if n <= SMALL_LANGS:  # the same rows either way; the texts then stay where they are
        rates = F.broadcast(rates)
    rows = train.join(rates, "lang").where(u < F.col("rate")).select("lang", "text", u.alias("u")).distinct()
    # turns: a limit takes from languages with many texts first, never the first texts of a rare one
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("u", "text"))
    picked = rows.withColumn("turn", turn).orderBy("turn", "lang").limit(max_train)
    return [(r["lang"], r["text"]) for r in picked.collect()]


def _examples(rows: list[tuple[str, str]]) -> list[tuple[int, str, str]]:
    """Whole texts and two short windows of each: ``(place within the language, language, letters)``."""
    out, seen = [], {}
    for lang, text in rows:
        clean = letters(text)
        if clean is None:
            continue
        i = seen[lang] = seen.get(lang, -1) + 1
        out.append((i, lang, clean))
        middle = len(clean) // 2
        for part in (clean[:40], clean[middle : middle + 120]):
            if part.strip():
                out.append((i, lang, f" {part.strip()} "))
    return out


def ftrl(examples: list[tuple[int, np.ndarray, np.ndarray]], classes: int, *, epochs: int, alpha: float, beta: float,
         l1: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Per-coordinate follow-the-regularised-leader; examples are (class, features, values)."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def leader(at):
        zz = z[at]
        w = -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        w[np.abs(zz) <= l1] = 0.0
        return w

    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            y, at, x = examples[i]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)  # the last coordinate is the bias
            w = leader(at)
            g = softmax(x @ w)
            g[y] -= 1.0
            grad = np.outer(x, g)
            squares = grad * grad
            old = n[at]
            z[at] += grad - (np.sqrt(old + squares) - np.sqrt(old)) / alpha * w
            n[at] = old + squares
    w = leader(np.arange(BUCKETS + 1))
    return w[:BUCKETS], w[BUCKETS]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section on its logarithm."""
    def loss(t):
        p = softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()

    low, high, ratio = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(50):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(train: DataFrame, *, lang: str = "lang", text: str = "text", max_train: int = 3000, epochs: int = 2,
        alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> Model:
    """Learn from the rows of ``train`` whose language is known.

    Counts cover all of them; the weights a sample of at most ``max_train`` texts, every fifth of which in each
    language is kept back for the temperature (a language with fewer is learned from all of them).
    """
    train = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    df, n = document_frequencies(train, text)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    rows = _examples(_sample(train, lang, text, max_train))
    langs = sorted({lang for _, lang, _ in rows})
    if not langs:
        return Model([], idf, np.zeros((BUCKETS, 0)), np.zeros(0))
    number = {v: i for i, v in enumerate(langs)}
    made = []
    for i, label, clean in rows:
        at, counts = grams(clean)
        made.append((i, (number[label], at, weighted(at, counts, idf))))
    weights, bias = ftrl([e for i, e in made if i % 5 < 4], len(langs), epochs=epochs, alpha=alpha, beta=beta, l1=l1, l2=l2)
    kept = [e for i, e in made if i % 5 == 4]
    model = Model(langs, idf, weights.astype(np.float32), bias)
    if kept and len(langs) > 1:
        logits = np.array([x @ weights[at] + bias for _, at, x in kept])
        model.temperature = temperature(logits, np.array([y for y, _, _ in kept]))
    return model


def identify(docs: DataFrame, model: Model, keep: list[Column | str], *, text: str = "text") -> DataFrame:
    """The columns ``keep`` plus ``lang_pred`` and ``score`` for every row of ``docs``; the whole text counts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages, whatever the size of docs
    kept = docs.select(*keep)
    names = kept.columns

    def run(batches):
        m = shared.value
        for batch in sliced(batches):
            out = [m.predict(body) for body in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array([o[0] for o in out], pa.string()),
                 pa.array([o[1] for o in out], pa.float64())],
                names=[*names, "lang_pred", "score"],
            )

    schema = kept.schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)
