"""Near-dedup at other thresholds than 85, against brute force."""

import random

import pytest

import corpus_pipeline
from meander.llm import minhash


def family(rng, name, changes):
    """A text and one copy for each number of changed words, the changes apart from each other."""
    words = [f"{name}w{i}" for i in range(204)]
    out = [" ".join(words)]
    for n in changes:
        copy = words[:]
        for k, at in enumerate(rng.sample(range(5, 195, 6), n)):
            copy[at] = f"{name}x{n}x{k}"
        out.append(" ".join(copy))
    return out


def similarity(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    # 4 changes: 0.82 (also 3: 0.86, 5: 0.78)
    return [t for i in range(120) for t in family(rng, f"f{i}", [[4], [3], [5]][i % 3])]


def least_ids(texts, percent):
    least = list(range(len(texts)))
    for i in range(0, len(texts), 2):  # families share nothing
        if 100 * similarity(texts[i], texts[i + 1]) >= percent:
            least[i + 1] = i
    return least


@pytest.mark.parametrize("percent", [70, 80, 85])
def test_components_at_other_thresholds(spark, texts, percent):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, percent=percent).collect()}
    assert [out[i] for i in range(len(texts))] == least_ids(texts, percent)


def test_stage_takes_pairs_from_80(spark, texts):
    shared = [similarity(texts[i], texts[i + 1]) for i in range(0, len(texts), 2)]
    assert sum(0.80 <= s < 0.85 for s in shared) == 40
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "unused").collect()}
    assert kept == set(least_ids(texts, 80))


def test_bands_and_signature_bound():
    assert [minhash.banding(p) for p in (80, 85)] == [6, 8]
    for percent in range(5, 101):
        s, r = percent / 100, minhash.banding(percent)
        assert (1 - s**r) ** (minhash.SKETCH // r) <= minhash.MISS
        assert minhash.lowest(percent) <= s - 5 * (s * (1 - s) / minhash.SKETCH) ** 0.5
    for percent in (0, 1, 101):
        with pytest.raises(ValueError):
            minhash.banding(percent)
