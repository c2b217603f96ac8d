"""Vectors whose squares overflow or vanish keep their cosine."""

import math

import numpy as np

from meander.llm import neighbours


def test_huge_and_tiny_components(spark):
    rng = np.random.default_rng(5)
    plain = rng.normal(size=(200, 8))
    scale = [1.0, 1e160, 1e-200, 1e300, 2.0 ** -1040]
    rows = [(i, [float(x) for x in v * scale[i % 5]]) for i, v in enumerate(plain)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, every=50).orderBy("query_id", "rank").collect():
        assert math.isfinite(r.score)
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    unit = np.array([[x / max(map(abs, v)) for x in v] for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    hit = 0
    for q in range(0, 200, 50):
        cosine = unit @ unit[q]
        cosine[q] = -2
        best = np.argsort(-cosine)[:5]
        hit += len({int(b) for b in best} & {v for v, _ in got[q]})
        for v, score in got[q]:
            assert abs(score - cosine[v]) < 1e-9
    assert hit >= 0.9 * 20
