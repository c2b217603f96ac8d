"""Rows that share an id take one place in the sample, so no other id is pushed out of it."""

from meander.llm import quality


def test_repeated_ids_push_no_other_out(spark, monkeypatch):
    rows = [(1, f"copy {i}") for i in range(50)] + [(i, f"text {i}") for i in range(2, 9)] + [(9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 10)] + [(1, 0)], "doc_id long, quality int")
    taken = []
    monkeypatch.setattr(quality, "train", lambda pairs, **_: taken.extend(pairs) or quality.Network(
        quality.np.zeros((quality.WIDTH, 256, quality.FILTERS), "float32"), quality.np.zeros(quality.FILTERS, "float32"),
        quality.np.zeros(2 * quality.FILTERS), 0.0))
    quality.fit(docs, labels, max_train=20, label="quality")
    assert [label for _, label in taken] == [1, 0, 1, 0, 1, 0, 1, 0, 1]
    assert all((a == b).all() for a, b in zip([body for body, _ in taken][:2], [quality.encode("copy 0"), quality.encode("text 2")]))
