"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns for every operator."""

import random

import numpy as np
import pytest

import corpus_pipeline
from meander.llm import components, fingerprints, htmlmodel, langid, licenses, minhash, mixing, neighbours, packing
from meander.llm import quality, secrets
from meander.llm.catalog import vocabulary
from meander.llm.htmltree import parse

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, size string, key string"


def make(spark, odd=True):
    rng = random.Random(5)
    words = {"en": "the of and then there with that which their from".split(),
             "de": "der die das und nicht auch eine einer schon über".split()}
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        rows.append((i, " ".join(rng.choices(words[lang], k=40)) + ".", lang, f"s{i % 4}"))
    if odd:
        rows += [(100, None, "en", "s0"), (101, "", None, None), (102, "1234 !!", "en", None), (103, "x", None, "s1"),
                 (None, "the of and", "en", "s1"), (None, None, None, None), rows[1], rows[1], (104, rows[2][1], "en", "s2"),
                 (105, "the of and then " * 20_000, "en", "s3"), (106, "\n\n", "en", "s0")]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 1, "s", "k") for r in rows], SCHEMA), rows


@pytest.fixture(scope="module")
def odd(spark):
    df, rows = make(spark)
    return df.cache(), rows


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_language(odd, none):
    df, rows = odd
    model = langid.fit(df)
    out = langid.identify(df, model, ["doc_id", "rank", "lang"]).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for key in (100, 101, 102, 106):
        assert (by[key].lang_pred, by[key].score) == ("und", 0.0)
    assert all(r.lang_pred == r.lang for r in out if r.doc_id is not None and r.doc_id < 60)
    empty = langid.fit(none)
    assert empty.langs == [] and langid.identify(df, empty, ["doc_id"]).first().lang_pred == "und"
    assert langid.identify(none, model, ["doc_id"]).count() == 0


def test_mix(odd, none):
    df, rows = odd
    out = mixing.mix(df).collect()
    assert len(out) == len(rows) and sum(r.size == 0 for r in out) == 4
    assert all(r.copies in (0, 1, 2) and r.taken == r.copies * r.size for r in out)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    again = mixing.repeated(df)
    assert again.columns == df.columns and again.count() == sum(r.copies for r in out)
    assert mixing.mix(none).count() == 0 and mixing.repeated(none).count() == 0


def test_html(spark, none):
    model = htmlmodel.train([])
    story = "It was a dark night, and the rain fell in torrents on the roofs of the old town."
    page = (f"<body><header>Site</header><nav><a>Home</a></nav><div class=content><h1>Title</h1><p>{story}<p>A &amp; b"
            f" &#233;<br>c</div><form><p>Your mail</p></form><div class='ad'>Buy this now, it is cheap.</div>"
            "<div class=comments><p>Nice text, thank you for it.</p></div><footer>Rights</footer>")
    assert htmlmodel.main_text(model, page) == f"Title\n{story}\nA & b é c"
    df = spark.createDataFrame([(1, page, "a"), (1, page, "a"), (2, None, "b"), (3, "", "c"), (4, "<" * 500, "d"),
                                (5, "<div>" * 3000 + "<p>" + story, "e")], "page_id long, html string, text string")
    out = {r.page_id: r for r in htmlmodel.extract(df, model, ["page_id"]).collect()}
    assert out[2].text == out[3].text == "" and out[2].n_chars == 0 and len(out) == 5
    empty = df.limit(0)
    assert htmlmodel.extract(empty, htmlmodel.fit(empty), ["page_id"]).count() == 0


def test_sum_product_is_exact():
    """Marginals of a small tree against the sum over all states."""
    model = htmlmodel.train([])
    page = parse("<body><div><p>one two</p><p>three, four.</p></div><nav><a>x</a></nav>")
    n = len(page.tag)
    unary = htmlmodel.features(page) @ model.weights
    weight = np.zeros((n, 2))
    for code in range(2**n):
        s = [(code >> i) & 1 for i in range(n)]
        total = sum(unary[i] * s[i] for i in range(n))
        for i in range(1, n):
            p = page.parent[i]
            total += model.tables[htmlmodel._kinds(page)[p]][2 * s[p] + s[i]]
        for i in range(n):
            weight[i, s[i]] += np.exp(total)
    assert np.allclose(np.log(weight[:, 1] / weight[:, 0]), htmlmodel.marginals(model, page))


def test_secrets(spark, none):
    shared, own = "a1" * 12, "b2" * 12
    rows = [(i, f'é token = "{shared}" x', f"o{i}") for i in range(4)]
    rows += [(10, f"Password: {own} and {own}", "o1"), (10, f"Password: {own} and {own}", "o1"), (11, None, None), (12, "", "o"),
             (13, "token: token: abcdef", "o"), (14, "zQ9" * 8 + "_KEY", "o9"), (None, "secret=abcdefg", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = secrets.document_spans(df).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows)
    assert [(s["kind"], s["start"], s["end"]) for s in by[0].base] == [(0, 2, 35), (2, 11, 35)] and by[0].n_example == 2
    assert by[10].n_live == 3 and by[11].base == [] and by[13].base == []
    assert [(s["kind"], s["start"], s["end"]) for s in by[14].extra] == [(3, 0, 28)]
    assert len(by[None].base) == 1
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert clean[0] == 'é <secret>" x' and clean[10] == "<secret> and <secret>" and clean[11] is None and clean[14] == "<secret>"
    few = none.select("doc_id", "text", "source")
    assert secrets.document_spans(few).count() == 0 and secrets.redact(none).columns == none.columns


def test_packing(odd, none):
    df, rows = odd
    out = packing.pack(df, vocabulary=vocabulary(), capacity=256).toPandas()
    assert out.groupby("sequence_id").length.sum().max() <= 256
    assert out[out.doc_id == 100].length.sum() == 1 and out[out.doc_id == 1].length.sum() == 3 * out[
        out.doc_id == 1].doc_tokens.iloc[0]
    assert packing.pack(none, vocabulary=vocabulary()).count() == 0
    for n in range(1, 3000):
        assert sum(packing.cuts(n, 1024, 0.04)) == n and min(packing.cuts(n, 1024, 0.04)) > 0


def test_licenses(odd, none):
    df, rows = odd
    assert licenses.recognise(df).count() == len(rows) and licenses.recognise(none).count() == 0


def test_quality(spark, odd, none):
    df, rows = odd
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, 1), (70, None)],
                                   "doc_id long, quality int")
    net = quality.fit(df, labels, epochs=1)
    out = quality.classify(df, net, ["doc_id", "rank"]).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    flat = quality.fit(df, labels.limit(0))
    assert flat.score("anything") == pytest.approx(0.5)
    assert quality.classify(none, net, ["doc_id"]).count() == 0
    long = np.frombuffer(("word " * 40_000).encode(), np.uint8)
    blocks, _ = quality.features(net, quality.encode("word " * 40_000))
    assert np.isfinite(blocks).all() and len(long) == 200_000


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(300)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(300, 420)]
    rows += [(450, None), (500, [0.0] * 4), (550, [1.0, None, 1.0, 1.0]), (600, [float("nan")] * 4), (650, [1.0]), (None, [1.0] * 4),
             (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = neighbours.nearest(df, recall=1.0).toPandas().sort_values(["query_id", "rank"])
    assert set(out.query_id) == {*range(0, 420, 50)} and (out.groupby("query_id").size() == 5).all()
    assert list(out[out.query_id == 350].vec_id) == [300, 301, 302, 303, 304]
    assert list(out[out.query_id == 300].vec_id) == [301, 302, 303, 304, 305]
    few = neighbours.nearest(df.where("vec_id < 3")).toPandas()
    assert len(few) == 2 and set(few.vec_id) == {1, 2}
    assert neighbours.nearest(df.limit(0)).count() == 0 and neighbours.nearest(df.where("vec_id = 0")).count() == 0


def test_near_duplicates(odd, none):
    df, rows = odd
    out = minhash.near_duplicates(df).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by[100].n_shingles == 0 and by[100].component_id == 100 and by[100].kept
    assert by[104].component_id == 2 and not by[104].kept and by[105].n_shingles == 4
    kept = minhash.deduplicate(df)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == df.columns and ids.count(1) == 1 and 104 not in ids and ids.count(None) == 2
    assert minhash.near_duplicates(none).count() == 0 and minhash.deduplicate(none).count() == 0


def test_links_between_members_that_miss_the_pivot(spark):
    """A chain: each text is near the next one only, and all share a long passage."""
    base = [f"w{i}" for i in range(200)]
    texts = []
    for k in range(12):
        base = base[:]
        base[10 * k : 10 * k + 3] = [f"x{k}", f"y{k}", f"z{k}"]
        texts.append(" ".join(base))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicates(df).collect()} == {0}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1040)]
    least = {}

    def find(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        least[b] = a
    out = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in out} == {x: find(x) for x in least if find(x) != x}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_fingerprints(spark, odd, none):
    df, rows = odd
    out = fingerprints.fingerprints(df).collect()
    assert len(out) == len(rows) and all(0 <= r.near_edited <= 1 for r in out)
    assert fingerprints.fingerprints(none).count() == 0
    assert fingerprints.fingerprints(df.where("doc_id = 5")).first().near_next == 1.0
    a, b, c = b"one two three\nfour five", b"four five\none two three", b"one two three"
    f = fingerprints.fingerprint
    assert fingerprints.to_text(f(a)) == fingerprints.to_text(f(b))
    taken = fingerprints.minus(f(a), f(b"four five"))
    assert fingerprints.to_text(taken) == fingerprints.to_text(f(c))
    assert fingerprints.to_text(fingerprints.plus(taken, f(b"four five"))) == fingerprints.to_text(f(a))
    back = fingerprints.from_text(fingerprints.to_text(f(a)))
    assert fingerprints.likeness(back, f(a)) == 1.0 and fingerprints.likeness(f(b""), f(a)) == 0.0


def test_pipeline_stages(odd, none, spark):
    df, rows = odd
    docs, empty = (d.select("doc_id", "text", "lang", "source", "n_chars") for d in (df, none))
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, empty):
            out = stage(spark, given, "unused")
            out.count()
            if name != "pack":
                assert out.columns == given.columns
