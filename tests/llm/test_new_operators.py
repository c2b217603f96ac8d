"""Clustering, lexical search and SimHash against brute force, and their odd inputs."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from meander.llm import centroids, lexical, simhash

# --- centroid clustering ---------------------------------------------------------------------------------------------


def lloyd(rows, k, rounds, scale=256, seed=2):
    """Plain Lloyd rounds on Python integers: rows are (vec_id, components)."""
    points = [[math.floor(scale * x) for x in v] for _, v in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, hashlib.sha256(
        f"{seed}:{rows[i][0]}".encode()).hexdigest(), points[i]))
    centres = [list(points[i]) for i in order[:k]]

    def assign():
        out = []
        for p in points:
            far = [sum((a - b) ** 2 for a, b in zip(p, c, strict=True)) for c in centres]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        found = assign()
        for c in range(len(centres)):
            own = [p for p, (a, _) in zip(points, found, strict=True) if a == c]
            if own:
                centres[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return assign(), centres


@pytest.mark.parametrize("lead", [1, 3, 8])
def test_clusters_equal_lloyd(spark, lead):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 2, (5, 8))
    rows = [(i, (centres[i % 5] + rng.normal(0, 0.3, 8)).astype(np.float32).tolist()) for i in range(240)]
    rows += [rows[7], rows[7], (900, rows[3][1]), (901, [0.0] * 8), (None, rows[4][1])]
    odd = [(1000, None), (1001, []), (1002, [1.0] * 7), (1003, [1.0] * 7 + [None]), (1004, [1.0] * 7 + [math.nan]),
           (1005, [1.0] * 7 + [math.inf]), (None, None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], "vec_id long, embedding array<float>, cluster int, h string")
    found, final = lloyd(rows, 12, 4)
    out = centroids.cluster(df.repartition(5), k=12, rounds=4, width=8, lead=lead).collect()
    got = sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance) for r in out)
    assert got == sorted((i is None, i or 0, c, d) for (i, _), (c, d) in zip(rows, found, strict=True))
    inertia = Counter()
    for c, d in found:
        inertia[c] += d
    for r in out:
        assert r.cluster_inertia == inertia[r.cluster] and r.inertia == sum(inertia.values())
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, final[r.cluster])).encode()).hexdigest()


def test_bounds_never_exceed_the_distance():
    rng = np.random.default_rng(4)
    for size in (3, 1000, centroids.HELD):
        ints = rng.integers(-size, size, (300, 16))
        cents = rng.integers(-size, size, (9, 16))
        axes = centroids.Axes(ints[:50].astype(float), 16, 4)
        low = centroids.bounds(*axes.place(ints), *axes.place(cents))
        exact = ((ints[:, None] - cents[None]) ** 2).sum(axis=2)
        assert (low <= exact).all()
        best, far = centroids.nearest(ints, *axes.place(ints), cents, *axes.place(cents))
        assert (best == exact.argmin(axis=1)).all() and (far == exact.min(axis=1)).all()


def test_cluster_small_and_empty(spark):
    df = spark.createDataFrame([(5, [1.0, 2.0]), (6, [1e30, -1e30])], "vec_id long, embedding array<float>")
    out = {r.vec_id: r for r in centroids.cluster(df, width=2).collect()}
    assert out[5].distance == out[6].distance == 0 and out[5].cluster != out[6].cluster
    assert centroids.cluster(df.limit(0), width=2).collect() == []
    equal = spark.createDataFrame([(i, [0.5, 0.5]) for i in range(9)], "vec_id long, embedding array<float>")
    out = centroids.cluster(equal, k=4, width=2).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in out} == {(0, 0, 0)} and len(out) == 9


# --- lexical search --------------------------------------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, top):
    bags = [(i, Counter(terms_of(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, length = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for key, text in items:
        rows = []
        for i, bag, n in bags:
            m = 75 + 25 * n * n_docs // length
            score = sum(
                math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m))
                for t in terms_of(text) if bag[t]
            )
            if score > 0:
                rows.append((-score, i is None, i or 0))
        out += [(key, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(rows)[:top], 1)]
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["É", "é", "ß7", "x-y", "A_b"]
    pick = lambda k: " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=k))
    docs = [(i, pick(rng.randint(1, 30)).title()) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(150)]  # equal vectors
    docs += [(3, docs[3][1]), (3, "w1 w2"), (None, docs[5][1]), (None, None), (n + 900, ""), (n + 901, " -- !"),
             (n + 902, "w1 w3 É " * 60_000)]
    return docs, [(i, pick(rng.randint(1, 12))) for i in range(25)] + [(100, "nowhere"), (101, None), (102, ""), (103, "w1 W1 w1")]


@pytest.mark.parametrize("block_bytes, leaf", [(4 << 20, 32), (300, 4)])
def test_search_equals_ranking_all(spark, monkeypatch, block_bytes, leaf):
    docs, items = corpus(1, 700)
    df = spark.createDataFrame([(*d, 1, "a") for d in docs], "doc_id long, text string, rank int, head string").repartition(4)
    asked = spark.createDataFrame([(*i, 2.0) for i in items + items[:2]], "item_id long, text string, score double")
    monkeypatch.setattr(lexical, "LEAF", leaf)
    got = lexical.search(df, asked, block_bytes=block_bytes).collect()
    key = lambda r: (r[0], r[1])
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=key) == sorted(ranked(docs, items, 20), key=key)


def test_tree_visits_few_leaves_and_misses_none():
    """Trees of several shards with the places carried over, against scoring everything."""
    rng = np.random.default_rng(8)
    n_terms, heap, every = 60, [], []
    dense, weights = np.zeros(n_terms, np.int64), {5: 700, 20: 3000, 41: 9000}
    for shard in range(3):
        paths = sorted(tuple(sorted(set((rng.pareto(1.0, 8) * 3).astype(int).clip(0, n_terms - 1)))) for _ in range(800))
        sizes = np.array([len(p) for p in paths])
        terms = np.concatenate([np.array(p, np.int32) for p in paths])
        tfs, m = rng.integers(1, 5, len(terms)), rng.integers(75, 140, len(paths))
        ids = rng.permutation(800) + 800 * shard
        tree = lexical.Tree(ids, m, sizes, terms, tfs, n_terms)
        assert sorted((tree.begin[i], tree.end[i]) for i in range(len(tree.begin)) if not tree.children[i])[0][0] == 0
        tree.search(weights, dense, heap, 10, shard)
        assert not dense.any()
        value = lexical._saturated(tfs, np.repeat(m, sizes)) * np.array([weights.get(int(t), 0) for t in terms])
        every += list(zip(np.add.reduceat(value, tree.off[:-1]).tolist(), (-ids).tolist(), strict=True))
    assert sorted(e[:2] for e in heap) == sorted(every)[-10:]


def test_search_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a"), (2, "zz")], "item_id long, text string")
    names = ["item_id", "rank", "doc_id", "score"]
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs, items.where("item_id = 2"))):
        out = lexical.search(d, i)
        assert out.columns == names and out.collect() == []
    # the only document has the word: w = floor(1000 ln(4/3)), m = 100
    assert lexical.search(docs, items).collect()[0].score == 287 * (10**9 // 2200)


# --- SimHash ---------------------------------------------------------------------------------------------------------


def plain_print(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, distance):
    """Component number of each distinct fingerprint, all pairs compared."""
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(distinct):
        for q in distinct[:i]:
            if (p ^ q).bit_count() <= distance:
                root[find(p)] = find(q)
    return {p: find(p) for p in distinct}


def test_fingerprint_is_the_majority():
    rng = random.Random(2)
    texts = [None, "", "  \t\n", "One", "one two three", "a b c d", "A\x0bB\x0cC  d e", "é ß É 漢字   x", "x " * 9000]
    texts += [" ".join(rng.choices(["Ab", "c", "dé", "ef"], k=rng.randint(1, 60))) for _ in range(40)]
    texts.append(" ".join(f"w{i}" for i in range(400_000)))  # several pieces
    for t in texts:
        assert simhash.fingerprint(t) == plain_print(t)


@pytest.mark.parametrize("distance", [1, 2, 3, 4, 6])
@pytest.mark.parametrize("split", [1 << 16, 14])
def test_links_have_the_components_of_all_pairs(spark, distance, split):
    rng = random.Random(distance)
    prints = [rng.getrandbits(64) for _ in range(30)]
    for centre in list(prints[:6]) + [0, (1 << 64) - 1]:
        group = [centre]
        for _ in range(60):
            group.append(rng.choice(group) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
        prints += group
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in set(prints)]
    found = simhash.links(spark.createDataFrame(signed, "print long"), distance=distance, split=split).collect()
    root = {p: p for p in set(prints)}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for u, v in found:
        u, v = u % (1 << 64), v % (1 << 64)
        assert (u ^ v).bit_count() <= distance
        root[find(u)] = find(v)
    want = plain_components(prints, distance)
    groups = lambda name: sorted(sorted(p for p in want if name(p) == c) for c in {name(p) for p in want})
    assert groups(find) == groups(want.__getitem__)


@pytest.mark.parametrize("parts", [2, 3, 4, 5])
def test_every_layout_meets_every_pair(spark, parts):
    """All places of four flipped bits within reach of the pigeonhole: keys of both sides have one in common."""
    rng = random.Random(parts)
    segments = simhash.layout(64, 4, parts)
    assert sum(w for _, w, _ in segments) == 64 and sum(r + 1 for *_, r in segments) == 5
    rows = []
    for i in range(400):
        p = rng.getrandbits(64)
        q = p ^ sum(1 << b for b in rng.sample(range(64), 4))
        rows.append((i, *(x - (1 << 64) if x >> 63 else x for x in (p, q))))
    df = spark.createDataFrame(rows, "i long, p long, q long")
    from pyspark.sql import functions as F

    keys = df.select(F.arrays_overlap(simhash._keys(F.col("p"), segments), simhash._keys(F.col("q"), segments)).alias("met"))
    assert keys.where("not met").count() == 0


def test_near_duplicates_of_odd_rows(spark):
    rng = random.Random(9)
    base = [" ".join(rng.choices([f"v{i}" for i in range(300)], k=500)) for _ in range(12)]
    rows = [(10 + i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i % 12].replace(base[i % 12].split()[i], "other", 1)) for i in range(60)]  # near copies
    rows += [(5, base[2].upper()), (11, base[4]), (11, base[4]), (None, base[7]), (None, "alone here"), (300, None),
             (301, ""), (302, " \n"), (None, None), (303, "tiny"), (304, "a b c " * 50_000)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, print int, component string")
    got = simhash.near_duplicates(df.repartition(3)).collect()
    prints = [plain_print(t) for _, t in rows]
    of = plain_components(prints, 4)
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[of[p]] = min(i, least.get(of[p], i))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted([(i, f"{p:016x}", least.get(of[p])) for (i, _), p in zip(rows, prints, strict=True)], key=key)
    assert sorted([tuple(r) for r in got], key=key) == want
    assert simhash.near_duplicates(df.limit(0)).collect() == []
    assert any(r.doc_id is None and r.component_id is None for r in got)


# --- SQL -------------------------------------------------------------------------------------------------------------


def test_sql_of_search_and_clusters_runs():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    assert con.execute(lexical.sql()).fetchall() and con.execute(centroids.sql(rounds=1)).fetchall()


def test_shingles_hashed_together():
    """Hashes and fingerprints of many texts at once are those of the library, text by text."""
    rng = np.random.default_rng(21)
    raw = rng.integers(0, 256, 4000, dtype=np.uint8).tobytes()
    start, size = rng.integers(0, 3700, 3000), rng.integers(0, 290, 3000)
    start[:200], size[:200] = 5, np.arange(200)
    got = simhash.digests(np.frombuffer(raw + bytes(8), np.uint8), start, size)
    assert got.tolist() == [xxhash.xxh64_intdigest(raw[a : a + n], 42) for a, n in zip(start.tolist(), size.tolist(), strict=True)]
    signs = ["a", "Bc", "Üñ", "\x1c", "\x00", "0" * 70, " ", "x" * 9, "퟿" * 12]
    gaps = [" ", "  ", "\n", "\t\r\n", "\x0b\x0c"]
    texts = [None, "", " \n", "one two three", "a b c d"]
    for n in [*range(1, 40), 300, 1500]:
        texts.append("".join(signs[rng.integers(len(signs))] + gaps[rng.integers(len(gaps))] for _ in range(n)))
    texts += ["Q " * (1 << 19) + "end", texts[-1], "same same same same " * 400]
    assert simhash.prints_of(texts).tolist() == [simhash.fingerprint(t) for t in texts]
    assert simhash.prints_of([]).tolist() == simhash.prints_of([None])[:0].tolist()
