"""The eleven queries over small whole tables, against plain Python."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from meander.llm import catalog, licenses, packing
from meander.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def rows(name):
    return duckdb.connect().execute(f"SELECT * FROM '{SF}/{name}.parquet'").fetchdf()


@pytest.fixture(scope="module")
def docs():
    return rows("documents").sort_values("doc_id", ignore_index=True)


def run(spark, name):
    return QUERIES[name](spark, SF).toPandas()


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}


def test_language(spark, docs):
    out = run(spark, "op1_language_id").merge(docs, on="doc_id")
    assert len(out) == len(docs) and out.score.between(0, 1).all()
    held = out[out.held_out]
    assert set(held.doc_id) == {i for i in docs.doc_id if zlib.crc32(str(i).encode()) % 4 == 2}
    assert (held.lang == held.lang_pred).mean() > 0.95


def test_mix(spark, docs):
    out = run(spark, "op2_entropy_mix").merge(docs[["doc_id", "source", "text"]], on="doc_id")
    assert list(out["size"]) == [len(WORD.findall(t or "")) for t in out.text]
    assert (out.taken <= 2 * out["size"]).all()
    sizes = out.groupby("source")["size"].sum()
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    targets, free = {}, dict(zip(sizes.index, weights, strict=True))
    left = 1.5 * sizes.sum()
    while free:  # reshare what is above the caps
        level = left / sum(free.values())
        above = [s for s, w in free.items() if level * w >= 2 * sizes[s]]
        if not above:
            targets |= {s: level * w for s, w in free.items()}
            break
        for s in above:
            targets[s] = 2.0 * sizes[s]
            left -= targets[s]
            free.pop(s)
    for s, part in out.groupby("source"):
        assert part.target.iloc[0] == pytest.approx(targets[s])
        assert abs(part.taken.sum() - targets[s]) <= 0.02 * targets[s]  # ten documents a source here


def test_main_text(spark):
    from html import unescape

    pages = rows("pages")
    out = run(spark, "op3_html_tree_model").set_index("page_id")
    wrong = 0
    for page, html in zip(pages.page_id, pages.html, strict=True):
        body = re.search("<article>(.*?)(?:</article>|$)", html, re.S)[1].replace("<br>", " ")
        parts = (" ".join(unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split("</?(?:p|h1)>", body))
        wrong += out.text[page] != "\n".join(p for p in parts if p)
        assert out.n_chars[page] == len(out.text[page])
    assert wrong <= 1


def test_secrets(spark, docs):
    assign = re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = run(spark, "op4_secret_ownership").set_index("doc_id")
    for key, text in zip(docs.doc_id, docs.text, strict=True):
        found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        line = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
        assert out.base_sha256[key] == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(out.spans[key].split(","))


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = run(spark, "op5_harmonic_pack")
    pieces = {k: g.sort_values("start") for k, g in out.groupby("doc_id")}
    for key, text in zip(docs.doc_id, docs.text, strict=True):
        ids = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in pieces[key].itertuples():
            assert p.start == at and p.doc_tokens == len(ids)
            at += p.length
            assert p.ids_crc32 == zlib.crc32(ids[p.start : at].tobytes())
        assert at == len(ids)
    padding = 0
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]]
        n = int(g.length.sum())
        assert n <= 1024
        padding += 0 if n & (n - 1) == 0 else 1024 - n
    assert padding < 0.03 * out.length.sum()


def test_tokens_agree_on_odd_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    exact, own = Tokenizer.from_file(path), packing.tokens(path)
    odd = ["", " ", "  two  spaces ", "a\n b", "a \nb", "tab\t x", "it's we'll", "x<|endoftext|>y z <|endoftext|>",
           "é ñ ß 日本 語", "1 22 333,4", "end ", " nb  sp", "a  b", "!!! ?? a!", "\n\n\n x", "A" * 3000]
    for text in odd:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == exact.encode(text, add_special_tokens=False).ids, text


def test_tokens_keep_no_words():
    import tracemalloc

    import public_tokenizers

    own = packing.Tokens(public_tokenizers.path("byte_bpe_50k.json"))
    own.ids("a b")
    tracemalloc.start()
    for i in range(100):
        own.ids(" ".join(f"w{i}x{j}" for j in range(500)))
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 1_000_000  # 50,000 different words


def test_packing_takes_few_rows_at_a_time(spark, monkeypatch):
    import public_tokenizers

    names = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before, seen = [spark.conf.get(n) for n in names], []
    monkeypatch.setattr(packing, "materialised", lambda df, name, f=packing.materialised: (
        seen.append([int(spark.conf.get(n)) for n in names]), f(df, name))[1])
    df = spark.range(2000).selectExpr("id AS doc_id", "repeat('a ', 10) AS text").coalesce(1)
    out = packing.pack(df, vocabulary=public_tokenizers.path("byte_bpe_50k.json"))
    assert max(seen[0]) <= 256 and [spark.conf.get(n) for n in names] == before
    assert out.agg({"length": "sum"}).first()[0] == out.dropDuplicates(["doc_id"]).agg({"doc_tokens": "sum"}).first()[0]


def test_packing_numbers_left_over_pieces_in_their_task(spark):
    import public_tokenizers

    rows = [(i % 7 if i % 5 else None, "a " * (i % 90)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = public_tokenizers.path("byte_bpe_50k.json")
    cut = packing.pieces(df, path, 256, 0.04, 0, "doc_id", "text").toPandas()
    left = cut[cut.bin < 0]
    assert len(left)
    for (k, _), g in left.groupby(["class", "worker"]):
        assert len(g) < k and set(g.bin) == {-len(g)} and sorted(g.offset) == list(range(len(g)))
        g = g.sort_values("offset")
        key = list(zip(g.doc_id.notna(), g.doc_id.fillna(0), g.start, g.ids_crc32, g.length, strict=True))
        assert key == sorted(key)
    plan = packing.pack(df, vocabulary=path, capacity=256)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 5  # 7 before the tasks numbered their pieces


def test_license_queries(spark, docs):
    out = run(spark, "op6_license_rules").set_index("doc_id")
    names = {"GNU General Public License, version 3.": "GPL-3.0-only", "CC BY-NC 4.0.": "CC-BY-NC-4.0",
             "under the MIT License.": "MIT", "Apache License, Version 2.0.": "Apache-2.0"}
    for key, text in zip(docs.doc_id, docs.text, strict=True):
        assert set(filter(None, out.licenses[key].split(","))) == {v for k, v in names.items() if k in text}


def test_license_rules_take_the_longest_run(spark):
    bsd3 = ". ".join(licenses.SENTENCES[i][0] for i in ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"))
    texts = [bsd3, bsd3.rpartition(". ")[0], "MIT License\n" + licenses.SENTENCES["mit_grant"][0] + ":",
             "2.0", None, "", "This program is free software: " + licenses.SENTENCES["gpl2_later"][0] + "."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [r.licenses for r in licenses.recognise(df).orderBy("doc_id").collect()]
    assert got == [["BSD-3-Clause"], ["BSD-2-Clause"], ["MIT"], [], [], [], ["GPL-2.0-or-later"]]
    stems = re.compile(licenses.STEMS)
    assert all(stems.search(s) for s in licenses.known_sentences())


def test_quality(spark):
    out = run(spark, "op7_byte_cnn_quality").merge(rows("labels"), on="doc_id")
    assert out.score.between(0, 1).all()
    order = out.score.rank()
    good, bad = order[out.quality == 1], order[out.quality == 0]
    assert (good.sum() - len(good) * (len(good) + 1) / 2) / (len(good) * len(bad)) > 0.85


def test_neighbours(spark):
    data = rows("embeddings").sort_values("vec_id", ignore_index=True)
    x = np.stack(data.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = run(spark, "op8_kmeans_tree_search").sort_values(["query_id", "rank"])
    hits = 0
    for i in np.flatnonzero(data.vec_id % 50 == 0):
        s = x @ x[i]
        s[i] = -2
        best = set(data.vec_id[np.lexsort((data.vec_id, -s))[:5]])
        got = out[out.query_id == data.vec_id[i]]
        assert list(got["rank"]) == [1, 2, 3, 4, 5] and (np.diff(got.score) <= 0).all()
        hits += len(best & set(got.vec_id))
    assert hits >= 0.9 * len(out)


def test_near_duplicates(spark, docs):
    out = run(spark, "op9_minhash_dedup").set_index("doc_id")
    sets = {}
    for key, text in zip(docs.doc_id, docs.text, strict=True):
        w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[key] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    least = {k: k for k in sets}

    def find(k):
        while least[k] != k:
            k = least[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 85 * len(sets[a] | sets[b]):
                a_, b_ = sorted((find(a), find(b)))
                least[b_] = a_
    for k in keys:
        assert out.n_shingles[k] == len(sets[k]) and out.component_id[k] == find(k)
        assert out.kept[k] == (find(k) == k)


def test_fingerprints(spark, docs):
    out = run(spark, "op10_multiset_fingerprint").sort_values("doc_id", ignore_index=True)
    texts = list(docs.text)
    for i, text in enumerate(texts):
        half = len(text) // 2
        new = text[: len(text) - half] + texts[(i + 1) % len(texts)][:half]
        assert out.edited_sha256[i] == hashlib.sha256(new.encode()).hexdigest() and out.n_chars[i] == len(text)
    by_text = collections.defaultdict(set)
    for text, print_ in zip(texts, out.fingerprint, strict=True):
        by_text[text].add(print_)
    assert all(len(v) == 1 for v in by_text.values()) and len({*out.fingerprint}) == len(by_text)
    assert out.near_edited.mean() > 0.4 > 0.1 > out.near_next.mean()


def test_pipeline(spark, docs):
    """Every stage on its predecessor's rows; the last against what the mix kept."""
    state, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, state, SF)
        if name != "pack":
            assert out.columns == state.columns
        state = corpus_pipeline.materialised(out, name)
        seen.append(state.toPandas())
    language, near, masked, mixed, packed = seen
    letters = {k for k, t in zip(docs.doc_id, docs.text, strict=True) if any(map(str.isalpha, t))}
    assert set(language.doc_id) <= letters and len(language) > 0.97 * len(letters)
    assert near.doc_id.is_unique and set(near.doc_id) <= set(language.doc_id)
    assert set(masked.doc_id) == set(near.doc_id)
    assert not masked.text.str.contains("[0-9a-f]{24}", regex=True).any()
    assert list(masked.n_chars) == [len(t) for t in masked.text]
    assert set(mixed.doc_id) <= set(masked.doc_id) and mixed.groupby("doc_id").size().max() <= 2
    assert set(packed.doc_id) == set(mixed.doc_id)
    whole = packed.groupby("doc_id").length.sum() / packed.groupby("doc_id").doc_tokens.first()
    assert (whole == mixed.groupby("doc_id").size()).all()
    assert catalog.queries()["pipeline"]
