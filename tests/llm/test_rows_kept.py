"""No document is lost, whatever its id, and extra columns may have any name."""

import random

import corpus_pipeline
from meander.llm import langid, minhash, mixing, secrets

NAMES = ["i", "m", "all", "_id", "_mark", "_nth", "_copy", "_key", "_own", "_spans", "_lang", "_rate", "row", "id", "name",
         "body", "own", "lang_pred", "mark", "nth", "turn", "u", "spans", "clean", "changed", "copy", "rate", "n"]


def words(seed, n=40):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 400)}" for _ in range(n))


def test_texts_that_share_an_id_are_documents(spark):
    a, u, x = words(1), words(2), words(3)
    rows = [(1, a), (2, a), (2, u), (3, x)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, minhash.deduplicate(df).collect())) == [(1, a), (2, u), (3, x)]


def test_rows_without_id_and_repeated_rows(spark):
    a, b, c = words(1), words(2), words(3)
    rows = [(None, a), (7, a), (None, b), (None, b), (5, c), (5, c), (9, None), (9, None), (None, ""), (4, c + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, minhash.deduplicate(df, percent=80).collect()), key=str)
    want = [(7, a), (None, b), (4, c + " more"), (9, None), (9, None), (None, "")]
    assert got == sorted(want, key=str)


def test_any_name(spark):
    text = words(4) + " password: hunter2hunter2"
    rows = [(i, text if i < 2 else words(10 + i), "en", f"s{i % 2}", 5, *range(len(NAMES))) for i in range(8)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in NAMES)
    df = spark.createDataFrame(rows, schema)
    once, mixed, masked = minhash.deduplicate(df), mixing.repeated(df), secrets.redact(df)
    assert once.count() == 7 and masked.count() == 8 and mixed.count() > 0
    for out in (once, mixed, masked, corpus_pipeline.language_id(spark, df, "")):
        assert out.columns == df.columns
        assert {tuple(r)[5:] for r in out.collect()} <= {tuple(range(len(NAMES)))}
    assert masked.where("text LIKE '%hunter2%'").count() == 0


def test_rare_languages_are_learned(spark):
    rng = random.Random(3)
    alphabets = {f"big{k}": "abcdefghij"[k * 2 :] + "xyz" for k in range(3)}
    rare = {f"rare{k}": chr(0x3B1 + 3 * k) + chr(0x3B2 + 3 * k) + chr(0x3B3 + 3 * k) for k in range(4)}

    def text(letters):
        return " ".join("".join(rng.choices(letters, k=5)) for _ in range(30))

    rows = [(lang, text(letters)) for lang, letters in alphabets.items() for _ in range(700)]
    rows += [(lang, text(letters)) for lang, letters in rare.items() for _ in range(2)]
    rows += [("big0", rows[0][1])] * 300  # copies of one text count once
    df = spark.createDataFrame(rows, "lang string, text string")
    model = langid.fit(df, max_train=300)
    assert set(rare) <= set(model.langs)
    fresh = spark.createDataFrame([(lang, text(letters)) for lang, letters in rare.items()], "want string, text string")
    assert all(r.want == r.lang_pred for r in langid.identify(fresh, model, ["want"]).collect())
