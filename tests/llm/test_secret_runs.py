"""Many secrets in one text, verdicts by owners and repositories, no value in clear."""

import re
import time

from pyspark.sql import functions as F

from meander.llm import secrets


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(secrets.ACCESS, text)]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(secrets.HEX, text)])


def plain_masked(text, spans):
    out, at = "", 0
    for start, _, end in sorted(spans):
        if start > at or not out:
            out += text[at:start] + "<secret>"
        at = max(at, end)
    return out + text[at:]


def test_runs_of_spans_equal_plain_python(spark):
    piece = "\u00e9 x{0} token = value{0}abc, AKIA{0:020d} and {0:030x}password:{0:024x}\n"
    texts = ["".join(piece.format(i) for i in range(n)) for n in (0, 1, 42, 43, 64, 128, 129, 400)]
    texts += ["token=abcdef" * 300, "", "token=short token=abcdef" * 200, "0" * 24 + "x" + "f" * 30]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.base] for r in secrets.scan(df).collect()}
    assert got == {i: plain_spans(t) for i, t in enumerate(texts)}
    wide = {r.doc_id: [(s.start, s.kind, s.end) for s in r.extra] for r in secrets.document_spans(df).collect()}
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert clean == {i: plain_masked(t, got[i] + wide[i]) for i, t in enumerate(texts)}


def test_cost_grows_with_the_number_of_secrets(spark):
    def seconds(n):
        df = spark.createDataFrame([(1, "token = value12345 and more\n" * n, "s")], "doc_id long, text string, source string")
        began = time.time()
        assert secrets.redact(df).first().text == "<secret> and more\n" * n
        return time.time() - began

    seconds(100)
    assert seconds(16_000) < 20


def test_verdict_by_owners_and_repositories_and_no_value_in_clear(spark):
    value = "Abc123Abc123Abc123Abc123"
    rows = [(i, f"see {value} here", "one") for i in range(60)]
    rows += [(100 + i, f"see X{value} here", f"o{i}") for i in range(3)]
    rows += [(200 + i, f"see Y{value} here", "one") for i in range(49)]
    rows += [(300 + i, f"see Z{value} here", f"o{i % 2}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    scanned, found = secrets.findings(df)
    got = {(r.group, r.n_owners, r.n_repositories, r.verdict) for r in found.select(
        F.floor(F.col("doc_id") / 100).alias("group"), "n_owners", "n_repositories", "verdict").collect()}
    assert got == {(0, 1, 60, "example"), (1, 3, 3, "example"), (2, 1, 49, "live"), (3, 2, 60, "live")}
    assert not scanned.where(F.to_json(F.struct("*")).contains("bc123")).count()
