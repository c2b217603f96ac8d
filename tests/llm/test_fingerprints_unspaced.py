"""Fingerprints of texts without white space, with very many equal lines and without ids."""

import hashlib
import random

import pytest

from meander.llm import fingerprints
from meander.llm.fingerprints import fingerprint, from_text, likeness, minus, plus, to_text


def han(rng, n):
    return "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))


@pytest.mark.parametrize("kind", ["han", "hex"])
def test_every_byte_of_a_long_word_counts(kind):
    rng = random.Random(7)
    make = (lambda n: han(rng, n)) if kind == "han" else (lambda n: "".join(rng.choices("0123456789abcdef", k=n)))
    text, other = make(2000), make(2000)
    f = lambda s: fingerprint(s.encode())
    assert likeness(f(text), f(text[:1000] + other[:1000])) == pytest.approx(0.5, abs=0.12)
    assert likeness(f(text), f(text[:4] + other)) < 0.2
    assert likeness(f(text), f(text[:1000] + other[:3] + text[1000:])) > 0.95  # what is put in moves no other grams
    for at in range(0, 40):  # of a word of 40 bytes each byte changes the likeness lanes
        word = text.encode()[:39] if kind == "han" else text.encode()[:40]
        if at < len(word):
            changed = word[:at] + bytes([word[at] ^ 1]) + word[at + 1 :]
            assert (fingerprint(word)[1] != fingerprint(changed)[1]).any()
    a, b = f(text), f(other)
    assert to_text(minus(plus(a, b), b)) == to_text(a) and likeness(from_text(to_text(a)), a) == 1.0


def test_picks_are_the_least_of_their_windows():
    rng = random.Random(3)
    for size in (13, 14, 20, 300):
        body = bytes(rng.choices(b"abcd", k=size))
        import numpy as np

        padded = np.frombuffer(b"zz " + body + b"\0" * 12, np.uint8)
        eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        got = fingerprints._inside(eight, np.array([0, 3]), np.array([2, 3 + size])).tolist()
        mixed = eight * fingerprints._MIX1
        mixed = ((mixed ^ (mixed >> np.uint64(31))) * fingerprints._MIX2 | np.uint64(1)).tolist()
        want = set()
        for i in range(3, 3 + size - fingerprints.WINDOW + 1):
            least = min(mixed[i : i + fingerprints.WINDOW])
            want |= {j for j in range(i, i + fingerprints.WINDOW) if mixed[j] == least}
        assert got == sorted(want - {3})


def test_many_equal_lines():
    lines = ["one line that is repeated very often"] * 40_000
    other = lines[:-1] + ["another one"]
    f = lambda rows: fingerprint("\n".join(rows).encode())
    assert likeness(f(lines), f(other)) > 0.999
    assert likeness(f(lines[:32_760]), f(lines[:32_780])) > 0.999  # on both sides of 2^15
    assert likeness(f(lines[:30_000]), f(lines)) > 0.999


def test_rows_without_an_id_are_dealt_by_text(spark):
    rng = random.Random(9)
    named = [(i, f"text {i} {rng.random()}") for i in range(300)]
    nameless = [(None, f"{rng.random()} text") for _ in range(300)] + [(None, None), (None, "")]
    nameless += [(None, "p" * 300 + str(i)) for i in range(40)]
    for rows in (named + nameless, nameless, named, nameless[:1], named[:1] + nameless[:1]):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        placed = fingerprints.with_next(df).where("not tail").groupBy("slice").count().collect()
        out = fingerprints.fingerprints(df).collect()
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
        want = []
        for i, (key, text) in enumerate(order):
            changed = fingerprints.edited(text or "", order[(i + 1) % len(order)][1] or "")
            want.append((key, hashlib.sha256(changed.encode()).hexdigest()))
        assert sorted(map(str, want)) == sorted(str((r.doc_id, r.edited_sha256)) for r in out)
        if len(rows) > 300:
            assert max(r["count"] for r in placed) < len(rows) / 4
