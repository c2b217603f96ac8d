"""Licence texts as files hold them: hard-wrapped, in comments, with titles on lines of their own."""

import textwrap

import pytest

from meander.llm import licenses

S = {k: v[0] for k, v in licenses.SENTENCES.items()}
MIT = ("MIT License\n\nCopyright (c) 2020 A. Body\n\n" + S["mit_grant"] + ":\n\n" + S["mit_notice"] + ".\n\n" + S["as_is"] + ".")
BSD2 = (f"Copyright (c) 2020, A. Body\nAll rights reserved.\n\n{S['bsd_grant']}:\n\n1. {S['bsd_source']}.\n\n"
        f"2. {S['bsd_binary']}.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS.")
BSD3 = BSD2.replace("\n\nTHIS", f"\n\n(3) {S['bsd_endorse']}.\n\nTHIS")
ISC = "Copyright 2020 A. Body\n\n" + S["isc_grant"] + "."
GPL = "This program is free software: {}.\n\nThis program is distributed in the hope that it will be useful."
APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\");\n" + S["apache2_comply"] + "."
WHOLE = {"MIT": MIT, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "ISC": ISC, "Apache-2.0": APACHE,
         "GPL-2.0-or-later": GPL.format(S["gpl2_later"].replace("Foundation,", "Foundation;")),
         "GPL-3.0-or-later": GPL.format(S["gpl3_later"]), "MPL-2.0": S["mpl2_terms"] + ". If a copy of it is missing, get one."}


def wrapped(text, width, mark=""):
    lines = [line for part in text.split("\n") for line in (textwrap.wrap(part, width) or [""])]
    return "\n".join((mark + line).rstrip() for line in lines)


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.licenses, r.sentence_ids) for r in licenses.recognise(df).orderBy("doc_id").collect()]


@pytest.mark.parametrize("mark", ["", " * ", "# ", "// ", ";; ", "dnl ", "-- ", "    "])
def test_wrapped_texts(spark, mark):
    names, texts = [], []
    for width in (40, 72, 78, 10_000):
        for name, text in WHOLE.items():
            names.append(name)
            texts.append("/*\n" + wrapped(text, width, mark) + "\n */\nint x;\n")
    texts += [t.replace("\n", "\r\n") for t in texts]
    assert [r[0] for r in found(spark, texts)] == [[n] for n in 2 * names]


def test_lines_and_blank_lines(spark):
    grant = wrapped(S["mit_grant"], 70)
    texts = ["The MIT License (MIT)\nCopyright (c) 2020 A. Body\n" + grant + ":\n" + S["mit_notice"] + ".\n" + S["as_is"],
             "Released under the MIT License\nand nothing else", "a | MIT License ~ b", "x MIT License", "MIT\n\nLicense",
             "free\nsoftware by us.\nMIT\nLicense.", "This program is free\n# software; x", "(a) MIT License", "\n \nMIT License"]
    got = found(spark, texts)
    assert got[0] == (["MIT"], ["mit_name", "mit_grant", "mit_notice", "as_is"])
    assert [r[0] for r in got[1:]] == [["MIT"], [], [], [], ["MIT"], [], ["MIT"], ["MIT"]]
    assert got[6][1] == ["gpl_free"]


def test_long_texts_without_licences(spark):
    """Runs of marks and white space cost no more than their length."""
    texts = [". " * 100_000 + "license", "\n" * 200_000 + "license", "license\n * " * 50_000, "!" * 200_000 + "license",
             "permission is hereby granted free of charge\n" * 20_000]
    assert all(r == ([], []) for r in found(spark, texts))
