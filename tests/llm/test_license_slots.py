"""Licences with holders' names, heads of licence files and named lines."""

import pytest

from meander.llm import licenses

S = {k: v[0] for k, v in licenses.SENTENCES.items()}
BSD = f"{S['bsd_grant']}:\n\n1. {S['bsd_source']}.\n\n2. {S['bsd_binary']}.\n\n"
END = "may be used to endorse or promote\nproducts derived from this software without specific prior written permission.\n"
LESSER = ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser "
          "General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at "
          "your option) any later version.")
CASES = [
    (BSD + "3. Neither the name of the University nor the names of its contributors\n   " + END, ["BSD-3-Clause"]),
    (BSD + "* Neither the name of Body, Limb & Co. Inc. nor the\n  names of its contributors " + END, ["BSD-3-Clause"]),
    (BSD + "3. The name of the author may not be used to endorse or promote products derived from this software "
     "without specific prior written permission.", ["BSD-3-Clause"]),
    (BSD, ["BSD-2-Clause"]),
    ("                 Apache License\n           Version 2.0, January 2004\n        http://example.org/\n", ["Apache-2.0"]),
    ("   GNU GENERAL PUBLIC LICENSE\n     Version 3, 29 June 2007\n\n Copyright (C) 2007", ["GPL-3.0-only"]),
    ("   GNU GENERAL PUBLIC LICENSE\n     Version 2, June 1991\n", ["GPL-2.0-only"]),
    (LESSER, ["LGPL-2.1-or-later"]),
    ("Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, "
     "provided that the above\ncopyright notice and this permission notice appear in all copies.", ["ISC"]),
    ("// SPDX-License-Identifier: GPL-2.0-or-later\nint x;", ["GPL-2.0-or-later"]),
    ("# SPDX-License-Identifier: MIT", ["MIT"]),
    ("the MIT licence is what we speak of here", []),
    ("Neither the name of the king nor the names of his men were known.", []),
]


@pytest.mark.parametrize("width", [None, 40])
def test_named_holders_heads_and_lines(spark, width):
    texts = [t if width is None else t.replace("\n", "\r\n") for t, _ in CASES]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.licenses for r in licenses.recognise(df).orderBy("doc_id").collect()]
    assert got == [want for _, want in CASES]


def test_a_slot_costs_little_in_long_texts(spark):
    text = "Neither the name of " + "word " * 200_000 + "nor the names of "
    df = spark.createDataFrame([(0, text * 2)], "doc_id long, text string")
    assert licenses.recognise(df).first().licenses == []
