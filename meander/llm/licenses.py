"""License scans by sentence rules, in DataFrame functions only.

A text is normalised to words and marks for sentence ends, line ends and blank lines; known sentences become
sentence identifiers.  A known sentence begins and ends at a mark or at the text's ends.  Line ends, comment marks
and punctuation inside it do not matter, so hard-wrapped notices and titles on a line of their own are both found;
a blank line is never inside one.  ``{}`` in a known sentence is a slot for a holder's name, at most twelve words.
Runs of identifiers are then matched against ordered rules, longer rules first;
a matched run is used up, so a three-clause notice is not reported as a two-clause one too.  Both tables are small
fixed literals: nothing is joined and nothing is shuffled.

Null and empty texts give no licence; repeated rows each get their own, equal result; other columns stay.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and notices, by identifier.
SENTENCES = {
    "mit_name": ["Released under the MIT License", "Licensed under the MIT License", "The MIT License",
                 "MIT License", "The MIT License (MIT)"],
    "mit_grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                  "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
                  "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
                  "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
                  "furnished to do so, subject to the following conditions"],
    "mit_notice": ["The above copyright notice and this permission notice shall be included in all copies or "
                   "substantial portions of the Software"],
    "as_is": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
              "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
              "NONINFRINGEMENT"],
    "apache2_name": ["Licensed under the Apache License, Version 2.0",
                     "Licensed under the Apache License, Version 2.0 (the \"License\")", "Apache License, Version 2.0",
                     "Apache License Version 2.0, January 2004"],
    "apache2_comply": ["you may not use this file except in compliance with the License"],
    "gpl3_name": ["This work is licensed under the GNU General Public License, version 3",
                  "Licensed under the GNU General Public License, version 3", "GNU General Public License, version 3",
                  "GNU General Public License Version 3, 29 June 2007"],
    "gpl_free": ["This program is free software"],
    "gpl2_later": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                   "published by the Free Software Foundation, either version 2 of the License, or (at your option) "
                   "any later version"],
    "gpl3_later": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                   "published by the Free Software Foundation, either version 3 of the License, or (at your option) "
                   "any later version"],
    "bsd_grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted "
                  "provided that the following conditions are met"],
    "bsd_source": ["Redistributions of source code must retain the above copyright notice, this list of conditions "
                   "and the following disclaimer"],
    "bsd_binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of "
                   "conditions and the following disclaimer in the documentation and/or other materials provided "
                   "with the distribution"],
    "bsd_endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to "
                    "endorse or promote products derived from this software without specific prior written "
                    "permission",
                    "Neither the name of {} nor the names of {} may be used to endorse or promote products derived "
                    "from this software without specific prior written permission",
                    "Neither the name of {} may be used to endorse or promote products derived from this software "
                    "without specific prior written permission",
                    "The name of {} may not be used to endorse or promote products derived from this software without "
                    "specific prior written permission",
                    "The names of {} may not be used to endorse or promote products derived from this software "
                    "without specific prior written permission"],
    "isc_grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
                  "fee is hereby granted, provided that the above copyright notice and this permission notice appear "
                  "in all copies",
                  "Permission to use, copy, modify, and distribute this software for any purpose with or without fee "
                  "is hereby granted, provided that the above copyright notice and this permission notice appear in "
                  "all copies"],
    "0bsd_grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
                   "fee is hereby granted"],
    "zlib_grant": ["Permission is granted to anyone to use this software for any purpose, including commercial "
                   "applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "lgpl_free": ["This library is free software"],
    "lgpl21_later": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
                     "License as published by the Free Software Foundation, either version 2.1 of the License, or (at "
                     "your option) any later version"],
    "lgpl3_later": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
                    "License as published by the Free Software Foundation, either version 3 of the License, or (at "
                    "your option) any later version"],
    "agpl3_later": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
                    "License as published by the Free Software Foundation, either version 3 of the License, or (at "
                    "your option) any later version"],
    "gpl2_text": ["GNU General Public License Version 2, June 1991"],
    "lgpl21_text": ["GNU Lesser General Public License Version 2.1, February 1999"],
    "lgpl3_text": ["GNU Lesser General Public License Version 3, 29 June 2007"],
    "agpl3_text": ["GNU Affero General Public License Version 3, 19 November 2007"],
    "bsl1_name": ["Boost Software License - Version 1.0 - August 17th, 2003",
                  "Distributed under the Boost Software License, Version 1.0"],
    "epl2_name": ["Eclipse Public License - v 2.0"],
    "mpl2_terms": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
                   "Mozilla Public License Version 2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "ccbync4_name": ["Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0"],
    "ccby4_name": ["Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0"],
    "ccbysa4_name": ["Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0"],
}

# A licence and the identifiers it takes, in order.
RULES = [
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("MIT", ["mit_name", "mit_grant", "mit_notice", "as_is"]),
    ("MIT", ["mit_grant", "mit_notice", "as_is"]),
    ("GPL-2.0-or-later", ["gpl_free", "gpl2_later"]),
    ("GPL-3.0-or-later", ["gpl_free", "gpl3_later"]),
    ("LGPL-2.1-or-later", ["lgpl_free", "lgpl21_later"]),
    ("LGPL-3.0-or-later", ["lgpl_free", "lgpl3_later"]),
    ("LGPL-3.0-or-later", ["gpl_free", "lgpl3_later"]),
    ("AGPL-3.0-or-later", ["gpl_free", "agpl3_later"]),
    ("Apache-2.0", ["apache2_name", "apache2_comply"]),
    ("Apache-2.0", ["apache2_name"]),
    ("GPL-3.0-only", ["gpl3_name"]),
    ("MIT", ["mit_name"]),
    ("ISC", ["isc_grant"]),
    ("0BSD", ["0bsd_grant"]),
    ("Zlib", ["zlib_grant"]),
    ("GPL-2.0-only", ["gpl2_text"]),
    ("LGPL-2.1-only", ["lgpl21_text"]),
    ("LGPL-3.0-only", ["lgpl3_text"]),
    ("AGPL-3.0-only", ["agpl3_text"]),
    ("BSL-1.0", ["bsl1_name"]),
    ("EPL-2.0", ["epl2_name"]),
    ("MPL-2.0", ["mpl2_terms"]),
    ("Unlicense", ["unlicense"]),
    ("CC-BY-NC-4.0", ["ccbync4_name"]),
    ("CC-BY-4.0", ["ccby4_name"]),
    ("CC-BY-SA-4.0", ["ccbysa4_name"]),
]

#: A line such as "SPDX-License-Identifier: MIT" names any licence of the rules.
SPDX = "SPDX-License-Identifier: "

#: Sentences end at .!?;: before white space; digits such as "2.0" stay whole.
BREAK = r"[.!?;:](?:[\x20\x09]+|$)"
#: Words that comment out a line; comment marks of other characters vanish with them.
COMMENT = r"(?m)^[^a-z0-9\n]*@?(?:dnl|rem)\b"
#: The mark of a list item, such as "(1)" or "b)", is no part of its sentence; "1." ends one anyway.
ITEM = r"(?m)^([^a-z0-9\n]*(?:[0-9]{1,2}|[a-z]))\)[\x20\x09]+"
#: A line end and all before the next one, without a letter or digit: a line without words.
BLANK = r"\n[^a-z0-9\n]*+(?=\n)"
#: Every known sentence holds one of these stems, so texts without any need no cutting.  No stem can be wrapped.
STEMS = "licen|permi|redistribut|warrant|software|copyright|endorse"


def normalised(sentence: str) -> str:
    """Lower case, everything but letters and digits of ASCII to one space, trimmed."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def known_sentences() -> dict[str, str]:
    """Normalised text to identifier; a slot stays ``{}``."""
    known = {" {} ".join(normalised(part) for part in whole.split("{}")): name
             for name, texts in SENTENCES.items() for whole in texts}
    return known | {normalised(SPDX + licence): f"spdx_{licence}" for licence, _ in RULES}


def ordered_rules() -> list[tuple[str, list[str]]]:
    """Licences and their identifiers, longer runs first; the named lines last."""
    named = [(licence, [f"spdx_{licence}"]) for licence in dict.fromkeys(licence for licence, _ in RULES)]
    return sorted(RULES + named, key=lambda r: -len(r[1]))


def marked(text: Column) -> Column:
    """Lower-case words of ``text`` with | for a sentence end, a line end for itself and ~ for blank lines."""
    out = F.regexp_replace(F.lower(F.translate(text, "|~", "^^")), r"\r\n?", "\n")
    out = F.regexp_replace(out, COMMENT, "")
    out = F.regexp_replace(out, ITEM, "$1|")
    out = F.regexp_replace(F.regexp_replace(out, BLANK, "~"), BREAK, "|")
    return F.regexp_replace(out, r"[^a-z0-9|~\n]+", " ")


def _as_pattern(sentence: str) -> str:
    """A normalised sentence as a pattern: any marks but blank lines between words, up to twelve words in a slot."""
    slot = r"[a-z0-9]+(?:[ |\n]+[a-z0-9]+){0,11}?"
    return sentence.replace(" ", r"[ |\n]+").replace("{}", slot)


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of ``text``, in order."""
    known = known_sentences()
    whole = {s: name for s, name in known.items() if "{}" not in s}
    table = F.create_map(*[F.lit(x) for pair in whole.items() for x in pair])
    # longer ones first: a title may begin another
    choice = "|".join(_as_pattern(k) for k in sorted(known, key=len, reverse=True))
    pattern = rf"(?<=^|^ |[|~\n]|[|~\n] )(?:{choice})(?= ?(?:[|~\n]|$))"
    hits = F.regexp_extract_all(marked(text), F.lit(pattern), F.lit(0))

    def name_of(hit: Column) -> Column:
        plain = F.regexp_replace(hit, r"[ |\n]+", " ")
        slotted = [F.when(plain.rlike(f"^{_as_pattern(s)}$"), F.lit(name)) for s, name in known.items() if "{}" in s]
        return F.coalesce(F.try_element_at(table, plain), *slotted)

    ids = F.transform(hits, name_of)
    return F.when(text.rlike(f"(?i){STEMS}"), ids).otherwise(F.array().cast("array<string>"))


def recognise(docs: DataFrame, *, text: str = "text", into: str = "licenses", ids: str = "sentence_ids") -> DataFrame:
    """``docs`` plus the sentence identifiers and the licences found, both arrays (licences in order of the rules)."""
    col = F.coalesce(F.col(text), F.lit(""))
    rest = F.concat(F.lit(" "), F.concat_ws(" ", F.col(ids)), F.lit(" "))
    hits = []
    for name, sequence in ordered_rules():
        run = " " + " ".join(sequence) + " "
        hits.append(F.when(F.contains(rest, F.lit(run)), F.lit(name)))
        rest = F.replace(rest, F.lit(run), F.lit(" | "))
    found = docs.withColumn(ids, sentence_ids(col))
    licences = F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull()))
    none = F.array().cast("array<string>")
    return found.withColumn(into, F.when(F.size(ids) > 0, licences).otherwise(none))
