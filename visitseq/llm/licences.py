"""Licence scan by canonical digests.

Text is brought to a canonical form line by line: lower case, runs of anything but letters and
digits as one space, lines that state a copyright left out, equivalent spellings made one. The
canonical lines joined by spaces are the canonical text, so line breaks and indentation do not
matter. The digest of an entire document and of each of its lines (one-line notices) is joined
with the digests of known licence texts. Digests are of whole texts: a licence with a word
changed or added is another text.

Digests are made distinct within a row before they move; the known side has one row a digest.
Rows are treated one by one, repeated rows and rows without doc_id included. Null and empty
texts, and texts of copyright lines only, have no licence. Other columns are not read.
"""

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from visitseq.sources import materialize

# Variant and standard spelling.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze",
    "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized",
    "cancelled": "canceled", "catalogue": "catalog", "categorise": "categorize",
    "centre": "center", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite",
    "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize",
    "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license",
    "licenced": "licensed", "licences": "licenses", "maximise": "maximize",
    "modelling": "modeling", "offence": "offense", "optimise": "optimize",
    "organisation": "organization", "organise": "organize", "practise": "practice",
    "programme": "program", "realise": "realize", "recognise": "recognize",
    "signalling": "signaling", "sublicence": "sublicense", "utilisation": "utilization",
    "whilst": "while", "wilful": "willful",
}
# Names by which one-line notices call a licence.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"],
    "MIT": ["MIT License", "MIT"],
    "ISC": ["ISC License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPL v2", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPL v3", "GPLv3"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPLv3"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0",
                     "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0",
                     "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "Unlicense": ["Unlicense"],
}
NOTICES = ["Licensed under {}.", "Licensed under the {}.", "Released under {}.",
           "Released under the {}.", "Distributed under the {}.",
           "This work is licensed under {}.", "This work is licensed under the {}.",
           "This work is licensed under a {}.", "This software is licensed under the {}."]
# Public licence texts.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
claim that you wrote the original software. If you use this software
in a product, an acknowledgment in the product documentation would be
appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.

In jurisdictions that recognize copyright laws, the author or authors
of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit
of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this
software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
}
# Lines that stand above a text.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License",
                     'BSD 2-Clause "Simplified" License', "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License",
                     'BSD 3-Clause "New" or "Revised" License'],
    "Unlicense": ["The Unlicense", "Unlicense"],
}
# Lines of the usual file headers.
HEADERS = {
    "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License");',
                   'Licensed under the Apache License, Version 2.0 (the "License"); you may not',
                   'Licensed under the Apache License, Version 2.0 (the "License"); you may not '
                   "use this file except in compliance with the License."],
    "MPL-2.0": ["License, v. 2.0. If a copy of the MPL was not distributed with this",
                "This Source Code Form is subject to the terms of the Mozilla Public License, "
                "v. 2.0."],
}
# Words after "copyright" that are no holder, as in a wrapped line of a text.
NO_HOLDER = ["and", "as", "for", "holder", "holders", "in", "interest", "interests", "is", "law",
             "laws", "license", "licenses", "licence", "licences", "notice", "notices", "of", "or",
             "owner", "owners", "statement", "the", "to"]


def _other_word(words: list[str], start: bool = True) -> str:
    """A pattern of any word but these, without lookahead."""
    firsts = sorted({w[0] for w in words if w})
    longer = f"[^ {''.join(firsts)}][^ ]*"
    options = [longer, *(c + _other_word([w[1:] for w in words if w and w[0] == c], False)
                         for c in firsts)]
    return f"({'|'.join(options)})" + ("" if start or "" in words else "?")


COPYRIGHT = (r"^((copyright( c)?|c) (19|20)[0-9][0-9]( .*)?|copyright (c|by)( .*)?|copyright"
             rf"|copyright {_other_word(NO_HOLDER)}( .*)?|all rights reserved)$")
NOT_WORD = r"[^\p{L}\p{N}]+"


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of the built-in licences: texts, titles, notices and identifier lines."""
    out = []
    for licence, text in TEXTS.items():
        forms = [text]
        if licence.startswith("BSD"):  # bullets instead of numbers
            forms.append(re.sub(r"(?m)^\d\. ", "* ", text))
        if licence == "Unlicense":
            forms += [text.replace("https:", "http:"), text.replace("org>", "org/>"),
                      text[:text.index("For more")]]
        out += [(licence, form) for form in forms]
        out += [(licence, f"{title}\n{form}") for title in TITLES[licence] for form in forms]
    out += [(licence, line) for lines in (TITLES, HEADERS) for licence, each in lines.items()
            for line in each]
    for licence, names in NAMES.items():
        out.append((licence, f"SPDX-License-Identifier: {licence}"))
        out += [(licence, notice.format(name)) for name in names for notice in NOTICES]
    return out


def known_licences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(known_texts(), "licence string, text string")


def canonical_lines(text: Column) -> Column:
    """The canonical form of every line that has one."""
    spelled = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    variant = f"(^| )({'|'.join(SPELLINGS)})( |$)"

    def standard(line):
        words = F.transform(F.split(line, " "), lambda w: F.coalesce(F.element_at(spelled, w), w))
        return F.when(line.rlike(variant), F.array_join(words, " ")).otherwise(line)

    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("©"), F.lit(" (c) ")))
    lines = F.transform(F.split(plain, "\n"), lambda x: F.trim(F.regexp_replace(x, NOT_WORD, " ")))
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(COPYRIGHT))
    return F.transform(kept, standard)


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def scan_licences(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, whole (licences equal to the entire text), lines (licences equal to a line).

    Both are sorted arrays. ``known`` has licence and text; texts with equal canonical forms
    are reported together.
    """
    whole = F.array_join("lines", " ")
    texts = (known.filter("licence is not null").select(
        "licence", digest(F.array_join(canonical_lines(F.col("text")), " ")).alias("digest"))
        .groupBy("digest").agg(F.array_sort(F.collect_set("licence")).alias("found")))
    lines = docs.select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    marked = lines.select("doc_id", F.when(F.size("lines") > 0, digest(whole)).alias("whole"),
                          F.array_distinct(F.transform("lines", digest)).alias("digests"))
    marked = materialize(marked.withColumn("row", F.monotonically_increasing_id()), "digests")
    parts = (marked.select("row", "whole", F.explode("digests").alias("digest"))
             .withColumn("of_text", F.lit(False))
             .unionByName(marked.filter("whole is not null").select(
                 "row", "whole", F.col("whole").alias("digest"), F.lit(True).alias("of_text"))))

    def listed(of_text):
        each = F.flatten(F.collect_list(F.when(F.col("of_text") == of_text, F.col("found"))))
        return F.array_sort(F.array_distinct(each))

    hits = (parts.join(texts, "digest").groupBy("row")
            .agg(listed(True).alias("of_whole"), listed(False).alias("of_lines")))
    none = F.array().cast("array<string>")
    return (marked.select("row", "doc_id").join(hits, "row", "left")
            .select("doc_id", F.coalesce("of_whole", none).alias("whole"),
                    F.coalesce("of_lines", none).alias("lines")))
