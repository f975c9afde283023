"""Licences by canonical digest: a text is looked up whole, not searched.

A unit is the whole text, one of its lines, or a run of comment lines (as at the head of a source file). It
is brought to a canonical form (lower case; copyright lines and bare titles dropped; equivalent
spellings made one; everything but letters and digits a single space) and its SHA-256 is joined
with the digests of known licence texts, headers and notices. The known table is made of the texts
in this file, or of any that the caller gives to known_digests(); its size is checked before it is
broadcast, and beyond the bound the join shuffles by digest.

Main path in DataFrame expressions: no Python runs on the executors. Units that are longer than any
known form, or do not begin with a word with which one begins, are not hashed, as they cannot be equal.

Defined results: null, empty and wordless texts match nothing; a text is digested whole, whatever
its length; repeated rows are each reported; a text with several notices has a row for each
(unit, licence), with the number of such units; empty tables give an empty result; further
columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the known table up to which it is broadcast: at most some 10 MB.
BROADCAST_ROWS = 50_000

#: Spellings that licence lists hold to be equal, as (pattern, replacement) on canonical words.
SPELLINGS = [
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("sublicence", "sublicense"),
    ("organisation", "organization"),
    ("organisations", "organizations"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("non commercial", "noncommercial"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("v2 0", "version 2 0"),
    ("v3", "version 3"),
]

#: Short licences and standard notices, by SPDX identifier.
KNOWN_TEXTS: list[tuple[str, str, str]] = [
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("MIT", "notice", "This project is licensed under the MIT License."),
    ("MIT", "notice", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "notice", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "notice", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "notice", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-or-later", "notice", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "notice", "Licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "notice", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "notice", "SPDX-License-Identifier: BSD-2-Clause"),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "notice", "Released under CC0 1.0."),
    (
        "MIT",
        "text",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        "text",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "0BSD",
        "text",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "BSD-2-Clause",
        "text",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "BSD-3-Clause",
        "text",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "Zlib",
        "text",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "Unlicense",
        "text",
        """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest
in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our
heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future
rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
    ),
    (
        "BSL-1.0",
        "text",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the
Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do
so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the
Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source
language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR
ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING
FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "Apache-2.0",
        "header",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    ),
    (
        "GPL-3.0-or-later",
        "header",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>.""",
    ),
]

#: Titles above licence texts, as canonical words; a line of nothing else is dropped.
TITLES = (
    "mit license", "the mit license", "the mit license mit", "mit license mit", "expat license", "isc license", "the isc license", "zero clause bsd", "bsd zero clause license",
    "bsd 2 clause license", "the bsd 2 clause license", "simplified bsd license", "bsd 3 clause license", "the bsd 3 clause license", "new bsd license", "bsd license", "zlib license",
    "the zlib license", "boost software license version 1 0 august 17th 2003", "boost software license version 1 0", "the unlicense", "unlicense",
)
#: What makes a lower-cased line a copyright line: the word or sign first, but not the beginning of a sentence about copyright.
COPYRIGHT_LINE = r"^[^\p{L}\p{N}]*(?:copyright(?:[^\p{L}\p{N}]*(?:\(c\)|©|[0-9]{4})|[^\p{L}\p{N}]+(?:\p{L}[^\s.]*\.?[^\p{L}\p{N}.]*){1,6}$)|\(c\)|©|all rights reserved).*$"
#: With what a comment line begins, after white space.
COMMENT_SIGNS = ("#", "/", "*", "-", ";", "%", "<", '"', "'", "!")
#: Stands for a line that is no comment.
GAP = "\x01"


def words_of(line: Column) -> Column:
    """The words of a lower-cased line with single spaces between; nothing for a copyright line or a title."""
    words = F.trim(F.regexp_replace(line, r"[^\p{L}\p{N}]+", " "))
    about = line.contains("copyright") | line.contains("(c)") | line.contains("©") | line.contains("all rights reserved")
    return F.when(about & line.rlike(COPYRIGHT_LINE), F.lit("")).otherwise(words)


def untitled(words: Column) -> Column:
    """The words of a line, nothing for a title: for units of several lines."""
    return F.when((F.length(words) <= max(map(len, TITLES))) & spelled(words).isin(*TITLES), F.lit("")).otherwise(words)


def spelled(words: Column) -> Column:
    """Equivalent spellings made one. Every word gets spaces of its own, so that neighbours are both replaced."""
    out = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b.replace(' ', '  ')} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def split_lines(text: Column) -> Column:
    return F.split(F.lower(text), "\n")


def joined(lines: Column) -> Column:
    """One form of several lines' words."""
    return F.array_join(F.filter(F.transform(lines, untitled), lambda x: x != ""), " ")


def comments(raw: Column, lines: Column) -> Column:
    """The forms of runs of comment lines: words of such lines, gaps for others, cut at the gaps."""
    kept = F.zip_with(raw, lines, lambda line, words: F.when(F.substring(F.ltrim(line), 1, 1).isin(*COMMENT_SIGNS), words).otherwise(F.lit(GAP)))
    runs = F.filter(F.split(F.array_join(kept, "\n"), GAP), lambda x: F.trim(x, F.lit("\n")).contains("\n"))  # of two lines at least
    return F.transform(runs, lambda x: joined(F.split(x, "\n")))


def known_digests(spark: SparkSession, texts: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """license_id, kind, digest, n_chars and first_word (of the canonical form) of known texts; of equal forms the first by name."""
    rows = spark.createDataFrame(texts or KNOWN_TEXTS, "license_id string, kind string, text string")
    form = spelled(joined(F.transform(split_lines(F.col("text")), words_of)))
    rows = rows.select("license_id", "kind", form.alias("form")).filter(F.col("form") != "")
    rows = rows.groupBy(F.sha2("form", 256).alias("digest"), F.length("form").alias("n_chars"), F.split_part("form", F.lit(" "), F.lit(1)).alias("first_word"))
    return rows.agg(F.min(F.struct("license_id", "kind")).alias("k")).select("k.license_id", "k.kind", "digest", "n_chars", "first_word")


def written(first: set[str]) -> set[str]:
    """The words with which a unit may begin so that its form begins with one of `first`."""
    return first | {a.split()[0] for a, b in SPELLINGS if b.split()[0] in first}


def most_written(longest: int) -> int:
    """The greatest length of a unit whose form has at most `longest` characters: every spelling that shortens may have been met everywhere."""
    share = max(len(a) / len(b) for a, b in SPELLINGS)
    return int(longest * max(1.0, share)) + 1


#: First words up to which units are told by them before they are hashed.
FIRST_WORDS = 2_000


def license_matches(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, unit ("text", "comment" or "line"), license_id, kind, digest and n_units for every match.

    known: license_id, kind, digest, n_chars, first_word; by default the texts of this module.
    """
    known = known_digests(docs.sparkSession) if known is None else known
    rows, longest = known.agg(F.count("*"), F.coalesce(F.max("n_chars"), F.lit(0))).first()
    if rows <= BROADCAST_ROWS:
        known = F.broadcast(known)
    firsts = {r[0] for r in known.select("first_word").distinct().limit(FIRST_WORDS + 1).collect()}
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), split_lines(F.col(text_col)).alias("raw"))
    read = read.select("row", "doc_id", "raw", F.transform("raw", words_of).alias("lines"))
    named = lambda kind, forms: F.transform(forms, lambda x: F.struct(F.lit(kind).alias("unit"), x.alias("words")))
    units = F.concat(named("text", F.array(joined(F.col("lines")))), named("comment", comments(F.col("raw"), F.col("lines"))), named("line", F.col("lines")))
    begins = lambda x: F.lit(True) if len(firsts) > FIRST_WORDS else F.split_part(x, F.lit(" "), F.lit(1)).isin(*sorted(written(firsts)))
    # only forms that are not longer than any known one, and begin like one, can be equal to it
    units = F.filter(units, lambda x: (F.length(x["words"]).between(1, most_written(longest))) & begins(x["words"]))
    found = read.select("row", "doc_id", F.explode(units).alias("u")).select("row", "doc_id", "u.unit", F.sha2(spelled(F.col("u.words")), 256).alias("digest"))
    found = found.join(known.select("license_id", "kind", "digest"), "digest")
    return found.groupBy("row", "doc_id", "unit", "license_id", "kind", "digest").agg(F.count("*").alias("n_units")).drop("row")
