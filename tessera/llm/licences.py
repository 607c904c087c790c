"""Licence scans by canonical digests of entire texts.

A text's canonical form has ASCII lower case, no copyright statements, blanks for
punctuation, one spelling for equivalent words, and single blanks.  The digest
of a document's entire canonical text is joined to the digests of known
licences; the digests of its single lines are looked up among those of known
short notices.  Everything is built-in column functions; the table of known
digests is a constant of this module (a few rows), so it is broadcast.

A line is a copyright statement when it begins with the word or the sign and a
year, sign or holder follows; a licence's own wrapped line ("copyright notice
and ...") is not.  For the join, spellings of several words are replaced across
line ends, too.  The SQL deletes all lines that begin with the word, and joins
by the digest as it is, so it finds fewer wrapped licences.

Defined cases: null and empty texts match nothing; very long texts are
canonicalised whole; repeated rows are matched each on their own; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_0BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT_0 = _MIT.replace(", subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ".")
_APACHE_FILE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL_FILE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
_MPL_FILE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
#: Whole licences: (id, text with its usual heading or without).
LICENCES = (
    ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT), ("MIT", _MIT), ("ISC", "ISC License\n\n" + _ISC), ("ISC", _ISC), ("0BSD", "Zero-Clause BSD\n\n" + _0BSD), ("0BSD", _0BSD),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL), ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL), ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("Zlib", "zlib License\n\n" + _ZLIB), ("Zlib", _ZLIB), ("Unlicense", _UNLICENSE), ("Unlicense", _UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org>"), ("Unlicense", _UNLICENSE + "\n\nFor more information, please refer to <http://unlicense.org/>"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + _BOOST), ("BSL-1.0", _BOOST), ("MIT-0", "MIT No Attribution\n\n" + _MIT_0), ("MIT-0", _MIT_0), ("Apache-2.0", _APACHE_FILE), ("GPL-3.0-or-later", _GPL_FILE),
    ("LGPL-3.0-or-later", _GPL_FILE.replace("GNU General", "GNU Lesser General")), ("AGPL-3.0-or-later", _GPL_FILE.replace("GNU General", "GNU Affero General")), ("MPL-2.0", _MPL_FILE),
)
#: Notices of one line; a document that consists of one has that licence, too.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0"), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"), ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
)
#: (pattern, replacement), applied in this order to lower-case text; both Java and RE2 read them alike.
STEPS = (
    (r"(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*(\n|$)", "\n"),
    (r"(?m)^[ \t]*all rights reserved[ \t.]*(\n|$)", "\n"),
    (r"[!-/:-@\[-`{-~“”‘’«»–—…\t\r\f]+", " "),
    (r"\b(licence|licens)\b", "license"),
    (r"\blicenced\b", "licensed"),
    (r"\bsub license\b", "sublicense"),
    (r"\bnon infringement\b", "noninfringement"),
    (r"\bmerchantibility\b", "merchantability"),
    (r"\backnowledgement\b", "acknowledgment"),
    (r"\borganisation\b", "organization"),
    (r"\bcopyright owners?\b", "copyright holder"),
    (r"\bcopyright holders\b", "copyright holder"),
    (r"\bversion (\d)( 0)?\b", "version \\1"),
    (r"\b(as) is\b", "\\1is"),
    (r" *\n[ \n]*", "\n"),
    (r"  +", " "),
)
#: Words that follow "copyright" within licences; what else follows is a holder.
_BODY = "notices?|holders?|owners?|licen[sc]es?|laws?|statements?|interests?|protection|permissions?|ownership|treat(?:y|ies)|acts?|infringement|rights?|disclaimers?|dates?|years?|symbols?|information|claims?|lines?|headers?|status|materials?|works?|and|or|in|is|are|to|on|of|for|shall|must|may|will|can|as|if|that|this|which|under|with|without|from"
#: Copyright statements, which the scan removes instead of the first of STEPS.
STATEMENT = (rf"(?m)^[ \t]*(copyright[ \t]*(?:(?:holders?|owners?)[ \t]*)?(?::|\(c\)|©|\d)|copyright[ \t]+(?!(?:{_BODY})\b)[^\s]|\(c\)[ \t]*(?:copyright\b|©|\d)|©)[^\n]*(\n|$)", "\n")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: Column) -> Column:
    """The canonical form, lines kept apart."""
    out = F.translate(text, _UPPER, _LOWER)
    for pattern, replacement in (STATEMENT, *STEPS[1:]):
        out = F.regexp_replace(out, pattern, replacement.replace("\\1", "$1").replace("\\2", "$2"))
    return F.trim(F.regexp_replace(out, r"^\n+|\n+$", ""))


def _whole(lines: Column) -> Column:
    return F.regexp_replace(lines, r" *\n *", " ")


def _joined(lines: Column) -> Column:
    """One line in which spellings of several words are replaced again, as a line may have ended within them."""
    out = _whole(lines)
    for pattern, replacement in STEPS:
        if pattern.startswith("\\b") and " " in pattern:
            out = F.regexp_replace(out, pattern, replacement.replace("\\1", "$1"))
    return out


def known(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """digest, licence_id of the module's licences and notices, and of more (licence_id, text) that a caller has."""
    rows = spark.createDataFrame([*LICENCES, *NOTICES], "licence_id string, text string")
    rows = rows if more is None else rows.union(more.select("licence_id", "text"))
    return rows.select(F.sha2(_joined(canonical(F.col("text"))), 256).alias("digest"), "licence_id").groupBy("digest").agg(F.min("licence_id").alias("licence_id"))


def scan(documents: DataFrame, licences: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, licence_id (null: none) of each entire text; n_notices and notices of its lines.

    licences: what ``known`` gives, with longer licences, say; it is broadcast, so some thousands of rows at most.
    """
    spark = documents.sparkSession
    notices = {r["digest"]: r["licence_id"] for r in known(spark).collect()}
    name_of = F.create_map(*(F.lit(x) for pair in notices.items() for x in pair))
    lines = canonical(F.coalesce(F.col("text"), F.lit("")))
    rows = documents.select("doc_id", lines.alias("_lines"))
    found = F.filter(F.transform(F.split("_lines", "\n"), lambda x: name_of[F.sha2(F.trim(x), 256)]), lambda x: x.isNotNull())
    rows = rows.select("doc_id", F.sha2(_whole(F.col("_lines")), 256).alias("digest"), F.sha2(_joined(F.col("_lines")), 256).alias("_key"), found.alias("_found"))
    table = (known(spark) if licences is None else licences).withColumnRenamed("digest", "_key")
    rows = rows.join(F.broadcast(table), "_key", "left")
    return rows.select("doc_id", "digest", "licence_id", F.size("_found").cast("long").alias("n_notices"), F.concat_ws(",", F.array_sort(F.array_distinct("_found"))).alias("notices"))


def sql() -> str:
    """The same scan as one DuckDB statement."""

    def steps(text: str) -> str:
        out = f"translate({text}, '{_UPPER}', '{_LOWER}')"
        for pattern, replacement in STEPS:
            quoted = pattern.replace("'", "''")
            new = "chr(10)" if replacement == "\n" else "'" + replacement + "'"
            out = f"regexp_replace({out}, '{quoted}', {new}, 'g')"
        return rf"trim(regexp_replace({out}, '^\n+|\n+$', '', 'g'), ' ')"

    rows = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in (*LICENCES, *NOTICES))
    whole = r"regexp_replace({}, ' *\n *', ' ', 'g')"
    return f"""
WITH texts(licence_id, text) AS (VALUES {rows}),
known AS (SELECT sha256({whole.format(steps("text"))}) AS digest, min(licence_id) AS licence_id FROM texts GROUP BY 1),
names AS (SELECT map(list(digest ORDER BY digest), list(licence_id ORDER BY digest)) AS m FROM known),
docs AS (SELECT doc_id, {steps("coalesce(text, '')")} AS lines FROM documents),
found AS (SELECT doc_id, sha256({whole.format("lines")}) AS digest, list_filter([m[sha256(trim(x, ' '))] FOR x IN string_split(lines, chr(10))], lambda y: y IS NOT NULL) AS hits FROM docs, names)
SELECT doc_id, found.digest, licence_id, CAST(len(hits) AS BIGINT) AS n_notices, array_to_string(list_sort(list_distinct(hits)), ',') AS notices
FROM found LEFT JOIN known ON known.digest = found.digest"""
