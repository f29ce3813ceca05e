"""Licence scans by canonical digests.

A text is made canonical: ASCII lower case, no copyright lines, one spelling of equivalent
words, and any other characters than letters and digits of any script (so curly quotes, too)
as single spaces.  Its SHA-256 is
joined with the digests of known licence texts and notices.  Both whole documents and their
single lines are looked up, each as an entire text.

The known texts are a fixed table that goes to every executor (its size does not depend on
the data); documents are neither shuffled nor read twice.

Defined results: null, empty and all-copyright texts match nothing; rows are scanned one by
one, so repeated rows give repeated hits and null ids are reported as null; an empty table
gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""

#: Public licence texts and common notices, by SPDX id.
KNOWN: list[tuple[str, str]] = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n" + _ISC),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_END),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_3 + _BSD_END),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("proprietary", "All rights reserved."),
]

_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
_MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def full_texts() -> list[tuple[str, str]]:
    """Whole public licence texts (files beside this module) and standard headers, by SPDX id."""
    names = {"GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-3": "LGPL-3.0"}
    files = sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
    return [(names.get(f.stem, f.stem), f.read_text("utf-8")) for f in files] + [("Apache-2.0", _APACHE_HEADER), ("GPL-3.0", _GPL_HEADER), ("MPL-2.0", _MPL_HEADER)]


#: A line that names a year, sign or holder; text that goes on with "copyright notice" is none.
COPYRIGHT_LINE = r"^[ \t]*(?:copyright[^a-z\n]*(?:\(c\)|©|[0-9<\[{]|the |by )|\(c\)|©)[^\n]*"
OTHER = r"[^a-z0-9\p{L}\p{M}\p{N}]+"
#: Spellings taken as equal, applied in this order.
SPELLINGS = [("&", " and "), ("licence", "license"), ("favour", "favor"), ("organis", "organiz"), ("https://", "http://"), ("non-commercial", "noncommercial")]


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.translate(text, UPPER, LOWER), "(?md)" + COPYRIGHT_LINE, "")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, OTHER, " "))


def canonical_sql(text: str) -> str:
    """``canonical`` for DuckDB."""
    out = f"regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), '(?m){COPYRIGHT_LINE}', '', 'g')"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return f"trim(regexp_replace({out}, '{OTHER}', ' ', 'g'))"


def digests(spark, known: list[tuple[str, str]]) -> DataFrame:
    """(license, digest) of SPDX ids and texts."""
    return spark.createDataFrame(known, "license string, known string").select("license", F.sha2(canonical(F.col("known")), 256).alias("digest")).distinct()


def scan(docs: DataFrame, known: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """(doc_id, line_no, license): hits of whole texts (line_no -1) and of lines (from 0).
    ``known``: SPDX ids and texts, or a table (license, digest) of any size, whose join Spark
    plans by its size; by default ``KNOWN`` and ``full_texts()``."""
    table = known if isinstance(known, DataFrame) else F.broadcast(digests(docs.sparkSession, [*KNOWN, *full_texts()] if known is None else known))
    text = F.col("text")
    whole = F.array(F.struct(F.lit(-1).alias("line_no"), F.sha2(canonical(text), 256).alias("digest")))
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line_no"), F.sha2(canonical(x), 256).alias("digest")))
    units = docs.where("text is not null").select("doc_id", F.explode(F.concat(whole, lines)).alias("u")).select("doc_id", "u.*")
    return units.join(table, "digest").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "license")


def scan_sql() -> str:
    quoted = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in [*KNOWN, *full_texts()])
    return f"""
        WITH known(license, known) AS (VALUES {quoted}),
        digests AS (SELECT DISTINCT license, sha256({canonical_sql("known")}) AS digest FROM known),
        units AS (
            SELECT doc_id, -1 AS line_no, text AS unit FROM documents WHERE text IS NOT NULL
            UNION ALL
            SELECT doc_id, i - 1, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL))
        SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, license
        FROM units JOIN digests ON digest = sha256({canonical_sql("unit")})"""
