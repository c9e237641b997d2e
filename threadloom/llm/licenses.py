"""Licence scans by canonical digest.

A text is brought to a canonical form (A-Z to lower case, copyright lines and punctuation gone, equivalent spellings
made equal, white space to single spaces) and its SHA-256 is joined with the digests of known licences in
the same form, with and without their titles. Only whole texts match; a notice inside other text does not.
SQL holds KNOWN in one title and wording each; the scan knows besides their usual titles, list markers and
wordings (TITLES, LISTS, WORDINGS) and the digests of long licences (license_digests.py). Where no text is one of
these, its rows are those of SQL. AGPL, CC licences other than CC0 and BY-SA 4.0, and BSD texts that name another
holder in their last clause are not known and come out null.

Null texts are empty and match nothing. Rows with equal doc_id are judged each by itself. The table of known
licences is a short literal and is broadcast; other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .license_digests import DIGESTS

SPELLINGS = (
    ("licence", "license"), ("acknowledgement", "acknowledgment"), ("organisation", "organization"), ("favour", "favor"), ("behaviour", "behavior"),
    ("authoris", "authoriz"), ("recognis", "recogniz"), ("utilis", "utiliz"), ("whilst", "while"), ("copyright owner", "copyright holder"),
    ("per cent", "percent"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("merchantibility", "merchantability"),
)
COPYRIGHT = r"^[^a-z0-9(\xa9]*(copyright[^a-z0-9]*(\(c\)|\xa9|[0-9]|<|\[|$)|\(c\)[^a-z]*[0-9]|\xa9|all rights reserved[^a-z]*$)"

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
#: Identifier: title, whole text without title and copyright line.
KNOWN = {
    "MIT": ("MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    "ISC": ("ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END),
    "0BSD": ("BSD Zero Clause License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_END),
    "BSD-2-Clause": ("BSD 2-Clause License", _BSD + " " + _BSD_END),
    "BSD-3-Clause": ("BSD 3-Clause License", _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END),
    "Zlib": ("zlib License", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
}


#: Other titles of KNOWN; each also with The before it.
TITLES = {
    "MIT": ("MIT License", "MIT License (MIT)", "MIT", "Expat License", "MIT (Expat) License", "Expat (MIT) License"),
    "ISC": ("ISC License", "ISC License (ISC)", "ISC"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero Clause License (0BSD)", "Zero Clause BSD License (0BSD)", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "BSD-2-Clause", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "FreeBSD License", "BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "BSD-3-Clause", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "Modified BSD License", "Revised BSD License", "BSD License"),
    "Zlib": ("zlib License", "zlib License (Zlib)", "zlib/libpng License", "Zlib"),
}
#: What stands before the conditions in place of 1. 2. 3.; bullets are punctuation and leave nothing.
LISTS = (("1.", "2.", "3."), ("", "", ""), ("a.", "b.", "c."), ("i.", "ii.", "iii."))
#: Wordings in use beside that of KNOWN: licence, what KNOWN says, what is said instead.
WORDINGS = (
    ("ISC", "modify, and/or distribute", "modify, and distribute"),
    ("0BSD", "modify, and/or distribute", "modify, and distribute"),
    ("BSD-2-Clause", "HOLDERS AND CONTRIBUTORS", "HOLDER AND CONTRIBUTORS"),
    ("BSD-2-Clause", "HOLDER OR CONTRIBUTORS", "OWNER OR CONTRIBUTORS"),
    ("BSD-3-Clause", "HOLDERS AND CONTRIBUTORS", "HOLDER AND CONTRIBUTORS"),
    ("BSD-3-Clause", "nor the names of its contributors", "nor the names of contributors"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: str) -> str:
    """The canonical form in Python, for the known licences; columns use canonical_column."""
    lines = [x for x in text.translate(str.maketrans(_UPPER, _LOWER)).split("\n") if not re.search(COPYRIGHT, x)]
    out = re.sub("[^a-z0-9\x80-\U0010ffff]+", " ", "\n".join(lines)).strip(" ")
    for a, b in SPELLINGS:
        out = out.replace(a, b)
    return out


def canonical_column(text: Column) -> Column:
    lines = F.filter(F.split(F.translate(text, _UPPER, _LOWER), "\n"), lambda x: ~x.rlike(COPYRIGHT))
    out = F.trim(F.regexp_replace(F.array_join(lines, "\n"), r"[^a-z0-9\x{80}-\x{10ffff}]+", " "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def known_digests(known: dict[str, tuple[str, str]] | None = None) -> list[tuple[str, str]]:
    """(digest, licence) of each known text, with its title and without."""
    digest = lambda t: hashlib.sha256(canonical(t).encode()).hexdigest()
    pairs = {digest(t): name for name, (title, body) in (known or KNOWN).items() for t in (body, f"{title}\n{body}")}
    return sorted(pairs.items())


def _wordings(name: str, body: str) -> set[str]:
    forms = {body}
    for licence, usual, other in WORDINGS:
        if licence == name:
            forms |= {x.replace(usual, other) for x in forms}
    listed = set()
    for marks in LISTS:
        for x in forms:
            for usual, other in zip(LISTS[0], marks):
                x = x.replace(f" {usual} ", f" {other} ")
            listed.add(x)
    return listed


def all_digests() -> list[tuple[str, str]]:
    """(digest, licence) of the known texts, of their usual titles and wordings, and of the long licences."""
    pairs = {d: name for name, own in DIGESTS.items() for d in own}
    for name, (_, body) in KNOWN.items():
        titles = {"", *TITLES[name], *(f"The {x}" for x in TITLES[name])}
        pairs |= {hashlib.sha256(canonical(f"{title}\n{form}").encode()).hexdigest(): name for title in titles for form in _wordings(name, body)}
    return sorted((pairs | dict(known_digests())).items())


def scan(docs: DataFrame, text: str = "text", known: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, digest of the canonical text, license (null unless the whole text is one)."""
    table = docs.sparkSession.createDataFrame(known_digests(known) if known else all_digests(), "digest string, license string")
    rows = docs.select("doc_id", F.sha2(canonical_column(text_or_empty(text)), 256).alias("digest"))
    return rows.join(F.broadcast(table), "digest", "left").select("doc_id", "digest", "license")


def _sql() -> str:
    spelt = "trim(regexp_replace(array_to_string(list_filter(string_split(translate(coalesce(text, ''), '" + _UPPER + "', '" + _LOWER + "'), chr(10)), lambda x: NOT regexp_matches(x, '" + COPYRIGHT + r"')), chr(10)), '[^a-z0-9\x{80}-\x{10ffff}]+', ' ', 'g'))"
    for a, b in SPELLINGS:
        spelt = f"replace({spelt}, '{a}', '{b}')"
    values = ", ".join(f"('{d}', '{n}')" for d, n in known_digests())
    return f"WITH k(digest, license) AS (VALUES {values}), d AS (SELECT doc_id, sha256({spelt}) AS digest FROM documents) SELECT doc_id, digest, license FROM d LEFT JOIN k USING (digest)"


SQL = _sql()
