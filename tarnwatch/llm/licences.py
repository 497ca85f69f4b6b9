"""Licence scans by canonical digest, in DataFrame operations only.

A text is lower-cased, its copyright clauses dropped (to the end of the sentence or line, so the rest of a
one-line licence stays), equivalent spellings made one, and runs of punctuation and space made single
spaces, which also undoes line wraps and comment signs.  The SHA-256 of what is left of the *entire*
text is hash-joined to the digests of known licences; each line is looked up alike, in a hash set, for
notices that stand alone on a line.

The catalogue holds short licences and notices as text, and the long ones (Apache, GPL, LGPL, MPL, CC0 and
others) as digests of their published texts, whole and without the advice that follows the terms.  It
lacks rarer licences and reworded ones: a text is known exactly or not at all.  A caller's own
catalogue is accepted up to ``MAX_KNOWN`` texts, so what is broadcast is bounded.  Nothing else moves:
the scan has no shuffle, so no source or document can make a task hot.

Defined cases: null and empty texts have the digest of the empty text and no licence; a
notice that occurs on several lines counts each time and is named once; repeated rows are
judged each for itself; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licence texts and notices, as (identifier, text).
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MIT_0 = _MIT.split("\n")[0].replace(", subject to the following conditions:", ".") + "\n" + _MIT.split("\n")[2]
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_SPDX = "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-2.0 Unlicense WTFPL Zlib"
KNOWN = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("MIT-0", _MIT_0),
    ("MIT-0", "MIT No Attribution\n" + _MIT_0),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}"),
    ("ISC", f"ISC License\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}"),
    ("0BSD", f"{_ISC_GRANT}.\n{_ISC_END}"),
    ("0BSD", f"BSD Zero Clause License\n{_ISC_GRANT}.\n{_ISC_END}"),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n{_BSD_END}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n{_BSD_HEAD}\n{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}\n{_BSD_THIRD}\n{_BSD_END}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n{_BSD_HEAD}\n{_BSD_THIRD}\n{_BSD_END}"),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE + "\nFor more information, please refer to <https://unlicense.org>"),
    ("Unlicense", _UNLICENSE + "\nFor more information, please refer to <https://unlicense.org/>"),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("BSL-1.0", _BOOST),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    *[(i, f"SPDX-License-Identifier: {i}") for i in _SPDX.split()],
]

# Digests of published texts in canonical form, whole or up to the end of the terms.
KNOWN_DIGESTS = [
    ("Apache-2.0", "4a6318c7afd8feed8c4463ea5ae0f2f609d433928a8b17f31104c8e7743de2c5"),
    ("Apache-2.0", "b93faad605f4e5d56d92cb01789c993887913c893e441b2305b4f880a9cead93"),
    ("Apache-2.0", "4d82b1bff1ec74deb3a29bbe890a43fcd5d6d11ae4b24b20d2c0ef74a1b12809"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0", "e80b630fa4f92f7da9cffbd75699f62bfac51ce5b33da44e74b5acc53e5187f6"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-2.0", "ada43b21b16dd64b4b8f1d9c2ab43ff16f75a8f0f835fc2f37a0c7e65f28d243"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-3.0", "a6a3c847015e8505b1d152c1bcdf4b64e2b7d5c41edd6775fe18475b27ae8387"),
    ("GPL-3.0", "caf91755cf33283be25f1e05efbd2839d225ef7def53695a510aed6dfdd1550c"),
    ("GPL-3.0", "5f9a16d8d81dfc9674a4e4f9408fb8caac3d60626eaf090bb0c40c0f9cd0eb14"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-3.0", "63f16a6808ef8dfa21c2ea61b3f84e9b02208b9032233b9104d82a29a42afdb6"),
    ("MPL-1.1", "4be4a6251869e153404f424bbd1c116ada60f8969d5610b406e2a430e206b0bc"),
    ("MPL-2.0", "4019e4c8fe9ede57c538b37b3332dc097a88c163e273bb6905d38316e63c2eb6"),
]

# Equivalent spellings, as (found, written).
SPELLINGS = [
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("non-infringement", "noninfringement"),
    ("non-commercial", "noncommercial"),
    ("copyright owner", "copyright holder"),
    ("http://", "https://"),
    ("&", "and"),
    ("favour", "favor"),
    ("authorisation", "authorization"),
    ("per cent", "percent"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("fulfil ", "fulfill "),
]

# openings of grants begin a line of their own, so a copyright clause before them ends there
GRANT = r"(permission is hereby granted|permission to use, copy|redistribution and use in source)"
COPYRIGHT = r"(copyright[ \t]*(\(c\)|©)|(copyright|\(c\)|©)[ \t]+(by[ \t]+)?([0-9]{4}|<year|\[yyyy|\[year))[^\n]*?([a-z0-9>)\]]{2}\.[ \t]|\n|\z)"
RESERVED = r"all rights reserved"
PUNCTUATION = r"[^a-z0-9\n\x{80}-\x{10ffff}]+"
MAX_KNOWN = 100_000


def canonical_lines(text: Column) -> Column:
    """The lines of a text in canonical form, without empty ones."""
    out = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), GRANT, "\n$1")
    out = F.regexp_replace(F.regexp_replace(out, COPYRIGHT, "\n"), RESERVED, "")
    for found, written in SPELLINGS:
        out = F.replace(out, F.lit(found), F.lit(written))
    out = F.regexp_replace(out, PUNCTUATION, " ")
    return F.filter(F.transform(F.split(out, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form of an entire text."""
    return F.sha2(F.array_join(canonical_lines(text), " "), 256)


def catalogue(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """digest and license_id of each known text; a digest has one row."""
    if len(known or []) > MAX_KNOWN:
        raise ValueError(f"a catalogue of over {MAX_KNOWN} texts")
    rows = spark.createDataFrame(known or KNOWN, "license_id string, text string").select(digest(F.col("text")).alias("digest"), "license_id")
    if not known:
        rows = rows.unionByName(spark.createDataFrame(KNOWN_DIGESTS, "license_id string, digest string"))
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per document: doc_id, license_id (of the entire text), n_notices, notices, canonical_sha256."""
    spark = docs.sparkSession
    listed = catalogue(spark, known)
    names = {r.digest: r.license_id for r in listed.collect()}
    # a list of literals is a hash set in the plan; the map is read for hits only
    named = F.create_map(*[F.lit(x) for d in sorted(names) for x in (d, names[d])])
    rows = docs.select(F.col("doc_id").cast("long"), canonical_lines(F.col("text")).alias("lines"))
    rows = rows.select("doc_id", F.sha2(F.array_join("lines", " "), 256).alias("canonical_sha256"), F.filter(F.transform("lines", lambda x: F.sha2(x, 256)), lambda d: d.isin(list(names))).alias("hits"))
    rows = rows.join(F.broadcast(listed), rows.canonical_sha256 == listed.digest, "left")
    return rows.select("doc_id", "license_id", F.size("hits").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda d: F.element_at(named, d)))), ",").alias("notices"), "canonical_sha256")
