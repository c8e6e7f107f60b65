"""Licence scans by canonical digests.

A text is brought to one form (case, punctuation, copyright lines, equivalent spellings), and the digest of the whole form is joined to the digests of known licence texts. Units are a document's whole text and each of its lines, since licence notices are lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Equivalent spellings, as the public licence matching guidelines list them; whole words, after folding.
SPELLINGS = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"), ("organisations", "organizations"), ("authorised", "authorized"), ("unauthorised", "unauthorized"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("whilst", "while"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("https", "http")]

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_BSD3 = _BSD2.replace("\nTHIS SOFTWARE", "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE", 1)
_0BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "", 1)
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
_BSL = """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""
_MPL_HEADER = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
_GNU_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details.
You should have received a copy of the GNU {kind}General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""

#: SPDX identifiers that a line may state. Fixed values.
SPDX = ["0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib"]
#: Names of the Creative Commons licences. Fixed values.
CREATIVE_COMMONS = [("BY", "Attribution"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-SA", "Attribution-ShareAlike")]

#: Known licence texts and notices (license, text). Fixed values.
KNOWN = [
    ("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC), ("ISC", "ISC License\n\n" + _ISC), ("BSD-2-Clause", _BSD2), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD2),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"), ("MIT", "MIT License"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"), ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."), ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("all-rights-reserved", "All rights reserved."),
]
KNOWN += [(n, t) for n, title, text in [("BSD-3-Clause", "BSD 3-Clause License", _BSD3), ("0BSD", "BSD Zero Clause License", _0BSD), ("Zlib", "zlib License", _ZLIB)] for t in (text, f"{title}\n\n{text}")]
KNOWN += [("Unlicense", _UNLICENSE), ("MPL-2.0", _MPL_HEADER), ("BSL-1.0", _BSL), ("Apache-2.0", _APACHE_HEADER)]
KNOWN += [(f"{n}-{v}-or-later", _GNU_HEADER.format(kind=kind, version=v.removesuffix(".0"))) for n, kind, v in [("GPL", "", "2.0"), ("GPL", "", "3.0"), ("LGPL", "Lesser ", "2.1"), ("LGPL", "Lesser ", "3.0"), ("AGPL", "Affero ", "3.0")]]
KNOWN += [(n, f"SPDX-License-Identifier: {n}") for n in SPDX]
KNOWN += [(f"CC-{a}-{v}", t) for a, name in CREATIVE_COMMONS for v, port in (("3.0", "Unported"), ("4.0", "International")) for t in (f"Licensed under CC {a} {v}.", f"This work is licensed under a Creative Commons {name} {v} {port} License.")]
#: Digests of the forms of longer licences in full, as published (license, digest): with and without what follows the end of the terms, the publisher's address in its older forms, a year filled in or not. Fixed values, made by digest() with the spellings above.
DIGESTS = [
    ("Apache-2.0", "6074c3536c43b739207170b87d1681477d0f07374ed3d862ba461334cce848e3"),
    ("Apache-2.0", "6aa661403864282a4d084f1551e8149a5f1a7b5e8b05b6db8e1a8a28d0badc64"),
    ("Apache-2.0", "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe"),
    ("Apache-2.0", "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "bcaf73c390ff78d5d2b473b276dad2a90ec7da4293754147ae2f9ff8c9e8a64f"),
    ("GFDL-1.3", "e676b958da2711c7643566d30bb24ad57001a807341408f6aeb62b58cb85276f"),
    ("GPL-1.0", "eafda7cb5e995143f4d45ef2107eb160d6856afabed7c48b1b317303bc40a7e6"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "adc15cc83ce26650e2b03700b2780975d9c1fde1f4a39fb48ad7022a37c738b1"),
    ("GPL-1.0", "98c96304603be152968c123e484f744c9b51ebd341914aee6eea5c39133891e1"),
    ("GPL-1.0", "ac9f80a0d38a1e001427acb1e9fa5f9a23aee35e40ee2759901306fd4e382697"),
    ("GPL-1.0", "47021872353ca0444688410fff47398b339fe31a96ff93b0c0d15cc3bd6769a9"),
    ("GPL-1.0", "c0734228e33375b72256fed50d8056b50049dff71f408765af98cd4384a7434a"),
    ("GPL-1.0", "7b86297a2762700b078231c8b488809b0f63cac5e298d74f4270d251bbef230f"),
    ("GPL-2.0", "633db8412bbb99b0672b664e80d260461a3f7fb1c14a45c614eb6124876ce2a7"),
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "10c562a13afa499308a9ef4dcf4c486cc775aed3583f5c830a93ff20ba2a25cb"),
    ("GPL-2.0", "78e9c9f811bd1ba04ed6d619d3e51a759305d2f124cee9defa3535ba4a24bd25"),
    ("GPL-2.0", "b1abfb46077acd6c0450274e16fe4cb4610ec546c090c5977a069c5f74340774"),
    ("GPL-2.0", "da465d8c6dc810dfa28102991c415364e0895a5cd430534d8fc32b3d71650b55"),
    ("GPL-2.0", "acaf68e303fe7610fff5b930bace57b87821d132bc434f4a104512da48f8bb6c"),
    ("GPL-2.0", "ba8b5323b72bf2f2c5d07074133b38292e0fa23fde8fa48771ba8a04cccacddd"),
    ("GPL-3.0", "cc8c7596e87658cdffe98ce31be98b303df2589758bd6d4365cdb496f419c85f"),
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0", "1f1ace2d2c5e80547f3f0517299934f8d456c17a9a9939250e76087b010f5614"),
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "e195b1eefc38bbb77d3f351651061352c68a113bdd52b1b24b6dae705ef8c21e"),
    ("LGPL-2.0", "dc842683831d008ff5f32600206cfd765e4d05df71fe831b1b4b31462fa2fff1"),
    ("LGPL-2.0", "5ce88337a2fce97b0f2b6aac63afc49927c0dc31e15bf530a83e603e1d298d8b"),
    ("LGPL-2.0", "b9392f182aed1dedf0d0e405ce88f7ca62c24bac504bbce15b073596ec954c41"),
    ("LGPL-2.0", "cbc927caf696ef44b2fbebe29ffa45a5fccf0a64c78f2b85678a11032ebb3318"),
    ("LGPL-2.0", "d40504a2bf1a1a86ee76e642ced31126577d21774b1ac0a222ce730ec78d7108"),
    ("LGPL-2.1", "6eacb2e57ceb0cc63a48b9b4e3181e4b691c27408dfd80dc12bafc4bffff46b5"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "676e0ba1644528402e23cfea4da27727a38c7b0d85c90f212910ec9afec86111"),
    ("LGPL-2.1", "df8b7d554d9ba4683d95046dc0cd8fdf6c063841a3cfabcf242ab40e69237421"),
    ("LGPL-2.1", "a5ac783c64dc7fa3fe7b641692ee7b8da491bd87f613c9bb99618a9469e71c47"),
    ("LGPL-2.1", "826b1d9fbfa419ac1921bf02da95c8515d0f4fce141441e304683171bfc9f641"),
    ("LGPL-2.1", "925c28788af11361f32b5b10dbeb4454be64e8448ed4a7c0926618a5d8a85bfb"),
    ("LGPL-2.1", "3bde1ca18489d8594a2c0c04b5ae1003c1795d1680675f4ef758325e1e1c3169"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
]
#: A line that names a year of copyright, behind a comment's marks too.
COPYRIGHT = r"(^|\n)[^\p{L}\p{N}\n]*(copyright|\(c\)|©)[^\n]*[0-9]{4}[^\n]*"
OTHER = r"[^\p{L}\p{N}]+"
#: Known texts up to this number are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def canonical(text: Column) -> Column:
    """The form that is compared: lower case, no copyright lines, words parted by single spaces, spellings made equal."""
    t = F.regexp_replace(F.lower(text), COPYRIGHT, "$1")
    return spelled(F.regexp_replace(t, OTHER, "  "), SPELLINGS)


def spelled(words: Column, pairs: list[tuple[str, str]]) -> Column:
    """Words parted by two spaces each, spellings made equal, as words parted by one. Each word has spaces of its own, so neighbours are both found."""
    t = F.concat(F.lit(" "), words, F.lit(" "))
    for a, b in pairs:
        a, b = (x.replace(" ", "  ") for x in (a, b))
        t = F.replace(t, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(F.replace(t, F.lit("  "), F.lit(" ")))


def whole(lines: Column) -> Column:
    """The form of a whole text by the forms of its lines: only spellings of several words can lie across a line's end."""
    t = F.array_join(F.filter(lines, lambda x: x != ""), " ")
    several = [(a, b) for a, b in SPELLINGS if " " in a]
    return spelled(F.replace(t, F.lit(" "), F.lit("  ")), several)


def digest_of(form: Column) -> Column:
    """A form's digest; null for a text that has no word."""
    return F.sha2(F.nullif(form, F.lit("")), 256)


def digest(text: Column) -> Column:
    return digest_of(canonical(text))


def known(spark: SparkSession, texts: list[tuple[str, str]] | None = None, digests: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license) of licence texts and of digests made before, by default KNOWN and DIGESTS; of one digest the first name in order."""
    if texts is None and digests is None:
        texts, digests = KNOWN, DIGESTS
    d = spark.createDataFrame(texts or [], "license string, text string").select(digest(F.col("text")).alias("digest"), "license").where("digest is not null")
    d = d.union(spark.createDataFrame(digests or [], "license string, digest string").select("digest", "license"))
    return d.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, licences: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_license, n_notices, licenses) of every row of docs: the licence that its whole text is, or null; how many of its lines are a known text; the licences of both, sorted and comma-joined.

    Null and empty texts match nothing. Repeated rows each give the same result. A text of any length is one row of digests; of two names for one digest the first in order counts; an empty table gives none; other columns of docs are not read, so their names clash with nothing.
    """
    licences = licences if licences is not None else known(docs.sparkSession)
    small = licences.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    k = F.broadcast(licences) if small else licences
    d = docs.select("doc_id", "text").withColumn("_t", F.xxhash64("text"))
    # digests are made inside the array, before it becomes rows: a filter that the join adds on them then costs nothing
    forms = d.select("doc_id", "_t", F.transform(F.split("text", "\n"), canonical).alias("_f"))
    digests = F.concat(F.array(digest_of(whole(F.col("_f")))), F.transform("_f", digest_of))
    units = forms.select("doc_id", "_t", F.posexplode(digests).alias("pos", "digest"))
    hits = units.where("digest is not null").join(k, "digest").select("doc_id", "_t", "pos", "license").distinct()
    found = hits.groupBy("doc_id", "_t").agg(F.max(F.when(F.col("pos") == 0, F.col("license"))).alias("text_license"), F.count_if(F.col("pos") > 0).alias("n_notices"), F.concat_ws(",", F.array_sort(F.collect_set("license"))).alias("licenses"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("_t").alias("_h"), "text_license", "n_notices", "licenses")
    out = d.select("doc_id", "_t").join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_t").eqNullSafe(F.col("_h")), "left")
    return out.select("doc_id", "text_license", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("licenses", F.lit("")).alias("licenses"))


def scan_sql() -> str:
    """The same in DuckDB's SQL, over the table documents."""
    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def form(x: str) -> str:
        t = f"regexp_replace(lower({x}), {q(COPYRIGHT)}, '\\1', 'g')"
        t = f"(' ' || regexp_replace({t}, {q(OTHER)}, '  ', 'g') || ' ')"
        for a, b in SPELLINGS:
            a, b = (w.replace(" ", "  ") for w in (a, b))
            t = f"replace({t}, ' {a} ', ' {b} ')"
        return f"trim(replace({t}, '  ', ' '), ' ')"

    def values(rows: list[tuple[str, str]]) -> str:
        return "values " + ", ".join(f"({q(n)}, {q(t)})" for n, t in rows)

    return f"""
with k as (select digest, min(license) as license from (select sha256({form('text')}) as digest, license from ({values(KNOWN)}) v(license, text) union all select digest, license from ({values(DIGESTS)}) v(license, digest)) group by 1),
u as (select doc_id, text, unnest(list_concat([text], string_split(text, chr(10)))) as unit, unnest(range(len(string_split(text, chr(10))) + 1)) as pos from documents where text is not null),
h as (select doc_id, text, pos, license from (select doc_id, text, pos, {form('unit')} as form from u) f join k on k.digest = sha256(f.form) where form <> '' group by all),
g as (select doc_id, text, max(license) filter (pos = 0) as text_license, count(*) filter (pos > 0) as n_notices, array_to_string(list_sort(list_distinct(list(license))), ',') as licenses from h group by all)
select d.doc_id, g.text_license, coalesce(g.n_notices, 0)::bigint as n_notices, coalesce(g.licenses, '') as licenses
from documents d left join g on d.doc_id is not distinct from g.doc_id and d.text is not distinct from g.text"""
