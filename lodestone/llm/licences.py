"""Licence scans by sentence rules (operator 5), DataFrame functions only.

A text is normalised and cut into sentences; each known licence sentence that stands between two ends, also
over wrapped or commented lines and with stops of its own, becomes an identifier, every other one the mark of an
unknown sentence. Ordered licence rules are then matched against the document's sequence: a rule is a run of
identifiers, with nothing unknown between them, and the licence it shows; what one rule has matched is spent for those
after it. Copyright notices, reservations of rights and the numbers of a list may stand anywhere in a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public licence texts and notices, one sentence each, and the identifier of each.
SENTENCES: dict[str, str] = {
    "Apache License": "ApacheTitle",
    "Apache License, Version 2.0": "ApacheFull",
    "Version 2.0, January 2004": "ApacheVersion",
    "Licensed under the Apache License, Version 2.0 (the \"License\");": "ApacheHead",
    "you may not use this file except in compliance with the License.": "ApacheUse",
    "You may obtain a copy of the License at": "ApacheCopy",
    "http://www.apache.org/licenses/LICENSE-2.0": "ApacheUrl",
    "https://www.apache.org/licenses/LICENSE-2.0": "ApacheUrl",
    "http://www.apache.org/licenses/": "ApacheUrl",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.": "ApacheBasis",
    "See the License for the specific language governing permissions and limitations under the License.": "ApacheSee",
    "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION": "ApacheTerms",
    "MIT License": "MITTitle",
    "The MIT License": "MITTitle",
    "The MIT License (MIT)": "MITTitle",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:": "MITPerm",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.": "MITNotice",
    "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software.": "MITNotice",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.": "MITAsIs",
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.": "MITLiability",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.": "MIT0Perm",
    "ISC License": "ISCTitle",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "ISCPerm",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "ISCPerm",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.": "BSD0Perm",
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.": "ISCAsIs",
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.": "ISCLiability",
    "BSD 2-Clause License": "BSD2Title",
    "BSD 3-Clause License": "BSD3Title",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "BSDPre",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.": "BSDSource",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.": "BSDBinary",
    "All advertising materials mentioning features or use of this software must display the following acknowledgement:": "BSDAdvert",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "BSDName",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.": "BSDAsIs",
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.": "BSDLiability",
    "This software is provided 'as-is', without any express or implied warranty.": "ZlibAsIs",
    "In no event will the authors be held liable for any damages arising from the use of this software.": "ZlibLiability",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:": "ZlibPerm",
    "The origin of this software must not be misrepresented;": "ZlibOrigin",
    "Boost Software License - Version 1.0 - August 17th, 2003": "BoostTitle",
    "Distributed under the Boost Software License, Version 1.0.": "BoostRef",
    "This work is licensed under the GNU General Public License, version 3.": "GPL3Ref",
    "This work is licensed under the GNU General Public License, version 2.": "GPL2Ref",
    "GNU GENERAL PUBLIC LICENSE": "GPLTitle",
    "GNU LESSER GENERAL PUBLIC LICENSE": "LGPLTitle",
    "GNU AFFERO GENERAL PUBLIC LICENSE": "AGPLTitle",
    "Version 2, June 1991": "GPL2Version",
    "Version 2.1, February 1999": "LGPL21Version",
    "Version 3, 29 June 2007": "GPL3Version",
    "Version 3, 19 November 2007": "AGPL3Version",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "GPL3Plus",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.": "GPL3Only",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "GPL2Plus",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.": "GPL2Only",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "AGPL3Plus",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "LGPL3Plus",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.": "LGPL21Plus",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.": "GPLHope",
    "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.": "GPLHope",
    "See the GNU General Public License for more details.": "GPLSee",
    "See the GNU Lesser General Public License for more details.": "GPLSee",
    "See the GNU Affero General Public License for more details.": "GPLSee",
    "You should have received a copy of the GNU General Public License along with this program.": "GPLCopy",
    "You should have received a copy of the GNU Lesser General Public License along with this program.": "GPLCopy",
    "You should have received a copy of the GNU Affero General Public License along with this program.": "GPLCopy",
    "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.": "GPLVerbatim",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "MPLRef",
    "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.": "MPLCopy",
    "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.": "MPLCopy",
    "Mozilla Public License Version 2.0": "MPLTitle",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/": "EPL2Ref",
    "This is free and unencumbered software released into the public domain.": "Unlicense",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.": "UnlicenseFree",
    "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE": "WtfplTitle",
    "All rights reserved.": "AllRights",
}
# Identifiers of the public licence list, each of which makes a tag, and names under which notices cite a licence.
LISTED = "Apache-2.0 MIT MIT-0 ISC 0BSD BSD-2-Clause BSD-3-Clause Zlib BSL-1.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 EPL-2.0 Unlicense WTFPL CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0".split()
NAMES = {
    "Apache License, Version 2.0": "Apache-2.0",
    "Apache License 2.0": "Apache-2.0",
    "Apache 2.0 License": "Apache-2.0",
    "MIT License": "MIT",
    "ISC License": "ISC",
    "BSD 2-Clause License": "BSD-2-Clause",
    "BSD 3-Clause License": "BSD-3-Clause",
    "Mozilla Public License 2.0": "MPL-2.0",
    "GNU General Public License v2.0": "GPL-2.0-only",
    "GNU General Public License v3.0": "GPL-3.0-only",
    "GNU Affero General Public License v3.0": "AGPL-3.0-only",
    "GNU Lesser General Public License v3.0": "LGPL-3.0-only",
}
CITES = ("Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "This project is licensed under the {}.", "This software is licensed under the {}.")
CLAUSES, VERSIONS = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"), ("4.0", "3.0")

SENTENCES |= {f"SPDX-License-Identifier: {x}": f"Spdx:{x}" for x in LISTED}
SENTENCES |= {cite.format(name): f"Cites:{x}" for name, x in NAMES.items() for cite in CITES}
SENTENCES |= {f"{cites} CC {c} {v}.": f"Cites:CC-{c}-{v}" for c in CLAUSES for v in VERSIONS for cites in ("Licensed under", "This work is licensed under")}
SENTENCES |= {f"{cites} CC0 1.0.": "Cites:CC0-1.0" for cites in ("Licensed under", "This work is licensed under")}

# Rules in the order they are tried, longer ones first.
RULES: list[tuple[tuple[str, ...], str]] = [
    (("ApacheHead", "ApacheUse", "ApacheCopy", "ApacheUrl", "ApacheBasis", "ApacheSee"), "Apache-2.0"),
    (("ApacheHead", "ApacheUse", "ApacheCopy", "ApacheUrl"), "Apache-2.0"),
    (("ApacheTitle", "ApacheVersion", "ApacheUrl", "ApacheTerms"), "Apache-2.0"),
    (("ApacheTitle", "ApacheVersion"), "Apache-2.0"),
    (("ApacheHead",), "Apache-2.0"),
    (("ApacheFull",), "Apache-2.0"),
    (("MITTitle", "MITPerm", "MITNotice", "MITAsIs", "MITLiability"), "MIT"),
    (("MITPerm", "MITNotice", "MITAsIs", "MITLiability"), "MIT"),
    (("MITPerm", "MITNotice", "MITAsIs"), "MIT"),
    (("MITPerm", "MITNotice"), "MIT"),
    (("MIT0Perm", "MITAsIs", "MITLiability"), "MIT-0"),
    (("MIT0Perm",), "MIT-0"),
    (("MITPerm",), "MIT"),
    (("MITTitle",), "MIT"),
    (("ISCTitle", "ISCPerm", "ISCAsIs", "ISCLiability"), "ISC"),
    (("ISCPerm", "ISCAsIs", "ISCLiability"), "ISC"),
    (("ISCPerm",), "ISC"),
    (("BSD0Perm", "ISCAsIs", "ISCLiability"), "0BSD"),
    (("BSD0Perm",), "0BSD"),
    (("ISCTitle",), "ISC"),
    (("BSD3Title", "BSDPre", "BSDSource", "BSDBinary", "BSDName", "BSDAsIs", "BSDLiability"), "BSD-3-Clause"),
    (("BSDPre", "BSDSource", "BSDBinary", "BSDName", "BSDAsIs", "BSDLiability"), "BSD-3-Clause"),
    (("BSDPre", "BSDSource", "BSDBinary", "BSDName"), "BSD-3-Clause"),
    (("BSDPre", "BSDSource", "BSDBinary", "BSDAdvert"), "BSD-4-Clause"),
    (("BSD2Title", "BSDPre", "BSDSource", "BSDBinary", "BSDAsIs", "BSDLiability"), "BSD-2-Clause"),
    (("BSDPre", "BSDSource", "BSDBinary", "BSDAsIs", "BSDLiability"), "BSD-2-Clause"),
    (("BSDPre", "BSDSource", "BSDBinary"), "BSD-2-Clause"),
    (("BSD3Title",), "BSD-3-Clause"),
    (("BSD2Title",), "BSD-2-Clause"),
    (("ZlibAsIs", "ZlibLiability", "ZlibPerm", "ZlibOrigin"), "Zlib"),
    (("ZlibAsIs", "ZlibLiability", "ZlibPerm"), "Zlib"),
    (("BoostTitle",), "BSL-1.0"),
    (("BoostRef",), "BSL-1.0"),
    (("GPL3Plus", "GPLHope", "GPLSee", "GPLCopy"), "GPL-3.0-or-later"),
    (("GPL3Plus", "GPLHope", "GPLSee"), "GPL-3.0-or-later"),
    (("GPL2Plus", "GPLHope", "GPLSee", "GPLCopy"), "GPL-2.0-or-later"),
    (("GPL2Plus", "GPLHope", "GPLSee"), "GPL-2.0-or-later"),
    (("AGPL3Plus", "GPLHope", "GPLSee", "GPLCopy"), "AGPL-3.0-or-later"),
    (("AGPL3Plus", "GPLHope", "GPLSee"), "AGPL-3.0-or-later"),
    (("LGPL3Plus", "GPLHope", "GPLSee", "GPLCopy"), "LGPL-3.0-or-later"),
    (("LGPL3Plus", "GPLHope", "GPLSee"), "LGPL-3.0-or-later"),
    (("LGPL21Plus", "GPLHope", "GPLSee"), "LGPL-2.1-or-later"),
    (("GPL3Only", "GPLHope", "GPLSee"), "GPL-3.0-only"),
    (("GPL2Only", "GPLHope", "GPLSee"), "GPL-2.0-only"),
    (("GPL3Plus",), "GPL-3.0-or-later"),
    (("GPL2Plus",), "GPL-2.0-or-later"),
    (("AGPL3Plus",), "AGPL-3.0-or-later"),
    (("LGPL3Plus",), "LGPL-3.0-or-later"),
    (("LGPL21Plus",), "LGPL-2.1-or-later"),
    (("GPL3Only",), "GPL-3.0-only"),
    (("GPL2Only",), "GPL-2.0-only"),
    (("GPL3Ref",), "GPL-3.0-only"),
    (("GPL2Ref",), "GPL-2.0-only"),
    (("AGPLTitle", "AGPL3Version"), "AGPL-3.0-only"),
    (("LGPLTitle", "GPL3Version"), "LGPL-3.0-only"),
    (("LGPLTitle", "LGPL21Version"), "LGPL-2.1-only"),
    (("GPLTitle", "GPL3Version", "GPLVerbatim"), "GPL-3.0-only"),
    (("GPLTitle", "GPL2Version", "GPLVerbatim"), "GPL-2.0-only"),
    (("GPLTitle", "GPL3Version"), "GPL-3.0-only"),
    (("GPLTitle", "GPL2Version"), "GPL-2.0-only"),
    (("MPLRef", "MPLCopy"), "MPL-2.0"),
    (("MPLRef",), "MPL-2.0"),
    (("MPLTitle",), "MPL-2.0"),
    (("EPL2Ref",), "EPL-2.0"),
    (("Unlicense", "UnlicenseFree"), "Unlicense"),
    (("Unlicense",), "Unlicense"),
    (("WtfplTitle",), "WTFPL"),
]
RULES += [((f"Spdx:{x}",), x) for x in LISTED]
RULES += [((x,), x.removeprefix("Cites:")) for x in dict.fromkeys(SENTENCES.values()) if x.startswith("Cites:")]

#: Stops before blanks, but not those of initials, which end a sentence as line feeds do; what is no letter, digit or mark of an end.
_STOP, _ODD = r"[.;:!?](?<![^A-Za-z0-9][A-Z][.])[\x20\x09\x0B-\x0D]+", r"[^a-z0-9|\n]+"
#: Sentences that may stand anywhere in a run: copyright notices, and numbers or letters of a list.
_NEUTRAL = r"^(?:copyright( .*)?|c [12][0-9]{3}( .*)?|[0-9]{1,3}|[a-z])$"
UNKNOWN, ANYWHERE = "?", "AllRights"


def _plain(sentence: str) -> str:
    return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in sentence.lower()).split())


KNOWN: dict[str, str] = {_plain(s): i for s, i in SENTENCES.items()}


#: A known sentence from one end to another, or any other sentence. Ends inside a known one are passed over: its own stops, and line feeds of wrapped text.
_ANY = r"(?<=[\n\f])(?:" + "|".join(k.replace(" ", r"[ \n]") for k in sorted(KNOWN, key=lambda k: (-len(k), k))) + r")(?=[\n\f])|[^\n\f]+"


def normalised(text: Column) -> Column:
    """ASCII letters and digits in lower case, one blank for all else; LF for the end of a sentence, FF for blank lines, and one at either end."""
    ends = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "|", "_"), _STOP, "|")
    plain = F.regexp_replace(F.lower(ends), _ODD, " ")
    plain = F.regexp_replace(plain, r"[ |]*\n[ |]*(?:\n[ |]*)+", "\f")
    plain = F.regexp_replace(plain, r"[ |]*\n[ |]*| *\|[ |]*", "\n")
    return F.concat(F.lit("\n"), F.btrim(plain, F.lit(" \n\f")), F.lit("\n"))


def sequence(text: Column) -> Column:
    """Array of the identifiers of a text's sentences, in order: the longest known one where several begin, UNKNOWN for others, null for neutral ones."""
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    other = lambda s: F.when(~s.rlike(_NEUTRAL), F.lit(UNKNOWN))
    return F.transform(F.regexp_extract_all(normalised(text), F.lit(_ANY), F.lit(0)), lambda s: F.coalesce(known[F.translate(s, "\n", " ")], other(s)))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Append licence_sentences (known identifiers in order, joined by a blank), licences (matched, in order of rules, joined by a comma) and n_unmatched.

    Each row is scanned alone over its whole text, without any shuffle. Null or empty text: '', '' and
    0. Known sentences that no rule takes are counted in n_unmatched, but for reservations of rights. Repeated rows give repeated results;
    columns named like the results are replaced.
    """
    rows = df.drop(*[c for c in df.columns if c.lower() in ("licence_sentences", "licences", "n_unmatched")])
    both = next(c for c in ("licence_sequence", "_licence_sequence", "__licence_sequence") if c not in rows.columns)
    out = rows.withColumn(both, F.filter(sequence(F.col(text)), lambda i: i.isNotNull()))
    out = out.withColumn("licence_sentences", F.concat_ws(" ", F.filter(both, lambda i: i != UNKNOWN)))
    # two blanks between identifiers, so that neighbours never share one
    left: Column = F.concat(F.lit(" "), F.concat_ws("  ", F.filter(both, lambda i: i != ANYWHERE)), F.lit(" "))
    state = F.struct(left.alias("left"), F.lit("").alias("found"))
    rules = F.array(*[F.struct(F.lit(" " + "  ".join(ids) + " ").alias("ids"), F.lit(name).alias("name")) for ids, name in RULES])
    step = lambda s, r: F.when(F.contains(s["left"], r["ids"]), F.struct(F.replace(s["left"], r["ids"], F.lit("|")).alias("left"), F.when(F.contains(F.concat(F.lit(","), s["found"], F.lit(",")), F.concat(F.lit(","), r["name"], F.lit(","))), s["found"]).otherwise(F.concat(s["found"], F.when(s["found"] == "", "").otherwise(","), r["name"])).alias("found"))).otherwise(s)
    done = F.when(F.col("licence_sentences") == "", F.struct(F.lit("").alias("left"), F.lit("").alias("found"))).otherwise(F.aggregate(rules, state, step))
    n = F.size(F.filter(F.split(F.translate(done["left"], "|", " "), " "), lambda x: ~x.isin("", UNKNOWN)))
    return out.withColumns({"licences": done["found"], "n_unmatched": n.cast("long")}).drop(both)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _oracle() -> str:
    """SQL that finds known sentences by looking up joined pieces, the longest first, rather than by a pattern."""
    pieces = max(s.count(" ") for s in KNOWN) + 1
    known = "MAP {" + ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in KNOWN.items()) + "}"
    heads = "[" + ", ".join(_quoted(h) for h in sorted({k.split(" ")[0] for k in KNOWN})) + "]"
    rules = "[" + ", ".join(f"{{'ids': {_quoted(' ' + '  '.join(ids) + ' ')}, 'name': {_quoted(name)}}}" for ids, name in RULES) + "]"
    return f"""
WITH o AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(regexp_replace(translate(coalesce(text, ''), chr(1), ' '), '([^A-Za-z0-9][A-Z])\\.', '\\1 ', 'g'), '([^A-Za-z0-9][A-Z])\\.', '\\1 ', 'g') AS t FROM documents
), a AS (SELECT r, doc_id, regexp_replace(t, '([.;:!?])[ \\t\\x0B-\\x0D]+', '\\1' || chr(1), 'g') AS t FROM o
), b AS (SELECT r, doc_id, regexp_replace(lower(t), '[^a-z0-9\\x01\\n]+', ' ', 'g') AS t FROM a
), c AS (SELECT r, doc_id, regexp_replace(regexp_replace(t, '[ \\x01]*\\n[ \\x01]*(\\n[ \\x01]*)+', chr(2), 'g'), '[ \\x01]*\\n[ \\x01]*| *\\x01[ \\x01]*', chr(1), 'g') AS t FROM b
), p AS (SELECT r, unnest(string_split(trim(t, ' ' || chr(1) || chr(2)), chr(2))) AS para, unnest(range(len(string_split(trim(t, ' ' || chr(1) || chr(2)), chr(2))))) AS k FROM c
), s AS (SELECT r, k, string_split(para, chr(1)) AS w FROM p
), x AS (SELECT r, k, w, unnest(w) AS head, unnest(range(1, len(w) + 1)) AS i FROM s
), j AS (SELECT r, k, i, head, w, unnest(range(i, least(len(w), i + {pieces}) + 1)) AS e FROM x WHERE list_contains({heads}, string_split(head, ' ')[1])
), m AS (SELECT r, k, i, e, ({known})[array_to_string(w[i:e], ' ')] AS ident FROM j
), l AS (SELECT r, k, i, max(e) AS e, max_by(ident, e) AS ident FROM m WHERE ident IS NOT NULL GROUP BY r, k, i
), f AS (SELECT x.r, x.k, list({{'i': x.i, 'e': coalesce(l.e, x.i), 'ident': coalesce(l.ident, CASE WHEN x.head = '' OR regexp_full_match(x.head, 'copyright( .*)?|c [12][0-9]{{3}}( .*)?|[0-9]{{1,3}}|[a-z]') THEN '' ELSE '{UNKNOWN}' END)}} ORDER BY x.i) AS seen FROM x LEFT JOIN l ON x.r = l.r AND x.k = l.k AND x.i = l.i GROUP BY x.r, x.k
), g AS (SELECT r, k, list_reduce(seen, lambda s, y: CASE WHEN y.i <= s.e THEN s ELSE {{'i': y.i, 'e': y.e, 'ident': s.ident || CASE WHEN y.ident = '' THEN '' ELSE ' ' || y.ident || ' ' END}} END, {{'i': 0::BIGINT, 'e': 0::BIGINT, 'ident': ''}}).ident AS ids FROM f
), h AS (SELECT r, string_agg(ids, '' ORDER BY k) AS ids FROM g GROUP BY r
), d AS (SELECT r, ids, list_reduce({rules}, lambda s, y: CASE WHEN NOT contains(s.ids, y.ids) THEN s ELSE {{'ids': replace(s.ids, y.ids, '|'), 'name': CASE WHEN contains(',' || s.name || ',', ',' || y.name || ',') THEN s.name WHEN s.name = '' THEN y.name ELSE s.name || ',' || y.name END}} END, {{'ids': replace(ids, ' {ANYWHERE} ', ''), 'name': ''}}) AS z FROM h
)
SELECT a.doc_id, array_to_string(list_filter(string_split(d.ids, ' '), lambda y: y NOT IN ('', '{UNKNOWN}')), ' ') AS licence_sentences, d.z.name AS licences,
  CAST(len(list_filter(string_split(translate(d.z.ids, '|', ' '), ' '), lambda y: y NOT IN ('', '{UNKNOWN}'))) AS BIGINT) AS n_unmatched
FROM a JOIN d ON a.r = d.r
"""


ORACLE = _oracle()
