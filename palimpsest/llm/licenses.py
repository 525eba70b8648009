"""License scans by patience alignment.

Words that are unique both to the text and to a template are anchors; the longest increasing subsequence of anchors fixes the
alignment, and each gap between neighbouring anchors is aligned the same way. Coverage is the share of a template's words that
are aligned. Each template also names words that must be aligned (a license's name, its version, what tells it from its kin) and
words that must not stand in between; a number must follow its predecessor directly. So an unknown variant gets no name.

A text is searched around the rarest word that a template must have, first as if no word had been put in, then in a region that
allows ``spread`` further words on either side. So a notice may stand anywhere in a long text, more than once, and be interspersed.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from ..tables import table

# Public license texts and names; fixed values.
_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
#: (license, text, words that must be aligned, words that must not stand within)
TEXTS = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', "apache license 2.0", ""),
    ("MIT", _GRANT, "permission granted charge deal", ""),
    ("MIT", f"{_GRANT}, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_WARRANTY}", "permission granted sublicense furnished", ""),
    ("ISC", _ISC, "permission purpose fee granted", ""),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.", "permission purpose fee granted appear", ""),
    ("0BSD", f"{_ISC}. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE", "permission purpose fee granted disclaims", "appear"),
    ("BSD", _BSD_HEAD, "redistribution source binary forms", ""),
    ("BSD-2-Clause", f"{_BSD_HEAD} {_BSD_TWO} {_BSD_WARRANTY}", "redistributions retain reproduce disclaimed", "endorse"),
    ("BSD-3-Clause", f"{_BSD_HEAD} {_BSD_TWO} {_BSD_THIRD}", "redistributions retain reproduce endorse", ""),
    ("BSD-3-Clause", f"{_BSD_HEAD} {_BSD_TWO} {_BSD_THIRD} {_BSD_WARRANTY}", "redistributions retain reproduce endorse disclaimed", ""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mozilla public license 2.0", ""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla public license 2.0", ""),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "eclipse public license 2.0", ""),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0", "eclipse public license v1.0", ""),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.", "alter misrepresented plainly removed", ""),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "unencumbered public domain", ""),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "permission granted organization covered", ""),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0.", "boost license 1.0", ""),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", "fuck want public license", ""),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "waived neighboring rights", ""),
    ("Public-domain", "This work is released into the public domain", "released public domain", "unencumbered"),
    ("All-rights-reserved", "All rights reserved", "all rights reserved", ""),
]
#: License and the names it goes by after "Licensed under the" or "Released under the".
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "Apache-1.1": ("Apache License, Version 1.1", "Apache Software License, Version 1.1"),
    "MIT": ("MIT License",),
    "ISC": ("ISC License",),
    "BSD": ("BSD License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU LGPL version 2.1", "LGPLv2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL version 3", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL version 3", "AGPLv3"),
    "MPL-1.1": ("Mozilla Public License, version 1.1",),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "EPL-1.0": ("Eclipse Public License, version 1.0", "Eclipse Public License 1.0"),
    "EPL-2.0": ("Eclipse Public License, version 2.0", "Eclipse Public License 2.0"),
    "Zlib": ("zlib License",),
    "Unlicense": ("Unlicense",),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "CC0-1.0": ("CC0 1.0 Universal License", "Creative Commons Zero 1.0 Universal License"),
}
_COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_COMMONS_VERSIONS = {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
_KIN = {"GPL": "lesser library affero", "Commons": "noncommercial sharealike noderivatives non-commercial share-alike no-derivatives"}
COVERAGE = 0.8
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def words(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[str, ...]
    must: frozenset[str]
    never: frozenset[str]

    @property
    def spread(self) -> int:
        """Further words on either side of a must word within which the template is looked for."""
        return 2 * len(self.words) + 16

    @property
    def key(self) -> str:
        """A must word that few other texts have: the longest."""
        return max(self.must, key=lambda w: (len(w), w))


def _template(name: str, text: str, must: str, never: str = "") -> Template:
    return Template(name, tuple(w for w, _, _ in words(text)), frozenset(w for w, _, _ in words(must)), frozenset(never.split()))


@functools.cache
def templates() -> tuple[Template, ...]:
    """The full texts, then by rule the short notices, those of the Creative Commons family and SPDX tags."""
    out = [_template(*t) for t in TEXTS]
    for name, titles in NAMES.items():
        for title in titles:
            never = _KIN["GPL"] if name.startswith("GPL") else ""
            must = title if "GPL" in name else re.sub(r"(?i)version|software|universal", "", title)
            out += [_template(name, f"{verb} under the {title}", must, never) for verb in ("Licensed", "Released")]
    for name, version in (("GPL-2.0", "2"), ("GPL-3.0", "3"), ("LGPL-2.1", "2.1"), ("LGPL-3.0", "3"), ("AGPL-3.0", "3")):
        kind = {"G": "", "L": "Lesser ", "A": "Affero "}[name[0]]
        text = f"This {'program' if name[0] != 'L' else 'library'} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation; either version {version} of the License"
        out.append(_template(name, text, f"redistribute {kind} general public license {version}", "" if kind else _KIN["GPL"]))
        if not kind:
            out.append(_template(name, f"This work is licensed under the GNU General Public License, version {version}.", f"general public license {version}", _KIN["GPL"]))
    for short, long in _COMMONS.items():
        for version, region in _COMMONS_VERSIONS.items():
            name, never = f"CC-{short}-{version}", _KIN["Commons"] if short == "BY" else ""
            out.append(_template(name, f"Licensed under CC {short} {version}.", f"cc {short} {version}"))
            out.append(_template(name, f"Licensed under CC-{short}-{version}.", f"CC-{short}-{version}"))
            out.append(_template(name, f"This work is licensed under a Creative Commons {long} {version} {region} License.", f"creative commons {long} {version}", never))
    ids = {t.name for t in out} - {"BSD", "Public-domain", "All-rights-reserved"}
    for name in sorted(ids):
        for tag in (name, f"{name}-only", f"{name}-or-later") if "GPL" in name else (name,):
            out.append(_template(name, f"SPDX-License-Identifier: {tag}", f"SPDX-License-Identifier {tag}"))
    return tuple(dict.fromkeys(out))


@functools.cache
def _by_key() -> dict[str, list[Template]]:
    out = defaultdict(list)
    for t in templates():
        out[t.key].append(t)
    return out


def cues() -> list[str]:
    """Strings of which every text with a notice has one in lower case: the templates' keys but for those that hold another."""
    keys = _by_key()
    return sorted(w for w in keys if not any(x in w for x in keys if x != w))


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned positions (in a, in b), rising in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:  # equal ends need no anchor
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {w: j for j, w in enumerate(b[b0:b1], b0) if cb[w] == 1}
        pairs = [(i, at[w]) for i, w in enumerate(a[a0:a1], a0) if ca[w] == 1 and w in at]
        if not pairs:
            continue
        tails, ends, back = [], [], {}
        for p in pairs:
            k = bisect_left(tails, p[1])
            back[p] = ends[k - 1] if k else None
            tails[k : k + 1], ends[k : k + 1] = [p[1]], [p]
        chain, p = [], ends[-1]
        while p:
            chain.append(p)
            p = back[p]
        chain.reverse()
        out += chain
        for (x0, y0), (x1, y1) in zip([(a0 - 1, b0 - 1), *chain], [*chain, (a1, b1)], strict=True):
            todo.append((x0 + 1, x1, y0 + 1, y1))
    return sorted(out)


def _aligned(t: Template, ws: list[str], lo: int, hi: int) -> list[tuple[int, int]] | None:
    """Aligned positions (in the text, in the template) if the template stands within the words from lo to hi."""
    pairs = [(lo + i, j) for i, j in patience(ws[lo:hi], list(t.words))]
    if len(pairs) < COVERAGE * len(t.words):
        return None
    if not t.must <= {t.words[j] for _, j in pairs}:
        return None
    if t.never and not t.never.isdisjoint(ws[pairs[0][0] : pairs[-1][0] + 1]):
        return None
    for (i0, j0), (i1, j1) in zip(pairs, pairs[1:], strict=False):
        if t.words[j1] in t.must and t.words[j1][-1].isdigit() and i1 - i0 > j1 - j0:  # a number of something else
            return None
    return pairs


def scan(text: str | None) -> list[tuple[str, float, int, int]]:
    """(license, coverage, start, end) of every notice found, by start; positions are code points. Of overlapping ones that with most aligned words, then the better covered, stays."""
    found_words = words(text or "")
    ws = [w for w, _, _ in found_words]
    where = defaultdict(list)
    for i, w in enumerate(ws):
        where[w].append(i)
    found = []
    for key, group in _by_key().items():
        if key not in where:
            continue
        for t in group:
            if not all(w in where for w in t.must):
                continue
            n, times = len(t.words), Counter(t.words)
            rare = min(t.must, key=lambda w: (times[w] > 1, len(where[w]), w))
            at, offset = where[rare], t.words.index(rare)
            done = -1
            for k, i in enumerate(at):
                if i < done:
                    continue
                pairs = _aligned(t, ws, max(0, i - offset, done), min(len(ws), max(0, i - offset) + n))
                if pairs is None:
                    # up to the neighbouring occurrences of the rare word, which belong to other notices
                    alone = times[rare] == 1
                    lo = max(0, done, i - offset - t.spread, at[k - 1] + 1 if alone and k else 0)
                    hi = min(len(ws), i - offset + n + t.spread, at[k + 1] if alone and k + 1 < len(at) else len(ws))
                    if all((x := bisect_left(where[w], lo)) < len(where[w]) and where[w][x] < hi for w in t.must):
                        pairs = _aligned(t, ws, lo, hi)
                if pairs is not None:
                    a, b = pairs[0][0], pairs[-1][0]
                    found.append((t.name, len(pairs) / n, found_words[a][1], found_words[b][2], len(pairs)))
                    done = b + 1
    out: list[tuple[str, float, int, int]] = []
    taken: list[tuple[int, int]] = []  # spans kept, in order; none overlaps another
    for name, cover, s, e, _ in sorted(found, key=lambda x: (-x[4], -x[1], x[2], x[0])):
        at = bisect_left(taken, (s, e))
        if (at == 0 or taken[at - 1][1] <= s) and (at == len(taken) or e <= taken[at][0]):
            taken.insert(at, (s, e))
            out.append((name, cover, s, e))
    return sorted(out, key=lambda x: x[2])


_RESULT = ArrayType(StructType([StructField("license", StringType()), StructField("coverage", DoubleType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))


@F.pandas_udf(_RESULT)
def scan_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("license", "coverage", "start", "end"), x)) for x in scan(t)] for t in texts], dtype=object)


def licensed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``notices``, an array of (license, coverage, start, end): empty for null and empty texts and where nothing is found.

    Texts without a cue word have no notice and never leave the JVM. Repeated rows give equal results. A column named notices is
    replaced; all others pass through.
    """
    t = F.col(text_col)
    wide = docs.select(F.struct(*docs.columns).alias("row_"), t.alias("text_"), F.lower(t).alias("low_"))  # lowered once
    cue = F.coalesce(functools.reduce(lambda a, b: a | b, (F.contains("low_", F.lit(w)) for w in cues())), F.lit(False))
    found = wide.select("row_", scan_udf(F.when(cue, F.col("text_")).otherwise(F.lit(""))).alias("notices_"))
    return found.select(*(F.col(f"row_.`{c}`").alias(c) for c in docs.columns if c != "notices"), F.col("notices_").alias("notices"))


def op2_license(spark, sf_dir: str) -> DataFrame:
    found = licensed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    notices = F.array_join(F.transform("notices", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    best = F.array_max(F.transform("notices", lambda x: x["coverage"]))
    return found.select("doc_id", F.size("notices").cast("long").alias("n_notices"), notices.alias("notices"), F.coalesce(best, F.lit(0.0)).alias("coverage"))


QUERIES = {"op2_license": op2_license}
ORACLE_SQL: dict[str, str] = {}
