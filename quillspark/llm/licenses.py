"""License scans by patience alignment.

A window of a text is aligned with the text of a license: words that occur once in both
are anchors, the longest run of anchors that rises in both is kept, and the gaps between
are aligned in the same way. Coverage is the share of the license's words that are
matched. Windows are placed where enough different words of the license lie close by.
Names of licenses, SPDX identifiers and the reserved-rights line are too short for that
and are looked for word by word.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .decontamination import words_of

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

#: The wordings looked for, and words that must be among the matched ones.
TEMPLATES: dict[str, tuple[str, tuple[str, ...]]] = {
    "MIT": (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. """
        + _WARRANTY,
        (),
    ),
    "ISC": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
        (),
    ),
    "BSD": (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution.""",
        (),
    ),
    "Apache-2.0": (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You
        may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        ("apache",),
    ),
    "GPL": (
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published
        by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in
        the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
        PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
        ("gnu", "general"),
    ),
    "MPL-2.0": (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
        this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
        ("mozilla",),
    ),
    "Unlicense": (
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
        or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by
        any means.""",
        (),
    ),
    "MIT statement": ("Released under the MIT License.", ("mit",)),
    "Apache-2.0 statement": ("Licensed under the Apache License, Version 2.0.", ("apache", "2")),
    "GPL-3.0 statement": ("This work is licensed under the GNU General Public License, version 3.", ("gnu", "general", "3")),
    "CC-BY-NC-4.0 statement": ("Licensed under CC BY-NC 4.0.", ("cc", "by", "nc")),
    "CC-BY-4.0 statement": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative", "attribution")),
    "BSD statement": ("Released under the BSD 3-Clause License.", ("bsd",)),
    "LGPL": (
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
        published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
        ("gnu", "lesser"),
    ),
    "AGPL": (
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
        ("gnu", "affero"),
    ),
    "GNU license text": (
        """Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document,
        but changing it is not allowed.""",
        ("verbatim", "changing"),
    ),
    "Apache-2.0 text": (
        """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
        1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution""",
        ("apache", "reproduction"),
    ),
    "MPL-2.0 text": (
        """Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes
        to the creation of, or owns Covered Software.""",
        ("mozilla", "contributor"),
    ),
}


def _phrases() -> dict[str, str]:
    """Wording: name, of all short forms."""
    out = {"All rights reserved": "All rights reserved", "SPDX-License-Identifier": "SPDX identifier", "CC0": "CC0", "CC0 1.0": "CC0-1.0", "Creative Commons Zero": "CC0"}
    gnu = (("GPL", "General", ("1", "2", "3")), ("LGPL", "Lesser General", ("2", "2.1", "3")), ("LGPL", "Library General", ("2",)), ("AGPL", "Affero General", ("1", "3")))
    spdx = ["MIT", "MIT-0", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSD-3-Clause-Clear", "Apache-1.1", "Apache-2.0", "MPL-1.1", "MPL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "BSL-1.0", "Zlib", "Unlicense", "WTFPL", "Artistic-2.0", "CC0-1.0", "OFL-1.1"]
    for short, long, versions in gnu:
        for v in versions:
            full = v if "." in v else f"{v}.0"
            for form in (f"GNU {long} Public License", f"GNU {short}", short):
                out |= {f"{form} {how}{n}": f"{short}-{full}" for how in ("", "version ", "v") for n in (v, full)}
            out[f"{short}v{v}"] = f"{short}-{full}"
            spdx += [f"{short}-{full}{end}" for end in ("", "-only", "-or-later")]
    words = {"BY": ["Attribution"], "SA": ["ShareAlike", "Share Alike"], "ND": ["NoDerivatives", "NoDerivs", "No Derivatives"], "NC": ["NonCommercial", "Non Commercial"]}
    for code in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"):
        spelled = [" ".join(x) for x in product(*(words[c] for c in code.split("-")))]
        for form in (f"CC {code}", *(f"Creative Commons {x}" for x in spelled)):
            if form != "CC BY":  # two common words
                out[form] = f"CC-{code}"
            out |= {f"{form} {v}": f"CC-{code}-{v}" for v in ("1.0", "2.0", "2.5", "3.0", "4.0")}
        spdx += [f"CC-{code}-{v}" for v in ("1.0", "2.0", "2.5", "3.0", "4.0")]
    for name, forms in {
        "MIT": ("MIT License", "MIT licence"),
        "Apache-2.0": ("Apache License Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0"),
        "MPL-2.0": ("Mozilla Public License Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License v. 2.0", "Mozilla Public License v2.0", "MPL 2.0"),
        "BSD-2-Clause": ("BSD 2-Clause", "2-Clause BSD"),
        "BSD-3-Clause": ("BSD 3-Clause", "3-Clause BSD"),
    }.items():
        out |= dict.fromkeys(forms, name)
    return out | {f"SPDX-License-Identifier: {x}": f"SPDX {x}" for x in spdx}


#: Short forms that are looked for word by word, with their names.
PHRASES: dict[str, str] = _phrases()


def patience(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Matched places of two sequences, rising in both: equal ends, then the anchors' longest rising run, then its gaps."""
    out: list[tuple[int, int]] = []
    waiting = [(0, len(a), 0, len(b))]
    while waiting:
        a0, a1, b0, b1 = waiting.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and in_a.get(w) == 1}
        anchors = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if w in place]
        run = _rising(anchors)
        if not run:
            continue
        ends = [(a0 - 1, b0 - 1), *run, (a1, b1)]
        out += run
        waiting += [(p + 1, i, q + 1, j) for (p, q), (i, j) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, in order of the first, that rises in the second."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        tops[p : p + 1] = [j]
        at[p : p + 1] = [k]
        before.append(at[p - 1] if p else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


@dataclass
class Template:
    """A wording: its words, the needed ones, and how many words of it may be missing.

    It is looked for in runs of `reach` words: `stretch` times its own number, for wordings
    of fewer than `short` words, whose words chance brings together, a quarter more.
    """

    name: str
    words: list[bytes]
    needed: frozenset[bytes]
    least: float
    stretch: float = 2.5
    short: int = 30

    def __post_init__(self) -> None:
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(self.words))}
        self.missing = int(len(self.words) * (1 - self.least) + 1e-9)
        self.close = len(self.words) + max(3, len(self.words) // 4)
        self.reach = self.close if len(self.words) < self.short else max(self.close, int(self.stretch * len(self.words)))
        self.wanted = ceil(self.least * len(self.words) - 1e-9)
        self.bits = [0] * len(self.vocabulary)
        for at, w in enumerate(self.words):
            self.bits[self.vocabulary[w]] |= 1 << at

    def most(self, code: list[int]) -> int:
        """How many words of the wording any alignment can match, in order, with some words in codes: the longest common subsequence, a row of bits at a time."""
        full = (1 << len(self.words)) - 1
        row = full
        for c in code:
            common = row & self.bits[c]
            row = (row + common | row - common) & full
        return len(self.words) - row.bit_count()

    def find(self, words: list[bytes], known: set[bytes]) -> Iterator[tuple[str, float, int, int]]:
        """(name, coverage, first word, words) of each place in a text, from left to right and apart; known: the text's words."""
        if not self.needed <= known or len(self.vocabulary.keys() & known) < len(self.vocabulary) - self.missing:
            return
        code = np.fromiter((self.vocabulary.get(w, -1) for w in words), np.int64, len(words))
        hits = np.flatnonzero(code >= 0)
        total = np.concatenate(([0], np.cumsum(code >= 0)))
        near = hits[total[np.minimum(hits + self.reach, len(words))] - total[hits] >= len(self.words) - self.missing]
        after, hopeless, wide = -1, -1, self.reach + self.close
        for s in near.tolist():
            if s < after or s < hopeless:
                continue
            end = min(s + wide, len(words))
            if (best := self.most((own := code[s:end])[own >= 0].tolist())) < self.wanted:
                # each word that comes in at the end adds one at most
                hopeless = int(np.searchsorted(total, total[end] + self.wanted - best)) - wide
                continue
            if len(np.unique(part := code[s : s + self.reach])) - (part.min() < 0) < len(self.vocabulary) - self.missing:
                continue
            window = words[s : s + wide]
            # the narrowest that covers most: in a wide one a second copy leaves no word unique, in a narrow one the wording may begin late
            matched = max((patience(window[:n], self.words) for n in sorted({self.close, self.reach, len(window)})), key=len)
            if len(matched) >= self.least * len(self.words) and self.needed <= {window[i] for i, _ in matched}:
                first, last = matched[0][0], matched[-1][0]
                yield self.name, len(matched) / len(self.words), s + first, last - first + 1
                after = s + last + 1


class Phrases:
    """Short wordings whose words all stand side by side; at each place the longest counts."""

    def __init__(self, names: dict[str, str]) -> None:
        self.by_first: dict[bytes, list[tuple[list[bytes], str]]] = {}
        for text, name in names.items():
            if words := words_of(text):
                self.by_first.setdefault(words[0], []).append((words, name))
        for held in self.by_first.values():
            held.sort(key=lambda x: -len(x[0]))

    def find(self, words: list[bytes], known: set[bytes]) -> Iterator[tuple[str, float, int, int]]:
        """As Template.find."""
        starts: list[int] = []
        for first in self.by_first.keys() & known:
            if any(known.issuperset(w) for w, _ in self.by_first[first]):
                at = -1
                for _ in range(words.count(first)):
                    starts.append(at := words.index(first, at + 1))
        after = 0
        for s in sorted(starts):
            for w, name in self.by_first[words[s]] if s >= after else ():
                if words[s : s + len(w)] == w:
                    yield name, 1.0, s, len(w)
                    after = s + len(w)
                    break


def _found(templates: list[Template | Phrases]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k, text in enumerate(batch.column(1)):
                words = words_of(text.as_py() or "")
                known = set(words)
                rows += [(k, *found) for t in templates for found in t.find(words, known)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
                names=["doc_id", "license", "coverage", "start", "words"],
            )

    return run


def license_spans(docs: DataFrame, templates: dict[str, tuple[str, tuple[str, ...]]] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, stretch: float = 2.5) -> DataFrame:
    """(doc_id, license, coverage, start, words): each place where a text covers at least `least` of a wording.

    Texts are read whole, as lower-case words. A place spans from the first to the last
    matched word; places of one wording don't overlap, those of different ones may. A place
    with other words in between is found if it takes at most `stretch` times the words of
    the wording (1.25 times for wordings of under 30 words). Null and empty texts have
    none; repeated rows give repeated results; no other column is read. The wordings are a list written by hand, held by each task. Those of `phrases`
    (wording: name) must be there whole and side by side; they are PHRASES, or none beside
    templates of the caller's own.
    """
    prepare(docs.sparkSession)
    known = [Template(name, words_of(text), frozenset(w.encode() for w in needed), least, stretch) for name, (text, needed) in (templates or TEMPLATES).items()]
    known.append(Phrases(phrases if phrases is not None else {} if templates else PHRASES))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_found(known), "doc_id long, license string, coverage double, start long, words long")


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """The licenses stated in documents."""
    return license_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
