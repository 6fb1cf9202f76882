"""Licence notices found by patience alignment with templates.

A template and a region of a text are aligned on the words that are unique in both: the longest
increasing subsequence of these anchors is kept, and the gaps between them are aligned in the same way, where
more words are unique. Coverage is the share of the template's words that are matched.

Regions are found without a scan per template: an alignment that covers ``share`` of a template's words
matches at least one of any set of more than (1 - share) of its words, so regions start around every occurrence
of so many of its rarest words in the text. Each grows beyond its outermost matched words while that adds
matches, so words may be inserted in any number of places. A gap between two matched words is only crossed up to
the length of a first region (n + 2 * (n // 4 + 1) words, n in the template): words farther apart are
taken for different passages. A region counts only if it matches the words that tell the licence from its kin
(its version, NC, SA, ND, Lesser) and holds none of its kin's.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SHARE = 0.8
FIELDS = ["license", "coverage", "matched_words", "start_word", "end_word"]


@dataclass(frozen=True)
class Template:
    """A licence's text. A region of a document is only that licence if it matches the words ``needs``, and holds
    none of ``bars``: versions, and what tells one member of a family from another."""

    license: str
    text: str
    needs: tuple[str, ...] = ()
    bars: tuple[str, ...] = ()


def _creative_commons() -> list[Template]:
    """The notices of all six licences in all versions."""
    parts = {"nc": "NonCommercial", "nd": "NoDerivatives", "sa": "ShareAlike"}
    out = []
    for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        number = version.removesuffix(".0")
        for own in ((), ("nc",), ("nd",), ("sa",), ("nc", "nd"), ("nc", "sa")):
            name = "-".join(["by", *own])
            short, long = [p for p in parts if p not in own], [parts[p].lower() for p in parts if p not in own]
            bars = tuple(short + long)
            code = f"CC {name.upper()} {version}"
            full = f"Creative Commons {'-'.join(['Attribution', *(parts[p] for p in own)])} {version}"
            for text, needs in ((code, ("cc", "by", *own, number)), (full, ("commons", "attribution", *(parts[p].lower() for p in own), number))):
                out.append(Template(f"cc-{name}-{version}", text, needs, bars))
                out.append(Template(f"cc-{name}-{version}", f"Licensed under {text}", needs, bars))
                out.append(Template(f"cc-{name}-{version}", f"This work is licensed under a {text} International License", needs, bars))
    return out


def _gnu() -> list[Template]:
    """The notices of the GNU licences in their versions."""
    out = []
    for name, kind, versions in (("gpl", "", "123"), ("lgpl", "Lesser", "23"), ("lgpl", "Library", "2"), ("agpl", "Affero", "3")):
        others = tuple(k.lower() for k in ("Lesser", "Library", "Affero") if k != kind)
        spelled = f"GNU {kind} General Public License".replace("  ", " ")
        for v in [*versions, *(["2.1"] if kind == "Lesser" else [])]:
            own = ("public", v, *([kind.lower()] if kind else []))
            licence = f"{name}-{v if '.' in v else v + '.0'}"
            for text in (
                f"{spelled}, version {v}",
                f"This work is licensed under the {spelled}, version {v}",
                f"This program is free software: you can redistribute it and/or modify it under the terms of the {spelled}"
                f" as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.",
                f"This program is free software; you can redistribute it and/or modify it under the terms of the {spelled}"
                f" as published by the Free Software Foundation; version {v} of the License.",
            ):
                out.append(Template(licence, text, own, others))
            out.append(Template(licence, f"GNU {kind} GPL, version {v}".replace("  ", " "), ("gpl", v, *([kind.lower()] if kind else [])), others))
    return out


_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    " documentation files (the \"Software\"), to deal in the Software without restriction, including without"
    " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of"
    " the Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
    " conditions"
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
    " provided that the above copyright notice and this permission notice appear in all copies."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
    " that the following conditions are met"
)
_BSD_TWO = (
    " Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer"
    " in the documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
    " derived from this software without specific prior written permission."
)
_BSD_END = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,"
    " BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT"
    " SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL"
    " DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS"
    " INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE"
    " OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Notices, and whole texts where they are short, as their licences publish them (fixed texts).
TEMPLATES = [
    Template("apache-2.0", "Apache License, Version 2.0", ("apache", "2")),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache", "2")),
    Template(
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
        " compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,"
        " software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR"
        " CONDITIONS OF ANY KIND, either express or implied.",
        ("apache", "2"),
    ),
    Template("apache-1.1", "Apache License, Version 1.1", ("apache", "1.1")),
    Template("apache-1.1", "Apache Software License, Version 1.1", ("apache", "1.1")),
    Template("bsd", _BSD_HEAD, ("redistribution", "binary")),
    Template("bsd", "Released under the BSD License", ("bsd",)),
    Template("bsd-2-clause", _BSD_HEAD + _BSD_TWO + _BSD_END, ("redistribution", "reproduce"), ("endorse",)),
    Template("bsd-3-clause", _BSD_HEAD + _BSD_TWO + _BSD_THIRD + _BSD_END, ("redistribution", "reproduce", "endorse")),
    *_creative_commons(),
    Template("cc0-1.0", "CC0 1.0 Universal", ("cc0", "1")),
    *_gnu(),
    Template("isc", _ISC_GRANT, ("fee", "permission")),
    Template(
        "isc",
        _ISC_GRANT + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL"
        " IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR"
        " CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,"
        " NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        ("fee", "permission"),
    ),
    Template("mit", "Released under the MIT License", ("mit",)),
    Template("mit", "Licensed under the MIT License", ("mit",)),
    Template("mit", _MIT_GRANT, ("permission", "sublicense")),
    Template(
        "mit",
        _MIT_GRANT + ": The above copyright notice and this permission notice shall be included in all copies or substantial portions of the"
        " Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE"
        " WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT"
        " HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT"
        " OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        ("permission", "sublicense"),
    ),
    Template("mpl-1.1", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1", ("mozilla", "1.1")),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla", "2")),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,"
        " sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or"
        " non-commercial, and by any means.",
        ("unencumbered",),
    ),
    Template(
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any"
        " damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including"
        " commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        ("redistribute", "alter"),
    ),
]

_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
_VERSION = re.compile(r"v?([0-9]+)(?:\.0)?|v([0-9]+(?:\.[0-9]+)+)")


def words_of(text: str) -> list[str]:
    """Words in lower case; a version is spelled alike however it is written: 2.0, 2, v2 and v2.0 are "2"."""
    out = []
    for word in _WORD.findall(text.lower()):
        version = _VERSION.fullmatch(word) if word[0] in "v0123456789" else None
        out.append((version[1] or version[2]) if version else word)
    return out


def increasing(positions: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence (patience sorting)."""
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(positions)
    for i, p in enumerate(positions):
        k = bisect_left(tops, p)
        if k == len(tops):
            tops.append(p)
            last.append(i)
        else:
            tops[k], last[k] = p, i
        back[i] = last[k - 1] if k else -1
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _unique(words: list[str], lo: int, hi: int) -> dict[str, int]:
    seen: dict[str, int] = {}
    for i in range(lo, hi):
        seen[words[i]] = -1 if words[i] in seen else i
    return {w: i for w, i in seen.items() if i >= 0}


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched index pairs of two word lists, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        mine, other = _unique(a, a0, a1), _unique(b, b0, b1)
        shared = [(i, other[w]) for w, i in mine.items() if w in other]
        anchors = [shared[k] for k in increasing([j for _, j in shared])]
        if not anchors:
            continue
        out.extend(anchors)
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(x[0] + 1, y[0], x[1] + 1, y[1]) for x, y in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def grown(a: list[str], b: list[str], lo: int, hi: int, reach: int) -> list[tuple[int, int]]:
    """Matches of ``a`` in b[lo:hi] and in what lies up to ``reach`` words beyond them, for as long as
    that adds some; positions count from the start of ``b``."""

    def aligned(lo: int, hi: int, i: int = 0, k: int = len(a)) -> list[tuple[int, int]]:
        return [(i + x, lo + y) for x, y in patience(a[i:k], b[lo:hi])]

    pairs = aligned(lo, hi)
    while reach and pairs and len(pairs) < len(a):
        (i, first), (k, last) = pairs[0], pairs[-1]
        left, right = max(0, first - reach), min(len(b), last + 1 + reach)
        wider = aligned(left, first, 0, i) + pairs + aligned(last + 1, right, k + 1)
        if len(wider) == len(pairs):
            # a wider region repeats more words, which then are no anchors: each side is tried alone too
            wider = max((aligned(x, y) for x, y in ((left, last + 1), (first, right), (left, right))), key=len)
        if len(wider) <= len(pairs):
            # the template's next words may stand there without being unique in its rest
            wider = list(pairs)
            if i and a[i - 1] in b[left:first]:
                wider.insert(0, (i - 1, first - 1 - b[left:first][::-1].index(a[i - 1])))
            if k + 1 < len(a) and a[k + 1] in b[last + 1 : right]:
                wider.append((k + 1, b.index(a[k + 1], last + 1, right)))
        if len(wider) <= len(pairs):
            break
        pairs = wider
    # words that a wide region took far from the rest may stand nearer, too
    while pairs:
        first, end = pairs[0][1], pairs[-1][1] + 1
        closer = max((aligned(first + 1, end), aligned(first, end - 1)), key=len)
        if len(closer) < len(pairs):
            break
        pairs = closer
    return pairs


def _order(x: tuple) -> tuple:
    return -x[2], -x[1], x[3], x[0], x[4]


def best_of(notices: list[tuple]) -> tuple | None:
    return min(notices, key=_order, default=None)


class Scanner:
    """Finds the regions of a text that cover templates."""

    def __init__(self, templates: list[Template], share: float = SHARE):
        self.share = share
        self.templates = [(t, w) for t in templates if (w := words_of(t.text))]
        self.known = {w for _, own in self.templates for w in own} | {w for t in templates for w in (*t.needs, *t.bars)}

    def __call__(self, text: str) -> tuple | None:
        """The best of ``notices``: most words matched, then most coverage, the earlier place, the name."""
        return best_of(self.notices(text))

    def notices(self, text: str) -> list[tuple]:
        """(name, coverage, matched, first word, last word + 1) of the text's notices, in its order.

        Of regions that overlap the better one stays, and one that had to grow never takes another notice's
        words: it only replaces a smaller region of its own. What lies between is scanned again.
        """
        words = words_of(text)
        out, todo = [], [(0, len(words))]
        while todo:
            lo, hi = todo.pop()
            chosen: list[tuple] = []
            near, wide = self._regions(words[lo:hi])
            for x in sorted(near, key=_order) + sorted(wide - near, key=_order):
                first = bisect_right(chosen, x[3], key=lambda y: y[4])
                last = bisect_left(chosen, x[4], key=lambda y: y[3])
                same = last - first == 1 and chosen[first][0] == x[0] and chosen[first][2] < x[2]
                if first == last or same and x in wide and x[3] <= chosen[first][3] and chosen[first][4] <= x[4]:
                    chosen[first:last] = [x]
            chosen = [(*x[:3], lo + x[3], lo + x[4]) for x in chosen]
            out += chosen
            if chosen:
                edges = [lo, *(p for x in chosen for p in x[3:5]), hi]
                todo += [(x, y) for x, y in zip(edges[::2], edges[1::2], strict=True) if x < y]
        return sorted(out, key=lambda x: x[3])

    def _regions(self, words: list[str]) -> tuple[set[tuple], set[tuple]]:
        """First regions and grown ones that cover a template to the share; they may overlap."""
        places: dict[str, list[int]] = defaultdict(list)
        known = self.known
        for i, w in enumerate(words):
            if w in known:
                places[w].append(i)
        near, wide = set(), set()
        for template, own in self.templates:
            n = len(own)
            if not all(w in places for w in template.needs) or sum(w in places for w in own) < self.share * n:
                continue
            # more than (1 - share) of its positions, the rarest in this text
            rare = sorted(range(n), key=lambda q: (len(places[own[q]]), q))[: int((1 - self.share) * n + 1e-9) + 1]
            slack = n // 4 + 1
            # a region that covers the template has that word at most so far from its place
            shift = slack + int((1 - self.share) * n) + 1
            # starts so near to each other see the same words of a long template
            step = max(1, slack // 8)
            found_at = {(p - q) // step for q in rare for p in places[own[q]]}
            reached = -(-shift // step)
            for start in sorted({p + d for p in found_at for d in range(-reached, reached + 1)}):
                lo, hi = max(0, start * step - slack), min(len(words), start * step + n + slack + step)
                if hi <= lo:
                    continue
                for reach, out in ((0, near), (n + 2 * slack, wide)):
                    pairs = grown(own, words, lo, hi, reach)
                    if len(pairs) >= self.share * n and self._told(template, own, words, pairs):
                        out.add((template.license, len(pairs) / n, len(pairs), pairs[0][1], pairs[-1][1] + 1))
        return near, wide

    @staticmethod
    def _told(template: Template, own: list[str], words: list[str], pairs: list[tuple[int, int]]) -> bool:
        """Whether the matched words are what tells this licence from its kin."""
        matched = {own[i] for i, _ in pairs}
        region = words[pairs[0][1] : pairs[-1][1] + 1]
        return matched.issuperset(template.needs) and not any(w in region for w in template.bars)


def scan(docs: DataFrame, templates: list[Template] | None = None, share: float = SHARE) -> DataFrame:
    """doc_id, license, coverage, matched_words, start_word, end_word, notices of every row of ``docs``.

    notices are all regions that cover a template to ``share`` and don't overlap, in the text's order, each with
    the same five fields (license: the name of the template's licence, with its version); the columns before are the best of them. license is NULL, coverage 0 and notices empty
    where no template is covered so far, as for NULL and empty texts. Word offsets count the text's words (letters and digits, case ignored), the end exclusive.
    NULL doc_ids stay, repeated rows are scanned each, other columns are ignored, an empty table gives no
    rows. The templates are part of the program and go with the tasks.
    """
    chosen = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, share)
        fields = list(zip(FIELDS, [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()], strict=True))
        for batch in batches:
            found = [scanner.notices(t) if t else [] for t in batch.column(1).to_pylist()]
            columns = list(zip(*(best_of(x) or (None, 0.0, 0, None, None) for x in found), strict=True)) or [[]] * 5
            listed = [[dict(zip(FIELDS, x, strict=True)) for x in xs] for xs in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)),
                    pa.array(listed, pa.list_(pa.struct(fields))),
                ],
                ["doc_id", *FIELDS, "notices"],
            )

    each = "license string, coverage double, matched_words long, start_word long, end_word long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, f"doc_id long, {each}, notices array<struct<{each}>>"
    )
