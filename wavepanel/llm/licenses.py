"""License scans by patience alignment.

A template is aligned with a stretch of a text's words: words that occur once
in both are anchors; the longest increasing subsequence of their places keeps
the order; the gaps between kept anchors are aligned in the same way, and equal
words at a gap's ends are matched. A gap whose common words all repeat has no
anchors; its longest common subsequence is taken. Coverage is the share of the
template's words that are matched. The words that name a licence, its version
and its kind have to be among them, so another licence's notice isn't one of it.

A text is looked at if it has enough of a template's words at all, counted as
often as the template has them. Then, from every word of the template, the
longest common subsequence with the template is counted along a stretch of twice
its length. Both tests are necessary for the coverage asked for, so nothing is
lost by them. Of the stretches that pass, the one that differs least from the
template (words on either side that are not matched) is an occurrence: notices
side by side, changed or not, are one each.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame

from wavepanel.llm.common import bound_arrow_batches, text_or_empty

MIN_COVERAGE = 0.8
#: Stretch of text that a template may take up, in times its own words.
STRETCH = 2
#: Wordings of public license notices. A sentence that two licences share names both; their bodies tell them apart.
MIT_GRANT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
             "documentation files (the \"Software\"), to deal in the Software without restriction")
MIT_RIGHTS = (", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
              "copies of the Software, and to permit persons to whom the Software is furnished to do so")
MIT_CONDITION = (", subject to the following conditions: The above copyright notice and this permission notice shall be included "
                 "in all copies or substantial portions of the Software.")
MIT_WARRANTY = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
                "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.")
BSD_GRANT = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided "
             "that the following conditions are met")
BSD_CLAUSES = (": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
               "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
               "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.")
BSD_ENDORSEMENT = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                   "products derived from this software without specific prior written permission.")
TEMPLATES = (
    ("MIT", f"{MIT_GRANT}{MIT_RIGHTS}{MIT_CONDITION} {MIT_WARRANTY}"),
    ("MIT-0", f"{MIT_GRANT}{MIT_RIGHTS}. {MIT_WARRANTY}"),
    ("BSD-2-Clause", f"{BSD_GRANT}{BSD_CLAUSES}"),
    ("BSD-3-Clause", f"{BSD_GRANT}{BSD_CLAUSES} {BSD_ENDORSEMENT}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT OR MIT-0", MIT_GRANT),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-2-Clause OR BSD-3-Clause", BSD_GRANT),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
CC_KINDS = {"BY": "Attribution", "BY-NC": "Attribution-NonCommercial", "BY-SA": "Attribution-ShareAlike",
            "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
            "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
#: Notices whose words are almost those of one of the above.
NEIGHBOURS = (
    ("EPL-2.0", "Licensed under the Eclipse Public License, Version 2.0."),
    ("MIT-0", "Released under the MIT No Attribution License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
                "option) any later version."),
    *((name, f"This work is licensed under the GNU {kind} General Public License, version {version}.")
      for name, kind, version in (("LGPL-2.1", "Lesser", "2.1"), ("LGPL-3.0", "Lesser", "3"), ("AGPL-3.0", "Affero", "3"))),
    *((name, f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} "
             f"General Public License as published by the Free Software Foundation, either version {version} of the License, "
             "or (at your option) any later version.")
      for name, kind, version in (("LGPL-2.1", "Lesser", "2.1"), ("LGPL-3.0", "Lesser", "3"), ("AGPL-3.0", "Affero", "3"))),
    *((f"CC-{kind}-{version}", f"Licensed under CC {kind} {version}.") for kind in CC_KINDS for version in CC_VERSIONS),
    *((f"CC-{kind}-{version}", f"This work is licensed under a Creative Commons {words} {version} {scope} License.")
      for kind, words in CC_KINDS.items() for version, scope in CC_VERSIONS.items()),
    *((f"MPL-{version}", f"This Source Code Form is subject to the terms of the Mozilla Public License, v. {version}.")
      for version in ("1.0", "1.1")),
)
#: Words of a licence's templates that have to be matched, beside the coverage. Versions are left to the neighbours
#: where all published ones are listed, so that a notice with its version changed is still found.
NAMING = {
    "Apache-2.0": ("apache", "2"), "MIT": ("mit", "substantial"), "MIT-0": ("mit", "attribution"), "BSD-3-Clause": ("endorse",), "EPL-2.0": ("eclipse", "2"),
    "MPL-1.0": ("mozilla",), "MPL-1.1": ("mozilla",), "MPL-2.0": ("mozilla",),
    "GPL-2.0": ("gnu", "2"), "GPL-3.0": ("gnu", "3"), "LGPL-2.1": ("gnu", "lesser", "2", "1"),
    "LGPL-3.0": ("gnu", "lesser", "3"), "AGPL-3.0": ("gnu", "affero", "3"),
    **{f"CC-{kind}-{version}": ("cc", "by", "nc", "sa", "nd", "creative", "commons", "noncommercial", "sharealike",
                                "noderivatives") for kind in CC_KINDS for version in CC_VERSIONS},
}
WORD = re.compile(r"[0-9A-Za-z_]+")
#: ASCII other than letters, digits and the underscore separates words; so does what is not ASCII.
SEPARATORS = bytes(c if chr(c).isalnum() and c < 0x80 or c == 0x5F else 0x20 for c in range(256))


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def _increasing(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience piles."""
    tops: list[int] = []
    top_index: list[int] = []
    back: list[int] = []
    for i, place in enumerate(places):
        pile = bisect_left(tops, place)
        if pile == len(tops):
            tops.append(place)
            top_index.append(i)
        else:
            tops[pile], top_index[pile] = place, i
        back.append(top_index[pile - 1] if pile else -1)
    out, i = [], top_index[-1] if top_index else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def common_lengths(a: list[str], masks: dict[str, int], n: int) -> list[int]:
    """Length of the longest common subsequence of each prefix of ``a`` with a
    template of ``n`` words, of which ``masks`` has the places of every word as
    bits: a zero bit of ``row`` is a place where the length grows."""
    whole = (1 << n) - 1
    row, out, length = whole, [], 0
    for w in a:
        here = row & masks.get(w, 0)
        if here:
            row = ((row + here) | (row - here)) & whole
            length = n - row.bit_count()
        out.append(length)
    return out


def _subsequence(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places (in ``a``, in ``b``) of matched words, increasing in both."""
    matched: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and in_a[w] == 1}
        once = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if w in place]
        anchors = [once[i] for i in _increasing([j for _, j in once])]
        if not anchors:
            if in_a.keys() & in_b.keys():
                matched += [(a0 + i, b0 + j) for i, j in _subsequence(a[a0:a1], b[b0:b1])]
            continue
        matched += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        gaps += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:])]
    return sorted(matched)


class Spans:
    """Spans that do not overlap, in order."""

    def __init__(self) -> None:
        self.firsts: list[int] = []
        self.lasts: list[int] = []

    def free(self, first: int, last: int) -> bool:
        i = bisect_left(self.lasts, first)
        return i == len(self.firsts) or self.firsts[i] > last

    def add(self, first: int, last: int) -> bool:
        """Whether the span overlaps none of the earlier ones; it then is one of them."""
        if not self.free(first, last):
            return False
        i = bisect_left(self.lasts, first)
        self.firsts.insert(i, first)
        self.lasts.insert(i, last)
        return True


class Scanner:
    """Templates made ready, and the search in one text."""

    def __init__(self, templates: tuple[tuple[str, str], ...], min_coverage: float,
                 naming: dict[str, tuple[str, ...]] = NAMING):
        self.templates = [(name, words) for name, text in templates if (words := words_of(text))]
        self.counts = [Counter(words) for _, words in self.templates]
        self.least = [ceil(min_coverage * len(words) - 1e-9) for _, words in self.templates]
        self.named = [{i for i, w in enumerate(words) if w in naming.get(name, ())} for name, words in self.templates]
        self.naming = [{words[i] for i in named} for (_, words), named in zip(self.templates, self.named)]
        self.masks = [{w: sum(1 << i for i, x in enumerate(words) if x == w) for w in c}
                      for (_, words), c in zip(self.templates, self.counts)]
        self.known = {w.encode() for c in self.counts for w in c}

    def candidates(self, raw: list[bytes]) -> list[int]:
        """Templates of which the text has enough words."""
        have = self.known.intersection(raw)
        if not have:
            return []
        words = {w.decode() for w in have}
        return [k for k, c in enumerate(self.counts) if sum(n for w, n in c.items() if w in words) >= self.least[k]]

    def stretches(self, words: list[str], k: int, first: int) -> list[tuple[int, int]]:
        """(words that at least differ, length) of the stretches from ``first`` on
        with the naming words and a long enough common subsequence, those that
        differ least first."""
        n, counts, least = len(self.templates[k][1]), self.counts[k], self.least[k]
        stretch = words[first:first + STRETCH * n]
        if not self.naming[k].issubset(stretch):
            return []
        named = max((stretch.index(w) for w in self.naming[k]), default=-1)
        return sorted((n + end - 2 * c, end) for end, c in enumerate(common_lengths(stretch, self.masks[k], n), 1)
                      if c >= least and end > named and stretch[end - 1] in counts)

    def starts(self, words: list[str], k: int) -> Iterator[int]:
        """Places after which a stretch has enough of the template's words."""
        counts, least = self.counts[k], self.least[k]
        places = [i for i, w in enumerate(words) if w in counts]
        length, inside, have, j = STRETCH * len(self.templates[k][1]), Counter(), 0, 0
        for first in places:
            while j < len(places) and places[j] < first + length:
                w = words[places[j]]
                inside[w] += 1
                have += inside[w] <= counts[w]
                j += 1
            if have >= least:
                yield first
            w = words[first]
            have -= inside[w] <= counts[w]
            inside[w] -= 1

    def occurrences(self, words: list[str], k: int) -> list[tuple[int, int, int]]:
        """(first word, last word, matched words) of the template's occurrences,
        which do not overlap: of those that do, the one that differs least
        stands, the first one of equals. Stretches wait in the order of what they
        differ by at least, and are aligned only when their turn comes."""
        template, named = self.templates[k][1], self.named[k]
        waiting: list[tuple[int, int, int, tuple[int, int, int] | None]] = []

        def wait(first: int, rank: int) -> None:
            ends = self.stretches(words, k, first)
            if rank < len(ends):
                heappush(waiting, (ends[rank][0], first, rank, None))

        for first in self.starts(words, k):
            wait(first, 0)
        taken, out = Spans(), []
        while waiting:
            _, first, rank, aligned = heappop(waiting)
            if aligned:
                if taken.add(*aligned[:2]):
                    out.append(aligned)
            elif taken.free(first, first):
                end = self.stretches(words, k, first)[rank][1]
                if taken.free(first, first + end - 1):
                    pairs = align(words[first:first + end], template)
                    if len(pairs) >= self.least[k] and named.issubset(i for _, i in pairs):
                        heappush(waiting, (len(template) + end - 2 * len(pairs), first, rank,
                                           (first + pairs[0][0], first + pairs[-1][0], len(pairs))))
                wait(first, rank + 1)
        return sorted(out)

    def scan(self, text: str) -> list[tuple[str, int, int, int, float]]:
        """(license, start, end, matched words, coverage); where occurrences of
        several templates overlap, the one with most matched words stands."""
        raw = text.lower().encode().translate(SEPARATORS).split()
        chosen = self.candidates(raw)
        if not chosen:
            return []
        spans = [(m.start(), m.end()) for m in WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in spans]
        found = [(-n, -n / len(self.templates[k][1]), first, last, k) for k in chosen
                 for first, last, n in self.occurrences(words, k)]
        taken, out = Spans(), []
        for n, coverage, first, last, k in sorted(found):
            if taken.add(first, last):
                out.append((self.templates[k][0], spans[first][0], spans[last][1], -n, round(-coverage, 6)))
        return sorted(out, key=lambda x: x[1])


def scan_licenses(df: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES + NEIGHBOURS,
                  min_coverage: float = MIN_COVERAGE, id_col: str = "doc_id", text: str = "text",
                  naming: dict[str, tuple[str, ...]] = NAMING) -> DataFrame:
    """One row per occurrence of a license notice: id, ``license``, ``start``,
    ``end`` (code points), ``n_words`` matched, ``coverage`` of the template. Of a
    license's templates the words that ``naming`` has for it are always matched.
    Null and empty texts have none, an empty table gives no rows; repeated rows
    are each scanned; ids may be null. Very long texts are scanned whole. Where
    templates overlap, the one with most matched words stands, of equals the one
    with the higher coverage, then the first in the text, then the first listed."""
    bound_arrow_batches(df.sparkSession)
    slim = df.select(df[id_col].alias("_id"), text_or_empty(df, text).alias("_text"))
    id_type = slim.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, min_coverage, naming)
        for batch in batches:
            row, out = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                found = scanner.scan(t)
                row += [i] * len(found)
                out += found
            columns = [pa.array([x[c] for x in out], kind) for c, kind in
                       enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *columns],
                                             names=[id_col, "license", "start", "end", "n_words", "coverage"])

    return slim.mapInArrow(run, f"`{id_col}` {id_type}, license string, start long, end long, n_words long, coverage double")
