"""Licence scans: matching statistics against a generalised suffix automaton of licence texts, chained into spans.

The automaton is built over the words of all templates. A text is streamed through it once; at each word it
gives the longest stretch that ends there and stands in some template, and along its suffix links the longest
for every other place of the templates. Stretches of three words or more that can't go on to the right are
chained per template, in the order of text and template, over gaps of a few words. A chain that covers most of
its template is a span. A span inside one that covers more words goes: licences share most of their wording.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultsift.llm.common import with_arrow

#: Fewest words of a stretch that chains are made of.
LEAST_MATCH = 3
#: Most words of the text between two stretches of a chain.
GAP = 8
#: Share of a template's words that a span covers.
COVER = 0.8

# Labels and phrases that are counted wherever they stand.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))

# Notices and main clauses of public licences.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        """you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed
        under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
        implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        shall be included in all copies or substantial portions of the Software.""",
    ),
    (
        "bsd-2-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    ),
    (
        "bsd-3-clause",
        """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
        from this software without specific prior written permission.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies.""",
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions""",
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means.""",
    ),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    (
        "gpl-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    ),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    (
        "gpl-2.0",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    ),
    (
        "lgpl-2.1",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
        as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    ),
    (
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
        this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("reserved", "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher"),
)
_WORD = bytes(ord("a") + c - ord("A") if chr(c).isupper() else c if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))


def words(text: str) -> list[bytes]:
    """Words in UTF-8: letters and digits of ASCII, lower-cased, and all other characters."""
    return text.encode().translate(_WORD).split()


class Automaton:
    """The generalised suffix automaton of sequences of numbers, and where its stretches stand in them."""

    def __init__(self, sequences: list[list[int]]):
        self.sequences = sequences
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, set[tuple[int, int]]] = {}
        for s in sequences:
            last = 0
            for c in s:
                last = self._extend(last, c)
        for t, s in enumerate(sequences):
            at = 0
            for e, c in enumerate(s):
                at = self.next[at][c]
                up = at
                while up > 0:
                    ends.setdefault(up, set()).add((t, e))
                    up = self.link[up]
        self.ends = ends
        self.known: dict[int, list[tuple[int, int, int]]] = {}

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of p's longest stretch and c, which may have to part from a longer one's."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        part = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = part
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = part
            p = self.link[p]
        return part

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def places(self, state: int) -> list[tuple[int, int, int]]:
        """Sequence, end and the longest stretch there of all places that share an end with a state's stretch.

        A length of 0 stands for the whole stretch that led to the state.
        """
        if state not in self.known:
            own = self.ends[state]
            up = self.link[state]
            more = [(t, e, n or self.length[up]) for t, e, n in self.places(up) if (t, e) not in own] if up > 0 else []
            self.known[state] = [(t, e, 0) for t, e in sorted(own)] + more
        return self.known[state]

    def statistics(self, seq: list[int]) -> Iterator[tuple[int, int, int]]:
        """Position, state and length of the longest stretch that ends there, where it has two numbers or more."""
        move, link, length = self.next, self.link, self.length
        v = n = 0
        for i, c in enumerate(seq):
            while v and c not in move[v]:
                v = link[v]
                n = length[v]
            to = move[v].get(c)
            if to is None:
                n = 0
                continue
            v, n = to, n + 1
            if n > 1:
                yield i, v, n


class Scanner:
    """Templates and base phrases as one automaton."""

    def __init__(self, templates: tuple[tuple[str, str], ...], base: tuple[tuple[str, str], ...]):
        self.labels = [label for label, _ in (*templates, *base)]
        texts = [words(text) for _, text in (*templates, *base)]
        self.n_templates = len(templates)
        self.vocabulary: dict[bytes, int] = {}
        sequences = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in t] for t in texts]
        self.auto = Automaton(sequences)

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Number of words; base phrases found as (phrase, start); spans as (template, first, last, covered words)."""
        found = words(text)
        get = self.vocabulary.get
        ids = np.array([0, *(get(w, 0) for w in found), 0])
        edges = np.flatnonzero((ids[1:] > 0) != (ids[:-1] > 0)).reshape(-1, 2)  # runs of known words
        base, matches = [], []
        for start, end in edges[edges[:, 1] - edges[:, 0] > 1].tolist():
            run = ids[start + 1 : end + 1].tolist()
            for i, state, n in self.auto.statistics(run):
                after = run[i + 1] if i + 1 < len(run) else 0
                for t, e, shorter in self.auto.places(state):
                    size, seq = shorter or n, self.auto.sequences[t]
                    if t >= self.n_templates:
                        if e + 1 == len(seq) and size == len(seq):
                            base.append((t - self.n_templates, start + i + 1 - size))
                    elif size >= LEAST_MATCH and (e + 1 == len(seq) or seq[e + 1] != after):
                        matches.append((t, start + i, e, size))
        return len(found), base, self._spans(matches)

    def _spans(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Chains of matches (template, last word, its place in the template, length) that cover a template."""
        ends: dict[tuple[int, int], tuple[int, int]] = {}
        recent: dict[int, list[tuple[int, int, int, int]]] = {}
        for t, at, e, n in sorted(matches, key=lambda m: (m[1], m[0], m[2])):
            first = at - n + 1
            before = recent.setdefault(t, [])
            best = (n, first)
            for at_, e_, covered, start in reversed(before):
                if first - at_ > GAP + 1:
                    break  # matches stand by their last word
                if e_ < e and at_ < at:
                    best = max(best, (covered + min(n, e - e_, at - at_), start))
            before.append((at, e, *best))
            if best[0] >= COVER * len(self.auto.sequences[t]):
                ends[t, best[1]] = max(ends.get((t, best[1]), (0, 0)), (best[0], -at))
        spans = sorted((start, at, -covered, t) for (t, start), (covered, at) in ends.items())  # at: the last word, negative
        kept, open_ = [], []
        for start, neg, less, t in spans:
            covered = -less
            open_ = [o for o in open_ if o[0] >= start]
            if not any(last >= -neg and more > covered for last, more in open_):
                kept.append((t, start, -neg, covered))
            open_.append((-neg, covered))
        return kept


@functools.lru_cache(maxsize=4)
def scanner(templates: tuple[tuple[str, str], ...], base: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(templates, base)


_FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label string, first long, last long, covered double>>"


def scan(df: DataFrame, text: str = "text", templates=TEMPLATES, base=BASE, keep: list[str] | None = None) -> DataFrame:
    """df (or its columns in keep) with the licences of each text.

    n_base, first_word, last_word: places of base phrases, their least and largest word (null if none). labels:
    base labels and those of spans, different ones in order, joined by commas. score: the largest covered share of a
    span, 1 with a base phrase, else 0. spans: label, first and last word, covered share; by their first word.
    A null text is an empty one: no words, empty labels. Repeated rows pass through; columns named like an output are replaced.
    """
    added = T.StructType.fromDDL(_FIELDS).fields
    templates, base = tuple(templates), tuple(base)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        tool, rows = scanner(templates, base), []
        for value in batch.column(text).to_pylist():
            n, places, spans = tool.scan(value or "")
            starts = [at for _, at in places]
            named = {base[p][0] for p, _ in places}
            found = [{"label": tool.labels[t], "first": a, "last": b, "covered": k / len(tool.auto.sequences[t])} for t, a, b, k in spans]
            score = max([1.0] * bool(places) + [s["covered"] for s in found], default=0.0)
            labels = named | {s["label"] for s in found}
            rows.append((n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(named)), ",".join(sorted(labels)), min(score, 1.0), found))
        spans_type = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.float64())]))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), spans_type]
        return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]

    return with_arrow(df, [text], added, compute, keep)


def flat_spans(scanned: DataFrame, *keys: str) -> DataFrame:
    """One row for each span of scanned texts."""
    return scanned.select(*keys, F.inline("spans"))
