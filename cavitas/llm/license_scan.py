"""License scans with a generalised suffix automaton of licence tokens.

A-Z are lower-cased; words are runs of 0-9, a-z and characters over U+007F.
The automaton holds all factors of the templates' word sequences. A text is
streamed through it for matching statistics - at each word the longest factor
that ends there - and its right-maximal matches of ``LEAST`` words or more are
chained, per template, into covered spans: the best chain takes matches in the order of both
texts, at most ``GAP`` words apart, for the weight of their words less ``PENALTY`` a skipped word. Words without a
meaning of their own (``LIGHT``) weigh ``LIGHT_WEIGHT``, all others 1. A chain with at least ``COVER`` of its template's
weight is a span with its label, unless it overlaps a span of more weight. Words that name a licence (``NAMES``) tell
siblings apart: a chain of a template that has such words is no span unless all of them stand in it, as does the
version that its label states; no such chain runs over a name that its template lacks, nor ends beside one of the
``VARIANTS``. The base phrases are templates too; all their places are counted.

Defined results: a null text counts as empty; without a base phrase first and
last word are null; repeated rows give repeated rows; null ids pass through;
an empty table gives no rows; other columns are not read. Score is the largest
share of a template's weight that a chain covers, whether or not its names stand there (a base phrase in place: 1). Spans count words from 0, ends
exclusive, by start; of equal chains the one that ends first is taken.
"""

from __future__ import annotations

import re
from bisect import bisect
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cavitas.llm.common import documents, map_batches, texts_of

LEAST = 3
COVER = 0.6
#: Words that a chain may skip between two matches, and what each takes off its weight.
GAP, PENALTY = 64, 0.02
#: Words that weigh little.
LIGHT = set("a an and any as at be by can for from if in is it may not of on or that the this to was were will with you".split())
LIGHT_WEIGHT = 0.25

#: Phrases whose every place counts, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices of public licences, with the method's labels.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "lgpl": [
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "licensed under the GNU Lesser General Public License",
    ],
    "agpl": [
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "licensed under the GNU Affero General Public License",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "licensed under the BSD 3-Clause License",
        "licensed under the BSD 2-Clause License",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}
TEMPLATES["mit"].append("MIT License")

#: Terms of the Creative Commons licences, with their names.
TERMS = {"nc": "NonCommercial", "sa": "ShareAlike", "nd": "NoDerivatives"}
for _terms in ((), ("nc",), ("sa",), ("nd",), ("nc", "sa"), ("nc", "nd")):
    _code = "-".join(("by", *_terms))
    TEMPLATES[f"cc-{_code}"] = [
        f"Licensed under CC {_code} 4.0.",
        f"licensed under a Creative Commons {'-'.join(('Attribution', *map(TERMS.get, _terms)))} 4.0 International License",
        f"SPDX-License-Identifier: CC-{_code}-4.0",
    ]
#: Public identifiers of licences, by label.
IDENTIFIERS = {
    "mit": ["MIT"], "apache-2.0": ["Apache-2.0"], "gpl": ["GPL-2.0-only", "GPL-3.0-only", "GPL-3.0-or-later"], "lgpl": ["LGPL-2.1-only", "LGPL-3.0-or-later"],
    "agpl": ["AGPL-3.0-only", "AGPL-3.0-or-later"], "bsd": ["BSD-2-Clause", "BSD-3-Clause"], "mpl-2.0": ["MPL-2.0"], "isc": ["ISC"], "unlicense": ["Unlicense"],
}
for _label, _ids in IDENTIFIERS.items():
    TEMPLATES[_label] += [f"SPDX-License-Identifier: {x}" for x in _ids]

#: Words that vary a licence's name, and all words that name licences.
VARIANTS = {b"nc", b"sa", b"nd", b"noncommercial", b"sharealike", b"noderivatives", b"lesser", b"affero"}
NAMES = VARIANTS | {b"mit", b"apache", b"gnu", b"gpl", b"lgpl", b"agpl", b"bsd", b"mozilla", b"mpl", b"isc", b"unlicense", b"unlicensed", b"commons", b"attribution", b"cc", b"spdx"}

_KEEP = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


class Automaton:
    """Generalised suffix automaton over word numbers; state 0 is the empty factor."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for end, word in enumerate(sequence, 1):
                last = self._extend(last, word)
                self.ends[last].add((number, end))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, like: int | None = None) -> int:
        self.next.append(dict(self.next[like]) if like is not None else {})
        self.length.append(length)
        self.link.append(self.link[like] if like is not None else 0)
        self.ends.append(set())
        return len(self.next) - 1

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, word, q)
        new, p = self._state(self.length[last] + 1), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
        return new

    def _clone(self, p: int, word: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, q)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone


class Scanner:
    def __init__(self):
        named = [(label, phrase) for phrase, label in BASE.items()] + [(label, t) for label, ts in TEMPLATES.items() for t in ts]
        self.labels = [label for label, _ in named]
        split = [words_of(t.encode()) for _, t in named]
        self.number: dict[bytes, int] = {}
        sequences = [[self.number.setdefault(w, len(self.number)) for w in s] for s in split]
        self.sizes = [len(s) for s in sequences]
        #: words that must stand in a span of each template: its names and its label's version
        self.names = [NAMES & set(s) for s in split]
        self.telling = [own | ({x.encode() for x in re.findall(r"\d+", label)[:1]} & set(s)) for own, label, s in zip(self.names, self.labels, split, strict=True)]
        #: weight of the first words of each template
        self.weights = [np.concatenate([[0], np.cumsum([LIGHT_WEIGHT if w in LIGHT else 1.0 for w in map(bytes.decode, s)])]).tolist() for s in split]
        self.n_base = len(BASE)
        self.automaton = Automaton(sequences)
        size = len(self.number)
        self.pairs = np.zeros((size + 1, size + 1), bool)  # word number -1, in no template, is the last row and column
        for s in sequences:
            self.pairs[s[:-1], s[1:]] = True

    def matches(self, words: list[bytes]):
        """(start, length, state) of each right-maximal match of two words or more, and (phrase, end) of each base phrase's place."""
        a = self.automaton
        found, places = [], []
        ids = np.fromiter(map(self.number.get, words, _MISSING), np.int32, len(words))
        joined = self.pairs[ids[:-1], ids[1:]]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], joined.view(np.int8), [0]])))
        for begin, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            state = length = 0
            for at, word in enumerate(ids[begin : stop + 1].tolist(), begin):
                if word not in a.next[state]:
                    if length >= 2:
                        found.append((at - length, length, state))
                    while state and word not in a.next[state]:
                        state = a.link[state]
                        length = a.length[state]
                state = a.next[state][word]
                length += 1
                places += self._phrases(state, length, at + 1)
            if length >= 2:
                found.append((stop + 1 - length, length, state))
        return found, places

    def _phrases(self, state: int, length: int, end: int):
        for number, at in self.automaton.ends[state]:
            if number < self.n_base and at == self.sizes[number] <= length:
                yield number, end
        # a shorter phrase that ends here has its end on the way up the suffix links
        up = self.automaton.link[state]
        while up > 0:
            for number, at in self.automaton.ends[up]:
                if number < self.n_base and at == self.sizes[number] <= self.automaton.length[up] and (number, at) not in self.automaton.ends[state]:
                    yield number, end
            up = -1 if self.automaton.length[up] < 2 else self.automaton.link[up]

    def chains(self, found, words: list[bytes]) -> list[tuple[int, int, int, float, bool]]:
        """(template, start, end, share of its weight, whether its telling words stand there) of the best chains of each template, which do not overlap."""
        placed: dict[int, list[tuple[int, int, int]]] = {}
        for start, length, state in found:
            stop, seen = start + length, set()
            while length >= 2:  # templates that have but the last words of the match are further up the suffix links
                for number, end in self.automaton.ends[state] - seen:
                    if number >= self.n_base and length >= min(LEAST, self.sizes[number]):
                        placed.setdefault(number, []).append((stop - length, stop, end))
                seen |= self.automaton.ends[state]
                state = self.automaton.link[state]
                length = self.automaton.length[state]
        named = [at for at, word in enumerate(words) if word in NAMES] if placed else []
        out = []
        for number, matches in placed.items():
            weight, own = self.weights[number], self.names[number]
            best = []
            for part in _between(matches, [at for at in named if words[at] not in own] if own else []):
                best += best_chains(part, weight)
            taken: list[tuple[int, int]] = []
            told = [(self._told(number, start, end, words), value, start, end, covered) for value, start, end, covered in best]
            for tells, _, start, end, covered in sorted(told, key=lambda c: (not c[0], -c[1], c[3])):
                if _take(taken, start, end):
                    out.append((number, start, end, min(1.0, covered / weight[-1]), tells))
        return out

    def _told(self, number: int, start: int, end: int, words: list[bytes]) -> bool:
        beside = {*words[max(0, start - 1) : start], *words[end : end + 1]} & VARIANTS if self.names[number] else ()
        return not beside and self.telling[number] <= set(words[start:end])

    def spans(self, found, words: list[bytes]) -> tuple[list[tuple[str, int, int, float]], float]:
        """(label, start, end, share) of covered template spans, and the largest share of any chain."""
        chains = self.chains(found, words)
        kept: list[tuple[str, int, int, float]] = []
        full = [c for c in chains if c[4] and c[3] >= COVER]
        taken: list[tuple[int, int]] = []
        for number, start, end, share, _ in sorted(full, key=lambda c: (-c[3] * self.weights[c[0]][-1], c[1:])):
            if _take(taken, start, end):
                kept.append((self.labels[number], start, end, share))
        return sorted(kept, key=lambda k: k[1:]), max((c[3] for c in chains), default=0.0)

    def scan(self, text: bytes) -> tuple:
        words = words_of(text)
        if len(words) < 2:
            return len(words), 0, None, None, "", "", 0.0, []
        found, places = self.matches(words)
        starts = [end - self.sizes[number] for number, end in places]
        base = {self.labels[number] for number, _ in places}
        spans, share = self.spans(found, words)
        labels = base | {label for label, *_ in spans}
        return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if places else share, spans


def _between(matches: list[tuple[int, int, int]], bars: list[int]) -> list[list[tuple[int, int, int]]]:
    """Matches by the bars that they lie between; none holds one."""
    parts: dict[int, list[tuple[int, int, int]]] = {}
    for match in matches:
        parts.setdefault(bisect(bars, match[0]), []).append(match)
    return list(parts.values())


def _take(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Adds a span to the sorted ``taken`` if it overlaps none of them."""
    at = bisect(taken, (start, end))
    if at and taken[at - 1][1] > start or at < len(taken) and taken[at][0] < end:
        return False
    taken.insert(at, (start, end))
    return True


def best_chains(matches: list[tuple[int, int, int]], weight: list[float]) -> list[tuple[float, int, int, float]]:
    """(value, start, end, weight covered) of the best chain that ends with each match (start, end, end in the template)."""
    matches = sorted(matches, key=lambda m: (m[1], m[2], m[0]))
    out: list[tuple[float, int, int, float]] = []
    for k, (start, end, to) in enumerate(matches):
        full = weight[to] - weight[to - (end - start)]
        best = (full, start, end, full)
        for j in range(k - 1, -1, -1):
            _, at, before = matches[j]
            if start - at > GAP:  # those before end earlier still
                break
            begin = max(start, at)  # what both have counts once
            skip = max(0, before - (to - (end - begin)))
            if at >= end or before >= to or begin + skip >= end or to - (end - begin) - before > GAP:
                continue
            own = weight[to] - weight[to - (end - begin) + skip]
            value = out[j][0] + own - PENALTY * (begin + skip - at)
            if value > best[0]:
                best = (value, out[j][1], end, out[j][3] + own)
        out.append(best)
    return out


class _Forever:
    def __iter__(self):
        return self

    def __next__(self):
        return -1


_MISSING = _Forever()


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,share:double>>"
_NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())])
_TYPES = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(_SPAN)]


def _make():
    found = scanner()

    def step(batch: pa.RecordBatch):
        columns = list(zip(*map(found.scan, texts_of(batch["text"])), strict=True)) or [[]] * 8
        columns[7:] = [[[dict(zip(("label", "start", "end", "share"), x, strict=True)) for x in row] for row in columns[7]]]
        arrays = [batch["doc_id"], *(pa.array(list(c), t) for c, t in zip(columns, _TYPES, strict=True))]
        yield pa.RecordBatch.from_arrays(arrays, _NAMES)

    return step


def scan(docs: DataFrame) -> DataFrame:
    """Counts, places, labels, score and covered spans of each document."""
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _make, _SCHEMA)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"].cast("string"), s["end"].cast("string"))), ","))
