"""License scans with a generalised suffix automaton of licence tokens.

All templates, and the base phrases as templates of their own, go into one automaton over words.
A text is streamed through it word by word, which gives its matching statistics: at each word,
the longest string of template words that ends there. Maximal matches of at least MIN_MATCH words
are placed in each template that holds them and chained where they follow one another in text and
template with small gaps; a chain that covers enough of a template is a span of its licence.
A base phrase is found where the statistics reach its whole length.

Only words of some template can lengthen a match, and a match of two words needs two neighbours
of some template. Words elsewhere have a statistic of at most 1, below every use of it, so the
stream visits just the runs of such neighbours; this leaves all longer statistics as they are.

Defined results: a null text counts as empty and has no words, labels or places; an empty table
gives an empty result; repeated rows are each reported; a very long text is streamed whole, in time that grows with its
words; labels that hold at one place are all told (ties), each once and sorted; other columns are left aside.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexiloom.llm.vectext import SLICE_BYTES, slices, utf8

# The phrases of the base labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices as their licences word them, by label.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "has waived all copyright and related or neighboring rights to this work CC0 1.0 Universal"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]

#: Words a match needs to enter a chain, words a chain may skip in text or template, and the share
#: of a template's words that a chain must cover.
MIN_MATCH, MAX_GAP, MIN_COVER = 4, 12, 0.8

_FOLD = bytes(
    32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b
    for b in range(256)
)
#: Parts the texts of a batch; it can't be a word.
_PART = b"!"


def split_words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and bytes over 0x7F of the text with A-Z lower-cased."""
    return text.translate(_FOLD).split()


class SuffixAutomaton:
    """Generalised suffix automaton of several word-id strings, with the places of its states."""

    def __init__(self, strings: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[list[tuple[int, int]]] = [[]]
        self.ends_of: list[int] = []
        for number, string in enumerate(strings):
            last = 0
            for at, word in enumerate(string):
                last = self._extend(last, word, own)
                own[last].append((number, at))
            self.ends_of.append(last)
        order = sorted(range(len(self.length)), key=self.length.__getitem__, reverse=True)
        places = [set(x) for x in own]
        for state in order[:-1]:
            places[self.link[state]] |= places[state]
        #: (string, end position) of every occurrence of a state's words.
        self.places = [sorted(x) for x in places]

    def _clone(self, p: int, q: int, word: int, own: list) -> int:
        clone = len(self.length)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        own.append([])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, word: int, own: list) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, word, own)
        state = len(self.length)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        own.append([])
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, word, own)
        return state

    def stream(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) after each word: the matching statistics by end."""
        state, length = 0, 0
        for word in ids:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            else:
                state, length = 0, 0
            yield state, length


class Scanner:
    """The automaton of templates and base phrases, and the chaining of its matches."""

    def __init__(self, templates=TEMPLATES, phrases=BASE_PHRASES, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER):
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        self.labels = [label for label, _ in templates]
        texts = [split_words(text.encode()) for _, text in templates]
        self.sizes = [len(x) for x in texts]
        self.least = min([min_match, *self.sizes])
        base = [(split_words(phrase.encode()), label) for phrase, label in phrases.items()]
        self.n_templates = len(texts)
        strings = texts + [words for words, _ in base]
        self.vocabulary: dict[bytes, int] = {_PART: 1}
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in x] for x in strings]
        self.automaton = SuffixAutomaton(coded)
        size = len(self.vocabulary) + 2
        self.pairs = np.zeros((size, size), bool)
        for x in coded:
            self.pairs[x[:-1], x[1:]] = True
        self.alone = np.zeros(size, bool)
        self.alone[[x[0] for x in coded if len(x) == 1]] = True
        # phrases that end at a state, by the suffix links above their own states
        own = {self.automaton.ends_of[self.n_templates + k]: (len(words), label) for k, (words, label) in enumerate(base)}
        self.phrase_ends: list[tuple[tuple[int, str], ...]] = []
        for state in range(len(self.automaton.length)):
            found, s = [], state
            while s > 0:
                if s in own:
                    found.append(own[s])
                s = self.automaton.link[s]
            self.phrase_ends.append(tuple(found))

    def runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of words whose neighbours are neighbours in some template, and single words that are one."""
        near = self.pairs[ids[:-1], ids[1:]]
        edge = np.diff(np.concatenate([[0], near.view(np.int8), [0]]))
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        single = np.flatnonzero(self.alone[ids])
        if len(single):
            inside = np.searchsorted(stop, single, side="right")
            covered = (inside < len(start)) & (np.append(start, len(ids))[inside] <= single)
            single = single[~covered]
            start, stop = np.concatenate([start, single]), np.concatenate([stop, single + 1])
            order = np.argsort(start)
            start, stop = start[order], stop[order]
        return list(zip(start.tolist(), stop.tolist(), strict=True))

    def scan(self, runs: list[tuple[int, int, list[int]]]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, float]], float]:
        """Base places (start, end, label), template spans (start, end, label, share covered), best share."""
        base, matches = [], defaultdict(list)
        for start, _, ids in runs:
            before = (0, 0, 0)
            for at, (state, length) in enumerate(self.automaton.stream(ids), start):
                base += [(at - n + 1, at + 1, label) for n, label in self.phrase_ends[state] if n <= length]
                if length <= before[1]:
                    self._place(matches, before)
                before = (state, length, at)
            self._place(matches, before)
        spans, best = [], 1.0 if base else 0.0
        for number, found in matches.items():
            for start, end, covered in self._chains(sorted(found)):
                share = covered / self.sizes[number]
                best = max(best, share)
                if share >= self.min_cover:
                    spans.append((start, end, self.labels[number], share))
        return base, sorted(spans), min(best, 1.0)

    def _place(self, matches: dict, match: tuple[int, int, int]) -> None:
        state, length, at = match
        if length >= self.least:
            for number, end in self.automaton.places[state]:
                if number < self.n_templates and length >= min(self.min_match, self.sizes[number]):
                    matches[number].append((at - length + 1, end - length + 1, length))

    def _chains(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Best chain to each match: it follows an earlier one in text and template within the gap.

        Chains that end further back than the gap are out of reach of all later matches, so few are looked at.
        """
        chains: list[tuple[int, int, int, int]] = []  # text start, text end, template end, covered
        near: list[tuple[int, int, int, int]] = []
        for at, place, length in found:
            best = (at, at + length, place + length, length)
            near = [c for c in near if c[1] >= at - self.max_gap]
            for start, end, template_end, covered in reversed(near):
                cut = max(end - at, template_end - place, 0)
                if cut < length and at + cut - end <= self.max_gap and place + cut - template_end <= self.max_gap and covered + length - cut > best[3]:
                    best = (start, at + length, place + length, covered + length - cut)
            chains.append(best)
            near.append(best)
        tops: list[tuple[int, int, int]] = []  # apart from one another, by their starts
        for start, end, _, covered in sorted(chains, key=lambda c: (-c[3], c[0])):
            k = bisect.bisect(tops, (start, end, covered))
            if (k == 0 or tops[k - 1][1] <= start) and (k == len(tops) or end <= tops[k][0]):
                tops.insert(k, (start, end, covered))
        return tops


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=BASE_PHRASES) -> DataFrame:
    """One row per text.

    id, n_words, n_base (all places of base phrases), first_word and last_word (their smallest and
    largest start; null without any), base_labels and labels (distinct, sorted, comma-joined; the
    second with the labels of covered templates), score (best share of a template or phrase that
    one chain covers), spans (array of structs first_word, end_word, label, share).
    One map over the rows: no shuffle, and memory for the texts of one Arrow batch.
    """
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    span = pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("label", pa.string()), ("share", pa.float64())])
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(span)]

    def run(batches):
        scanner = Scanner(templates, phrases)
        number = scanner.vocabulary.get
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            data = raw.tobytes()
            for lo, hi in slices(offsets, 2 * SLICE_BYTES):
                texts = [data[offsets[i] : offsets[i + 1]].translate(_FOLD) for i in range(lo, hi)]
                words = (b" " + _PART + b" ").join(texts).split()
                ids = np.fromiter((number(w, 0) for w in words), np.int32, len(words))
                cuts = np.flatnonzero(ids == 1)
                first = np.concatenate([[0], cuts + 1])
                sizes = np.concatenate([cuts, [len(ids)]]) - first
                by_text = defaultdict(list)
                for a, b in scanner.runs(ids):
                    k = int(np.searchsorted(first, a, side="right")) - 1
                    at = int(a - first[k])
                    by_text[k].append((at, at + b - a, ids[a:b].tolist()))
                rows = []
                for k in range(hi - lo):
                    base, spans, score = scanner.scan(by_text[k]) if k in by_text else ([], [], 0.0)
                    own = {x[2] for x in base}
                    rows.append((
                        int(sizes[k]), len(base), min((x[0] for x in base), default=None), max((x[0] for x in base), default=None),
                        ",".join(sorted(own)), ",".join(sorted(own | {x[2] for x in spans})), score,
                        [{"first_word": a, "end_word": b, "label": label, "share": share} for a, b, label, share in spans],
                    ))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))],
                    names=[id_col, *names],
                )

    return docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias(text_col)).mapInArrow(
        run,
        f"{id_col} long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<first_word:bigint,end_word:bigint,label:string,share:double>>",
    )
