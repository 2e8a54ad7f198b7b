"""Licence texts by matching statistics against a generalised suffix automaton of their words.

One automaton holds every run of words of all templates. A text is streamed through it once: after each word, the state
is the longest run of words up to there that some template holds. Where that run cannot go on, it is a match, at all
the places at which the templates have it. Matches of one template that follow each other in text and template are
chained, and a chain that covers enough of the template is a span. Short phrases are templates too; every place of
theirs is reported.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import shared_object, text_blocks

# The phrases of the contract and their labels.
PHRASES = (
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
)

# Public licence notices and passages of licence texts, whose wording is theirs.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
            "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
            "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
                 "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may "
               "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
               "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
               "See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
            "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that "
            "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
            "GNU General Public License for more details."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
             "by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in "
            "binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
            "materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
            "copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
            "You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
                  "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("reserved", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means"),
)

KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PIECE = 4_000_000


class Span(NamedTuple):
    """A template covered by a text: words [start, end), of which `covered` stand in the template."""

    template: int
    start: int
    end: int
    covered: int


def words_of(data: bytes) -> list[bytes]:
    """Runs of a-z (A-Z in lower case), digits and characters beyond ASCII."""
    return data.translate(KEEP).split()


def pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, of about `PIECE` bytes at a time."""
    lo = 0
    while lo < len(data):
        cut = re.compile(rb"[\x00-\x2F]").search(data, lo + PIECE) if len(data) - lo > PIECE else None
        hi = cut.end() if cut else len(data)
        yield words_of(data[lo:hi])
        lo = hi


class Automaton:
    """Generalised suffix automaton of word sequences, and the places at which its states end."""

    def __init__(self, sequences: Sequence[Sequence[bytes]]):
        self.sequences = [tuple(s) for s in sequences]
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.size = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for nth, sequence in enumerate(self.sequences):
            state = 0
            for place, word in enumerate(sequence):
                state = self._extended(state, word, ends)
                ends[state].append((nth, place + 1))
        self._places(ends)

    def _state(self, size: int, edges: dict[bytes, int], ends: list) -> int:
        self.next.append(edges)
        self.size.append(size)
        self.link.append(0)
        ends.append([])
        return len(self.next) - 1

    def _split(self, below: int, word: bytes, ends: list) -> int:
        """The state of the run that is one word longer than `below`, cut out of a state of longer runs if need be."""
        there = self.next[below][word]
        if self.size[there] == self.size[below] + 1:
            return there
        part = self._state(self.size[below] + 1, dict(self.next[there]), ends)
        self.link[part] = self.link[there]
        self.link[there] = part
        while below != -1 and self.next[below].get(word) == there:
            self.next[below][word] = part
            below = self.link[below]
        return part

    def _extended(self, last: int, word: bytes, ends: list) -> int:
        """The state of `last`'s longest run and the word behind it."""
        if word in self.next[last]:  # an earlier sequence has it
            return self._split(last, word, ends)
        new = self._state(self.size[last] + 1, {}, ends)
        while last != -1 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last != -1:
            self.link[new] = self._split(last, word, ends)
        return new

    def _places(self, ends: list[list[tuple[int, int]]]) -> None:
        """All places of a state's runs are those of the states linked below it: one range of a list in link order."""
        below: list[list[int]] = [[] for _ in self.next]
        for state in range(1, len(self.next)):
            below[self.link[state]].append(state)
        self.places: list[tuple[int, int]] = []
        self.range = [(0, 0)] * len(self.next)
        todo = [(0, False)]
        while todo:
            state, done = todo.pop()
            if done:
                self.range[state] = (self.range[state][0], len(self.places))
                continue
            self.range[state] = (len(self.places), 0)
            self.places += ends[state]
            todo.append((state, True))
            todo += [(s, False) for s in below[state]]

    def locus(self, sequence: Sequence[bytes]) -> int:
        state = 0
        for word in sequence:
            state = self.next[state][word]
        return state

    def ends_of(self, state: int) -> list[tuple[int, int]]:
        """(sequence, end) of every place of the state's runs."""
        lo, hi = self.range[state]
        return self.places[lo:hi]


class Scanner:
    """Templates and phrases ready to scan with. `least`: shortest match that is chained; `gap`: most words between two
    matches of a chain; `share`: of a template's words that a span covers."""

    def __init__(self, templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]], least: int = 4, gap: int = 12, share: float = 0.75):
        self.labels = [label for label, _ in templates]
        texts = [words_of(text.encode()) for _, text in templates]
        self.lengths = [len(t) for t in texts]
        self.least, self.gap, self.share = least, gap, share
        self.phrases = [(label, words_of(text.encode())) for label, text in phrases]
        self.automaton = a = Automaton([*texts, *(p for _, p in self.phrases)])
        # phrases that end where a state's runs end: its own and those of the states it links to
        own: dict[int, list[int]] = {}
        for nth, (_, phrase) in enumerate(self.phrases):
            own.setdefault(a.locus(phrase), []).append(nth)
        self.endings: list[list[int]] = [[] for _ in a.next]
        for state in sorted(range(1, len(a.next)), key=a.size.__getitem__):
            self.endings[state] = self.endings[a.link[state]] + own.get(state, [])

    def stream(self, data: bytes) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int]]]:
        """(words, places (start, phrase), matches (end, length, state) that cannot go on)."""
        edges, link, size, endings, least = self.automaton.next, self.automaton.link, self.automaton.size, self.endings, self.least
        known = edges[0]
        state = length = at = 0
        places, matches = [], []
        for words in pieces(data):
            for word in words:
                if word in edges[state]:
                    state = edges[state][word]
                    length += 1
                elif state:
                    if length >= least:
                        matches.append((at, length, state))
                    if word not in known:
                        state = length = 0
                    else:
                        while word not in edges[state]:
                            state = link[state]
                        length = size[state] + 1
                        state = edges[state][word]
                at += 1
                if endings[state]:
                    for nth in endings[state]:
                        n = len(self.phrases[nth][1])
                        if n <= length:
                            places.append((at - n, nth))
        if length >= least:
            matches.append((at, length, state))
        return at, places, matches

    def chains(self, matches: list[tuple[int, int, int]]) -> list[Span]:
        """Spans of templates, by start; of one template they do not overlap."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for end, length, state in matches:
            for template, place in self.automaton.ends_of(state):
                if template < len(self.labels):
                    by_template.setdefault(template, []).append((end - length, place - length, length))
        found = []
        for template, anchors in by_template.items():
            anchors = sorted(set(anchors))
            need = self.share * self.lengths[template]
            if sum(n for _, _, n in anchors) < need:
                continue
            covered, before, first = [], [], 0
            for j, (start, place, n) in enumerate(anchors):
                best, from_ = n, -1
                while anchors[first][0] < start - self.lengths[template] - self.gap:
                    first += 1  # matches are no longer than the template
                for i in range(first, j):
                    s, p, m = anchors[i]
                    if s < start and p < place and start - (s + m) <= self.gap:
                        gain = covered[i] + n - max(0, s + m - start, p + m - place)
                        if gain > best:
                            best, from_ = gain, i
                covered.append(best)
                before.append(from_)
            taken: list[tuple[int, int]] = []
            for j in sorted(range(len(anchors)), key=lambda j: (-covered[j], j)):
                if covered[j] < need:
                    break
                i = j
                while before[i] >= 0:
                    i = before[i]
                start, end = anchors[i][0], anchors[j][0] + anchors[j][2]
                at = bisect.bisect_left(taken, (end, 0))
                if at == 0 or taken[at - 1][1] <= start:
                    taken.insert(at, (start, end))
                    found.append(Span(template, start, end, covered[j]))
        return sorted(found, key=lambda s: (s.start, s.end, s.template))


MENTION = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.int64()), ("words", pa.int64())])


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, least: int = 4, gap: int = 12,
                  share: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words (long), mentions (array of label, start, end: every place of a phrase) and spans (array of label,
    start, end, covered, words: the templates covered, `covered` of their `words`).

    Places are words from 0, ends exclusive. Templates with fewer than `least` words are matched as phrases only. A null
    or empty text has no words. Spans of two templates may overlap, those of one do not; of overlapping chains the one
    that covers more goes first, then the earlier. Rows with null or repeated ids are scanned each; other columns are
    not read. A text of any length is streamed whole, in pieces between words. An empty table gives an empty one.
    """
    shared = shared_object(docs.sparkSession, Scanner(templates, phrases, least, gap, share))  # as large as the templates

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared()
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch, "text"):
                raw, sizes, mentions, spans = data.tobytes(), [], [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    n, places, matches = scanner.stream(raw[a:b])
                    sizes.append(n)
                    mentions.append([{"label": scanner.phrases[k][0], "start": s, "end": s + len(scanner.phrases[k][1])} for s, k in sorted(places)])
                    spans.append([{"label": scanner.labels[s.template], "start": s.start, "end": s.end, "covered": s.covered, "words": scanner.lengths[s.template]}
                                  for s in scanner.chains(matches)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(np.array(sizes, np.int64)), pa.array(mentions, pa.list_(MENTION)),
                                                  pa.array(spans, pa.list_(SPAN))], names=["doc_id", "n_words", "mentions", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, "doc_id long, n_words long, mentions array<struct<label:string,start:long,end:long>>, "
                                 "spans array<struct<label:string,start:long,end:long,covered:long,words:long>>")


def report(found: DataFrame) -> DataFrame:
    """Counts, first and last place, labels and a score per document.

    The score is the evidence of the best template or phrase: the covered share of it, times 1 - 2 ^ (-covered words / 4);
    0 without any.
    """
    starts, base = F.transform("mentions", lambda m: m["start"]), F.transform("mentions", lambda m: m["label"])
    of_spans = F.transform("spans", lambda s: s["covered"] / s["words"] * (1 - F.pow(F.lit(2.0), -s["covered"] / 4)))
    of_mentions = F.transform("mentions", lambda m: 1 - F.pow(F.lit(2.0), (m["start"] - m["end"]) / 4))
    labels = F.concat(base, F.transform("spans", lambda s: s["label"]))

    def listed(c: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(c)), ",")

    return found.select("doc_id", "n_words", F.size("mentions").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                        listed(base).alias("base_labels"), listed(labels).alias("labels"), F.coalesce(F.array_max(F.concat(of_spans, of_mentions)), F.lit(0.0)).alias("score"),
                        F.size("spans").cast("long").alias("n_spans"))
