"""Licence scan with a generalised suffix automaton of licence tokens.

The automaton holds the words of all templates: the phrases, usual notices and the wording of common
licences. A file's words stream through it and give matching statistics: at every word the longest
run ending there that stands in some template. Runs that cannot grow are matches; matches of at
least ``LONG_MATCH`` words are chained in template order into covered spans, and a template whose
words are covered to its threshold gives its label. Phrases are read from the same states (a phrase
ends at a word if its state is the current one or a suffix of it), so every place is found.

Words outside the templates cannot match, so a task looks all words up by hash in whole arrays, and
only stretches of neighbouring template words (pairs that stand in a template) enter the automaton.

Defined results: null and empty texts have no words, no places, empty labels and score 0. Repeated
rows give repeated results. Texts are streamed whole, whatever their length. Other columns are
not read. The automaton depends on the templates only, never on the data.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from deskstream.llm import common as c

LONG_MATCH = 3
MAX_GAP = 12

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Public licence wording (label, least covered share, words).
TEMPLATES = [
    ("apache-2.0", 0.75, "licensed under the apache license version 2 0"),
    ("apache-2.0", 0.5, "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-3.0", 0.75, "licensed under the gnu general public license version 3"),
    ("gpl", 0.5, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("cc-by-nc", 0.75, "licensed under cc by nc 4 0"),
    ("cc-by-sa", 0.75, "licensed under cc by sa 4 0"),
    ("mit", 0.75, "released under the mit license"),
    ("mit", 0.5, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied"),
    ("bsd", 0.5, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("isc", 0.5, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("all-rights-reserved", 1.0, "all rights reserved"),
]

WORD = ~c.byte_set((0, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
WORD[65:91] = True  # lower-cased before splitting
_SPLIT = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


class Automaton:
    """Generalised suffix automaton of token sequences."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int, int]] = []
        for k, sequence in enumerate(sequences):
            last = 0
            for at, token in enumerate(sequence):
                last = self._extend(last, token)
                ends.append((last, k, at + 1))
        #: For each state the (sequence, end) places of its longest string.
        self.places: list[set[tuple[int, int]]] = [set() for _ in self.next]
        for state, k, end in ends:
            while state > 0:
                self.places[state].add((k, end))
                state = self.link[state]

    def _extend(self, last: int, token: int) -> int:
        known = self.next[last].get(token)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, token, known)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, token, q)
        return new

    def _clone(self, p: int, token: int, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def statistics(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest match ending at each token."""
        state = length = 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            following = self.next[state].get(token)
            if following is None:
                state = length = 0
            else:
                state, length = following, length + 1
            yield state, length


class Scanner:
    """Templates prepared for scanning; built once per task."""

    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, float, str]]):
        self.labels = [*phrases.values(), *(t[0] for t in templates)]
        self.least = [1.0] * len(phrases) + [t[1] for t in templates]
        sequences = [_SPLIT.findall(t) for t in [*phrases, *(t[2] for t in templates)]]
        self.sizes = [len(s) for s in sequences]
        vocabulary = sorted({w for s in sequences for w in s})
        data = np.frombuffer(" ".join(vocabulary).encode(), np.uint8)
        starts, ends, _ = c.word_spans(data, np.array([0, len(data)]))
        hashes = c.span_hashes(c.prefix_sums(data, c.BYTE_HASH_LOWER), starts, ends)
        order = np.argsort(hashes)
        self.hashes, numbers = hashes[order], {vocabulary[j]: k for k, j in enumerate(order)}
        coded = [[numbers[w] for w in s] for s in sequences]
        self.pairs = np.unique([a << 32 | b for s in coded for a, b in zip(s, s[1:])])
        self.automaton = Automaton(coded)
        a = self.automaton
        self.phrases: list[list[int]] = []  # of each state: the phrases that its strings end with
        self.spans: list[list[tuple[int, int]]] = []
        for state in range(len(a.next)):
            found, s = [], state
            while s > 0:
                found += [(k, self.sizes[k]) for k, end in a.places[s] if k < len(phrases) and end == self.sizes[k] == a.length[s]]
                s = a.link[s]
            self.phrases.append(sorted(set(found)))
            self.spans.append(sorted(a.places[state]))

    def stretch(self, tokens: list[int], first: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Phrase places (phrase, start) and long matches (end, length, state) of one run of words starting at ``first``."""
        places, matches = [], []
        held = (0, 0)
        for at, (state, length) in enumerate(self.automaton.statistics(tokens)):
            places += [(k, first + at + 1 - size) for k, size in self.phrases[state] if size <= length]
            if held[1] >= LONG_MATCH and length <= held[1]:
                matches.append((first + at, held[1], held[0]))
            held = (state, length)
        if held[1] >= LONG_MATCH:
            matches.append((first + len(tokens), held[1], held[0]))
        return places, matches

    def chained(self, matches: list[tuple[int, int, int]]) -> dict[int, float]:
        """Covered share of each template: the best chain of matches in file order and template order."""
        by_template: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for end, length, state in matches:
            for k, stop in self.spans[state]:
                by_template[k].append((end, length, stop))
        covered = {}
        for k, found in by_template.items():
            size, best = self.sizes[k], []
            for end, length, stop in found:
                length = min(length, stop)
                most = length
                for end2, stop2, total in reversed(best):
                    if end - length - end2 > MAX_GAP + size:
                        break
                    if end2 <= end - length and stop2 <= stop - length:
                        most = max(most, total + length)
                best.append((end, stop, most))
            covered[k] = min(1.0, max(b[2] for b in best) / size)
        return covered

    def scan(self, data: np.ndarray, bounds: np.ndarray) -> list[tuple]:
        """(n_words, n_base, first, last, base labels, labels, score, spans) of each text."""
        starts, ends, first = c.word_spans(data, bounds, WORD)
        hashes = c.span_hashes(c.prefix_sums(data, c.BYTE_HASH_LOWER), starts, ends)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        codes = np.where(self.hashes[place] == hashes, place, -1)
        linked = np.zeros(len(codes), bool)
        if len(codes) > 1:
            near = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0))
            linked[near] = np.isin(codes[near] << 32 | codes[near + 1], self.pairs)
        inner = first[1:-1]
        linked[inner[inner > 0] - 1] = False  # the last word of a text is linked with none
        opens = np.flatnonzero(linked & ~np.concatenate([[False], linked[:-1]]))
        closes = np.flatnonzero(linked & ~np.append(linked[1:], False)) + 2
        owner = np.searchsorted(first, opens, "right") - 1
        found: dict[int, tuple[list, list]] = {}
        for text, a, b in zip(owner.tolist(), opens.tolist(), closes.tolist()):
            base = int(first[text])
            places, matches = self.stretch(codes[a:b].tolist(), a - base)
            if places or matches:
                held = found.setdefault(text, ([], []))
                held[0].extend(places)
                held[1].extend(matches)
        out = []
        for text, n in enumerate(np.diff(first).tolist()):
            places, matches = found.get(text, ((), ()))
            at = [p for _, p in places]
            base = {self.labels[k] for k, _ in places}
            covered = self.chained(matches)
            labels = base | {self.labels[k] for k, share in covered.items() if share >= self.least[k]}
            score = 1.0 if base else max(covered.values(), default=0.0)
            out.append((n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
        return out


SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def licence_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, float, str]] = TEMPLATES) -> DataFrame:
    """One row per document; a narrow scan of (doc_id, text) without a shuffle."""
    c.ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in batches:
            rows = [r for _, _, data, bounds in c.chunks(batch.column(1)) for r in scanner.scan(data, bounds)]
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(v, k) for v, k in zip(columns, kinds))], names=[f.split()[0] for f in SCHEMA.split(", ")]
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
