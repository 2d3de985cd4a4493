"""License scans with a generalised suffix automaton of license tokens.

The automaton holds every substring of every license template.  A text is
streamed through it word by word; after each word the automaton's state stands
for the longest run of words, ending there, that occurs in some template (the
matching statistics).  Maximal matches are chained per template, in order in
both the text and the template and with small gaps, into covered spans.  Fixed
phrases are templates too: a phrase stands wherever its state is on the suffix
path of the current state."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import id_text
from .textvec import flat, slices

# Phrases and their labels.
BASE_PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Wording of public license notices (label, text).
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required "
                   "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
                   "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
            "is furnished to do so, subject to the following conditions"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
            "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

MIN_MATCH = 4        # words of a match that counts (the whole template, if that is shorter)
MAX_GAP = 6          # words between chained matches, in the text and in the template
MIN_COVERAGE = 0.8   # share of a template's words that a chain must cover for its label

#: A-Z to lower case, every other ASCII byte outside 0-9 and a-z to a blank.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def license_words(data: bytes) -> list[bytes]:
    return data.translate(_CLEAN).split()


class Automaton:
    """Generalised suffix automaton over word sequences."""

    def __init__(self, templates: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [[]]
        for t, words in enumerate(templates):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w)
                self.ends[last].append((t, i))
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):   # longer strings end where they end
            if self.link[s] > 0:
                self.ends[self.link[s]].extend(self.ends[s])
        self.ends = [sorted(set(e)) for e in self.ends]

    def _new(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state for p's strings followed by w, apart from q's longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:                      # another template has this prefix
            return self._split(last, w, self.next[last][w])
        new, p = self._new(self.length[last] + 1, {}, 0), last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p != -1:
            self.link[new] = self._split(p, w, self.next[p][w])
        return new

    def step(self, state: int, length: int, w: int) -> tuple[int, int]:
        while state and w not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        to = self.next[state].get(w)
        return (0, 0) if to is None else (to, length + 1)


class Scanner:
    """Templates, vocabulary and automaton; small, and sent to the tasks as it is."""

    def __init__(self, phrases=BASE_PHRASES, templates=TEMPLATES):
        texts = [p for p, _ in phrases] + [t for _, t in templates]
        self.labels = [x for _, x in phrases] + [x for x, _ in templates]
        self.n_phrases = len(phrases)
        self.vocabulary: dict[bytes, int] = {}
        rows = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in license_words(t.encode())] for t in texts]
        self.sizes = [len(r) for r in rows]
        self.automaton = Automaton(rows)
        v = len(self.vocabulary)
        self.pairs = np.zeros((v + 1, v + 1), bool)   # last row and column: any other word
        for row in rows:
            self.pairs[row[:-1], row[1:]] = True
        self.phrases: list[list[tuple[int, int]]] = [[]] * len(self.automaton.next)   # that end where the state's longest string does
        for s in sorted(range(1, len(self.automaton.next)), key=lambda s: self.automaton.length[s]):
            own = [(t, self.sizes[t]) for t, end in self.automaton.ends[s]
                   if t < self.n_phrases and end == self.sizes[t] - 1 and self.automaton.length[self.automaton.link[s]] < self.sizes[t] <= self.automaton.length[s]]
            self.phrases[s] = own + self.phrases[self.automaton.link[s]]

    def statistics(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Phrase places (start, phrase) and maximal matches (last word, length, state), over
        the stretches of words whose neighbours stand together in some template; outside
        them no match is longer than one word."""
        other = len(self.vocabulary)
        near = self.pairs[ids[:-1], ids[1:]] if len(ids) > 1 else np.zeros(0, bool)
        if not near.any():
            return [], []
        edge = np.diff(np.concatenate([[0], near.view(np.int8), [0]]))
        places, matches, a = [], [], self.automaton
        for b, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            state = length = 0
            for i, w in enumerate(ids[b:e + 1].tolist(), b):
                before = (state, length)
                state, length = a.step(state, length, w) if w != other else (0, 0)
                if before[1] > 1 and length <= before[1]:
                    matches.append((i - 1, before[1], before[0]))
                places += [(i - n + 1, t) for t, n in self._phrases(state, length)]
            if length > 1:
                matches.append((e, length, state))
        return places, matches

    def _phrases(self, state: int, length: int) -> list[tuple[int, int]]:
        return [x for x in self.phrases[state] if x[1] <= length]

    def chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """(template, first word, last word, covered share): matches of one template joined
        while both their places in the text and in the template go on with small gaps."""
        by_template = defaultdict(list)
        for last, length, state in matches:
            for t, end in self.automaton.ends[state]:
                n = min(length, end + 1)
                if t >= self.n_phrases and n >= min(MIN_MATCH, self.sizes[t]):
                    by_template[t].append((last, end, n))
        out = []
        for t, found in by_template.items():
            best: list[tuple[int, int]] = []          # words covered, first word, of the best chain to each match
            spans = []
            for i, (last, end, n) in enumerate(found):
                covered, first = n, last - n + 1
                for j in range(i - 1, -1, -1):
                    p_last, p_end, _ = found[j]
                    if last - n - p_last > MAX_GAP:
                        if last - p_last > MAX_GAP + self.sizes[t]:
                            break
                        continue
                    gain = min(last - p_last, end - p_end, n)
                    if gain > 0 and end - n - p_end <= MAX_GAP and best[j][0] + gain > covered:
                        covered, first = best[j][0] + gain, best[j][1]
                best.append((covered, first))
                spans.append((first, last, covered))
            kept: dict[int, tuple[int, int]] = {}
            for first, last, covered in spans:        # of chains from one place, the fullest
                if covered > kept.get(first, (0, 0))[1]:
                    kept[first] = (last, covered)
            out += [(t, first, last, min(1.0, covered / self.sizes[t])) for first, (last, covered) in kept.items()]
        return out

    def scan(self, data: bytes) -> dict:
        words = license_words(data)
        other = len(self.vocabulary)
        get = self.vocabulary.get
        ids = np.fromiter((get(w, other) for w in words), np.int32, len(words))
        places, matches = self.statistics(ids)
        spans = self.chains(matches) if matches else []
        base = {self.labels[t] for _, t in places}
        firm = [s for s in spans if s[3] >= MIN_COVERAGE]
        labels = base | {self.labels[t] for t, *_ in firm}
        starts = [s for s, _ in places]
        return {
            "n_words": len(words), "n_base": len(places), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)),
            "score": 1.0 if places else max((s[3] for s in spans), default=0.0),
            "spans": [{"label": self.labels[t], "first_word": a, "last_word": b, "coverage": c} for t, a, b, c in sorted(firm, key=lambda s: (s[1], s[2], s[0]))],
        }


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "spans array<struct<label: string, first_word: long, last_word: long, coverage: double>>")
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("coverage", pa.float64())])))])


def license_scan(docs: DataFrame, phrases=BASE_PHRASES, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: word count, places of the base phrases, labels, score and
    the covered template spans (words from 0).

    ``score`` is 1 where a base phrase stands, else the largest share of a template that
    a chain covers.  A null or empty text has no words, no labels and score 0; a null id
    stays null; repeated rows give repeated rows; an empty table gives an empty one."""
    scanner = Scanner(phrases, templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b in slices(batch.column(1)):
                data, offsets = flat(batch.column(1).slice(a, b - a))
                rows = [scanner.scan(data[x:y].tobytes()) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                keys = ids.slice(a, b - a).to_pylist()
                yield pa.RecordBatch.from_pylist([{"doc_id": k} | r for k, r in zip(keys, rows)], schema=_ARROW)

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
