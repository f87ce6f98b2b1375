"""License scans with a generalised suffix automaton of licence tokens.

The automaton holds every substring of the templates' words. A file is streamed
through it: after each word the state tells the longest suffix of the words so
far that occurs in a template (matching statistics). Long matches are chained,
template by template, into spans of a file that cover a template in order, and
a label is given where a chain covers enough of its template. A word no
template has resets the automaton, so only runs of template words are streamed;
everything else is a dictionary lookup.

Besides, the places of fixed phrases are counted (``PHRASES``).

Defined results: null text counts as empty (no words, no labels, score 0);
repeated rows get one result each; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from iolens.llm.common import doc_text, map_text, prepare, table, text_bytes

#: phrases and their labels (fixed values)
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: passages of public licence texts by label (fixed values)
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for
more details. You should have received a copy of the GNU General Public License along with this program.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED.""",
}
#: words of a match that counts as long; words that may lie between matches of a chain; part of a template a label needs
LONG = 6
GAP = 40
COVER = 0.5

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: lower-cased runs of letters, digits and non-ASCII characters."""
    return text.translate(_WORDS).split()


@dataclass
class Automaton:
    """Generalised suffix automaton over token sequences. ``at`` gives, for each
    state, one (template, end position) where its strings occur in each
    template that has them."""
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    at: list[dict[int, int]] = field(default_factory=lambda: [{}])

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.at.append({})
        return len(self.step) - 1

    def _extend(self, last: int, c: int) -> int:
        if c in self.step[last]:
            q = self.step[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        now, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = now
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[now] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return now

    def _split(self, p: int, c: int, q: int) -> int:
        twin = self._new(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = twin
            p = self.link[p]
        return twin

    @classmethod
    def build(cls, sequences: list[list[int]]) -> Automaton:
        a = cls()
        ends = []
        for k, seq in enumerate(sequences):
            last = 0
            for i, c in enumerate(seq):
                last = a._extend(last, c)
            ends.append((k, seq))
        for k, seq in ends:  # states are final now: mark the prefixes' states, then what their links reach
            state = 0
            for i, c in enumerate(seq):
                state = a.step[state][c]
                a.at[state].setdefault(k, i)
        for s in sorted(range(1, len(a.step)), key=lambda s: -a.length[s]):
            for k, i in a.at[s].items():
                a.at[a.link[s]].setdefault(k, i)
        return a

    def statistics(self, seq: list[int]) -> list[tuple[int, int]]:
        """(state, length of the longest suffix that the templates have) after each token."""
        out, state, n = [], 0, 0
        for c in seq:
            while state and c not in self.step[state]:
                state = self.link[state]
                n = self.length[state]
            if c in self.step[state]:
                state, n = self.step[state][c], n + 1
            else:
                state = n = 0
            out.append((state, n))
        return out


@dataclass
class Scanner:
    """Templates ready to scan with: dictionary of their words, automaton, lengths."""
    names: list[str]
    vocab: dict[bytes, int]
    automaton: Automaton
    size: list[int]
    phrases: list[tuple[list[bytes], str]]

    @classmethod
    def of(cls, templates: dict[str, str], phrases: dict[str, str]) -> Scanner:
        vocab: dict[bytes, int] = {}
        seqs = [[vocab.setdefault(w, len(vocab)) for w in words_of(t.encode())] for t in templates.values()]
        return cls(list(templates), vocab, Automaton.build(seqs), [len(s) for s in seqs],
                   [(p.encode().split(), label) for p, label in phrases.items()])

    def places(self, text: bytes, words: list[bytes]) -> list[tuple[int, str]]:
        """(first word, label) of every place of a phrase."""
        out = []
        for phrase, label in self.phrases:
            if phrase[-1] not in text:
                continue
            k, last = -1, phrase[-1]
            while True:
                try:
                    k = words.index(last, k + 1)
                except ValueError:
                    break
                start = k - len(phrase) + 1
                if start >= 0 and words[start:k + 1] == phrase:
                    out.append((start, label))
        return out

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int, int]]:
        """Maximal long matches: (template, first word, its place in the template, words)."""
        ids = list(map(self.vocab.get, words))
        out, k, n = [], 0, len(ids)
        while k < n:
            if ids[k] is None:
                k += 1
                continue
            start = k
            while k < n and ids[k] is not None:
                k += 1
            if k - start < LONG:
                continue
            stats = self.automaton.statistics(ids[start:k])
            for i, (state, size) in enumerate(stats):
                if size >= LONG and (i + 1 == len(stats) or stats[i + 1][1] != size + 1):
                    out += [(t, start + i - size + 1, end - size + 1, size) for t, end in self.automaton.at[state].items()]
        return out

    def spans(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """Chains: (label, first word, word after the last, part of the template covered), best per template and place."""
        if len(words) < LONG:
            return []
        by: dict[int, list] = {}
        for t, *m in self.matches(words):
            by.setdefault(t, []).append(tuple(m))
        out = []
        for t, found in by.items():
            found.sort()
            best: list[tuple[int, int]] = []  # words covered, first word of the chain
            for i, (a, b, n) in enumerate(found):
                covered, first = n, a
                for j in range(i - 1, max(-1, i - 200), -1):
                    pa_, pb, pn = found[j]
                    if pa_ + pn <= a <= pa_ + pn + GAP and pb + pn <= b and best[j][0] + n > covered:
                        covered, first = best[j][0] + n, best[j][1]
                best.append((covered, first))
            top: dict[int, tuple[int, int]] = {}
            for (a, _, n), (covered, first) in zip(found, best):
                top[first] = max(top.get(first, (0, 0)), (covered, a + n))
            out += [(self.names[t], first, end, min(1.0, covered / self.size[t])) for first, (covered, end) in top.items()]
        return out


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Counts, labels, score and template spans (label:first:end:part) of every row."""
    made: list[Scanner] = []

    def batch(b: pa.RecordBatch) -> dict:
        if not made:
            made.append(Scanner.of(templates, phrases))
        s = made[0]
        out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
        for text in text_bytes(b.column("text")):
            low = text.translate(_WORDS)
            words = low.split()
            places = s.places(low, words)
            spans = s.spans(words)
            base = {label for _, label in places}
            firsts = [k for k, _ in places]
            for name, value in (("n_words", len(words)), ("n_base", len(places)), ("first_word", min(firsts, default=None)),
                                ("last_word", max(firsts, default=None)), ("base_labels", ",".join(sorted(base))),
                                ("labels", ",".join(sorted(base | {x[0] for x in spans if x[3] >= COVER}))),
                                ("score", max((x[3] for x in spans), default=0.0)),
                                ("spans", ",".join(f"{x[0]}:{x[1]}:{x[2]}:{x[3]:.3f}" for x in sorted(spans, key=lambda x: (x[1], x[0]))))):
                out[name].append(value)
        return out | {"doc_id": b.column("doc_id")}

    return map_text(doc_text(docs), "doc_id long, n_words long, n_base long, first_word long, last_word long, "
                                    "base_labels string, labels string, score double, spans string", batch)


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    """License phrases, labels and covered template spans of every document."""
    prepare(spark)
    return scan(table(spark, sf_dir, "documents"))
