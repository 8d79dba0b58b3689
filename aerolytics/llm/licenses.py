"""Licence scans: matching statistics over a generalised suffix automaton.

The templates' words form one suffix automaton. A file streams through it and
every position knows the longest run of words ending there that stands in some
template. Long runs are placed on the templates they come from, chained in
order, and the covered share of a template is a chain's score. Every notice of
a text that is covered enough gives a span, however often its template occurs.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolytics.llm.common import fold_words, raw_bytes

# Phrases of the base rule and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notices (label, text) that the method recognises.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction including "
            "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
            "copies of the software and to permit persons to whom the software is furnished to do so"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in "
               "compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is "
               "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license as published by the free software foundation either version 3 of the license "
            "or at your option any later version"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
    ("bsd", "released under the bsd license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
)
#: Words a match needs before it takes part in a chain.
MIN_MATCH = 4
#: Words of text or template that a chain may skip between two matches.
MAX_GAP = 12
#: Covered share of a template from which its label is given.
MIN_COVERAGE = 0.8


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences.

    ``ends[state]`` lists (sequence, end) of every occurrence that a run with
    that state has, so a match can be placed on its templates.
    """

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, words in enumerate(sequences):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w)
                self.ends[last].add((k, i + 1))
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.ends[self.link[s]] |= self.ends[s]
        self.ends[0] = set()

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        clone = self._state(self.length[p] + 1)
        self.next[clone] = dict(self.next[q])
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: bytes) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._state(self.length[last] + 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def statistics(self, words: list[bytes]):
        """(end, state, length) of the longest run ending at each word that has one."""
        nexts, link, length, start = self.next, self.link, self.length, self.next[0]
        state = run = 0
        for i, w in enumerate(words):
            if state == 0:
                if w not in start:
                    continue
                state, run = start[w], 1
            else:
                while state and w not in nexts[state]:
                    state = link[state]
                    run = length[state]
                if w in nexts[state]:
                    state, run = nexts[state][w], run + 1
                else:
                    run = 0
                    continue
            yield i + 1, state, run


class LicenseScanner:
    """Automaton over phrases and templates, with the chaining of long matches."""

    def __init__(self, templates=TEMPLATES, phrases=BASE_PHRASES):
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]
        self.templates = [(t.encode().split(), label) for label, t in templates]
        self.automaton = SuffixAutomaton([w for w, _ in self.phrases] + [w for w, _ in self.templates])

    def scan(self, text: bytes | None) -> dict:
        """Base places, covered template spans and labels of one text."""
        words = fold_words(text or b"")
        places: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int]] = []
        last = (0, 0, 0)
        for end, state, run in self.automaton.statistics(words):
            # A run stays maximal until the next word fails to extend it.
            if last[2] >= MIN_MATCH and (end != last[0] + 1 or run != last[2] + 1):
                matches.append(last)
            last = (end, state, run)
            for k, (phrase, _) in enumerate(self.phrases):
                if words[end - 1] == phrase[-1] and run >= len(phrase) and words[end - len(phrase):end] == phrase:
                    places.append((end - len(phrase), k))
        if last[2] >= MIN_MATCH:
            matches.append(last)
        covered = self._chains(matches)
        base = {self.phrases[k][1] for _, k in places}
        added = {self.templates[t][1] for t, (_, spans) in covered.items() if spans}
        score = max([1.0 if places else 0.0, *(share for share, _ in covered.values())])
        return {"n_words": len(words), "n_base": len(places),
                "first_word": min((p for p, _ in places), default=None),
                "last_word": max((p for p, _ in places), default=None),
                "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | added)),
                "score": score,
                "spans": [{"label": self.templates[t][1], "start": a, "end": b, "coverage": share}
                          for t, (_, spans) in sorted(covered.items()) for share, a, b in spans]}

    def _chains(self, matches: list[tuple[int, int, int]]) -> dict[int, tuple[float, list[tuple[float, int, int]]]]:
        """Per template: share of its best chain, and (share, first, last word) of every covered span.

        Every match extends the chain that then covers most, or starts one. Of
        the chains covered enough, those that share words of the text with a
        better one (greater share, then shorter) are left out.
        """
        # Per template, by text end: text start, text end, template end, covered words.
        open_: dict[int, list[tuple[int, int, int, int]]] = {}
        best: dict[int, float] = {}
        enough: dict[int, list[tuple[float, int, int]]] = {}
        offset = len(self.phrases)
        for end, state, run in matches:
            for seq, seq_end in sorted(self.automaton.ends[state]):
                t = seq - offset
                if t < 0:
                    continue
                # Runs start later and later, so a chain past the gap stays closed.
                chains = [c for c in open_.get(t, ()) if end - run - c[1] <= MAX_GAP]
                start, covered = end - run, run
                for first, last, place, words in chains:
                    # Words that text or template has already given to the chain count once.
                    new = min(run, end - last, seq_end - place)
                    if (new > 0 and end - new - last <= MAX_GAP and seq_end - new - place <= MAX_GAP
                            and (words + new, first) > (covered, start)):
                        start, covered = first, words + new
                open_[t] = [*chains, (start, end, seq_end, covered)]
                share = round(min(1.0, covered / len(self.templates[t][0])), 6)
                best[t] = max(best.get(t, 0.0), share)
                if share >= MIN_COVERAGE:
                    enough.setdefault(t, []).append((share, start, end))
        out = {}
        for t, share in best.items():
            taken: list[tuple[int, int, float]] = []
            for s, a, b in sorted(enough.get(t, ()), key=lambda c: (-c[0], c[2] - c[1], c[1])):
                at = bisect.bisect_left(taken, (a,))
                if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
                    taken.insert(at, (a, b, s))
            out[t] = share, [(s, a, b) for a, b, s in taken]
        return out


_FIELDS = {"n_words": ("long", pa.int64()), "n_base": ("long", pa.int64()), "first_word": ("long", pa.int64()),
           "last_word": ("long", pa.int64()), "base_labels": ("string", pa.string()),
           "labels": ("string", pa.string()), "score": ("double", pa.float64()),
           "spans": ("array<struct<label:string,start:int,end:int,coverage:double>>",
                     pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                                         ("coverage", pa.float64())])))}


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 templates=TEMPLATES) -> DataFrame:
    """Per row: id, word count, base places and labels, all labels, score, covered spans.

    A null or empty text has no words, no labels, null places and score zero.
    Repeated rows and null ids are scanned row by row; no other column is read.
    Map-only: the automaton is rebuilt in each task from the template texts.
    """
    arrow = pa.struct([(n, t) for n, (_, t) in _FIELDS.items()])
    ready: list[LicenseScanner] = []

    @F.arrow_udf("struct<" + ",".join(f"{n}:{t}" for n, (t, _) in _FIELDS.items()) + ">")
    def scan(column: pa.Array) -> pa.Array:
        if not ready:
            ready.append(LicenseScanner(templates))
        return pa.array([ready[0].scan(t) for t in raw_bytes(column)], arrow)

    return (docs.select(F.col(f"`{id_col}`").alias("doc_id"), scan(F.col(f"`{text_col}`")).alias("r"))
            .select("doc_id", *[F.col(f"r.{n}").alias(n) for n in _FIELDS]))
