"""Licence scans with a generalised suffix automaton of licence templates.

Templates are token sequences; the automaton accepts every run of tokens of any of them and knows where runs end. A text
is streamed through it, which gives at each token the longest run of some template that ends there (its matching
statistic). Maximal runs of some length are mapped to places in the templates, and places that follow each other in text
and template are chained into covered spans. A template whose covered share is high enough adds its label; the score of
a text is the largest share. Tokens outside all templates reset the automaton, so only runs of known tokens are streamed.

Base labels are exact places of short phrases; the method only adds labels to them.

Edge cases: a null, empty or symbol-only text has no words, no labels and score 0; repeated rows give equal rows; very
long texts are scanned whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapfold.llm.common import as_bytes

#: Phrase and label.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label and standard wording of public licences and of usual notices.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)

#: Everything but ASCII letters, digits and bytes of other code points separates words.
_BREAKS = bytes(b if chr(b).isalnum() and b < 0x80 or b >= 0x80 else 0x20 for b in range(256))


class Automaton:
    """Suffix automaton of several token sequences (one set of states for all)."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[list[tuple[int, int]]] = [[]]
        for number, tokens in enumerate(sequences):
            last = 0
            for i, token in enumerate(tokens):
                last = self._extend(last, token)
                self.places[last].append((number, i))
        # a state's places are also those of all states whose suffix link leads to it
        for state in sorted(range(1, len(self.link)), key=lambda x: -self.length[x]):
            if self.link[state] > 0:
                self.places[self.link[state]] = sorted({*self.places[self.link[state]], *self.places[state]})

    def _clone(self, p: int, q: int, token: int) -> int:
        copy = len(self.link)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.places.append([])
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, token: int) -> int:
        if (q := self.next[last].get(token)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, token)
        state = len(self.link)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        self.places.append([])
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, token)
        return state

    def matches(self, tokens: list[int]) -> list[tuple[int, int]]:
        """(length, state) of the longest known run that ends at each token."""
        state = length = 0
        out = []
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
            out.append((length, state))
        return out


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES, min_run: int = 3, max_gap: int = 6, cover: float = 0.6):
        self.min_run, self.max_gap, self.cover = min_run, max_gap, cover
        self.templates = [(label, text.encode().split()) for label, text in templates]
        self.ids: dict[bytes, int] = {}
        sequences = [[self.ids.setdefault(w, len(self.ids)) for w in words] for _, words in self.templates]
        self.automaton = Automaton(sequences)
        self.phrases = [(tuple(p.encode().split()), label) for p, label in phrases]

    def runs(self, words: list[bytes], known: list[int]) -> Iterator[tuple[int, int, int, int]]:
        """(start in the text, template, start in it, length) of maximal matches; `known` are the places of known words."""
        i = 0
        while i < len(known):
            j = i
            while j + 1 < len(known) and known[j + 1] == known[j] + 1:
                j += 1
            if j - i + 1 >= self.min_run:
                found = self.automaton.matches([self.ids[w] for w in words[known[i] : known[j] + 1]])
                for k, (length, state) in enumerate(found):
                    # maximal: the next token does not make it longer
                    if length >= self.min_run and (k + 1 == len(found) or found[k + 1][0] <= length):
                        for number, end in self.automaton.places[state]:
                            yield known[i] + k - length + 1, number, end - length + 1, length
            i = j + 1

    def scan(self, text: bytes) -> tuple:
        words = text.lower().translate(_BREAKS).split()
        ids = self.ids
        known = [i for i, w in enumerate(words) if w in ids]
        places, labels = [], set()
        for phrase, label in self.phrases:
            hits = [i for i in known if words[i] == phrase[0] and tuple(words[i : i + len(phrase)]) == phrase]
            places += hits
            labels |= {label} if hits else set()
        base = sorted(labels)
        chains: dict[int, list] = {}
        best: dict[int, tuple] = {}
        for at, number, inside, length in sorted(self.runs(words, known)):
            chain = chains.get(number)
            # a match goes on a chain if it follows it both in the text and in the template, without a long gap
            if chain and at >= chain[1] and inside >= chain[2] and at - chain[1] <= self.max_gap:
                chain[1], chain[2], chain[3] = at + length, inside + length, chain[3] + length
            else:
                chain = chains[number] = [at, at + length, inside + length, length]
            share = chain[3] / len(self.templates[number][1])
            if number not in best or share > best[number][0]:
                best[number] = share, chain[0], chain[1]
        spans = [(self.templates[n][0], start, end, share) for n, (share, start, end) in best.items() if share >= self.cover]
        labels |= {s[0] for s in spans}
        score = max([min(1.0, b[0]) for b in best.values()], default=0.0)
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(base), ",".join(sorted(labels)), score, sorted(spans, key=lambda s: (s[1], s[2], s[0]))


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,cover:double>>"


def scan_licences(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of docs, as in SCHEMA; spans are in words of the text, the end not included."""
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(**options)
        for batch in batches:
            rows = [scanner.scan(t) for t in as_bytes(batch.column(1))]
            columns = list(zip(*rows)) or [[]] * 8
            spans = pa.array([[dict(zip(("label", "start", "end", "cover"), s)) for s in x] for x in columns[-1]], span)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds)), spans], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SCHEMA)
