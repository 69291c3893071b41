"""Licence scans with a positional index of rare words.

Licence notices are kept as templates of words. Each template is indexed under its rarest
words, by inverse document frequency over the templates, with their positions. In a file, the
occurrences of those words are looked up, each posting says where its template would start,
and starts on which several rare words agree (give or take a few words put in or left out) are
candidates. A candidate is verified: most of the template's words have to stand near their
places, and its mandatory key phrases have to stand there word by word.

Base phrases are found by themselves, at every place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import LOWER, NON_ALNUM, hash_spans, slices, spans

#: Phrases that give a label wherever their words stand in a row.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label, notice, mandatory key phrases. Notices are the usual public ones, in words.
TEMPLATES = (
    ("agpl-3.0", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu affero general public license", "version 3")),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ("affero general public license", "version 3")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "2 0")),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache org licenses", "compliance with the license")),
    ("artistic-2.0", "licensed under the artistic license 2 0", ("artistic license", "2 0")),
    ("bsd-2-clause", "licensed under the bsd 2 clause license", ("bsd 2 clause",)),
    ("bsd-3-clause", "licensed under the bsd 3 clause license", ("bsd 3 clause",)),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products", "prior written permission")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("commons attribution 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial 4 0",)),
    ("cc-by-nc-nd-4.0", "licensed under cc by nc nd 4 0", ("cc by nc nd 4 0",)),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", ("cc by nc sa 4 0",)),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license", ("attribution sharealike 4 0",)),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related",)),
    ("cc0-1.0", "released under cc0 1 0 universal", ("cc0 1 0",)),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-2.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "either version 2")),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "either version 3")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    ("isc", "released under the isc license", ("isc license",)),
    ("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1", ("lesser general public license", "version 2 1")),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3", ("lesser general public license", "version 3")),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license", "2 0")),
    ("mpl-2.0", "licensed under the mozilla public license version 2 0", ("mozilla public license", "2 0")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ("alter it and redistribute it freely",)),
)


@dataclass(frozen=True)
class Settings:
    """rare: words that a template is indexed under. slack: words that may be put in or left out before a word. coverage: least
    share of a template's words near their places. base_score: of a file that has base phrases only.
    """

    rare: int = 4
    slack: int = 3
    coverage: float = 0.75
    base_score: float = 0.5


def words_of(text: bytes) -> np.ndarray:
    buf = LOWER[np.frombuffer(text, np.uint8)]
    starts, ends, _ = spans(buf, np.array([0, len(buf)]), NON_ALNUM)
    return hash_spans(buf, starts, ends)


class Index:
    """Postings of the templates' rarest words."""

    def __init__(self, s: Settings, templates=TEMPLATES, base=None):
        self.settings = s
        self.labels = [t[0] for t in templates]
        self.words = [words_of(t[1].encode()) for t in templates]
        self.keys = [[words_of(k.encode()) for k in t[2]] for t in templates]
        self.base = [(words_of(p.encode()), label) for p, label in (BASE if base is None else base).items()]
        seen, df = np.unique(np.concatenate([np.unique(w) for w in self.words]), return_counts=True)
        self.idf = dict(zip(seen.tolist(), np.log((1 + len(templates)) / df).tolist(), strict=True))
        posts = []
        for t, w in enumerate(self.words):
            rarest = sorted(set(w.tolist()), key=lambda h: (-self.idf[h], h))[: s.rare]
            posts += [(h, t, p) for p, h in enumerate(w.tolist()) if h in rarest]
        self.need = np.array([min(2, len(set(w.tolist()))) for w in self.words])
        posts.sort()
        self.hash = np.array([p[0] for p in posts], np.uint64)
        self.template = np.array([p[1] for p in posts], np.int64)
        self.place = np.array([p[2] for p in posts], np.int64)
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.hash >> np.uint64(48)).astype(np.int64)] = True

    def lookup(self, words: np.ndarray) -> np.ndarray:
        """Places of the words that have postings."""
        at = np.flatnonzero(self.filter[(words >> np.uint64(48)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.hash, words[at]), len(self.hash) - 1)
        return at[self.hash[k] == words[at]]

    def match(self, words: np.ndarray, at: np.ndarray) -> dict[str, float]:
        """Labels of one file, with the coverage of their best template; ``at``: where its rare words stand."""
        s = self.settings
        lo, hi = (np.searchsorted(self.hash, words[at], side) for side in ("left", "right"))
        n = hi - lo
        which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = np.repeat(at, n) - self.place[which]
        order = np.lexsort((start, self.template[which]))
        template, start, place = self.template[which][order], start[order], self.place[which][order]
        found: dict[str, float] = {}
        edge = np.flatnonzero(np.concatenate([[True], (template[1:] != template[:-1]) | (np.diff(start) > s.slack), [True]]))
        # Groups of near starts on which enough different rare words of a template agree.
        group = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        pairs = np.unique(np.stack([group, place]), axis=1)[0]
        agreed = np.bincount(pairs, minlength=len(edge) - 1)
        keep = agreed[group] >= self.need[template]
        for t in np.unique(template[keep]).tolist():
            score = self.verify(words, np.unique(start[keep & (template == t)]), t)
            if score > found.get(self.labels[t], 0):
                found[self.labels[t]] = score
        return found

    def verify(self, words: np.ndarray, starts: np.ndarray, t: int) -> float:
        """The largest share of the template's words near their places at one of the starts (sorted) that has all key phrases; 0 if it is too small."""
        s, w = self.settings, self.words[t]
        n = len(w)
        phrases = [(places(words, k), len(k)) for k in self.keys[t]]
        if not all(len(p) for p, _ in phrases):
            return 0.0
        padded = np.concatenate([np.zeros(n + s.slack, np.uint64), words, np.zeros(n + s.slack, np.uint64)])
        real = np.zeros(len(padded), bool)
        real[n + s.slack : n + s.slack + len(words)] = True
        best = 0.0
        for at in range(0, len(starts), 4096):  # bounds the memory of very many starts
            some = starts[at : at + 4096]
            ok = np.ones(len(some), bool)
            for p, size in phrases:  # a phrase that begins and ends within the template's reach
                k = np.searchsorted(p, np.maximum(0, some - s.slack))
                ok &= (k < len(p)) & (p[np.minimum(k, len(p) - 1)] + size <= some + n + s.slack)
            some = some[ok]
            if not len(some):
                continue
            near = np.zeros((len(some), n), bool)
            spot = some[:, None] + np.arange(n) + n + s.slack
            for e in range(-s.slack, s.slack + 1):
                near |= (padded[spot + e] == w) & real[spot + e]
            best = max(best, float(near.mean(1).max()))
        return best if best >= s.coverage else 0.0


def places(words: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the words of the phrase stand in a row."""
    n = len(words) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(words[:n] == phrase[0])
    for j in range(1, len(phrase)):
        at = at[words[at + j] == phrase[j]]
    return at


_FIELDS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document.

    base_labels and labels are empty strings where there are none. score is the coverage of the
    best template, at least ``base_score`` where a base phrase stands, else 0. A null text is
    empty. A null doc_id stays null; every row is judged by itself, repeated ones alike. An
    empty table gives an empty table. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(settings)
        for batch in batches:
            for lo, hi, buf, offsets in slices(batch, "text"):
                buf = LOWER[buf]
                starts, ends, first = spans(buf, offsets, NON_ALNUM)
                words = hash_spans(buf, starts, ends)
                base: dict[int, list] = {}
                for phrase, label in index.base:
                    at = places(words, phrase)
                    doc = np.searchsorted(first, at, "right") - 1
                    inside = at + len(phrase) <= first[doc + 1]
                    for d, p in zip(doc[inside].tolist(), (at - first[doc])[inside].tolist(), strict=True):
                        base.setdefault(d, []).append((p, label))
                hits = index.lookup(words)
                doc = np.searchsorted(first, hits, "right") - 1
                labels: dict[int, dict] = {}
                edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]])) if len(doc) else np.zeros(1, np.int64)
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    d = int(doc[a])
                    found = index.match(words[first[d] : first[d + 1]], hits[a:b] - first[d])
                    if found:
                        labels[d] = found
                rows = []
                for d, n in enumerate(np.diff(first).tolist()):
                    b, m = base.get(d, []), labels.get(d, {})
                    own = sorted({x[1] for x in b})
                    score = max([settings.base_score if b else 0.0, *m.values()])
                    rows.append((n, len(b), min(b)[0] if b else None, max(b)[0] if b else None, ",".join(own), ",".join(sorted({*own, *m})), score))
                types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *cols], names=[f.split()[0] for f in _FIELDS.split(", ")])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _FIELDS)
