"""Licence notices: phrases, and templates found by a positional index of their rare words.

The words of all templates get an inverse document frequency over all documents. A template is posted under its rarest words, with
their positions, as many as hold more of its weight than a place of it may lack. In a document every such word tells where the
templates that hold it would begin; postings that agree on a beginning add up, and only where they hold enough weight together can the
template stand. What is left is verified last: a mandatory key phrase in full, and the weighted share of equal words. However many
notices or licence words a document holds, none is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import NOT_ALNUM, chunks, word_hashes, words

# Phrases with their labels; templates as (label, text, mandatory key phrases).
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license version"]),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["in compliance with the license"]),
    ("gpl", "this work is licensed under the gnu general public license version", ["gnu general public license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ["gnu general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["to deal in the software without restriction", "this permission notice shall be included in all copies"]),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ["unless required by applicable law or agreed to in writing"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ["published by the free software foundation either version", "this program is distributed in the hope that it will be useful"]),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce the above copyright notice"]),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["may be used to endorse or promote products derived from this software"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["in no event will the authors be held liable for any damages"]),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["any person or organization obtaining a copy of the software"]),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ["eclipse public license"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", ["creative commons attribution noderivatives"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", ["to any person obtaining a copy"]),
    *[(label, f"spdx license identifier {name}", [f"spdx license identifier {name}"]) for label, name in (
        ("mit", "mit"), ("apache", "apache"), ("gpl", "gpl"), ("lgpl", "lgpl"), ("agpl", "agpl"), ("bsd", "bsd"), ("isc", "isc"), ("mpl", "mpl"), ("epl", "epl"), ("zlib", "zlib"), ("boost", "bsl"), ("unlicense", "unlicense"),
        ("cc0", "cc0"), ("cc-by-sa", "cc by sa"), ("cc-by-nd", "cc by nd"), ("cc-by-nc", "cc by nc"), ("cc-by", "cc by 4"), ("cc-by", "cc by 3"))],
    ("proprietary", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher", ["no part of this publication may be reproduced"]),
]


@dataclass
class Library:
    """Templates as word hashes."""

    labels: list[str]
    texts: list[np.ndarray]
    keys: list[list[tuple[int, int]]]  #: of each template, (position, words) of its key phrases
    vocabulary: np.ndarray

    @classmethod
    def of(cls, templates: list[tuple[str, str, list[str]]]) -> Library:
        texts = [word_hashes(text, NOT_ALNUM) for _, text, _ in templates]
        keys = []
        for text, (label, _, phrases) in zip(texts, templates):
            places = []
            for p in phrases:
                h = word_hashes(p, NOT_ALNUM)
                at = [i for i in range(len(text) - len(h) + 1) if (text[i : i + len(h)] == h).all()]
                if not at:
                    raise ValueError(f"{label}: the template does not hold its key phrase {p!r}")
                places.append((at[0], len(h)))
            keys.append(places)
        return cls([label for label, _, _ in templates], texts, keys, np.unique(np.concatenate(texts)))

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's place in the vocabulary, or -1."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)


#: Weight that a template's postings hold at least, beyond what a place may lack.
BEYOND = 0.2


class Scanner:
    """A place of a template lacks 1 - least of its weight at most. So of postings that hold more than that, those that agree on the place hold
    the rest of their weight at least, whichever they are."""

    def __init__(self, library: Library, idf: np.ndarray, least: float):
        self.library, self.least = library, least
        self.weight = [np.maximum(idf[library.number(t)], 1e-9) for t in library.texts]
        self.postings, self.enough = [], []
        for text, weight in zip(library.texts, self.weight):
            order = np.argsort(-weight, kind="stable")
            held = np.cumsum(weight[order])
            n = int(np.searchsorted(held, min(1.0, 1 - least + BEYOND) * weight.sum() * (1 - 1e-12))) + 1
            chosen = order[:n]
            self.postings.append(list(zip(library.number(text[chosen]).tolist(), chosen.tolist())))
            self.enough.append(float(weight[chosen].sum() - (1 - least) * weight.sum()))

    def find(self, hashes: np.ndarray, doc: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(document, template, weighted share) of each verified place: all that laying each template everywhere would find."""
        number = self.library.number(hashes)
        own = np.flatnonzero(number >= 0)
        own = own[np.argsort(number[own], kind="stable")]
        begin = np.searchsorted(number[own], np.arange(len(self.library.vocabulary) + 1))
        for t, postings in enumerate(self.postings):
            text, weight = self.library.texts[t], self.weight[t]
            places = [own[begin[word] : begin[word + 1]] for word, _ in postings]
            if not sum(map(len, places)):
                continue
            # a place is a document and a beginning, which may lie before the document's own
            width = len(hashes) + len(text)
            key = np.concatenate([doc[x] * width + (x - at + len(text)) for x, (_, at) in zip(places, postings)])
            found, which = np.unique(key, return_inverse=True)
            held = np.bincount(which, np.concatenate([np.full(len(x), weight[at]) for x, (_, at) in zip(places, postings)]))
            found = found[held >= self.enough[t] - 1e-9]
            d, start = found // width, found % width - len(text)
            phrase = np.zeros(len(found), bool)
            for p, k in self.library.keys[t]:
                fits = (start + p >= first[d]) & (start + p + k <= first[d + 1])
                for j in range(p, p + k):
                    fits &= hashes[np.clip(start + j, 0, len(hashes) - 1)] == text[j]
                phrase |= fits
            d, start = d[phrase], start[phrase]
            share = np.zeros(len(start))
            for j in range(len(text)):
                inside = (start + j >= first[d]) & (start + j < first[d + 1])
                share += weight[j] * (inside & (hashes[np.clip(start + j, 0, len(hashes) - 1)] == text[j]))
            share /= weight.sum()
            for x, s in zip(d, share):
                if s >= self.least - 1e-12:
                    yield int(x), t, min(1.0, float(s))


def document_frequencies(docs: DataFrame, library: Library) -> tuple[np.ndarray, int]:
    """Of each word of the templates the number of documents that hold it, and the number of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(len(library.vocabulary), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, texts in chunks(batch.column("text")):
                w = words(texts, NOT_ALNUM)
                number = library.number(w.hash)
                own = np.unique(w.doc()[number >= 0] * len(counts) + number[number >= 0])
                counts += np.bincount(own % len(counts), minlength=len(counts))
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(counts)), -1], pa.int32()), pa.array([*counts, n], pa.int64())], ["word", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = {r.word: r.n for r in found}
    return np.array([out.get(k, 0) for k in range(len(library.vocabulary))]), out.get(-1, 0)


def scan(docs: DataFrame, *, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str, list[str]]] = TEMPLATES, least: float = 0.6) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of docs(doc_id, text).

    n_base: all places of the phrases; first_word, last_word: the smallest and largest number of a word where one begins. labels:
    those of phrases and of templates found. score: the best template's share, 0 without one. Null text counts as empty. least:
    share that a template needs.
    Other columns are ignored; repeated rows give repeated results.
    """
    spark = docs.sparkSession
    library = Library.of(templates)
    frequency, n = document_frequencies(docs, library)
    idf = np.log((n + 2) / (frequency + 1))
    shared = spark.sparkContext.broadcast((Scanner(library, idf, least), [(word_hashes(p, NOT_ALNUM), label) for p, label in phrases]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, known = shared.value
        for batch in batches:
            for at, texts in chunks(batch.column("text")):
                w = words(texts, NOT_ALNUM)
                doc, size = w.doc(), len(texts)
                places = np.zeros(size, np.int64)
                low, high = np.full(size, np.iinfo(np.int64).max), np.full(size, -1)
                base: list[set] = [set() for _ in range(size)]
                for h, label in known:
                    hit = np.flatnonzero(w.hash[: len(w.hash) - len(h) + 1] == h[0]) if len(w.hash) >= len(h) else np.empty(0, int)
                    for j in range(1, len(h)):
                        hit = hit[w.hash[hit + j] == h[j]]
                    hit = hit[doc[hit] == doc[hit + len(h) - 1]]
                    places += np.bincount(doc[hit], minlength=size)
                    own = hit - w.first[doc[hit]]
                    np.minimum.at(low, doc[hit], own)
                    np.maximum.at(high, doc[hit], own)
                    for d in np.unique(doc[hit]):
                        base[d].add(label)
                more: list[set] = [set(b) for b in base]
                score = np.zeros(size)
                for d, t, share in scanner.find(w.hash, doc, w.first):
                    more[d].add(library.labels[t])
                    score[d] = max(score[d], share)
                none = places == 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, size), pa.array(np.diff(w.first)), pa.array(places), pa.array(low, mask=none), pa.array(high, mask=none), pa.array([",".join(sorted(b)) for b in base], pa.string()), pa.array([",".join(sorted(b)) for b in more], pa.string()), pa.array(score)],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
