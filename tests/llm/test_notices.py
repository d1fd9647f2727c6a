"""Every licence notice of a file is found."""

import re

import numpy as np

from examlattice.llm import licenses


def brute_labels(text, idf):
    """Labels by laying every template at every place."""
    w, found = re.findall("[a-z0-9]+", text.lower()), set()
    for label, template, phrases in licenses.TEMPLATES:
        t = template.split()
        places = []
        for p in phrases:
            k = p.split()
            i = next(i for i in range(len(t)) if t[i : i + len(k)] == k)
            places.append((i, i + len(k)))
        for b in range(-len(t) + 1, len(w)):
            equal = [0 <= b + j < len(w) and w[b + j] == x for j, x in enumerate(t)]
            share = sum(idf[x] for x, e in zip(t, equal) if e) / sum(idf[x] for x in t)
            if share >= 0.6 and any(all(equal[i:j]) for i, j in places):
                found.add(label)
    return found | {label for p, label in licenses.PHRASES if f" {p} " in f" {' '.join(w)} "}


def test_many_notices_and_long_prose_equal_brute_force(spark):
    t = [x for _, x, _ in licenses.TEMPLATES]
    texts = [f"{a}. some words between. {b}" for a in t for b in t if a != b] + t
    texts += ["provided charge permission international conditions binary of the " * 50 + x for x in t]
    texts += [" ".join("other" if j == 3 else w for j, w in enumerate(x.split())) for x in t] + [" ".join(x.split()[1:]) for x in t] + [" ".join(x.split()[:-2]) for x in t]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    library = licenses.Library.of(licenses.TEMPLATES)
    frequency, n = licenses.document_frequencies(docs, library)
    words = sorted({w for x in t for w in x.split()})
    number = library.number(np.concatenate([licenses.word_hashes(w, licenses.NOT_ALNUM) for w in words]))
    idf = dict(zip(words, np.log((n + 2) / (frequency[number] + 1))))
    found = {r.doc_id: set(filter(None, r.labels.split(","))) for r in licenses.scan(docs).collect()}
    assert found == {i: brute_labels(x, idf) for i, x in enumerate(texts)}


def test_identifiers_and_first_sentences(spark):
    texts = {"// SPDX-License-Identifier: GPL-3.0-only": "gpl", "# SPDX-License-Identifier: BSD-3-Clause": "bsd", "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit", "SPDX license": "", "obtaining a copy of it": ""}
    found = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [found[i] for i in range(len(texts))] == list(texts.values())


def test_postings_hold_more_than_a_place_may_lack(spark):
    library = licenses.Library.of(licenses.TEMPLATES)
    scanner = licenses.Scanner(library, np.linspace(0.1, 9, len(library.vocabulary)), 0.6)
    for text, weight, postings, enough in zip(library.texts, scanner.weight, scanner.postings, scanner.enough):
        assert enough > 0 and sum(weight[at] for _, at in postings) >= 0.6 * weight.sum() - 1e-6 and len(postings) < len(text) or len(text) < 8
