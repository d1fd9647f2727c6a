"""Spelling variants against a comparison of every pair of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from examlattice.llm import spelling
from examlattice.llm._store import Scratch


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_vocabulary(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 199 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def brute_group(words):
    form, near = {}, {}
    for w in words:
        near[w] = [x for x in words if one_edit(w, x)]
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def result(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def vocabulary(r, count, longest=12, letters="abcdeé\u00d7"):
    words = {}
    while len(words) < count:
        w = "".join(r.choice(letters) for _ in range(r.randrange(1, longest)))
        for _ in range(5):
            words[w] = r.choice([5, 6, 24, 25, 26, 130, 700, 10**6])
            i = r.randrange(len(w) + 1)
            w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1 :]]) or "a"
    return words


@pytest.mark.parametrize(("seed", "slice_bytes", "longest"), [(0, 32 << 20, 12), (1, 8 * spelling.CHUNK, 12), (2, 32 << 20, 3), (3, 8 * spelling.CHUNK, 90)])
def test_groups_are_those_of_all_pairs(spark, seed, slice_bytes, longest):
    words = vocabulary(random.Random(seed), 600, longest)
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert result(spelling.group(table, slice_bytes=slice_bytes)) == brute_group(words)


def test_many_slices_find_what_one_does(spark):
    words = vocabulary(random.Random(9), 12_000, 9, "abcdefghijklm")
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)
    one, many = (result(spelling.near(table, Scratch(spark, "t"), slice_bytes=b).selectExpr("word", "other form", "other root", "other_n n", "1 n_near", "1 form_n")) for b in (32 << 20, 8 * spelling.CHUNK))
    assert one == many and len(one) > 1000


def test_long_chains_end_at_their_root(spark):
    words = {"a" * 6 + "b" * i: 5 ** (i + 1) for i in range(12)}
    assert result(spelling.group(spark.createDataFrame(list(words.items()), "word string, n long"))) == brute_group(words)
    assert {r.root for r in spelling.group(spark.createDataFrame(list(words.items()), "word string, n long")).collect()} == {"a" * 6 + "b" * 11}


def test_whole_texts_and_odd_rows(spark):
    r = random.Random(4)
    base = ["Straße", "ÉCOLES", "letter", "lettres", "balloon", "K\u212aelvin", "naïveté", "x×y÷zz", "people"]
    docs = [(i, " ".join(r.choice(base) for _ in range(60)) + r.choice(["", "\u03a3ΑΣ letter", " don't"])) for i in range(120)]
    docs += [(None, "letter people people"), (500, None), (501, ""), (3, docs[3][1]), (3, docs[3][1]), (502, "q" * 300_000 + " " + "letter " * 20_000)] + [(600 + i, "w" * 5000) for i in range(6)] + [(700 + i, "w" * 2500 + "v" + "w" * 2499) for i in range(40)]
    table = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id long, text string, word string, n long, h int")
    want = brute_vocabulary(docs)
    assert {(x.word, x.n) for x in spelling.counts(spelling.slipped(spelling.runs(table))).collect()} == set(want.items())
    assert result(spelling.variants(table)) == brute_group(want)
    assert any(len(w) == 5000 for w in want)
    assert spelling.variants(table.where("doc_id = -1")).count() == 0
