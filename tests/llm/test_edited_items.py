"""Edited benchmark items are found down to the similarity that counts as a leak."""

import random

from examlattice.llm import decontam
from examlattice.llm._text import NOT_ALNUM, words


def edited(r, item, how):
    w = item.split()
    for at in {"one": [r.randrange(len(w))], "ends": [0, len(w) - 1], "last": [len(w) - 1, len(w) - 2], "none": []}[how]:
        w[at] = r.choice(("internationalisation", "x", "something"))
    if how == "none":
        del w[r.randrange(len(w))]
    return " ".join(w)


def test_edited_items_equal_brute_force(spark):
    import pyarrow as pa

    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.choice((1, 2, 2, 3, 4, 5, 6, 8, 11))))
    items = [" ".join(word() for _ in range(r.randrange(15, 60))) for _ in range(60)] + ["a b a b a b a b a b a b a b a b", "one two three"]
    texts = [f"{word()} {word()} {edited(r, x, how)} {word()} {word()}" for x in items for how in ("one", "ends", "last", "none")] + ["a b " * 40, "one two three one two", ""]
    want = {}
    split = [words(pa.array([x]), NOT_ALNUM) for x in items]
    for d, text in enumerate(texts):
        t = words(pa.array([text]), NOT_ALNUM)
        for i, w in enumerate(split):
            n = len(w.hash)
            near = [(decontam.similarity(decontam.weighted_shingles(t.hash[b : b + n], t.length[b : b + n], 5), decontam.weighted_shingles(w.hash, w.length, 5)), -b) for b in range(len(t.hash) - n + 1)] if set(t.hash) & set(w.hash) else []
            if near and max(near)[0] >= 0.8:
                want[d, i] = max(near)
    found = decontam.leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    got = {(x.doc_id, x.item_id): (x.similarity, -x.first_word) for x in found.collect()}
    print("leaks by brute force", len(want), "found", len(set(got) & set(want)))
    assert got == want and len(want) > 100
