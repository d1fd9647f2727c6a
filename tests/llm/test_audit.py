"""The filter audit against counts made from every document, order and step, and its micro-batches against any order of arrival."""

import itertools
import random
import re
from collections import Counter

import pytest

from examlattice.llm import audit

SCHEMA = "doc_id long, text string, lang string, state int, row string, digest long"


def texts(r):
    words = ["alpha", "beta", "Gamma", "delta", "x%", "NOISE", "é", "\u2003"]
    out = [None, "", " ", "\n\t a  b ", "same text", "A", "\u000b\f", "a" * 100_000, "word " * 50_000]
    for _ in range(20):
        pool = r.sample(words, r.randrange(1, len(words)))
        out.append(r.choice(["", " ", "\n"]) + r.choice([" ", "  ", "\t"]).join(r.choice(pool) + (str(i) if r.random() < 0.4 else "") for i in range(r.choice([1, 5, 199, 200, 201, 450]))) + r.choice(["", " "]))
    return out


def brute(rows, labels):
    flags = {}
    for i, q, t in labels:
        if i is not None:
            a, b = flags.get(i, (0, 0))
            flags[i] = (max(a, int(q == 1)), max(b, int(t == 1)))
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    found = {}
    for i, text, part, *_ in rows:
        t = text or ""
        words = re.findall("[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        good, toxic = flags.get(i, (0, 0))
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                c = found.setdefault((part or "", "".join(order), step), Counter())
                c["kept"] += not gone and not fails[f]
                c["removed"] += not gone and fails[f]
                c["redundant"] += gone and fails[f]
                c["unique_fails"] += fails[f] and sum(fails.values()) == 1
                c["good_lost"] += not gone and fails[f] and good
                c["toxic_lost"] += not gone and fails[f] and toxic
                gone = gone or fails[f]
    sums = Counter()
    for (part, order, step), c in found.items():
        sums[part, order[step - 1]] += c["removed"]
    return {(part, order, step, *[c[x] for x in audit.COUNTS[:-1]], sums[part, order[step - 1]]) for (part, order, step), c in found.items()}


@pytest.mark.parametrize("seed", range(2))
def test_every_order_and_step(spark, tmp_path, seed):
    r = random.Random(seed)
    some = texts(r)
    ids = list(range(120)) + [None, None, 5, 5]
    rows = [(i, r.choice(some), r.choice(["en", "fr", None, "", "two words"]), 1, "x", 2) for i in ids]
    rows += rows[:3]  # repeated rows
    r.shuffle(rows)
    for n in range(6):  # smaller ids arrive after larger ones
        spark.createDataFrame(rows[n::6], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    labels = [(r.choice(ids), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(80)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for files in (1, 6):
        counted = audit.counters(spark, str(tmp_path / "documents.parquet"), table, files=files)
        assert {tuple(x) for x in audit.interactions(counted).collect()} == brute(rows, labels)


def test_no_documents(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(audit.counters(spark, path, labels)).count() == 0
