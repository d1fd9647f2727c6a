"""Shapes that tell whether an operator's work stays bounded: very many matches, full spaces, dense vectors, real tables."""

import time

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from examlattice.llm import neardup, pii, secrets, topk
from examlattice.llm._text import chunks


def test_a_text_of_100_000_secrets(spark):
    n = 100_000
    text = "token=abcdef1 " * n
    began = time.time()
    row = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.size("secrets").alias("n"), F.element_at("secrets", -1).alias("last"), F.get("secrets", F.lit(49_999)).alias("mid")).first()
    assert row.n == n and (row.last.start, row.last.end) == (14 * (n - 1), 14 * n - 1) and row.mid.start == 14 * 49_999
    assert time.time() - began < 60


def test_entropy_spans_never_overlap_base_spans(spark):
    key = "Zq3vB8nLk2Wm7XtYc5Rd9Hs"
    texts = [f"x {key} y", f"token={key} and {key}", f"{key} secret: {key}", f"{key} AKIA{'A1' * 12} {key}", "sk_live_4f9a2c7e1b8d0365af42 x"]
    rows = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    found = [[(secrets.KINDS[s.rank], s.start, s.end) for s in r.secrets] for r in rows]
    assert [[k for k, _, _ in f] for f in found] == [["entropy"], ["assign", "entropy"], ["entropy", "assign"], ["entropy", "access", "entropy"], ["entropy"]]
    for f in found:
        assert all(a[2] <= b[1] for a, b in zip(f, f[1:]))


def test_surrogates_of_a_full_space_stay_distinct(spark):
    """All numbers of a short form are real, so surrogates of that form cannot be new."""
    numbers = [f"20-{a:03d}-{b:03d}" for a in range(40) for b in range(25)]
    docs = spark.createDataFrame([(i, f"call {x} now") for i, x in enumerate(numbers)], "doc_id long, text string")
    found = [r.text for r in pii.pseudonymise(docs, "k").collect()]
    assert len(set(found)) == len(numbers) and not set(found) & {f"call {x} now" for x in numbers}


def test_people_stay_distinct_and_agree_with_themselves(spark):
    people = [(given, last) for given in ("Peter", "Luke", "John", "Paul", "Mark", "Adam", "Karl", "Hans", "Otto", "Ernst", "Fritz", "Willi", "Jan", "Piet", "Kees", "Joop", "Bert", "Anton") for last in ("Smith", "Jones", "Keller")]
    docs = spark.createDataFrame([(i, f"Mr {g} {n} met Mr {n}. Mr {g} {n} left.") for i, (g, n) in enumerate(people)], "doc_id long, text string")
    names, lasts = {}, {}
    for r in pii.pseudonymise(docs, "k").collect():
        first, again = r.text.split(" met ")[0], r.text.split(". ")[1].removesuffix(" left.")
        assert first == again
        names[people[r.doc_id]] = first
        lasts.setdefault(people[r.doc_id][1], set()).add(first.split()[-1])
    assert len(set(names.values())) == len(people) and all(len(x) == 1 for x in lasts.values())


def test_top_k_stops_early_on_dense_vectors():
    r = np.random.default_rng(5)
    v = np.floor(256 * r.normal(size=(4000, 48))).astype(np.int64)
    index = topk.ImpactIndex(np.arange(4000), v)
    for own in range(0, 4000, 400):
        index.processed = 0
        ids, score = index.top_k(v[own], own, 5)
        exact = v @ v[own]
        exact[own] = -(1 << 60)
        best = np.lexsort((np.arange(4000), -exact))[:5]
        assert ids.tolist() == best.tolist() and score.tolist() == exact[best].tolist()
        assert index.processed < 0.9 * len(index.begin)


def exact_components(path, k):
    """Components of the exact similarity join, by shared shingles."""
    t = pq.read_table(path, columns=["doc_id", "text"])
    sets = [s for _, part in chunks(t["text"].combine_chunks()) for s in neardup.shingle_sets(part, k)]
    ids, root = t["doc_id"].to_pylist(), {}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        common = {}
        for h in s.tolist():
            own = holders.setdefault(h, [])
            for j in own:
                common[j] = common.get(j, 0) + 1
            own.append(i)
        for j, c in common.items():
            if 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                a, b = find(ids[i]), find(ids[j])
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates_of_a_real_table_equal_an_exact_join(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.read.parquet(path), k=4).collect()}
    assert found == exact_components(path, 4)
