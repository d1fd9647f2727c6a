"""Inputs at the ends of their range: names of very many labels, and vectors of any finite size."""

import random

import pytest
from pyspark.sql import functions as F

from examlattice.llm import pii, topk

N = 10**6


def test_entities_of_any_length(spark):
    texts = {1: "x@" + "a." * N + "1", 2: "x@" + "a." * N + "com", 3: "y" * N + "@a.com", 4: "Mr " + "B" + "c" * 60 + " said", 5: "Mr " + "Abc'-" * N, 6: "x@" * N, 7: "a@b.com and A@B.com"}
    rows = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "k").collect()}
    assert {i: r.pii for i, r in rows.items()} == {1: {}, 2: {"email": 1}, 3: {"email": 1}, 4: {"person": 1}, 5: {"person": 1}, 6: {}, 7: {"email": 2}}
    assert rows[1].text == texts[1] and rows[6].text == texts[6]
    assert len(rows[3].text) > N and rows[4].text.startswith("Mr ") and "ccc" not in rows[4].text and rows[4].text.endswith(" said")
    a, b = rows[7].text.split(" and ")
    assert a == b


def brute(vectors, queries, k):
    out = set()
    for q, v in queries:
        scored = sorted(((-sum(int(a) * int(b) for a, b in zip(v, w)), i) for i, w in vectors if i != q))
        out |= {(q, n + 1, i, str(-s)) for n, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_large_components_are_exact(spark, seed):
    r = random.Random(seed)
    sizes = [1, 300, 4 * 10**5, 10**12, 2**53, 10**30]
    rows = [(i, [float(int(r.uniform(-1, 1) * r.choice(sizes))) for _ in range(4)]) for i in range(60)]
    rows += [(100 + i, v) for i, (_, v) in enumerate(rows[:10])]  # ties
    v = spark.createDataFrame(rows, "vec_id long, v array<double>")
    found = topk.top_k(v, v.where("vec_id % 3 = 0"), k=5).collect()
    assert {(x.query_id, x["rank"], x.vec_id, x.digits) for x in found} == brute(rows, [x for x in rows if x[0] % 3 == 0], 5)
    assert all(x.score == min(max(int(x.digits), -(2**63)), 2**63 - 1) for x in found)


def test_quantised_values_are_whole_and_exact(spark):
    e = spark.createDataFrame([(1, [0.5, -0.001, 4e5]), (2, [1e300, 1.0, 0.0]), (3, [float("nan"), 1.0, 1.0]), (4, [1.7e308, 1.0, 1.0]), (5, [1.0, None, 1.0])], "vec_id long, embedding array<double>")
    found = {r.vec_id: r.v for r in topk.quantised(e).collect()}
    assert found == {1: [128.0, -1.0, 4e5 * 256], 2: [1e300 * 256, 256.0, 0.0]}
    found = topk.top_k(topk.quantised(e), topk.quantised(e).where(F.col("vec_id") == 1), k=5).collect()
    assert [(r.vec_id, r.digits) for r in found] == [(2, str(int(1e300 * 256) * 128 - 256))]
