"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from examlattice.llm import decontam, langid, licenses, neardup, packing, pii, secrets, tokencount, topk, urlfilter
from examlattice.llm.queries import tokenizer_path

LONG = " ".join(f"word{i % 977}, mail{i}@x.org token=abcdef{i}" for i in range(12_000))
TEXTS = [(1, "The MIT License and a house"), (2, None), (3, ""), (4, " \n"), (5, LONG), (6, "same text of six plain words"), (6, "same text of six plain words"), (7, "same text of six plain words"), (None, "no id at all"), (8, "\u0000\ud7ff \U0001f600 \u0301")]
CLASH = ("lang_pred", "secrets", "pii", "labels", "score", "host", "verdict", "__t", "__base", "__terms", "__rule", "__lang", "__pii_id", "bin", "rank", "salt", "tokens", "set", "gid", "comp", "similarity", "length", "word", "c", "q", "dim", "asks", "v2")


def table(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return docs.select("*", F.lit("en").alias("lang"), *[F.lit("x").alias(c) for c in CLASH])


def operators(spark):
    items = spark.createDataFrame([(1, "same text of six plain words"), (2, None)], "item_id long, text string").withColumn("similarity", F.lit(1))
    return {
        "langid": lambda d: langid.identify(d, langid.fit(d)), "secrets": secrets.scan, "neardup": neardup.near_duplicates, "urls": lambda d: urlfilter.judge(d.withColumn("url", F.col("text"))),
        "decontam": lambda d: decontam.clean(d, items), "tokens": lambda d: d.select("doc_id", tokencount.token_count(F.col("text"), tokenizer_path("piece_bpe_32k.model")).alias("n")),
        "pii": lambda d: pii.pseudonymise(d, "k"), "licenses": licenses.scan, "packing": lambda d: packing.pack(d, tokenizer_path("word_bpe_49k.json")),
    }


NAMES = ["langid", "secrets", "neardup", "urls", "decontam", "tokens", "pii", "licenses", "packing"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, name):
    run = operators(spark)[name]
    found = run(table(spark)).collect()
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
    if name == "decontam":
        assert set(by_id) == {1, 2, 3, 4, 5, 8, None}
        return
    assert set(by_id) == {i for i, _ in TEXTS}
    if name != "packing":
        assert len(found) == len(TEXTS)
        a, b = by_id[6]
        assert a == b
    values = {i: x[0].asDict() for i, x in by_id.items()}
    if name == "tokens":
        assert values[2]["n"] == values[3]["n"] == 0 < values[5]["n"]
    if name == "secrets":
        assert values[2]["secrets"] == values[3]["secrets"] == [] and len(values[5]["secrets"]) >= 12_000
    if name == "pii":
        assert values[2]["text"] is None and values[3]["text"] == "" and values[5]["pii"]["email"] == 12_000 and values[1]["text"] == TEXTS[0][1]
    if name == "licenses":
        assert (values[2]["n_words"], values[1]["base_labels"], values[3]["labels"]) == (0, "mit", "")
    if name == "packing":
        assert values[2]["doc_tokens"] == values[3]["doc_tokens"] == 1 and len(by_id[6]) == 2
    if name == "neardup":
        assert values[7]["component_id"] == 6 and values[2]["n_shingles"] == 0 and values[None]["kept"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, name):
    assert operators(spark)[name](table(spark).where("doc_id = -1")).count() == 0


def test_urls_without_words(spark):
    pages = spark.createDataFrame([(1, "http://a.com/porn-x", "h", "t")], "page_id long, url string, __host string, host string")
    row = urlfilter.judge(pages, strict=[], soft=[]).first()
    assert (row.verdict, row.n_strict, row["__host"], row.host) == ("allow", 0, "h", "a.com")
    assert urlfilter.judge(pages).first().verdict == "block"


def test_vectors(spark):
    rows = [(1, [1, 2]), (2, []), (3, None), (4, [1, None]), (5, [3, 4]), (5, [3, 4]), (6, [1, 2, 3]), (None, [1, 1]), (7, [-5, 0])]
    v = spark.createDataFrame(rows, "vec_id long, v array<long>").withColumn("c", F.lit("x"))
    found = {}
    for r in topk.top_k(v, v.where("vec_id IN (1, 2, 5, 6)"), k=5).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {q: sorted(x) for q, x in found.items()} == {1: [(1, 5, 11), (2, 5, 11), (3, 7, -5)], 5: [(1, 1, 11), (2, 7, -15)]}
    assert topk.top_k(v.where("vec_id = -1"), v, k=5).count() == 0 and topk.top_k(v, v.where("vec_id = -1"), k=5).count() == 0
