"""The stages of the corpus pipeline against brute force, on odd rows, and one after the other."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from examlattice.llm import packing
from examlattice.llm.queries import tokenizer_path
from test_operators import brute_components, near_texts, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "the quick surveyor measured seventeen narrow bridges before the northern garrison finally surrendered its ancient brass telescope"
STAGES = dict(pipeline.STAGES)


def rows():
    out = [(i, prose("en" if i % 2 else "fr", 60, i), "en" if i % 2 else "fr") for i in range(40)]
    out += [(100 + i, t, "en") for i, t in enumerate(near_texts(30, 3, 8))]
    out += [(200, out[4][1], "fr"), (201, None, "en"), (202, "", None), (203, "12 34 !!", None), (204, prose("en", 20_000, 5), "en"), (205, "Mr John Smith wrote to john@smith.org about the house and people.", "en"), (None, "the house of the people and the water", "en"), (None, "the house of the people and the water", "en"), (6, out[6][1], "fr")]
    out += [(300, f"{prose('en', 30, 91)} {ITEM} {prose('en', 30, 92)}", "en"), (301, f"{prose('en', 9, 93)} {ITEM.rsplit(' ', 1)[0]} spyglass end", "en"), (302, ITEM.rsplit(" ", 9)[0], "en")]
    return [(*r, "web", None if r[1] is None else len(r[1])) for r in out]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def counted(df):
    out = {}
    for r in df.collect():
        out[tuple(r)] = out.get(tuple(r), 0) + 1
    return out


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stages_keep_the_columns_and_take_empty_tables(spark, folder, name):
    empty = docs(spark).where("doc_id = -1")
    found = STAGES[name](spark, empty, folder)
    assert found.columns == pipeline.COLUMNS and found.count() == 0


def test_language_keeps_clean_documents(spark, folder):
    kept = counted(STAGES["language ID"](spark, docs(spark), folder))
    gone = {r[0] for r in rows()} - {r[0] for r in kept}
    assert {201, 202, 203} <= gone and not gone & set(range(40)) and sum(n for r, n in kept.items() if r[0] is None) == 2 and sum(n for r, n in kept.items() if r[0] == 6) == 2


def test_near_duplicates_leave_one_of_each_group(spark, folder):
    texts = {r[0]: r[1] for r in rows() if r[0] is not None}
    want = sorted(i for i, (_, root) in brute_components(texts, 5, 80).items() if i == root)
    found = [r.doc_id for r in STAGES["MinHash near-dedup"](spark, docs(spark), folder).collect()]
    assert sorted(i for i in found if i is not None) == want and found.count(None) == 2


def test_leaks_go(spark, folder):
    kept = counted(STAGES["benchmark decontamination"](spark, docs(spark), folder))
    assert {r[0] for r in rows()} - {r[0] for r in kept} == {300, 301} and sum(kept.values()) == len(rows()) - 2


def test_private_data_goes(spark, folder):
    kept = {r.doc_id: r for r in STAGES["PII"](spark, docs(spark), folder).collect() if r.doc_id is not None}
    before = {r[0]: r for r in rows()}
    assert all(tuple(kept[i]) == before[i] for i in before if i not in (None, 205))
    assert "Smith" not in kept[205].text and "@smith.org" not in kept[205].text and kept[205].n_chars == len(kept[205].text)


def check_packing(found, texts, length=4096):
    """Every id of every document stands in one piece, and sequences have no gaps."""
    own = packing.Encoder(tokenizer_path("word_bpe_49k.json")).tokenizer
    pieces, sequences = {}, {}
    for r in found:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 2]
        own_pieces = sorted(pieces[i], key=lambda r: r.start)
        assert [r.start for r in own_pieces] == [sum(x.length for x in own_pieces[:k]) for k in range(len(own_pieces))] and sum(r.length for r in own_pieces) == len(ids) == own_pieces[0].doc_tokens
        for r in own_pieces:
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[r.start : r.start + r.length]))
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:k]) for k in range(len(s))] and sum(r.length for r in s) <= length
    return len(sequences)


def test_packing_is_whole(spark, folder):
    some = docs(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    check_packing(STAGES["packing"](spark, some, folder).collect(), {r.doc_id: r.text for r in some.collect()})


def test_the_stages_in_a_row(spark, folder):
    found = pipeline.run(spark, folder).where("doc_id IS NOT NULL").collect()
    kept = {r.doc_id for r in found}
    texts = {r[0]: r[1] for r in rows() if r[0] is not None}
    roots = brute_components({i: t for i, t in texts.items() if i not in (201, 202, 203)}, 5, 80)
    assert kept == {i for i, (_, root) in roots.items() if i == root} - {300, 301}
    assert random.Random(1).sample(sorted(kept), 3)
    spark.createDataFrame(rows(), SCHEMA).where("doc_id = -1").write.mode("overwrite").parquet(f"{folder}/none/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.mode("overwrite").parquet(f"{folder}/none/benchmark.parquet")
    assert pipeline.run(spark, f"{folder}/none").count() == 0
