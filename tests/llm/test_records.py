"""Record files: an exact round trip, ids equal to the tokenizer's, damage found, lost attempts ignored."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from examlattice.llm import records

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = ["abcdefghij", "ABCXYZ", "éÉçßœŸñ", "0123456789", "'s'T'll", ".,;:!?-_()[]", "\u00a0\u2003\u3000\u2028", "\u0301", "русский", "中文字", "\x01\x02\x1c\x1f\x7f\x85", "\u200b\ufeff\u180e\u2060", "١٢²½Ⅷ", "😀"]


def texts(seed, n):
    r = random.Random(seed)
    out = ["", " ", "  ", "\n", " \n a  b \n\n c ", "don't I'LL they'd", "a <|endoftext|> b", "x" * 3000, "tab\tand\r\nline  "]
    for _ in range(n):
        out.append("".join(r.choice([" ", "\n", "\t", "  ", " \n", "\n "]) if r.random() < 0.2 else r.choice(ALPHABET[r.choice([0, 0, 0, 1, 2, r.randrange(len(ALPHABET))])]) for _ in range(r.randrange(150))))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_ids_are_the_tokenizers(seed):
    own = records.Encoder(PATH)
    some = texts(seed, 300)
    for text, packed in zip(some, own.encode(some)):
        assert np.frombuffer(packed, "<u2").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    assert all(len(k) <= records.LONGEST for k in [*own.known, *own.spaced])


def brute(rows):
    from tokenizers import Tokenizer

    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def digest(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.c) for r in df.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("c")).collect()), key=lambda x: x[1])


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    rows = list(zip(r.sample(range(-50, 2000), 300), texts(7, 291)))
    return rows + [(None, "no id"), (2001, None), (2002, "word " * 200_000), (-(2**63), "least"), (2**63 - 1, "most")]


def test_round_trip(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr(records, "CHUNK", 1 << 12)
    table = spark.createDataFrame([(*x, 1, "x", "y") for x in rows], "doc_id long, text string, start int, ids string, t string").repartition(7)
    folder = str(tmp_path / "r")
    manifest = records.write(table, folder, PATH)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    want = brute(rows)
    assert digest(records.read(spark, folder)) == want
    one, again, other = (records.read_shuffled(spark, folder, seed) for seed in (1, 1, 2))
    assert digest(one) == want
    order = [[r.doc_id for r in x.collect()] for x in (one, again, other)]
    assert order[0] == order[1] != order[2] and order[0] != sorted(order[0], key=lambda x: (x is not None, x or 0))
    assert {r.place for r in one.collect()}.__len__() == len(rows)
    with pytest.raises(Exception, match="exists"):
        records.write(table, folder, PATH)


def test_repeated_rows_and_empty_tables(spark, tmp_path):
    table = spark.createDataFrame([(4, "same"), (4, "same"), (4, "other"), (1, "b")], "doc_id long, text string")
    records.write(table, str(tmp_path / "a"), PATH)
    found = digest(records.read(spark, str(tmp_path / "a")))
    assert [x[:3] for x in found if x[0] == 1] == [(1, 0, 2)] and len(found) == 4 and [x[1] for x in found] == np.cumsum([0, *[x[2] for x in found]])[:-1].tolist()
    records.write(table.where("doc_id = 0"), str(tmp_path / "b"), PATH)
    assert records.read(spark, str(tmp_path / "b")).count() == 0 == records.read_shuffled(spark, str(tmp_path / "b"), 1).count()


def test_damage_and_left_overs(spark, tmp_path):
    folder = tmp_path / "r"
    records.write(spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string").coalesce(1), str(folder), PATH)
    (folder / "000000-999-0000.rec").write_bytes(b"a lost attempt")
    assert records.read(spark, str(folder)).count() == 20
    shard = next(p for p in folder.glob("*.rec") if "-999-" not in p.name)
    data = bytearray(shard.read_bytes())
    data[40] ^= 1
    shard.write_bytes(data)
    with pytest.raises(Exception, match="damaged record"):
        records.read(spark, str(folder)).collect()


def test_shards_end(tmp_path, monkeypatch):
    shard = records.Shard(f"file://{tmp_path}", "s")
    for i in range(3):
        shard.add(None if i == 1 else i, b"ab" * i, 2)
    name, n, tokens, size = shard.close()
    assert (n, tokens, size) == (3, 3, (tmp_path / "s.rec").stat().st_size)
    assert records.masked(b"") == 0xA282EAD8


def test_each_distinct_word_of_a_call_is_looked_up_once(monkeypatch):
    looked = []

    class Counted(dict):
        def get(self, *x):
            looked.append(x[0])
            return super().get(*x)

    own = records.Encoder(PATH)
    own.code = Counted()
    some = ["one two, two\nthree " + "x" * 100 + " two, two é été. don't's"] * 50 + ["  odd\ttext  "] * 50
    want = [own.tokenizer.encode(t, add_special_tokens=False).ids for t in some]
    for _ in range(2):
        assert [np.frombuffer(p, "<u2").tolist() for p in own.encode(some)] == want
    assert len(looked) < 40
    monkeypatch.setattr(records, "CACHED", 40)  # what is kept stays bounded, and what comes back is right
    for n in range(60):
        some = [" ".join(f"w{n}" + "abcdefgh"[i] * (1 + i % 3) + ".," [i % 2] for i in range(8)), "the same words"]
        assert [np.frombuffer(p, "<u2").tolist() for p in own.encode(some)] == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in some]
        assert len(own.code) <= 60
    assert "same" in own.code
