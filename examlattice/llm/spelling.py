"""Spelling variants: words one edit apart, found through broadcast Bloom filters, and the commoner form that each stands for.

The vocabulary (words with their counts) is put into blocked Bloom filters, a shard for each word length; a word's bits lie in one
64-bit block. Each word generates its edits (every deletion and every replacement; an insertion is another word's deletion) as rolling
hashes, without making strings, and probes the shards of its own and the next smaller length. Only positives become strings and are
shuffled to an exact join with the vocabulary, which removes the false ones; a vocabulary word is never missed. The filters' size is
known from the counts before they are built; beyond `slice_bytes` they are broadcast in slices, one after the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import Scratch, joined
from ._text import U, mix

RUNS = r"[A-Za-zÀ-ÿ]+"
BITS, KEYS = 24, 5  #: filter bits for each word, and bits set for each; about one false positive in 2000 probes
LAST = 64  #: words of this length and beyond share a shard and leave bits in two blocks, as they probe so often
CHUNK = 1024  #: blocks of a filter that are packed by one task into one row
PROBES = 1 << 20  #: probes computed at once
_BASE = 0x9E3779B97F4A7C15
_BACK = U(pow(_BASE, -1, 1 << 64))


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else. Where all other characters keep their case anyway, the plain function does it faster."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(text.rlike(r"[^\x00-\x7Fß-ÿ]"), F.translate(text, letters, letters.lower())).otherwise(F.lower(text))


def counts(words: DataFrame, *, min_length: int = 6, min_count: int = 5) -> DataFrame:
    """(word, n) of a table of words: those of min_length code points and more that occur min_count times at least."""
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def runs(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", pattern: str = RUNS) -> DataFrame:
    """(doc_id, run): every maximal run of letters of each text, A-Z in lower case. A null text has none."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.regexp_extract_all(lowered(F.col(text)), F.lit(pattern), F.lit(0))).alias("run"))


def slipped(rows: DataFrame, every: int = 199) -> DataFrame:
    """(word): the runs, of which one in `every` loses a letter, chosen by the checksum of '<doc_id>:<run>'. A run without a doc_id
    stays whole."""
    h, at = F.col("h"), (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return rows.select("run", F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), "run")).alias("h"), F.col("doc_id").isNull().alias("whole")).select(F.when(F.col("whole") | (h % every != 0), F.col("run")).otherwise(cut).alias("word"))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(U) + U(1), np.array([len(w) for w in words])


class Layout:
    """Where the shards lie in the row of all blocks."""

    def __init__(self, by_shard: dict[int, int]):
        size, self.first, self.blocks = 0, np.zeros(LAST + 1, np.int64), np.zeros(LAST + 1, U)
        for shard, n in sorted(by_shard.items()):
            rounds = 2 if shard == LAST else 1
            self.first[shard], self.blocks[shard] = size, -(-n * BITS * rounds // 64)
            size += int(self.blocks[shard])
        self.size = size

    def places(self, sums: np.ndarray, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Block and bits of words by their polynomial sums, for each round; nothing where no word has that length."""
        shard = min(length, LAST)
        if length < 0 or not self.blocks[shard]:
            return []
        h, out = mix(sums + U(length * 0xD6E8FEB86659FD93 & (1 << 64) - 1)), []
        for _ in range(2 if shard == LAST else 1):
            bits, g = np.zeros_like(h), mix(h ^ U(0xC2B2AE3D27D4EB4F))
            for k in range(KEYS):
                bits |= U(1) << (g >> U(6 * k) & U(63))
            out.append(((h % self.blocks[shard]).astype(np.int64) + self.first[shard], bits))
            h = mix(g)
        return out


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in the list, matrix of code points) for words of one length."""
    points, sizes = _code_points(words)
    ends = np.cumsum(sizes)
    for length in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == length)
        step = max(1, PROBES // max(1, length))
        for at in range(0, len(own), step):
            some = own[at : at + step]
            yield length, some, points[(ends[some] - length)[:, None] + np.arange(length)]


def filters(vocabulary: DataFrame, layout: Layout) -> DataFrame:
    """(chunk, data): the filters' blocks, CHUNK to a row."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [p for length, _, m in _by_length(batch.column("word").to_pylist()) for p in layout.places((m * _powers(length)).sum(1, dtype=U), length)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([b for b, _ in found])), pa.array(np.concatenate([x for _, x in found]).view(np.int64))], ["block", "bits"])

    def pack(rows: pa.Table) -> pa.Table:
        block = rows.column("block").to_numpy()
        data = np.zeros(CHUNK, U)
        np.bitwise_or.at(data, block % CHUNK, rows.column("bits").to_numpy().view(U))
        return pa.table({"chunk": [int(block[0]) // CHUNK], "data": [data.tobytes()]})

    set_bits = vocabulary.select("word").mapInArrow(bits, "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits"))
    return set_bits.withColumn("chunk", F.floor(F.col("block") / CHUNK)).groupBy("chunk").applyInArrow(pack, "chunk long, data binary")


def _probe(layout: Layout, alphabet: np.ndarray, first: int, blocks):
    """Tasks that yield (word, n, other, shorter) for the edits whose blocks in the broadcast slice say yes."""

    def hits(sums: np.ndarray, length: int, data: np.ndarray) -> np.ndarray:
        """Which of the sums may be words of that length: a word must fit wherever the slice holds its blocks, and begin in the slice."""
        places = layout.places(sums, length)
        if not places:
            return np.zeros(sums.shape, bool)
        inside = (places[0][0] >= first) & (places[0][0] < first + len(data))
        out = inside
        for block, bits in places:
            here = (block >= first) & (block < first + len(data))
            out = out & (~here | (data[np.where(here, block - first, 0)] & bits == bits))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = np.frombuffer(blocks.value, U)
        for batch in batches:
            words, n = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            out, size = [], 0
            for length, own, m in _by_length(words):
                power = _powers(length + 1)
                terms = m * power[:length]
                total = terms.sum(1, dtype=U)
                before = np.cumsum(terms, 1, dtype=U) - terms
                shorter = before + (total[:, None] - before - terms) * _BACK
                new = np.ones(m.shape, bool)
                new[:, 1:] = m[:, 1:] != m[:, :-1]  # of equal letters in a row any one may go
                for w, i in zip(*(x.tolist() for x in np.nonzero(hits(shorter, length - 1, data) & new))):
                    word = words[own[w]]
                    out.append((word, n[own[w]], word[:i] + word[i + 1 :], True))
                    size += length
                wide, tall = max(1, PROBES // len(alphabet)), max(1, PROBES // (len(alphabet) * length))
                for a in range(0, len(own), tall):
                    for b in range(0, length, wide):
                        part = m[a : a + tall, b : b + wide]
                        changed = total[a : a + tall, None, None] + (alphabet - part[:, :, None]) * power[b : b + part.shape[1], None]
                        for w, i, c in zip(*(x.tolist() for x in np.nonzero(hits(changed, length, data) & (alphabet != part[:, :, None])))):
                            word = words[own[a + w]]
                            out.append((word, n[own[a + w]], word[: b + i] + chr(int(alphabet[c]) - 1) + word[b + i + 1 :], False))
                            size += length
                        if len(out) > 20_000 or size > 1 << 22:
                            yield rows_of(out)
                            out, size = [], 0
            if out:
                yield rows_of(out)

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.bool_()))], ["word", "n", "other", "shorter"])

    return run


def near(vocabulary: DataFrame, scratch: Scratch, *, slice_bytes: int = 32 << 20) -> DataFrame:
    """(word, other, other_n): all pairs of vocabulary words that differ by one inserted, deleted or replaced code point, both ways.
    vocabulary: (word, n) of distinct words without null, which is read once for each slice of the filters."""
    spark = vocabulary.sparkSession
    shards = vocabulary.groupBy(F.least(F.length("word"), F.lit(LAST)).alias("shard")).agg(F.count("*").alias("n")).collect()  # 65 rows at most
    layout = Layout({r.shard: r.n for r in shards if r.shard > 0})
    # the letters of the vocabulary's script
    letters = sorted(r.c for r in vocabulary.select(F.explode(F.split("word", "")).alias("c")).where("c != ''").distinct().collect())
    alphabet = np.array([ord(c) + 1 for c in letters], U)
    packed = scratch.keep(filters(vocabulary, layout))
    found = []
    chunks = max(1, slice_bytes // (8 * CHUNK))
    for low in range(0, -(-layout.size // CHUNK), chunks):
        rows = packed.where((F.col("chunk") >= low) & (F.col("chunk") < low + chunks)).collect()  # slice_bytes at most
        data = np.zeros(chunks * CHUNK, U) if layout.size > chunks * CHUNK else np.zeros(-(-layout.size // CHUNK) * CHUNK, U)
        for r in rows:
            data[(r.chunk - low) * CHUNK : (r.chunk - low + 1) * CHUNK] = np.frombuffer(r.data, U)
        blocks = spark.sparkContext.broadcast(data.tobytes())
        positive = vocabulary.select("word", "n").mapInArrow(_probe(layout, alphabet, low * CHUNK, blocks), "word string, n long, other string, shorter boolean")
        true = positive.join(vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
        there, back = F.struct("word", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n"))
        found.append(scratch.keep(true.select(F.explode(F.when(F.col("shorter"), F.array(there, back)).otherwise(F.array(there))).alias("x")).select("x.*")))
        blocks.destroy()
    scratch.drop(packed)
    if not found:
        return vocabulary.select("word", F.col("word").alias("other"), F.col("n").alias("other_n")).limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def group(vocabulary: DataFrame, *, factor: int = 5, slice_bytes: int = 32 << 20) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of a vocabulary (word, n): the near word of largest n (ties: the smallest),
    if that is at least `factor` times the word's n; the last word that forms lead to (the word itself without a form); and how many
    near words it has. An empty vocabulary gives no rows."""
    if factor < 2:
        raise ValueError("forms must be commoner than their variants")
    scratch = Scratch(vocabulary.sparkSession, "spelling")
    words = scratch.keep(vocabulary.select("word", "n"))
    best = near(words, scratch, slice_bytes=slice_bytes).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("form"))).alias("best"))
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.n") >= factor * F.col("n"), F.struct(F.col("best.form").alias("form"), (-F.col("best.n")).alias("n"))).alias("f"))
    rows = scratch.keep(rows.select("word", "f.form", "n", "n_near", F.col("f.n").alias("form_n")))
    facts = rows.agg(F.max("n").alias("n"), F.count("form").alias("forms"), F.sum(F.length("form")).alias("chars")).first()
    size = max(facts.forms, (facts.chars or 0) // 16)
    roots = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    # counts grow by the factor with each form, which bounds a chain's length; each round doubles what a row has followed
    longest = math.log(max(facts.n or 1, 1)) / math.log(factor)
    for _ in range(math.ceil(math.log2(max(longest, 1))) + 1 if facts.forms else 0):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends = scratch.keep(joined(roots, onward, "root", size).select("word", "next"))
        known = roots.join(ends, "word", "left").select("word", F.coalesce("next", "root").alias("root"))
        roots = scratch.keep(known)
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, **options) -> DataFrame:
    """group() over the words of whole texts, as `runs`, `slipped` and `counts` give them. Null and empty texts have none; other columns of
    docs do not matter; repeated rows count each."""
    return group(counts(slipped(runs(docs))), **options)
