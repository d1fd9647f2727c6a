"""Benchmark decontamination: windows of an item's size, found by shingles that a leak cannot be without, verified exactly.

The similarity of window and item is the weighted Jaccard similarity of their multisets of five-word shingles. A window of
similarity `least` holds at least that share of the item's weight, so of any of the item's shingles that weigh more than the rest
together (1 - least) it holds one. Those that the fewest items hold are posted, and each window around one is a candidate. Prefix
sums of the weights of the item's shingles bound a window's similarity from above; what is left is verified. No leak is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch, restrict
from ._text import NOT_ALNUM, U, Words, chunks, mix, shingles, words

BLOCKS, WIDTH = 4, 16


def weights(length: np.ndarray) -> np.ndarray:
    """A word's weight: 0 up to two bytes, 1 up to four, else 2. Short words are mostly function words."""
    return np.where(length <= 2, 0, np.where(length <= 4, 1, 2)).astype(np.int64)


def votes(hashes: np.ndarray, length: np.ndarray, kind: type) -> np.ndarray:
    """(words, 64): plus or minus the word's weight for each bit."""
    bits = np.unpackbits(mix(hashes ^ U(0x1234567)).view(np.uint8).reshape(-1, 8), axis=1).view(np.int8)
    w = weights(length).astype(kind)
    return (2 * bits - 1).astype(kind) * w[:, None]


def fingerprints(sums: np.ndarray, size: int) -> np.ndarray:
    """Of each window of `size` words, from prefix sums (which may wrap round: the windows' sums fit)."""
    return np.packbits(((sums[size:] - sums[:-size]) > 0).reshape(-1)).view(U)


def prefix_sums(hashes: np.ndarray, length: np.ndarray, kind: type) -> np.ndarray:
    out = np.zeros((len(hashes) + 1, 64), kind)
    np.cumsum(votes(hashes, length, kind), axis=0, dtype=kind, out=out[1:])
    return out


def weighted_shingles(hashes: np.ndarray, length: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, weight): its letters. With fewer than k words the whole sequence is one shingle."""
    k = min(k, len(hashes))
    total = np.concatenate([[0], np.cumsum(length)])
    return shingles(hashes, k), total[k:] - total[:-k]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller weights over sum of the larger ones, of two weighted multisets."""
    keys = np.concatenate([a[0], b[0]])
    _, at = np.unique(keys, return_inverse=True)
    wa, wb = np.bincount(at[: len(a[0])], a[1], at.max() + 1), np.bincount(at[len(a[0]) :], b[1], at.max() + 1)
    return float(np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum())


class Index:
    """Multi-index of the SimHash fingerprints of items of one size: finds what lies within a Hamming radius. items: (item_id, word
    hashes, word lengths). `leaks` does not use it, as a radius would miss edited items."""

    def __init__(self, size: int, items: list[tuple[int, np.ndarray, np.ndarray]], radius: int, k: int):
        self.size, self.radius = size, radius
        self.ids = [i for i, _, _ in items]
        self.shingles = [weighted_shingles(h, n, k) for _, h, n in items]
        self.prints = np.array([fingerprints(prefix_sums(h, n, np.int32), size)[0] for _, h, n in items], U)
        flips = [sum(1 << b for b in c) for r in range(radius // BLOCKS + 1) for c in combinations(range(WIDTH), r)]
        self.near = np.zeros((BLOCKS, 1 << WIDTH), bool)
        for block, value in enumerate(self.prints.view(np.uint16).reshape(-1, BLOCKS).T):
            for f in flips:
                self.near[block, value ^ np.uint16(f)] = True

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all fingerprints within the radius."""
        parts = prints.view(np.uint16).reshape(-1, BLOCKS)
        hit = self.near[0].take(parts[:, 0])
        for block in range(1, BLOCKS):
            hit |= self.near[block].take(parts[:, block])
        window = np.flatnonzero(hit)
        found = [(np.empty(0, int), np.empty(0, int))]
        for at in range(0, len(window), 4096):
            w = window[at : at + 4096]
            x, y = np.nonzero(np.bitwise_count(prints[w][:, None] ^ self.prints[None, :]) <= self.radius)
            found.append((w[x], y))
        return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def cover(ends: np.ndarray, size: int) -> np.ndarray:
    """All numbers of the runs of `size` that end at `ends` (in order, distinct), once each and in order."""
    own = np.minimum(np.diff(ends, prepend=ends[0] - size), size)
    return np.repeat(ends - (np.cumsum(own) - 1), own) + np.arange(own.sum())


class Postings:
    """The shingles of k words that tell of an item. items: (item_id, word hashes, word lengths)."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]], least: float, k: int):
        self.k, self.ids, self.sizes = k, [i for i, _, _ in items], [len(h) for _, h, _ in items]
        self.shingles = [weighted_shingles(h, n, k) for _, h, n in items]
        own = []
        for s, n in self.shingles:
            keys, at = np.unique(s, return_inverse=True)
            own.append((keys, np.bincount(at, n)))
        every, held = np.unique(np.concatenate([keys for keys, _ in own]), return_counts=True)
        self.members = own
        keys, item = [], []
        for y, (mine, weight) in enumerate(own):
            order = np.lexsort((-weight, held[np.searchsorted(every, mine)]))
            enough = int(np.searchsorted(np.cumsum(weight[order]), (1 - least) * weight.sum() + 1e-6, "right")) + 1
            keys.append(mine[order[:enough]])
            item.append(np.full(len(keys[-1]), y))
        key, item = np.concatenate(keys), np.concatenate(item)
        order = np.argsort(key, kind="stable")
        self.item = item[order]
        self.keys, self.begin = np.unique(key[order], return_index=True)
        self.begin = np.append(self.begin, len(key))
        self.mask = U((1 << max(16, len(key).bit_length() + 4)) - 1)
        self.near = np.zeros(int(self.mask) + 1, bool)
        self.near[self.keys & self.mask] = True

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place) of all posted shingles among codes, in order."""
        place = np.flatnonzero(self.near.take(codes & self.mask))
        at = np.minimum(np.searchsorted(self.keys, codes[place]), len(self.keys) - 1)
        good = self.keys[at] == codes[place]
        place, at = place[good], at[good]
        size = self.begin[at + 1] - self.begin[at]
        entry = np.repeat(self.begin[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        item, place = self.item[entry], np.repeat(place, size)
        order = np.lexsort((place, item))
        return item[order], place[order]


def postings(items: list[tuple[int, np.ndarray, np.ndarray]], least: float, k: int) -> list[Postings]:
    """Items of fewer than k words are one shingle and go by their size."""
    by_k: dict[int, list] = {}
    for x in items:
        by_k.setdefault(min(k, len(x[1])), []).append(x)
    return [Postings(own, least, n) for n, own in sorted(by_k.items())]


def find(w: Words, indexes: list[Postings], least: float) -> Iterator[tuple[int, int, int, int, float]]:
    """(text, item_id, first word, words, similarity): of each text and item the best window (the first of those), if it reaches least."""
    owner = w.doc()
    before = np.concatenate([[0], np.cumsum(w.length)])
    for index in indexes:
        k = index.k
        codes = shingles(w.hash, k)
        if not len(codes):
            continue
        weight = before[k:] - before[:-k]
        total = np.concatenate([[0], np.cumsum(weight)])
        item, place = index.hits(codes)
        edges = np.flatnonzero(np.diff(item, prepend=-1))
        for lo, hi in zip(edges, np.append(edges[1:], len(item))):
            y = int(item[lo])
            size, (keys, mass) = index.sizes[y], index.members[y]
            m = size - k + 1
            start = cover(place[lo:hi], m)
            start = start[(start >= 0) & (start + size <= len(owner))]
            start = start[owner[start] == owner[start + size - 1]]
            if not len(start):
                continue
            inside = cover(start + m - 1, m)
            at = np.minimum(np.searchsorted(keys, codes[inside]), len(keys) - 1)
            shared = np.concatenate([[0], np.cumsum(weight[inside] * (keys[at] == codes[inside]))])
            first = np.searchsorted(inside, start)
            whole = mass.sum()
            most = np.minimum(shared[first + m] - shared[first], whole)
            bound = most / (total[start + m] - total[start] + whole - most)
            good = bound >= least - 1e-9
            start, bound = start[good], bound[good]
            order = np.lexsort((start, -bound, owner[start]))
            text, best = -1, (0.0, 0)
            for x, b in zip(start[order], bound[order]):
                if owner[x] != text:
                    if best[0] >= least:
                        yield text, index.ids[y], int(-best[1] - w.first[text]), size, best[0]
                    text, best = int(owner[x]), (0.0, 0)
                if b >= best[0] - 1e-9:
                    best = max(best, (similarity(weighted_shingles(w.hash[x : x + size], w.length[x : x + size], k), index.shingles[y]), -int(x)))
            if best[0] >= least:
                yield text, index.ids[y], int(-best[1] - w.first[text]), size, best[0]


def leaks(docs: DataFrame, benchmark: DataFrame, *, least: float = 0.8, k: int = 5, block: int = 20_000) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity): each item that a document holds, at its best window (the first of
    those). docs(doc_id, text), benchmark(item_id, text); other columns are ignored, null texts count as empty and hold nothing.

    least: similarity of a leak; all leaks are found. Items without words are left out. Items go to the tasks in blocks of up to `block` items, one pass over docs for each: the size of what a task gets is bounded.
    """
    spark = docs.sparkSession
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL AND item_id IS NOT NULL")
    n = benchmark.count()
    passes = max(1, -(-n // block))
    out = None
    for p in range(passes):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p) if passes > 1 else benchmark
        rows = rows.toArrow().combine_chunks()
        items = []
        if rows.num_rows:
            w = words(rows.column("text"), NOT_ALNUM)
            items = [(i, w.hash[a:b], w.length[a:b]) for i, a, b in zip(rows.column("item_id").to_pylist(), w.first[:-1], w.first[1:]) if b > a]
        shared = spark.sparkContext.broadcast(postings(items, least, k))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, texts in chunks(batch.column("text")) if shared.value else ():
                    found = list(find(words(texts, NOT_ALNUM), shared.value, least))
                    if found:
                        text, item, first, size, s = zip(*found)
                        yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)).take(pa.array(text)), pa.array(item), pa.array(first), pa.array(size), pa.array(s)], ["doc_id", "item_id", "first_word", "n_words", "similarity"])

        hits = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, item_id long, first_word long, n_words long, similarity double")
        best = hits.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("first_word")).alias("before"), "n_words")).alias("x"))
        best = best.select("doc_id", "item_id", (-F.col("x.before")).alias("first_word"), "x.n_words", "x.similarity")
        out = best if out is None else out.unionAll(best)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those that hold a benchmark item. Rows without doc_id are judged by none and stay."""
    held = Scratch(docs.sparkSession, "decontam").keep(leaks(docs, benchmark, **options).select("doc_id").distinct())
    return restrict(docs, held, "doc_id", "left_anti").select(*docs.columns)
