"""Packing documents into sequences of bounded length: cutting stock by column generation.

A document's tokens are cut into full blocks and one rest. The rests' lengths fall into bins (relative width 1/resolution); the
histogram of the bins, whose size no input can raise, goes to the driver. There a linear program over patterns (how many pieces
of each bin share a sequence) is solved by the revised simplex method; a knapsack dynamic program prices new patterns. Patterns
are used floor(x) times, and what is left over goes first-fit decreasing. Each piece is ranked in its bin in a distributed way,
and its rank tells its pattern and sequence.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import Scratch, partitions
from ._text import chunks

MARK = "\x01"
CACHE, CACHE_BYTES = 800_000, 16 << 20  #: runs of text whose ids a Python worker keeps, and their characters

# The letters of Western European languages, whose normal form, lower case and class no Unicode version changes; and the
# contractions that the tokenizer's pattern knows.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿßœ"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
PATTERN = rf"{CONTRACTIONS}|[\p{{L}}]+|[\p{{N}}]|[^\s\p{{L}}\p{{N}}]+"
_CAPITALS = "".join(c.upper() for c in LETTERS if len(c.upper()) == 1)
_PLAIN = re.compile(rf"[!-~{LETTERS}{_CAPITALS}]+")
_PIECES = re.compile(rf"{CONTRACTIONS}|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+")


class Encoder:
    """Ids of texts. The tokenizer drops white space and never looks across it, so ids are kept for each run between spaces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        marks = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = marks[0] if len(marks) == 1 else None
        self.byte_level, self.model = None, self.tokenizer.model
        state = json.loads(self.tokenizer.to_str())
        parts = (state.get("pre_tokenizer") or {}).get("pretokenizers", [])
        normal = [n["type"] for n in (state.get("normalizer") or {}).get("normalizers", [])]
        if normal == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"] == {"Regex": PATTERN}:
            level = ByteLevel(add_prefix_space=False, use_regex=False)
            self.byte_level = {ord(c): level.pre_tokenize_str(c)[0][0] for c in LETTERS if not c.isascii()}
        self._clear()

    def _clear(self) -> None:
        self.code: dict[str, int] = {"": 0}
        self.at = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.hits = np.zeros(1 << 16, np.int32)  #: chunks of text in which a run stood
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used = self.kept = 0

    def _compact(self) -> None:
        """Forgets runs that stood in one chunk only, and the rarest others if too many are left."""
        runs, hits = list(self.code), self.hits[: len(self.code)]
        least = max(2, int(np.sort(hits)[-(CACHE // 4)]) + 1 if len(hits) > CACHE // 4 else 2)
        kept = 1 + np.flatnonzero(hits[1:] >= least)
        size = self.size[kept]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.at[kept] - (ends - size), size) + np.arange(size.sum())]
        runs = [runs[i] for i in kept.tolist()]
        self._clear()
        self._add(runs, ids, size)

    def _one_by_one(self, runs: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(runs, add_special_tokens=False)]

    def _piece(self, piece: str) -> list[int]:
        code = self.code.get(piece)
        if code is not None:
            return self.ids[self.at[code] : self.at[code] + self.size[code]].tolist()
        return [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.translate(self.byte_level))]

    def _plain(self, runs: list[str]) -> None:
        """Keeps the ids of runs of ASCII and the known letters: the tokenizer's own pieces of them, each by its model alone. Most runs are
        letters, or letters and one mark."""
        ids, size, known = [], [], {}
        for run in runs:
            low, before = run.lower(), len(ids)
            for piece in (low,) if low.isalpha() else (low[:-1], low[-1]) if low[:-1].isalpha() and low[-1] in ".,;:!?" else _PIECES.findall(low):
                own = known.get(piece)
                if own is None:
                    own = known[piece] = self._piece(piece)
                ids += own
            size.append(len(ids) - before)
        self._add(runs, np.array(ids, np.uint32), np.array(size, np.int64))

    def _learn(self, missing: list[str]) -> None:
        """Keeps the ids of new runs. Runs of plain letters go to the tokenizer's model; many others are encoded as one text, with a mark
        between them that is one token."""
        if self.byte_level is not None:
            own = [r for r in missing if _PLAIN.fullmatch(r)]
            self._plain(own)
            missing = [r for r in missing if r not in self.code]
        plain = [r for r in missing if MARK not in r] if self.mark is not None else []
        rest = [r for r in missing if MARK in r] if self.mark is not None else missing
        for at in range(0, len(plain), 1024):
            runs = plain[at : at + 1024]
            ids = np.array(self.tokenizer.encode(f" {MARK} ".join([*runs, ""]), add_special_tokens=False).ids, np.uint32)
            mark = ids == self.mark
            ends = np.flatnonzero(mark)
            self._add(runs, ids[~mark], np.diff(ends, prepend=-1) - 1)
        if rest:
            found = self._one_by_one(rest)
            self._add(rest, np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found]))

    def _add(self, runs: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        k, n = len(self.code), len(runs)
        self.kept += sum(map(len, runs))
        while k + n > len(self.at):
            self.at, self.size, self.hits = (np.resize(x, 2 * len(x)) for x in (self.at, self.size, self.hits))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.size[k : k + n], self.hits[k : k + n] = size, 0
        self.at[k : k + n] = self.used + np.cumsum(size) - size
        self.code.update(zip(runs, range(k, k + n)))
        self.used += len(ids)

    def encode(self, texts: list[str], end: int) -> Iterator[np.ndarray]:
        """Ids of each text, then `end`."""
        if len(self.code) > CACHE or self.kept > CACHE_BYTES:
            self._compact()
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        runs = list(chain.from_iterable(split))
        code = np.fromiter(map(self.code.get, runs, repeat(-1)), np.int64, len(runs))
        new = np.flatnonzero(code < 0).tolist()
        if new:
            self._learn(list(dict.fromkeys(runs[i] for i in new)))
            code[new] = [self.code[runs[i]] for i in new]
        self.hits[code] += 1
        size = self.size[code]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.at[code] - (ends - size), size) + np.arange(total)]
        stop = 0
        for s, last in zip(split, np.cumsum([len(s) for s in split]) - 1):
            start, stop = stop, int(ends[last])
            yield np.append(ids[start:stop], np.uint32(end))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def bin_edges(length: int, resolution: int) -> np.ndarray:
    """The largest length of each bin; the last bin holds full blocks only."""
    edges = [1]
    while edges[-1] < length - 1:
        edges.append(min(length - 1, edges[-1] + max(1, edges[-1] // resolution)))
    return np.array([*edges, length] if length > 1 else [1])


def pieces(docs: DataFrame, path: str, length: int, end: int, resolution: int) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, bin) of every piece."""
    edges = bin_edges(length, resolution)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for at, texts in chunks(batch.column("text")):
                doc, start, size, crc, total = [], [], [], [], []
                for k, ids in enumerate(own.encode(pc.fill_null(texts, "").to_pylist(), end)):
                    raw = ids.astype("<u4").tobytes()
                    for a in range(0, len(ids), length):
                        b = min(len(ids), a + length)
                        doc.append(k)
                        start.append(a)
                        size.append(b - a)
                        crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                        total.append(len(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)).take(pa.array(doc, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, size, crc, total)), pa.array(np.searchsorted(edges, size).astype(np.int32))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin"])
        own._clear()  # a worker that goes on to other work keeps no runs

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bin int")


def knapsack(value: np.ndarray, size: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """For each capacity up to room the best value of items (each as often as wanted), and the item taken last (-1: none).
    size is rising."""
    best, item = np.zeros(room + 1), np.full(room + 1, -1, np.int64)
    fits = np.searchsorted(size, np.arange(room + 1), "right")
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        n = fits[c]
        if n:
            with_item = value[:n] + best[c - size[:n]]
            k = int(with_item.argmax())
            if with_item[k] > best[c] + 1e-12:
                best[c], item[c] = with_item[k], k
    return best, item


def pattern(item: np.ndarray, size: np.ndarray, room: int) -> np.ndarray:
    """How often each item is in the best filling of room."""
    out = np.zeros(len(size), np.int64)
    while room > 0:
        if item[room] < 0:
            room -= 1
        else:
            out[item[room]] += 1
            room -= int(size[item[room]])
    return out


def greedy_basis(size: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """A first basis (patterns as columns) and its use: always the largest piece left, filled up with the next largest that fit. Each
    pattern is used until a bin is exhausted, which makes the basis triangular."""
    left, columns, used = demand.astype(float).copy(), np.zeros((len(size), len(size))), np.zeros(len(size))
    alive = np.ones(len(size), bool)
    for _ in range(len(size)):
        new, free = np.zeros(len(size)), room
        for k in np.flatnonzero(alive)[::-1]:
            new[k] = min(free // size[k], max(1, np.ceil(left[k])))
            free -= int(new[k] * size[k])
            if free < size[0]:
                break
        own = np.flatnonzero(new)
        ratio = left[own] / new[own]
        out = own[ratio.argmin()]
        left[own] = np.maximum(0, left[own] - ratio.min() * new[own])
        left[out], alive[out] = 0, False
        columns[:, out], used[out] = new, ratio.min()
    return columns, used


def solve(size: np.ndarray, demand: np.ndarray, room: int, gap: float = 1e-3, rounds: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one in each row) and how often the linear program uses them; size is rising. Ends within `gap` of the optimum,
    by Farley's bound or the pieces' total length."""
    start, use = greedy_basis(size, demand, room)
    columns, inverse, x = start.copy(), np.linalg.inv(start), use.copy()
    least = float(size @ demand) / room
    dual = inverse.sum(0)
    for _ in range(rounds):
        value = np.maximum(dual, 0)
        best, item = knapsack(value, size, room)
        least = max(least, float(value @ demand) / max(1.0, best[room]))
        if x.sum() <= (1 + gap) * least or best[room] <= 1 + 1e-7:
            break
        through = value + best[room - size]
        for k in np.argsort(-through)[:24]:
            if through[k] <= 1 + 1e-7:
                break
            new = pattern(item, size, room - int(size[k]))
            new[k] += 1
            if dual @ new <= 1 + 1e-9:
                continue
            step = inverse @ new
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(step > 1e-9, x / step, np.inf)
            out = int(ratio.argmin())
            if not np.isfinite(ratio[out]):
                continue
            x = np.maximum(x - ratio[out] * step, 0)
            x[out] = ratio[out]
            row = inverse[out] / step[out]
            inverse -= np.outer(step, row)
            inverse[out] = row
            columns[:, out] = new
            dual = inverse.sum(0)
    if not np.allclose(columns @ x, demand, rtol=1e-2, atol=0.5):  # rounding errors of the pivots have grown: as it began
        columns, x = start, use
    return np.rint(columns.T).astype(np.int64), x


def first_fit(size: np.ndarray, left: np.ndarray, room: int) -> list[np.ndarray]:
    """Patterns for the leftover pieces, largest first, each into the first sequence that has room."""
    free, out = [], []
    for k in np.argsort(-size, kind="stable"):
        for _ in range(int(left[k])):
            place = next((i for i, f in enumerate(free) if f >= size[k]), None)
            if place is None:
                place = len(free)
                free.append(room)
                out.append(np.zeros(len(size), np.int64))
            free[place] -= int(size[k])
            out[place][k] += 1
    return out


def layout(bins: np.ndarray, size: np.ndarray, count: np.ndarray, room: int) -> dict[str, np.ndarray]:
    """Slots for the ranks of every bin: entries (bin, first rank, pieces in each sequence, first sequence), by bin and rank."""
    entries, sequences = [], 0
    order = np.argsort(size, kind="stable")
    bins, size, count = bins[order], size[order], count[order]
    used = np.zeros(len(size), np.int64)

    def add(new: np.ndarray, times: int) -> None:
        nonlocal sequences
        for k in np.flatnonzero(new):
            entries.append((int(bins[k]), int(used[k]), int(new[k]), sequences))
            used[k] += new[k] * times
        sequences += times

    full = size == room
    for k in np.flatnonzero(full):
        new = np.zeros(len(size), np.int64)
        new[k] = 1
        add(new, int(count[k]))
    part = np.flatnonzero(~full)
    if len(part):
        rows, x = solve(size[part], count[part].astype(float), room)
        for new, times in zip(rows, np.floor(x + 1e-6).astype(np.int64)):
            wide = np.zeros(len(size), np.int64)
            wide[part] = new
            own = wide > 0
            times = min(int(times), int(((count - used)[own] // wide[own]).min())) if own.any() else 0
            if times > 0:
                add(wide, times)
        for new in first_fit(size[part], (count - used)[part], room):
            wide = np.zeros(len(size), np.int64)
            wide[part] = new
            add(wide, 1)
    entries.sort()
    table = np.array(entries, np.int64).reshape(-1, 4)
    return {"bin": table[:, 0], "rank": table[:, 1], "each": table[:, 2], "first": table[:, 3]}


def pack(docs: DataFrame, tokenizer: str, *, length: int = 4096, end: int = 2, resolution: int = 64) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of docs(doc_id, text).

    A document's ids are the tokenizer's, then `end`; a null text counts as empty and has the one id `end`. Pieces are the full
    blocks of `length` ids and the rest, so a piece never depends on what else is packed. In a sequence longer pieces stand
    first, without gaps. Repeated rows are packed each. Other columns are ignored. An empty table gives no pieces.
    resolution: bins are 1/resolution of a length wide; it bounds the size of the linear program and, at half of it, the padding.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cut = scratch.keep(pieces(docs, tokenizer, length, end, resolution))
    found = cut.groupBy("bin").agg(F.count("*").alias("n"), F.max("length").alias("size")).collect()
    if not found:
        return cut.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    bins, count, size = (np.array([r[k] for r in found], np.int64) for k in ("bin", "n", "size"))
    slots = spark.sparkContext.broadcast(layout(bins, size, count, length))

    # ranks: a bin of any size is dealt to salts of a bounded share of all pieces; each salt's first rank comes from their counts
    share = max(64, int(count.sum()) // (2 * partitions(spark)))
    salts = np.ones(int(bins.max()) + 1, np.int64)
    salts[bins] = -(-count // share)
    spread = spark.sparkContext.broadcast(salts)

    @F.arrow_udf("long")
    def salts_of(b: pa.Array) -> pa.Array:
        return pa.array(spread.value[b.to_numpy()])

    salted = scratch.keep(cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), salts_of("bin"))))
    counts = salted.groupBy("bin", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bin").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("bin", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("bin", "salt").orderBy(F.desc("length"), "doc_id", "start")
    ranked = salted.withColumn("rank", F.row_number().over(inside) - 1).join(counts, ["bin", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))

    @F.arrow_udf("long")
    def sequence_of(b: pa.Array, rank: pa.Array) -> pa.Array:
        b, rank, s = b.to_numpy(), rank.to_numpy(), slots.value
        out = np.empty(len(b), np.int64)
        for value in np.unique(b):
            own = b == value
            lo, hi = np.searchsorted(s["bin"], [value, value + 1])
            at = lo + np.searchsorted(s["rank"][lo:hi], rank[own], "right") - 1
            out[own] = s["first"][at] + (rank[own] - s["rank"][at]) // s["each"][at]
        return pa.array(out)

    placed = ranked.withColumn("sequence_id", sequence_of("bin", "rank"))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(order), F.lit(0)).alias("offset"))
