"""Token sequences as files of length-delimited binary records, with an offset index for reads in any order.

A shard holds records of this form, all numbers little-endian:

    length of the payload (8 bytes) | masked checksum of these 8 bytes (4) | payload | masked checksum of the payload (4)
    payload: flags (1 byte; 1: has a document id, 2: ids of 4 bytes instead of 2) | document id (8, signed) | token ids

The checksum is CRC-32, rotated by 15 bits and offset by a constant, so that a record that holds records keeps a checksum of its own.
Beside each shard lies its index: for each record its offset and the number of tokens before it in the shard (8 bytes each), then the
same for the shard's end, then their masked checksum. A manifest names the shards that count: a lost attempt's files are in none.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import shared_folder
from ._text import chunks

SHARD, CHUNK = 64 << 20, 16 << 20  #: bytes after which a shard ends, and that a reading task takes about
CACHED, CACHED_BYTES, LONGEST = 1_200_000, 16 << 20, 64  #: pieces whose ids a Python worker keeps, their characters, and of the longest one
TOGETHER, TEXTS = 64, 4 << 20  #: new words that are encoded as one text; bytes of texts that are encoded in one call
HEADER, FLAGS, ENTRY = struct.Struct("<QI"), struct.Struct("<Bq"), struct.Struct("<QQ")
HAS_ID, WIDE = 1, 2
MASK = 0xA282EAD8

#: The tokenizer never looks across these pieces: it cuts before a space that a mark or letter follows, and takes all but the last
#: character of other white space as one. Where Python and the tokenizer may not agree on what is white space, whole texts are encoded.
PIECES = re.compile(r" ?\S+|\s+(?!\S)|\s")
#: Letters that every Unicode version knows; ASCII marks without the apostrophe.
LATIN, MARKS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+"), "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
DOUBTFUL = re.compile("[\x1c-\x1f\x85᠎​-‏⁠﻿]")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def plain(text: str) -> bool:
    """Whether a text is lines of words with single spaces between them: what is printable holds no other white space."""
    return text.replace("\n", "").isprintable() and text[:1] not in ("", " ", "\n") and text[-1] not in " \n" and not any(x in text for x in ("  ", " \n", "\n ", "\n\n"))


class Encoder:
    """Ids of whole texts as bytes; those of recurring pieces are kept.

    What is kept has a key: a word alone stands for a space and the word; FIRST, LINE and PIECE before one for a text's first word, for a
    line's end and the next one's first word, and for any other piece. No word of a plain text begins with these."""

    FIRST, LINE, PIECE = "\r", "\n", "\0"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.begins = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.begins[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("\u0120")]] = True  # how byte-level tokens write a space
        state, level = json.loads(self.tokenizer.to_str()), ByteLevel(add_prefix_space=False, use_regex=False)
        whole = state.get("pre_tokenizer") or {}
        #: how the tokenizer's model reads letters, where nothing but its bytes and spaces comes before the model
        self.letters = {ord(c): level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xC0, 0x100)) if LATIN.fullmatch(c)}
        if not (whole.get("type") == "ByteLevel" and whole.get("use_regex") and not whole.get("add_prefix_space") and not state.get("normalizer")):
            self.letters = None
        self._clear()

    def _clear(self) -> None:
        self.code: dict[str, int] = {}  #: key -> its place in the arrays
        self.at, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)  #: where its ids begin, and how many there are
        self.hits = np.zeros(1 << 16, np.int32)  #: calls in which it stood
        self.ids = np.zeros(1 << 18, f"<u{self.width}")
        self.used = self.chars = 0

    @property
    def known(self) -> list[str]:
        """The pieces that are kept."""
        return [k[1:] for k in self.code if k[0] in "\r\n\0"]

    @property
    def spaced(self) -> list[str]:
        """The words that are kept with a space before them."""
        return [k for k in self.code if k[0] not in "\r\n\0"]

    def _retire(self) -> None:
        """Forgets what stood in one call only, and the rarest others if too many are left or they are too long."""
        keys, hits = list(self.code), self.hits[: len(self.code)]
        order = np.argsort(-hits, kind="stable")
        order = order[: min(int((hits >= 2).sum()), CACHED // 4)].tolist()
        chars = np.cumsum([len(keys[i]) for i in order])
        order = order[: int(np.searchsorted(chars, CACHED_BYTES // 4, "right"))]
        ids, size = self._gather(np.array(order, np.int64))
        self._clear()
        self._add([keys[i] for i in order], ids, size)

    def _add(self, keys: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        k, n = len(self.code), len(keys)
        while k + n > len(self.at):
            self.at, self.size, self.hits = (np.resize(x, 2 * len(x)) for x in (self.at, self.size, self.hits))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.at[k : k + n] = self.used + np.cumsum(size) - size
        self.size[k : k + n], self.hits[k : k + n] = size, 0
        self.code.update(zip(keys, range(k, k + n)))
        self.used += len(ids)
        self.chars += sum(map(len, keys))

    def _gather(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all places of code, one after the other, and how many each has."""
        size = self.size[code]
        ends = np.cumsum(size)
        return self.ids[np.repeat(self.at[code] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], size

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def _learn(self, new: list[str]) -> list[str]:
        """Adds the ids of new keys. The long ones come last and are returned: they are not to be kept.

        Letters and the marks behind them are pieces of their own to the tokenizer, so that a word that is new only for its full stop is not."""
        short = [k for k in new if len(k) <= LONGEST]
        pieces, letters, others, marked = [], [], [], []
        for key in short:
            if key[0] in "\r\n\0":
                pieces.append(key)
                continue
            core = key.rstrip(MARKS)
            if not (core.isalpha() and (core.isascii() or LATIN.fullmatch(core))):
                others.append(key)
            elif len(core) == len(key):
                letters.append(key)
            else:
                marked.append((key, core, self.PIECE + key[len(core) :]))
        self._learn_pieces(pieces + sorted({mark for _, _, mark in marked}.difference(self.code, pieces)))
        letters += [core for core in {core for _, core, _ in marked}.difference(letters) if core not in self.code]
        if self.letters is None:
            others += letters
        else:
            self._learn_letters(letters)
        self._learn_together(others)
        if marked:
            ids, size = self._gather(np.fromiter((self.code[x] for _, core, mark in marked for x in (core, mark)), np.int64, 2 * len(marked)))
            self._add([key for key, _, _ in marked], ids, size.reshape(-1, 2).sum(1))
        long = [k for k in new if len(k) > LONGEST]
        self._learn_pieces(long)
        return long

    def _learn_pieces(self, keys: list[str]) -> None:
        """Each for itself."""
        texts = [k[1:] if k[0] in "\r\n\0" else f" {k}" for k in keys]
        found = [x.ids for x in self.tokenizer.encode_batch_fast([self.LINE, *texts], add_special_tokens=False)]
        end = found.pop(0)
        ids = [[*end, *own] if k[0] == self.LINE else own for k, own in zip(keys, found)]
        self._add(keys, np.fromiter(chain.from_iterable(ids), self.ids.dtype), np.fromiter(map(len, ids), np.int64, len(ids)))

    def _learn_letters(self, new: list[str]) -> None:
        """Words of known letters alone are one piece with the space before them, which the tokenizer's model takes as it is."""
        tokenize, table = self.tokenizer.model.tokenize, self.letters
        ids = [[t.id for t in tokenize("\u0120" + (w if w.isascii() else w.translate(table)))] for w in new]
        self._add(new, np.fromiter(chain.from_iterable(ids), self.ids.dtype), np.fromiter(map(len, ids), np.int64, len(ids)))

    def _learn_together(self, new: list[str]) -> None:
        """New words go to the tokenizer many at once, as that costs a fraction: a token that begins with a space begins the next word."""
        if not new:
            return
        texts = [" ".join(["", *new[at : at + TOGETHER]]) for at in range(0, len(new), TOGETHER)]
        ids = np.concatenate([np.array(x.ids, self.ids.dtype) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        first = np.flatnonzero(self.begins[ids])
        if len(first) != len(new):
            raise ValueError("the tokenizer does not cut at spaces")
        self._add(new, ids, np.diff(first, append=len(ids)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """A text of lines of words with single spaces is cut at spaces; any other one by PIECES, or not at all."""
        if len(self.code) > CACHED // 2 or self.chars > CACHED_BYTES // 2:
            self._retire()
        out: list[bytes] = [b""] * len(texts)
        lines, cut, odd, pieces = [], [], [], []
        for i, text in enumerate(texts):
            if self.special.search(text):
                out[i] = self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
            elif plain(text):
                cut.append(i)
                lines.append(self.FIRST + text.replace("\n", f" {self.LINE}"))
            elif DOUBTFUL.search(text):
                out[i] = self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
            else:
                odd.append(i)
                pieces.append([self.PIECE + p for p in PIECES.findall(text)])
        words = pc.split_pattern(pa.array(lines, pa.large_string()), " ")
        keys = pa.concat_arrays([words.flatten(), pa.array(chain.from_iterable(pieces), pa.large_string())])
        found = keys.dictionary_encode()
        own = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        code = np.fromiter(map(self.code.get, own, repeat(-1)), np.int64, len(own))
        missing = np.flatnonzero(code < 0)
        new = [own[i] for i in missing.tolist()]
        long = self._learn(new)
        code[missing] = np.fromiter(map(self.code.__getitem__, new), np.int64, len(new))
        self.hits[code] += 1
        ids, size = self._gather(code[found.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(size)])
        counts = [*pc.list_value_length(words).to_pylist(), *map(len, pieces)]
        at = (self.width * ends[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int64)]).tolist()
        data = memoryview(ids.tobytes())
        for i, start, stop in zip(cut + odd, at, at[1:]):
            out[i] = bytes(data[start:stop])
        if long:
            self.used -= sum(int(self.size[self.code[k]]) for k in long)
            self.chars -= sum(map(len, long))
            for k in long:
                del self.code[k]
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder's full address, as PyArrow's file systems (local, HDFS and object stores) take it in any task."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/(?!/)", "file:///", full)


def _opened(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


class Shard:
    """One shard and its index, written record by record."""

    def __init__(self, folder: str, name: str):
        self.files, root = _opened(folder)
        self.name, self.path = name, f"{root}/{name}"
        self.out = self.files.open_output_stream(f"{self.path}.rec")
        self.bytes = self.tokens = 0
        self.index: list[bytes] = []

    def add(self, doc_id: int | None, ids: bytes, width: int) -> None:
        payload = FLAGS.pack((HAS_ID if doc_id is not None else 0) | (WIDE if width == 4 else 0), doc_id or 0) + ids
        length = struct.pack("<Q", len(payload))
        self.index.append(ENTRY.pack(self.bytes, self.tokens))
        self.out.write(length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload)))
        self.bytes += HEADER.size + len(payload) + 4
        self.tokens += len(ids) // width

    def close(self) -> tuple:
        self.out.close()
        index = b"".join(self.index) + ENTRY.pack(self.bytes, self.tokens)
        with self.files.open_output_stream(f"{self.path}.idx") as out:
            out.write(index + struct.pack("<I", masked(index)))
        return self.name, len(self.index), self.tokens, self.bytes


MANIFEST = "part int, number int, shard string, records long, tokens long, bytes long"


def write(docs: DataFrame, folder: str, tokenizer: str, *, end: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Writes each document's ids, then `end`, as one record under a new `folder`, in ascending order of doc_id; returns the manifest.

    Null text counts as empty: its record holds `end` alone. Rows without an id come first; rows that share one follow each other. Rows
    are dealt by ranges of ids, and many rows of one id, or equal rows, to several tasks. Other columns do not matter. A task holds a
    document and its ids; its shards' names carry its attempt, and only those of the attempt that Spark commits are in the manifest."""
    folder = qualified(docs.sparkSession, folder)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("t"))
    rows = rows.select("*", F.xxhash64("t").alias("tie"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "tie", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = encoder(tokenizer), TaskContext.get()
        stop, shard, done = own.packed([end]), None, []
        for batch in batches:
            for at, texts in chunks(batch.column("t"), TEXTS):
                for i, ids in zip(batch.column("doc_id").slice(at, len(texts)).to_pylist(), own.encode(texts.to_pylist())):
                    if shard is None:
                        if not done:
                            files, root = _opened(folder)
                            files.create_dir(root, recursive=True)
                        shard = Shard(folder, f"{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}")
                    shard.add(i, ids + stop, own.width)
                    if shard.bytes >= SHARD:
                        done.append(shard.close())
                        shard = None
        if shard is not None:
            done.append(shard.close())
        yield pa.RecordBatch.from_pylist([{"part": task.partitionId(), "number": n, "shard": s[0], "records": s[1], "tokens": s[2], "bytes": s[3]} for n, s in enumerate(done)], pa.schema([("part", pa.int32()), ("number", pa.int32()), ("shard", pa.string()), ("records", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())]))

    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "t").mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest with `first`: the tokens of all shards before each. Summed within groups of a thousand parts, then over the groups."""
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").withColumn("g", F.floor(F.col("part") / 1000))
    own = rows.withColumn("in_group", F.coalesce(F.sum("tokens").over(Window.partitionBy("g").orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    groups = rows.groupBy("g").agg(F.sum("tokens").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return own.join(groups.drop("n"), "g").withColumn("first", (F.col("before") + F.col("in_group")).cast("long")).select("part", "number", "shard", "records", "bytes", "first")


def _index(files, path: str, first: int, last: int) -> np.ndarray:
    """(offset, tokens before) of the records from first to last, that one included."""
    with files.open_input_file(f"{path}.idx") as f:
        f.seek(first * ENTRY.size)
        return np.frombuffer(f.read((last - first + 1) * ENTRY.size), "<u8").reshape(-1, 2).astype(np.int64)


def _record(data: bytes, where: str) -> tuple[int | None, bytes]:
    """Id and token ids (4 bytes each) of a framed record, whose checksums are verified."""
    if len(data) < HEADER.size + FLAGS.size + 4:
        raise ValueError(f"cut record {where}")
    length, check = HEADER.unpack_from(data)
    payload = data[HEADER.size : -4]
    if masked(data[:8]) != check or length != len(payload) or masked(payload) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError(f"damaged record {where}")
    flags, doc_id = FLAGS.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & WIDE else "<u2", offset=FLAGS.size)
    return doc_id if flags & HAS_ID else None, ids.astype("<u4").tobytes()


RECORD = "doc_id long, start long, n_tokens long, ids binary"


def _reader(folder: str, keep: tuple[str, ...] = ()):
    """Reads runs of records (shard, first, i, j): those from i up to j, without j. Rows leave in batches of about 8 MB."""
    names = ["doc_id", "start", "n_tokens", "ids", *keep]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, zip(*rows))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _opened(folder)
        rows, size = [], 0
        for batch in batches:
            for run_of in batch.to_pylist():
                path = f"{root}/{run_of['shard']}"
                index = _index(files, path, run_of["i"], run_of["j"])
                with files.open_input_file(f"{path}.rec") as f:
                    for k in range(len(index) - 1):
                        f.seek(int(index[k, 0]))
                        doc_id, ids = _record(f.read(int(index[k + 1, 0] - index[k, 0])), f"{run_of['i'] + k} of {path}")
                        rows.append((doc_id, run_of["first"] + int(index[k, 1]), len(ids) // 4, ids, *[run_of[c] for c in keep]))
                        size += len(ids) + 64
                        if size > CHUNK // 2:
                            yield batch_of(rows)
                            rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return run


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every record that `write` left under folder: start counts the ids of all records before it,
    ids are 4 bytes each, little-endian. Checksums are verified; a damaged record stops the job with its place. Tasks take runs of
    records of some 16 MB, whichever shard they lie in."""
    folder = qualified(spark, folder)
    step = F.greatest(F.lit(1), F.floor(F.col("records") * CHUNK / F.col("bytes"))).cast("long")
    runs = shards(spark, folder).select("shard", "first", "records", step.alias("step")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.col("step"))).alias("i"))
    runs = runs.select("shard", "first", "i", F.least("records", F.col("i") + F.col("step")).alias("j"))
    return spread(runs, "shard", "i").mapInArrow(_reader(folder), RECORD)


def spread(runs: DataFrame, *keys: str) -> DataFrame:
    """A small table of tasks-to-be, one row a partition where there are enough partitions."""
    n = runs.count()
    return runs.repartitionByRange(max(1, n), *keys) if n <= 100_000 else runs.repartition(100_000, *keys)


def read_shuffled(spark: SparkSession, folder: str, seed: int) -> DataFrame:
    """The records in a random order that the seed fixes, told by `place` (evenly spread over the longs): partitions are ranges of it, and
    each is sorted by it. Every record is read by itself through the index."""
    folder = qualified(spark, folder)
    rows = shards(spark, folder).select("shard", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1)).alias("i"))
    rows = rows.select("shard", "first", "i", (F.col("i") + 1).alias("j"), F.xxhash64(F.lit(seed), "shard", "i").alias("place"))
    return rows.repartitionByRange("place").sortWithinPartitions("place").mapInArrow(_reader(folder, ("place",)), RECORD + ", place long")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
