"""Words of Arrow text batches as NumPy arrays: no Python object is made for a word or a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_P = 0x9E3779B97F4A7C15  # odd, so powers of it have inverses modulo 2**64
CHUNK = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Separator bytes: white space of ASCII; everything in ASCII but digits and small letters.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_P**i and its inverse modulo 2**64, for i below n at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        inverse = pow(_P, -1, 1 << 64)
        up, down = np.empty(size, U), np.empty(size, U)
        for out, base in ((up, _P), (down, inverse)):
            out[0] = 1
            done = 1
            while done < size:
                step = min(done, size - done)
                out[done : done + step] = out[:step] * U(pow(base, done, 1 << 64))
                done += step
        _powers[:] = [up, down]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose result looks random (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    first: np.ndarray  #: index of each text's first word; one more entry than texts
    hash: np.ndarray  #: of each word, 64 bits
    length: np.ndarray  #: of each word, in bytes

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each begins (and the last ends). A null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or at[-1] == at[0]:
        return np.empty(0, np.uint8), np.zeros(len(at), np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, pa.Array]]:
    """The texts in runs of about `limit` bytes, one text at least; with the index of the first."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(size), 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, texts.slice(start, stop - start)
        start = stop


def words(texts: pa.Array, separator: np.ndarray) -> Words:
    """The maximal runs of bytes that are no separators, of each text with A-Z in lower case."""
    raw, at = text_bytes(texts)
    n = len(raw)
    if not n:
        return Words(np.zeros(len(at), np.int64), np.empty(0, U), np.empty(0, np.int64))
    low = LOWER[raw]
    inside = ~separator[low]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    length = np.flatnonzero(inside & (~after | edge[1:])) + 1 - starts
    if not len(starts):
        return Words(np.zeros(len(at), np.int64), np.empty(0, U), np.empty(0, np.int64))
    up, down = powers(n)
    value = (low.astype(U) + U(1)) * up[:n]
    value[~inside] = 0
    code = np.add.reduceat(value, starts) * down[starts]
    return Words(np.searchsorted(starts, at), mix(code ^ (length.astype(U) * U(0xD6E8FEB86659FD93))), length)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit number for each run of k words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, U)
    code = np.full(n, k, U)
    for j in range(k):
        code = code * U(0xC2B2AE3D27D4EB4F) + hashes[j : j + n]
    return mix(code)


def word_hashes(text: str, separator: np.ndarray) -> np.ndarray:
    return words(pa.array([text], pa.string()), separator).hash
