"""Token counts by a count-only Viterbi search over a unigram vocabulary.

Aho-Corasick lists the vocabulary's pieces that end at each character. For each character the best score so far, the number of
pieces of that path and whether it ends in unknown characters are kept, but no path. Ties are a unigram tokenizer's: the piece
that starts first (the longest) stays. Characters that are no piece cost 10 below the lowest score; runs of them are one piece.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ._text import chunks

SPACE = "▁"
CACHE, LONG = 1_000_000, 64  #: words whose counts a Python worker keeps, and from how many characters on it keeps none


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model's ordinary pieces. Score: -log(rank + 2), the pieces standing by falling rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    return [(model.id_to_piece(i), -math.log(rank + 2)) for rank, i in enumerate(plain)]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - 10.0
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        n = len(word)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, piece in self.automaton.iter(word):
            ending[end + 1].append(piece)
        score, count, loose = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            best = None
            single = False
            for size, value in sorted(ending[end], reverse=True):
                single |= size == 1
                total = value + score[end - size]
                if best is None or total > best:
                    best = total
                    count[end], loose[end] = count[end - size] + 1, False
            if not single:
                total = self.unknown + score[end - 1]
                if best is None or total > best:
                    best = total
                    count[end], loose[end] = count[end - 1] + (not loose[end - 1]), True
            score[end] = best
        return count[n]

    def text(self, text: str) -> int:
        """A text is cut before each space, which is part of the word that follows; it begins with one."""
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        total, known = 0, self.known
        for word in (text[1:] if text.startswith(SPACE) else text).split(SPACE):
            n = known.get(word)
            if n is None:
                if len(known) >= CACHE:
                    known.clear()
                n = self.word(SPACE + word)
                if len(word) < LONG:
                    known[word] = n
            total += n
        return total


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(vocabulary(path))
    return _counters[path]


def token_count(text: Column, path: str) -> Column:
    """The number of tokens of whole texts; null and empty texts have none. path: the vocabulary's file, on every executor."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        own = counter(path)
        return pa.array([own.text(t or "") for _, part in chunks(texts) for t in part.to_pylist()], pa.int64())

    return F.coalesce(count(text), F.lit(0))
