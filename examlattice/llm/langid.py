"""Language identification with language-bitmask n-gram filters.

Every text is cut into 4-byte n-grams of its lower-case letters (whatever Unicode calls a letter or mark), with word ends. A Bloom filter is kept bit-sliced: each slot
holds one bit for each language, so the AND of an n-gram's slots gives the mask of all languages that contain it. For each
language the hits of a text are counted, freed of the filter's expected false positives, and the largest count decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._text import U, chunks, mix, text_bytes

UNKNOWN = "und"
_EDGE, _NONE = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
_LETTER = np.zeros(256, bool)
_LETTER[0x80:] = True
_LETTER[ord("a") : ord("z") + 1] = True


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, index of its text) for all n-grams: four bytes, where anything but letters counts as one space."""
    low = pc.utf8_lower(pc.replace_substring_regex(pc.fill_null(texts.cast(pa.large_string()), ""), r"[^\pL\pM]+", " "))
    low = pc.binary_join_element_wise(_EDGE, low, _EDGE, _NONE)
    raw, at = text_bytes(low)
    if len(raw) < 4:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    letter = _LETTER[raw]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[at[:-1]] = True
    after = np.cumsum(keep)
    at = np.concatenate([[0], after[at[1:] - 1]])
    b = np.where(letter, raw, 32)[keep].astype(np.uint32)
    if len(b) < 4:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    code = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    same = doc[:-3] == doc[3:]
    return code[same], doc[:-3][same]


@dataclass
class LanguageFilter:
    """languages: by falling share of the training texts, which also breaks ties. slots: (words of the mask, slots)."""

    languages: list[str]
    slots: np.ndarray
    hashes: int
    false_positive: np.ndarray = field(init=False)

    def __post_init__(self):
        filled = [np.mean((self.slots[k // 64] >> U(k % 64)) & U(1)) for k in range(len(self.languages))]
        self.false_positive = np.minimum(np.array(filled, float) ** self.hashes, 0.999)

    @staticmethod
    def places(codes: np.ndarray, n_slots: int, hashes: int) -> list[np.ndarray]:
        h = mix(codes.astype(U))
        step = (h >> U(32)) | U(1)
        return [((h + U(j) * step) % U(n_slots)).astype(np.int64) for j in range(hashes)]

    @classmethod
    def build(cls, languages: list[str], codes: np.ndarray, masks: np.ndarray, n_slots: int, hashes: int) -> LanguageFilter:
        """masks: (words of the mask, n-grams)."""
        slots = np.zeros((max(1, -(-len(languages) // 64)), n_slots), U)
        for place in cls.places(codes, n_slots, hashes):
            for word in range(len(slots)):
                np.bitwise_or.at(slots[word], place, masks[word])
        return cls(languages, slots, hashes)

    def masks(self, codes: np.ndarray) -> np.ndarray:
        places = self.places(codes, self.slots.shape[1], self.hashes)
        out = self.slots[:, places[0]]
        for place in places[1:]:
            out &= self.slots[:, place]
        return out

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of each text; for each text and language the hits, less those that the filter makes up."""
        code, doc = grams(texts)
        n = np.bincount(doc, minlength=len(texts)).astype(float)
        mask = self.masks(code)
        hits = np.empty((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            bit = (mask[k // 64] >> U(k % 64)) & U(1)
            hits[:, k] = np.bincount(doc, bit.astype(float), minlength=len(texts))
        fp = self.false_positive
        return n, np.maximum(0, (hits - n[:, None] * fp) / (1 - fp))

    def predict(self, texts: pa.Array) -> pa.StructArray:
        if not len(texts) or not self.languages:
            n = len(texts)
            return pa.StructArray.from_arrays([pa.array([UNKNOWN] * n, pa.string()), pa.array([0.0] * n), pa.array([0.0] * n)], ["lang_pred", "score", "coverage"])
        n, counts = self.counts(texts)
        best = counts.argmax(1)
        top, total = counts.max(1), counts.sum(1)
        score = np.where(total > 0, top / np.maximum(total, 1e-9), 0.0)
        coverage = np.minimum(1.0, top / np.maximum(n, 1))
        names = pa.array(self.languages, pa.string()).take(pa.array(best))
        return pa.StructArray.from_arrays([names, pa.array(score), pa.array(coverage)], ["lang_pred", "score", "coverage"])


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, number of texts that hold it), summed over each chunk of texts."""
    for batch in batches:
        for at, texts in chunks(batch.column("text")):
            lang = batch.column("lang").slice(at, len(texts)).dictionary_encode()
            ids, names = lang.indices.to_numpy(zero_copy_only=False).astype(U), lang.dictionary
            code, doc = grams(texts)
            own = np.unique((doc.astype(U) << U(32)) | code.astype(U))
            key, n = np.unique((ids[(own >> U(32)).astype(np.int64)] << U(32)) | (own & U(0xFFFFFFFF)), return_counts=True)
            yield pa.RecordBatch.from_arrays([names.take(pa.array((key >> U(32)).astype(np.int64))), pa.array((key & U(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def fit(labelled: DataFrame, *, sample: int = 20_000, least_share: float = 0.005, least: int = 2, n_slots: int = 1 << 20, hashes: int = 2, most_grams: int = 100_000, most_languages: int = 1024) -> LanguageFilter:
    """Learns a filter from (doc_id, text, lang).

    Rows without lang or text are left out. Of each language all labelled texts are used up to its equal share of `sample`, and about
    that share of a larger one, chosen by a hash of id and text: the n-gram vocabulary of a language is saturated long before, and a
    rare language keeps its rows. An n-gram belongs to a language if `least_share` of its texts and `least` texts hold it (one text is
    enough if the language has fewer than four). The model's size is bounded by parameters: a language keeps its `most_grams` most
    frequent n-grams (on the given tables no language has half as many), and labels that are none of the `most_languages` most
    frequent are not learned. Without any labelled row the filter knows no language.
    """
    labelled = labelled.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    if not sizes:
        return LanguageFilter([], np.zeros((1, n_slots), U), hashes)
    share = -(-sample // len(sizes))
    chance = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1 << 20, -(-share * (1 << 20) // n)))])
    labelled = labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < chance[F.col("lang")])
    totals = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(totals, key=lambda x: (-sizes[x], x))
    if not languages:
        return LanguageFilter([], np.zeros((1, n_slots), U), hashes)
    need = F.create_map(*[F.lit(x) for name in languages for x in (name, float(max(least if totals[name] >= 4 else 1, least_share * totals[name])))])
    counted = (
        labelled.select("lang", "text").mapInArrow(_document_counts, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= need[F.col("lang")])
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    table = counted.withColumn("rank", rank).where(F.col("rank") <= most_grams).select("lang", "gram").toArrow()
    place = {name: k for k, name in enumerate(languages)}
    code = table.column("gram").to_numpy()
    lang = np.array([place[x] for x in table.column("lang").to_pylist()], int)
    unique, inverse = np.unique(code, return_inverse=True)
    mask = np.zeros((max(1, -(-len(languages) // 64)), len(unique)), U)
    for k in range(len(languages)):
        mask[k // 64, inverse[lang == k]] |= U(1) << U(k % 64)
    return LanguageFilter.build(languages, unique.astype(np.uint32), mask, n_slots, hashes)


RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("coverage", T.DoubleType())])


def language(model: LanguageFilter, text: Column, spark) -> Column:
    """Struct (lang_pred, score, coverage) of a text. score: the winner's share of all corrected hits; coverage: the share of
    the text's n-grams that the winner knows. A null text, or one without a letter, is `und` with score 0. A text of letters
    that no language knows gets the most frequent language, with score 0. Ties go to the more frequent language."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def predict(texts: pa.Array) -> pa.Array:
        parts = [shared.value.predict(x) for _, x in chunks(texts)]
        return pa.concat_arrays(parts) if parts else shared.value.predict(texts)

    none = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("coverage"))
    if not model.languages:
        return none
    return F.when(text.isNull() | ~text.rlike(r"\p{L}"), none).otherwise(predict(text))


def identify(docs: DataFrame, model: LanguageFilter, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and coverage. Columns of docs with these names are replaced; all others stay."""
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "coverage", "__lang")]
    return docs.select(*kept, language(model, F.col(text), spark).alias("__lang")).select(*kept, "__lang.lang_pred", "__lang.score", "__lang.coverage")
