"""The corpus pipeline: language, near duplicates, benchmark leaks, privacy, packing; each stage over all that the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examlattice.llm import decontam, langid, neardup, packing, pii
from examlattice.llm._store import Scratch, restrict
from examlattice.llm.queries import PII_KEY, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the labelled rows teach. Rejected: no letters at all (null and empty texts too), or a text of
    20 characters and more of which the best language knows less than a tenth of the n-grams."""
    model = langid.fit(docs)
    found = langid.identify(docs, model)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & ((F.length("text") < 20) | (F.col("coverage") >= 0.1))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each near-duplicate component; of rows with one doc_id one. Rows without a
    doc_id and empty texts are linked with nothing and stay."""
    found = Scratch(spark, "pipeline").keep(neardup.near_duplicates(docs, k=5, percent=80).select("doc_id", "kept"))
    gone = Scratch(spark, "pipeline").keep(found.where("NOT kept").select("doc_id").distinct())
    kept = restrict(docs.select(*COLUMNS), gone, "doc_id", "left_anti").select(*COLUMNS)
    repeated = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.isEmpty():
        return kept
    return kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionAll(kept.where("doc_id IS NULL"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item, and rows without doc_id."""
    return decontam.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in all texts; n_chars is that of the new text, and stays where the text is null."""
    found = pii.pseudonymise(docs.select(*COLUMNS), PII_KEY)
    return found.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces of sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language ID", language_id), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("PII", pseudonymise), ("packing", pack)]

#: Chosen-path joins, fingerprints and column generation have no SQL form; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    before = None
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
