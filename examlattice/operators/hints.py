"""Subjects that a question's words point to, by a table of keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEAST = 2  #: points that a hint needs
SMALL = 100_000  #: keywords that may go to every task


def _pieces(s: Column) -> Column:
    return F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9]+"), F.lit(0))


def keyword_table(spark, keywords: dict[str, list[str]]) -> DataFrame:
    """(subject, keyword) of a dictionary of lists."""
    return spark.createDataFrame([(s, k) for s, own in keywords.items() for k in own], "subject string, keyword string")


def subject_scores(questions: DataFrame, keywords: DataFrame) -> DataFrame:
    """(question_id, subject, score) of questions (question_id, text, options array<string>) by keywords (subject, keyword): each distinct
    keyword in the text or an option counts 1, a phrase 2. Subjects without a hit are left out.

    A question's runs of up to as many words as the longest keyword has meet the keywords in one join, so a further keyword costs nothing; what
    meets is then looked at letter by letter, as 'no-confidence' is not 'no confidence'."""
    text = F.concat_ws(" ", "text", F.array_join(F.filter(F.coalesce("options", F.array().cast("array<string>")), lambda o: o != ""), " "))
    table = keywords.select("subject", F.lower("keyword").alias("keyword")).distinct().select("*", _pieces(F.col("keyword")).alias("p")).where(F.size("p") > 0)
    size = table.agg(F.count("*").alias("n"), F.max(F.size("p")).alias("longest")).first()
    table = table.select("subject", "keyword", F.array_join("p", " ").alias("run"), F.when(F.col("keyword").contains(" "), 2).otherwise(1).alias("weight"))
    rows = questions.select("question_id", F.lower(text).alias("low")).withColumn("p", _pieces(F.col("low")))
    places = F.when(F.size("p") > 0, F.sequence(F.lit(1), F.size("p"))).otherwise(F.array().cast("array<int>"))
    runs = F.flatten(F.transform(places, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(size.longest or 1), F.size("p") - i + 1)), lambda n: F.array_join(F.slice("p", i, n), " "))))
    met = rows.select("question_id", "low", F.explode(F.array_distinct(runs)).alias("run")).join(F.broadcast(table) if size.n <= SMALL else table, "run")
    exact = F.call_function("rlike", F.col("low"), F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.col("keyword"), F.lit(r"\E(?![a-z0-9])")))
    return met.where(exact).groupBy("question_id", "subject").agg(F.sum("weight").cast("int").alias("score"))


def subject_hints(questions: DataFrame, keywords: DataFrame, least: int = LEAST) -> DataFrame:
    """(question_id, subject, score) for every question: its best subject, if that has `least` points and more than any other; else nulls."""
    scores = subject_scores(questions, keywords).groupBy("question_id").agg(F.max(F.struct("score", "subject")).alias("best"), F.max("score").alias("top"), F.collect_list("score").alias("all"))
    clear = (F.col("top") >= least) & (F.size(F.filter("all", lambda s: s == F.col("top"))) == 1)
    found = scores.where(clear).select("question_id", "best.subject", "best.score")
    return questions.select("question_id").join(found, "question_id", "left")


def draw_pool(questions: DataFrame, area: str, buckets: int = 64) -> DataFrame:
    """(area, at, question_id): questions (question_id, and the column `area`) numbered from 0 within their area. Buckets by id are numbered by
    themselves and then shifted, so that no task sorts a whole area."""
    own = questions.where(F.col(area).isNotNull()).select(F.concat(F.lit(f"{area}:"), F.col(area)).alias("area"), "question_id", F.pmod("question_id", F.lit(buckets)).alias("b"))
    sizes = own.groupBy("area", "b").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("area").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("area", "b").orderBy("question_id")) - 1
    return own.withColumn("i", within).join(sizes.select("area", "b", before.alias("before")), ["area", "b"]).select("area", (F.col("before") + F.col("i")).alias("at"), "question_id")
