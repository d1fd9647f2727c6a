"""What a learner may see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def needs_snapshot() -> Column:
    """A question with an image but no picture of its page is held back."""
    return F.col("has_image") & ~F.col("has_snapshot")


def live_questions(questions: DataFrame, papers: DataFrame) -> DataFrame:
    """Live questions with an answer A-E, of ready, published papers that are not archived, and not held back."""
    shown = papers.where((F.col("status") == "ready") & (F.col("publish_status") == "published") & ~F.col("archived")).select("paper_id", "source_type", "year", "title")
    fine = (F.col("status") == "live") & F.col("correct_answer").isin(*"ABCDE") & ~needs_snapshot()
    return questions.where(fine).join(shown, "paper_id")


def unattempted(users: DataFrame, live: DataFrame, responses: DataFrame) -> DataFrame:
    """(user_id, n_open): live questions that a user has not answered. Counted, not listed: users times questions is never built."""
    answered = responses.where(F.col("selected_answer").isNotNull()).join(live.select("question_id"), "question_id", "left_semi")
    done = answered.groupBy("user_id").agg(F.countDistinct("question_id").alias("done"))
    total = live.agg(F.count("*").alias("total"))
    return users.select("user_id").join(done, "user_id", "left").join(F.broadcast(total)).select("user_id", (F.col("total") - F.coalesce("done", F.lit(0))).alias("n_open"))


def practice_pool(live: DataFrame, *, source: str | None = None, year: int | None = None, subject: str | None = None, topic: str | None = None, difficulty: str | None = None, unattempted_by: int | None = None, responses: DataFrame | None = None) -> DataFrame:
    """The live questions that a learner chose to practise. unattempted_by: only those that this user has not answered in responses."""
    for column, value in (("source_type", source), ("year", year), ("subject", subject), ("topic", topic), ("difficulty", difficulty)):
        if value is not None:
            live = live.where(F.col(column) == value)
    if unattempted_by is not None:
        done = responses.where((F.col("user_id") == unattempted_by) & F.col("selected_answer").isNotNull()).select("question_id")
        live = live.join(done, "question_id", "left_anti")
    return live


def seen_state(responses: DataFrame) -> DataFrame:
    """Per (user, question): has_seen (met at all), can_reveal (finished with it), locked (in a running test)."""
    timed = F.col("kind").isin("full_test", "section")
    running = F.col("attempt_status") == "in_progress"
    locked = F.max(F.coalesce(timed & running, F.lit(False)))
    over = F.max(F.coalesce(~running | (~timed & F.col("selected_answer").isNotNull()), F.lit(False)))
    found = responses.groupBy("user_id", "question_id").agg(locked.alias("locked"), over.alias("over"))
    return found.select("user_id", "question_id", F.col("over").alias("has_seen"), (F.col("over") & ~F.col("locked")).alias("can_reveal"), "locked")


def filter_options(live: DataFrame) -> DataFrame:
    """(kind, value, n): what the practice filter may offer, from one pass with grouping sets."""
    kinds = ["source_type", "year", "subject", "topic", "difficulty"]
    rows = live.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in kinds])).alias("x"))
    return rows.select("x.*").where("value IS NOT NULL").groupBy("kind", "value").agg(F.count("*").alias("n"))


def topic_frequency(live: DataFrame, top: int = 15) -> DataFrame:
    """(name, n, total) of the most frequent topics of official questions; of subjects, if no topic is assigned at all."""
    own = live.where("source_type = 'official'")
    has_topic = own.agg(F.count("topic").alias("topics"), F.count("*").alias("total"))
    rows = own.join(F.broadcast(has_topic)).select(F.when(F.col("topics") > 0, F.col("topic")).otherwise(F.col("subject")).alias("name"), "total")
    return rows.where("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("n"), F.max("total").alias("total")).orderBy(F.desc("n"), "name").limit(top)
