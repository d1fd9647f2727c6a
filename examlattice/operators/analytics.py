"""A learner's progress, for all learners at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .grading import percent, right

ENOUGH, WEAK = 5, 60


def graded_answers(responses: DataFrame) -> DataFrame:
    """Graded answers, of running practice too."""
    return responses.where(F.col("selected_answer").isNotNull() & F.col("is_correct").isNotNull())


def finished_tests(totals: DataFrame, attempts: DataFrame) -> DataFrame:
    """Finished timed tests with their score in percent."""
    own = attempts.where(F.col("kind").isin("full_test", "section") & F.col("status").isin("submitted", "expired")).select("attempt_id", "user_id", "kind", "status", "completed_at")
    score = F.when(F.col("max_marks") > 0, F.bround(100 * F.col("score") / F.col("max_marks"), 1))
    return totals.join(own, "attempt_id").withColumn("percent", score)


def overview(responses: DataFrame, tests: DataFrame) -> DataFrame:
    """Per user: answered, right, accuracy, mean seconds over recorded times, tests taken, mean score in percent.

    Half a percent is common among mean scores, and there a sum of doubles decides by its last bit. Two of them have the same sum in either
    order, which is taken as it is; that of more depends on their order, so their mean comes from whole tenths, as scores have one decimal."""
    t = F.when(F.col("seconds") > 0, F.col("seconds"))
    n, tenths = F.count("percent"), F.sum(F.round(10 * F.col("percent"), 0).cast("long"))
    mean = F.when(n <= 2, F.avg("percent")).otherwise(tenths / (10 * n))
    answers = graded_answers(responses).groupBy("user_id").agg(F.count("*").alias("answered"), F.count_if(right()).alias("right"), F.bround(F.avg(t), 0).cast("int").alias("mean_seconds"))
    taken = tests.groupBy("user_id").agg(F.count("*").alias("tests"), F.bround(mean, 0).cast("int").alias("mean_score"))
    return answers.join(taken, "user_id", "left").select("user_id", "answered", "right", percent(F.col("right"), F.col("answered")).alias("accuracy"), "mean_seconds", F.coalesce("tests", F.lit(0)).alias("tests"), "mean_score")


def accuracy_by(responses: DataFrame, key: str) -> DataFrame:
    """Per user and key (subject or topic; null topics are left out): counts, accuracy, and whether that is enough and weak."""
    rows = graded_answers(responses)
    rows = rows.where(F.col(key).isNotNull()) if key == "topic" else rows.withColumn(key, F.coalesce(key, F.lit("No subject set")))
    found = rows.groupBy("user_id", key).agg(F.count("*").alias("answered"), F.count_if(right()).alias("right"))
    found = found.withColumn("accuracy", percent(F.col("right"), F.col("answered"))).withColumn("enough", F.col("answered") >= ENOUGH)
    return found.withColumn("weak", F.col("enough") & (F.col("accuracy") < WEAK))


def weak_areas(responses: DataFrame, most: int = 3) -> DataFrame:
    """(user_id, kind, name, accuracy, place): a user's weakest topics; the weakest subjects if no topic is weak."""
    topics = accuracy_by(responses, "topic").where("weak").select("user_id", F.lit("topic").alias("kind"), F.col("topic").alias("name"), "accuracy", "answered")
    subjects = accuracy_by(responses.where("subject IS NOT NULL"), "subject").where("weak").select("user_id", F.lit("subject").alias("kind"), F.col("subject").alias("name"), "accuracy", "answered")
    both = topics.unionByName(subjects).withColumn("has_topic", F.max(F.col("kind") == "topic").over(Window.partitionBy("user_id")))
    both = both.where((F.col("kind") == "topic") | ~F.col("has_topic"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("accuracy", F.desc("answered"), "name"))
    return both.withColumn("place", place).where(F.col("place") <= most).select("user_id", "kind", "name", "accuracy", "place")


def score_trend(tests: DataFrame, most: int = 30) -> DataFrame:
    """The last finished tests of each user, oldest first."""
    back = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("completed_at"), F.desc("attempt_id")))
    found = tests.withColumn("back", back).where(F.col("back") <= most)
    order = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("back")))
    return found.select("user_id", "attempt_id", "percent", order.alias("place"))


def performance_list(users: DataFrame, over: DataFrame, weak: DataFrame, responses: DataFrame) -> DataFrame:
    """Approved students with their overview, weak areas and last activity."""
    areas = weak.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), ", ").alias("weak_areas"))
    last = responses.groupBy("user_id").agg(F.max("started_at").cast("date").alias("last_active"))
    own = users.where((F.col("status") == "approved") & ~F.col("is_admin")).select("user_id", "display_name")
    return own.join(over, "user_id", "left").join(areas, "user_id", "left").join(last, "user_id", "left").select("user_id", "display_name", "answered", "accuracy", "tests", "weak_areas", "last_active")
