"""Ranks: competition ranking, percentiles, boards by test and by week."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_ranked(tests: DataFrame) -> DataFrame:
    """The first started attempt of each user and rank key; only that one counts for a rank."""
    w = Window.partitionBy("user_id", "rank_key").orderBy("started_at", "attempt_id")
    return tests.withColumn("turn", F.row_number().over(w)).where("turn = 1").drop("turn")


def ranked(rows: DataFrame, board: str) -> DataFrame:
    """rows (board, user_id, value, seconds) with rank_pos, n and percentile. Ties share a rank only if value (6 places) and time
    are equal; a missing time is last. percentile: the share of the others that rank below, from five participants on.

    Places come from how often a board holds each (value, time), so no board is sorted row by row."""
    key = [F.col(board), F.bround("value", 6).alias("v"), F.coalesce("seconds", F.lit(float("inf"))).cast("double").alias("s")]
    rows = rows.select("*", *key[1:])
    counts = rows.groupBy(board, "v", "s").agg(F.count("*").alias("same"))
    w = Window.partitionBy(board).orderBy(F.desc("v"), "s")
    before = F.coalesce(F.sum("same").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.select(board, "v", "s", "same", before.alias("before"), F.sum("same").over(Window.partitionBy(board)).alias("n"))
    percentile = F.when(F.col("n") >= 5, F.bround(100.0 * (F.col("n") - F.col("before") - F.col("same")) / (F.col("n") - 1), 0).cast("int"))
    return rows.join(places, [board, "v", "s"]).withColumn("rank_pos", F.col("before") + 1).withColumn("percentile", percentile).drop("v", "s", "same", "before")


def test_board(tests: DataFrame, users: DataFrame) -> DataFrame:
    students = users.where((F.col("status") == "approved") & ~F.col("is_admin")).select("user_id")
    rows = first_ranked(tests).join(students, "user_id", "left_semi").where("max_marks > 0")
    return ranked(rows.select("rank_key", "user_id", F.col("percent").alias("value"), F.col("time_taken").alias("seconds")), "rank_key")


def weekly_board(tests: DataFrame, users: DataFrame) -> DataFrame:
    """Per week (from Monday) the mean percent and mean seconds of each user's counted full tests, ranked."""
    students = users.where((F.col("status") == "approved") & ~F.col("is_admin")).select("user_id")
    rows = first_ranked(tests).where("kind = 'full_test' AND max_marks > 0").join(students, "user_id", "left_semi")
    rows = rows.groupBy(F.date_trunc("week", "completed_at").cast("date").alias("week"), "user_id").agg(F.bround(F.avg("percent"), 6).alias("value"), F.bround(F.avg("time_taken"), 6).alias("seconds"))
    return ranked(rows, "week")


def shown(board: DataFrame, users: DataFrame, viewer: int, top: int = 10) -> DataFrame:
    """The first places and the viewer's own; who opted out is anonymous to others."""
    rows = board.where((F.col("rank_pos") <= top) | (F.col("user_id") == viewer)).join(users.select("user_id", "display_name", "show_on_leaderboard"), "user_id")
    own = F.col("user_id") == viewer
    return rows.withColumn("name", F.when(own | F.col("show_on_leaderboard"), F.col("display_name")).otherwise("Anonymous")).withColumn("is_viewer", own).drop("user_id", "display_name", "show_on_leaderboard")
