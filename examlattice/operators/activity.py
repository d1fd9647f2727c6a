"""Days of activity, targets and streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOOK_BACK = 400


def local_day(ts: Column, zone: str = "UTC") -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def answers_per_day(answers: DataFrame, ts: str, zone: str = "UTC") -> DataFrame:
    return answers.groupBy("user_id", local_day(F.col(ts), zone).alias("day")).agg(F.count("*").alias("n"))


def target_progress(daily: DataFrame, today: str, target: int = 20) -> DataFrame:
    own = daily.where(F.col("day") == F.lit(today).cast("date"))
    return own.select("user_id", "n", F.least(F.lit(100), F.bround(100.0 * F.col("n") / target, 0).cast("int")).alias("percent"), F.greatest(F.lit(0), target - F.col("n")).alias("remaining"), (F.col("n") >= target).alias("met"))


def streaks(daily: DataFrame, today: str) -> DataFrame:
    """(user_id, current_streak, best_streak): days in a row with answers, over the last 400. The current one may end yesterday. Days to come and
    days without answers do not count."""
    from pyspark.sql.window import Window

    now = F.lit(today).cast("date")
    days = daily.where((F.col("n") > 0) & (F.col("day") <= now) & (F.col("day") > F.date_sub(now, LOOK_BACK))).select("user_id", "day").distinct()
    island = F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day")))
    runs = days.withColumn("island", island).groupBy("user_id", "island").agg(F.count("*").alias("length"), F.max("day").alias("last"))
    current = F.max(F.when(F.col("last") >= F.date_sub(now, 1), F.col("length")))
    return runs.groupBy("user_id").agg(F.coalesce(current, F.lit(0)).alias("current_streak"), F.max("length").alias("best_streak"))


def screen_time(events: DataFrame, most: int = 300) -> DataFrame:
    """(attempt_id, question_id, seconds): the gap to the attempt's next event goes to the question on screen, whole seconds, `most` at most.
    With answered_at in events (practice), only the part up to that moment."""
    from pyspark.sql.window import Window

    seconds = lambda c: F.col(c).cast("timestamp").cast("double")
    following = F.lead(seconds("ts")).over(Window.partitionBy("attempt_id").orderBy("ts", "event_id"))
    rows = events.withColumn("following", following)
    until = F.least("following", seconds("answered_at")) if "answered_at" in events.columns else F.col("following")
    gap = F.least(F.floor(F.greatest(until, seconds("ts")) - seconds("ts")), F.lit(most))
    rows = rows.withColumn("gap", F.when(F.col("following").isNotNull(), gap))  # the last event has no time of its own
    return rows.groupBy("attempt_id", "question_id").agg(F.sum(F.coalesce("gap", F.lit(0))).alias("seconds"))


def bursts(failures: DataFrame, seconds: int = 900, times: int = 5, lock: int = 900) -> DataFrame:
    """Failures (key, ts, event_id) that are at least the `times`th within `seconds`, and until when the key is locked."""
    from pyspark.sql.window import Window

    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    rows = failures.withColumn("at", at)
    recent = F.count("*").over(Window.partitionBy("key").orderBy("at").rangeBetween(-seconds, 0))
    return rows.withColumn("recent", recent).where(F.col("recent") >= times).select("key", "event_id", "recent", (F.col("at") + lock).alias("locked_until"))
