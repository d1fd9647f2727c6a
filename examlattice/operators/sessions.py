"""Running sessions: the palette, where to go on, what to practise, and what a report needs to be taken."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST = 100  #: questions of one session


def _timed() -> Column:
    return F.col("kind").isin("full_test", "section")


def _running_test() -> Column:
    return _timed() & (F.col("attempt_status") == "in_progress")


def remaining(attempts: DataFrame, now: str, grace: int = 3) -> DataFrame:
    """(attempt_id, remaining, overdue) of running attempts: whole seconds up to the deadline (rounded up, 0 behind it, null without one), and
    whether deadline and grace are over."""
    left = F.col("deadline_at").cast("timestamp").cast("double") - F.lit(now).cast("timestamp").cast("double")
    return attempts.where("status = 'in_progress'").select("attempt_id", F.greatest(F.ceil(left), F.when(left.isNotNull(), 0)).cast("long").alias("remaining"), F.coalesce(left < -grace, F.lit(False)).alias("overdue"))


def palette(responses: DataFrame) -> DataFrame:
    """(attempt_id, position, state, marked) of each response; marked: for review. A running test tells only whether a question is answered or was seen; else what
    is answered is right or wrong, and what is not is skipped, once the session is over."""
    answered, visited = F.col("selected_answer").isNotNull(), F.coalesce("visited", F.lit(False))
    hidden = F.when(answered, "answered").when(visited, "unanswered").otherwise("notvisited")
    told = F.when(answered & F.coalesce("is_correct", F.lit(False)), "correct").when(answered, "wrong").when(F.col("attempt_status") != "in_progress", "skipped").otherwise("unanswered")
    return responses.select("attempt_id", "position", F.when(_running_test(), hidden).otherwise(told).alias("state"), F.coalesce("marked", F.lit(False)).alias("marked"))


def next_positions(responses: DataFrame) -> DataFrame:
    """(attempt_id, next_position): where to go on. In a timed test that is the question on screen (on_screen), if one is; else the first
    position without an answer, or the last one, if all are answered."""
    shown = F.max(F.when(_timed() & F.coalesce("on_screen", F.lit(False)), F.col("position")))
    return responses.groupBy("attempt_id").agg(F.coalesce(shown, F.min(F.when(F.col("selected_answer").isNull(), F.col("position"))), F.max("position")).alias("next_position"))


def summary_counts(responses: DataFrame) -> DataFrame:
    """(attempt_id, total, answered, unanswered, not_visited, marked, unrated): what stands before a test is handed in."""
    answered = F.col("selected_answer").isNotNull()
    unrated = answered & (F.coalesce("confidence", F.lit("skipped")) == "skipped")
    return responses.groupBy("attempt_id").agg(F.count("*").alias("total"), F.count_if(answered).alias("answered"), F.count_if(~answered).alias("unanswered"), F.count_if(~F.coalesce("visited", F.lit(False))).alias("not_visited"), F.count_if(F.coalesce("marked", F.lit(False))).alias("marked"), F.count_if(unrated).alias("unrated"))


def _chance(*parts: object) -> int:
    """The first 15 hexadecimal digits of a hash."""
    return int.from_bytes(hashlib.sha1(":".join(map(str, parts)).encode()).digest()[:8], "big") >> 4


def _numbers(seed: str, user: str, n: int, k: int) -> list[int]:
    """k of the numbers below n in random order (see practice_draw)."""
    taken: set[int] = set()
    for j in range(n - k, n):
        t = _chance(seed, user, j) % (j + 1)
        taken.add(j if t in taken else t)
    return [t for _, t in sorted((_chance(seed, user, "order", t), t) for t in taken)]


def practice_draw(requests: DataFrame, pool: DataFrame, seed: str = "1") -> DataFrame:
    """(user_id, position, question_id): for each request (user_id, areas array<string>, count) `count` questions, MOST at most, drawn at random
    from all its areas of the pool (area, at, question_id; see hints.draw_pool), in random order and without repeats. One area is a topic
    or subject that was asked for, several are a learner's weak ones; areas of one request must not overlap. One request for a user.

    A draw of k from n (Floyd's): for j from n - k to n - 1 take a random number up to j, or j itself if that number was taken. Every set of k
    is equally likely, and only the k numbers drawn meet the pool. Random numbers are hashes of seed, user and j, so a draw can be
    repeated."""

    @F.pandas_udf("array<bigint>")
    def drawn(users: pd.Series, n: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([_numbers(seed, *x) for x in zip(users.tolist(), n.tolist(), k.tolist())], dtype=object)

    sizes = pool.groupBy("area").agg(F.count("*").alias("n"))
    asked = requests.select("user_id", "count", F.explode(F.array_distinct("areas")).alias("area")).join(sizes, "area")
    asked = asked.groupBy("user_id", "count").agg(F.array_sort(F.collect_list(F.struct("area", "n"))).alias("areas"))
    ends = F.transform(F.sequence(F.lit(1), F.size("areas")), lambda i: F.aggregate(F.slice("areas", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    asked = asked.withColumn("ends", ends).withColumn("n", F.element_at("ends", -1)).withColumn("k", F.least(F.greatest("count", F.lit(1)).cast("long"), F.lit(MOST).cast("long"), "n"))
    # a request is few bytes and much work, so by their bytes all would go to one task; by user_id itself they may lie as one already
    asked = asked.repartition(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("user_id"))
    rows = asked.select("user_id", "areas", "ends", F.posexplode(drawn(F.col("user_id").cast("string"), "n", "k")).alias("i", "t"))
    rows = rows.withColumn("which", F.size(F.filter("ends", lambda e: e <= F.col("t"))))
    rows = rows.select("user_id", (F.col("i") + 1).alias("position"), F.get("areas", F.col("which"))["area"].alias("area"), (F.col("t") - F.when(F.col("which") > 0, F.get("ends", F.col("which") - 1)).otherwise(0)).alias("at"))
    return rows.join(pool, ["area", "at"]).select("user_id", "position", "question_id")


def mistake_draw(mistakes: DataFrame, count: int, shuffled: bool = False, seed: str = "1") -> DataFrame:
    """(user_id, position, question_id): each user's `count` mistakes (user_id, question_id, due), MOST at most: the longest due first, those
    without a date last, or in random order."""
    mixed = F.sha1(F.concat_ws(":", F.lit(seed), F.col("user_id").cast("string"), F.col("question_id").cast("string")))
    order = [mixed] if shuffled else [F.asc_nulls_last("due"), "question_id"]
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(*order))
    return mistakes.select("user_id", place.alias("position"), "question_id").where(F.col("position") <= max(1, min(count, MOST)))


def filter_errors(requests: DataFrame, sources: list[str], topics: DataFrame) -> DataFrame:
    """(request_id, error) of filter requests (request_id, source, subject, topic, difficulty), all texts that may be null. topics: all
    (subject, topic) that exist. error: null if the request is fine, else what is wrong with it first."""
    known = topics.select("subject").where("subject IS NOT NULL").distinct().select(F.col("subject"), F.lit(True).alias("has_subject"))
    subjects = topics.where("topic IS NOT NULL").groupBy("topic").agg(F.collect_set("subject").alias("subjects"))  # the few subjects of one topic
    rows = requests.join(known, "subject", "left").join(subjects, "topic", "left")
    given = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    error = (
        F.when(given("source") & ~F.col("source").isin(sources), "unknown_source").when(given("subject") & F.col("has_subject").isNull(), "unknown_subject")
        .when(given("topic") & F.col("subjects").isNull(), "unknown_topic").when(given("topic") & given("subject") & ~F.array_contains("subjects", F.col("subject")), "topic_of_other_subject")
        .when(given("difficulty") & ~F.lower("difficulty").isin("easy", "medium", "hard"), "unknown_difficulty")
    )
    return rows.select("request_id", error.alias("error"))


def report_verdicts(requests: DataFrame, reports: DataFrame, most: int = 20, hours: int = 24) -> DataFrame:
    """(request_id, recent, verdict) of requests (request_id, user_id, question_id, at) to report a question, by the reports that are
    stored (user_id, question_id, at, status): open if the user has an open one on the question, limit if the user filed `most`
    within the hours before, else taken. recent: how many these are."""
    second = F.unix_timestamp(F.col("at").cast("timestamp")).alias("second")
    asked = requests.select("request_id", "user_id", "question_id", second)
    both = reports.select(F.lit(None).cast("long").alias("request_id"), "user_id", "question_id", second).unionByName(asked)
    recent = F.count(F.when(F.col("request_id").isNull(), 1)).over(Window.partitionBy("user_id").orderBy("second").rangeBetween(-hours * 3600, 0))
    waiting = reports.where("status = 'open'").groupBy("user_id", "question_id").agg(F.min(F.unix_timestamp(F.col("at").cast("timestamp"))).alias("since"))
    rows = both.withColumn("recent", recent).where("request_id IS NOT NULL").join(waiting, ["user_id", "question_id"], "left")
    verdict = F.when(F.coalesce(F.col("since") <= F.col("second"), F.lit(False)), "open").when(F.col("recent") >= most, "limit").otherwise("taken")
    return rows.select("request_id", "recent", verdict.alias("verdict"))
