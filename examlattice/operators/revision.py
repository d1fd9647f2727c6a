"""Spaced repetition: the schedule as a fold over a question's graded answers, and the mistake notebook."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Days until the next review, by stage.
LADDER = [1, 3, 7, 15]
PASS = 2
STATE = "struct<stage:int,streak:int,status:string,due:date,result:string>"


def _due(stage: Column, day: Column) -> Column:
    return F.date_add(day, F.element_at(F.array(*[F.lit(d) for d in LADDER]), F.least(stage, F.lit(len(LADDER) - 1)) + 1))


def step(s: Column, x: Column) -> Column:
    """The state after one answer x (day, correct, clean). A right answer counts only if it is due; a clean one twice in a row
    masters the question; a wrong or guessed one breaks the streak. Whatever is due climbs the ladder."""
    day, correct, clean = x["day"], x["correct"], x["clean"]

    def state(stage: Column, streak: Column, status: str, due: Column, result: str) -> Column:
        return F.struct(stage.cast("int").alias("stage"), streak.cast("int").alias("streak"), F.lit(status).alias("status"), due.alias("due"), F.lit(result).alias("result"))

    none, done, due = s["status"].isNull(), s["status"] == "done", s["due"] <= day
    zero, up = F.lit(0), s["stage"] + 1
    unchanged = F.struct(s["stage"].alias("stage"), s["streak"].alias("streak"), s["status"].alias("status"), s["due"].alias("due"), F.lit("ignored").alias("result"))
    wrong = F.when(none, state(zero, zero, "active", _due(zero, day), "created")).when(done, state(zero, zero, "active", _due(zero, day), "reset")).when(due, state(up, zero, "active", _due(up, day), "reviewed")).otherwise(state(s["stage"], zero, "active", s["due"], "streak_broken"))
    right = F.when(none | done | ~due, unchanged).when(~clean, state(up, zero, "active", _due(up, day), "reviewed")).when(s["streak"] + 1 >= PASS, state(s["stage"], s["streak"] + 1, "done", s["due"], "mastered")).otherwise(state(up, s["streak"] + 1, "active", _due(up, day), "reviewed"))
    return F.when(correct, right).otherwise(wrong)


def _answer() -> Column:
    return F.struct("day", "seq", "correct", (~F.coalesce(F.col("confidence").isin("guessed", "no_idea"), F.lit(False))).alias("clean"))


def _fold(answers: str) -> Column:
    begin = F.struct(F.lit(None).cast("int").alias("stage"), F.lit(None).cast("int").alias("streak"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("date").alias("due"), F.lit(None).cast("string").alias("result"))
    return F.aggregate(answers, begin, step)


def schedule(answers: DataFrame) -> DataFrame:
    """(user_id, question_id, stage, streak, status, due) from answers (user_id, question_id, day, seq, correct, confidence)."""
    rows = answers.select("user_id", "question_id", _answer().alias("x"))
    folded = rows.groupBy("user_id", "question_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    last = folded.select("user_id", "question_id", _fold("xs").alias("s")).where("s.status IS NOT NULL")
    return last.select("user_id", "question_id", "s.stage", "s.streak", "s.status", "s.due")


def notebook(responses: DataFrame, reasons: DataFrame, items: DataFrame, today: str) -> DataFrame:
    """Per (user, question) that was ever wrong or guessed right: counts, the latest reason, last day and state (due, scheduled,
    mastered, guessed)."""
    graded = responses.where(F.col("selected_answer").isNotNull() & F.col("is_correct").isNotNull())
    graded = graded.join(reasons, ["attempt_id", "question_id"], "left")
    found = graded.groupBy("user_id", "question_id").agg(*_counts()).where("wrong_n > 0 OR guessed_n > 0")
    return _states(found.join(items.select("user_id", "question_id", "status", "due"), ["user_id", "question_id"], "left"), today)


def _counts() -> list[Column]:
    bad = ~F.col("is_correct")
    shaky = F.col("is_correct") & F.col("confidence").isin("guessed", "no_idea")
    return [F.count_if(bad).alias("wrong_n"), F.count_if(shaky).alias("guessed_n"), F.max_by(F.when(bad, F.col("reason")), F.when(bad, F.struct("attempt_id", "position"))).alias("last_reason"), F.max("started_at").cast("date").alias("last_day")]


def _states(found: DataFrame, today: str, *more: str) -> DataFrame:
    now = F.lit(today).cast("date")
    state = F.when(F.col("status") == "done", "mastered").when((F.col("status") == "active") & (F.col("due") <= now), "due").when(F.col("status") == "active", "scheduled").otherwise("guessed")
    return found.select("user_id", "question_id", "wrong_n", "guessed_n", "last_reason", "last_day", state.alias("state"), F.when(F.col("status") == "active", F.date_diff("due", now)).alias("days_until"), *more)


def notebook_at_once(responses: DataFrame, today: str, *more: str) -> DataFrame:
    """notebook, from responses with their reasons (see grading.with_reasons) and the schedule of their finished attempts, in one grouping.
    more: columns that a question fixes."""
    graded = responses.where(F.col("selected_answer").isNotNull() & F.col("is_correct").isNotNull())
    named = graded.withColumns({"day": F.col("started_at").cast("date"), "seq": F.col("attempt_id") * 100 + F.col("position"), "correct": F.col("is_correct")})
    # only a named user's finished attempts count in the schedule
    graded = named.select("user_id", "question_id", *more, "attempt_id", "position", "is_correct", "confidence", "reason", "started_at", F.when((F.col("attempt_status") != "in_progress") & F.col("user_id").isNotNull(), _answer()).alias("x"))
    found = graded.groupBy("user_id", "question_id", *more).agg(*_counts(), F.array_sort(F.collect_list("x")).alias("xs")).where("wrong_n > 0 OR guessed_n > 0")
    return _states(found.withColumn("s", _fold("xs")).select("*", "s.status", "s.due"), today, *more)


def due_counts(items: DataFrame, live: DataFrame, today: str) -> DataFrame:
    own = items.where((F.col("status") == "active") & (F.col("due") <= F.lit(today).cast("date"))).join(live.select("question_id"), "question_id", "left_semi")
    return own.groupBy("user_id").agg(F.count("*").alias("n"))
