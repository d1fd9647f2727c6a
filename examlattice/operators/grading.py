"""Marks, mistakes and guesses of attempts; all attempts in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PACE = 72  #: seconds for a question


def answered() -> Column:
    return F.col("selected_answer").isNotNull()


def right() -> Column:
    return answered() & F.coalesce(F.col("is_correct"), F.lit(False))


def wrong() -> Column:
    return answered() & F.coalesce(~F.col("is_correct"), F.lit(False))


def percent(part: Column, whole: Column) -> Column:
    """Half-even whole percent; null where nothing counts."""
    return F.when(whole > 0, F.bround(100.0 * part / whole, 0).cast("int"))


def scheme(marks: Column, negative: Column) -> Column:
    """(marks, penalty): a missing or zero mark is 2, a missing negative share a third; a share of zero is none."""
    m = F.coalesce(F.nullif(marks, F.lit(0.0)), F.lit(2.0))
    return F.struct(m.alias("marks"), F.round(m * F.coalesce(negative, F.lit(1) / F.lit(3)), 6).alias("penalty"))


def custom_scheme(attempts: DataFrame) -> DataFrame:
    """(attempt_id, marks, penalty, seconds, error, ranked) of tests that learners start: their own settings (own_marks, own_negative, own_minutes,
    null where they keep the paper's) or the paper's (marks_per_question, negative_fraction, n questions at the usual pace or
    duration_minutes). Only a paper's own full settings are ranked; error names a setting that cannot be."""
    m, f = F.coalesce(F.nullif("marks_per_question", F.lit(0.0)), F.lit(2.0)), F.coalesce("negative_fraction", F.lit(1) / F.lit(3))
    usual = F.coalesce(F.nullif("duration_minutes", F.lit(0)), F.greatest(F.lit(1), F.ceil(F.col("n") * PACE / 60).cast("int"))) * 60
    marks, negative, seconds = F.coalesce("own_marks", m), F.coalesce("own_negative", f), F.coalesce(F.col("own_minutes") * 60, usual)
    error = F.when(~F.coalesce(F.col("own_minutes").between(1, 600), F.lit(True)), "minutes").when(F.isnan(marks) | (marks <= 0) | (marks == float("inf")), "marks").when(F.isnan(negative) | ~negative.between(0, 1), "negative")
    standard = F.coalesce((marks == F.col("marks_per_question")) & (negative == F.col("negative_fraction")) & (seconds == usual), F.lit(False))
    return attempts.select("attempt_id", marks.alias("marks"), F.bround(marks * negative, 6).alias("penalty"), seconds.cast("long").alias("seconds"), error.alias("error"), (standard & error.isNull()).alias("ranked"))


def graded(responses: DataFrame) -> DataFrame:
    """responses with marks_awarded: null if skipped or not graded."""
    return responses.withColumn("marks_awarded", F.when(right(), F.col("marks_if_correct")).when(wrong(), -F.col("penalty_if_wrong")))


def attempt_totals(responses: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row for each attempt with responses: counts, score, maximum, marks gained and lost, time, accuracy, attempt rate."""
    marks = F.col("marks_awarded")
    totals = graded(responses).groupBy("attempt_id").agg(
        F.count("*").alias("total"), F.count_if(right()).alias("correct"), F.count_if(wrong()).alias("wrong"), F.count_if(~answered()).alias("skipped"),
        F.bround(F.coalesce(F.sum(marks), F.lit(0.0)), 6).alias("score"), F.bround(F.sum("marks_if_correct"), 6).alias("max_marks"),
        F.bround(F.coalesce(F.sum(F.when(marks > 0, marks)), F.lit(0.0)), 6).alias("gained"), F.bround(F.coalesce(F.sum(F.when(marks < 0, -marks)), F.lit(0.0)), 6).alias("lost"), F.sum("seconds").alias("screen_seconds"),
    )
    timed = F.col("kind").isin("full_test", "section")
    took = F.when(timed, (F.unix_timestamp("completed_at") - F.unix_timestamp("started_at")).cast("long")).otherwise(F.col("screen_seconds"))
    return totals.join(attempts.select("attempt_id", "kind", "started_at", "completed_at"), "attempt_id").select("attempt_id", "total", "correct", "wrong", "skipped", "score", "max_marks", "gained", "lost", took.alias("time_taken"), percent(F.col("correct"), F.col("correct") + F.col("wrong")).alias("accuracy"), percent(F.col("correct") + F.col("wrong"), F.col("total")).alias("attempt_rate"))


def typical_seconds(responses: DataFrame) -> DataFrame:
    """(attempt_id, typical): the median time of answered questions with a time; the usual pace if there are fewer than three."""
    t = F.when(answered() & (F.col("seconds") > 0), F.col("seconds"))
    return responses.groupBy("attempt_id").agg(F.when(F.count(t) >= 3, F.median(t)).otherwise(F.lit(float(PACE))).alias("typical"))


def _reason() -> Column:
    s = F.col("seconds")
    sure = (
        F.when(F.coalesce(s, F.lit(0)) == 0, "conceptual_confusion").when(s < F.greatest(F.lit(8.0), 0.25 * F.col("typical")), "careless")
        .when(s > 2.5 * F.col("typical"), "time_pressure").otherwise("conceptual_confusion")
    )
    c = F.col("confidence")
    return F.when(c == "no_idea", "knowledge_gap").when(c == "guessed", "guess_miss").when(c == "sure", sure).otherwise("unset")


def mistake_reasons(responses: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """(attempt_id, question_id, reason) of each wrong answer. own (attempt_id, question_id, own_reason): reasons that learners gave
    themselves; these stay."""
    reason = _reason()
    found = responses.where(wrong()).join(typical_seconds(responses), "attempt_id")
    if own is not None:
        found = found.join(own, ["attempt_id", "question_id"], "left")
        reason = F.coalesce("own_reason", reason)
    return found.select("attempt_id", "question_id", reason.alias("reason"))


def with_reasons(responses: DataFrame) -> DataFrame:
    """responses with the reason of each wrong answer (see mistake_reasons), null for others. Reads the responses once."""
    own = Window.partitionBy("attempt_id")
    t = F.when(answered() & (F.col("seconds") > 0), F.col("seconds"))
    typical = F.when(F.count(t).over(own) >= 3, F.median(t).over(own)).otherwise(F.lit(float(PACE)))
    return responses.withColumn("typical", typical).withColumn("reason", F.when(wrong(), _reason())).drop("typical")


def reason_counts(reasons: DataFrame) -> DataFrame:
    return reasons.groupBy("attempt_id", "reason").agg(F.count("*").alias("n"))


def guessing_report(responses: DataFrame) -> DataFrame:
    """Per attempt: answers, right ones and marks by confidence; marks of shaky answers and the score without them."""
    g = graded(responses).where(answered())
    marks, shaky = F.coalesce("marks_awarded", F.lit(0.0)), F.col("confidence").isin("guessed", "no_idea")
    out = []
    for c in ("sure", "guessed", "no_idea"):
        own = F.col("confidence") == c
        out += [F.count_if(own).alias(f"{c}_answered"), F.count_if(own & right()).alias(f"{c}_right"), F.bround(F.sum(F.when(own, marks).otherwise(0.0)), 6).alias(f"{c}_marks")]
    found = g.groupBy("attempt_id").agg(*out, F.bround(F.sum(F.when(shaky, marks).otherwise(0.0)), 6).alias("shaky_marks"), F.bround(F.sum(marks), 6).alias("score"))
    return found.withColumn("score_if_skipped", F.bround(F.col("score") - F.col("shaky_marks"), 6)).withColumn("guessing", F.when(F.col("shaky_marks") > 0, "helped").when(F.col("shaky_marks") < 0, "cost").otherwise("even"))


def subject_breakdown(responses: DataFrame) -> DataFrame:
    marks = F.coalesce("marks_awarded", F.lit(0.0))
    found = graded(responses).groupBy("attempt_id", F.coalesce("subject", F.lit("No subject set")).alias("subject")).agg(
        F.count("*").alias("total"), F.count_if(answered()).alias("answered"), F.count_if(right()).alias("right"), F.count_if(wrong()).alias("wrong"), F.count_if(~answered()).alias("skipped"), F.bround(F.sum(marks), 6).alias("marks"))
    return found.withColumn("accuracy", percent(F.col("right"), F.col("answered")))


def worth_attempting(responses: DataFrame, least: int = 5) -> DataFrame:
    """Per attempt: skipped questions whose expected marks are positive, and their sum. The chance of a right answer is the user's
    accuracy in the subject over finished attempts if there are `least` answers, else overall, else this attempt's."""
    done = responses.where((F.col("attempt_status") != "in_progress") & answered() & F.col("is_correct").isNotNull())
    n, ok = F.count("*"), F.count_if(right())
    by_subject = done.where("subject IS NOT NULL").groupBy("user_id", "subject").agg(n.alias("n1"), ok.alias("k1"))
    by_user = done.groupBy("user_id").agg(n.alias("n2"), ok.alias("k2"))
    own = responses.where(answered() & F.col("is_correct").isNotNull()).groupBy("attempt_id").agg(n.alias("n3"), ok.alias("k3"))
    skipped = responses.where(~answered()).select("attempt_id", "user_id", "subject", "marks_if_correct", "penalty_if_wrong")
    rows = skipped.join(by_subject, ["user_id", "subject"], "left").join(by_user, "user_id", "left").join(own, "attempt_id", "left")
    p = F.when(F.col("n1") >= least, F.col("k1") / F.col("n1")).when(F.col("n2") >= least, F.col("k2") / F.col("n2")).when(F.col("n3") > 0, F.col("k3") / F.col("n3"))
    gain = F.bround(p * F.col("marks_if_correct") - (1 - p) * F.col("penalty_if_wrong"), 9)
    rows = rows.select("attempt_id", gain.alias("gain"), (F.col("penalty_if_wrong") / (F.col("marks_if_correct") + F.col("penalty_if_wrong"))).alias("even"))
    return rows.groupBy("attempt_id").agg(F.count_if(F.col("gain") > 0).alias("worth"), F.bround(F.coalesce(F.sum(F.when(F.col("gain") > 0, F.col("gain"))), F.lit(0.0)), 6).alias("expected_gain"), F.bround(100 * F.max("even"), 0).cast("int").alias("break_even"))
