"""Answer keys that the strongest learners contradict."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUALIFY, RESPONDERS, HIGH, SHARE, MARGIN = 20, 12, 5, 0.25, 2


def first_answers(responses: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, question_id, letter): the first letter A-E of each user and question in a finished attempt; admins are left out."""
    students = users.where(~F.col("is_admin")).select("user_id")
    rows = responses.where((F.col("attempt_status") != "in_progress") & F.col("selected_answer").isin(*"ABCDE")).join(students, "user_id", "left_semi")
    return rows.groupBy("user_id", "question_id").agg(F.min_by("selected_answer", F.struct("attempt_id", "position")).alias("letter"))


def judged(first: DataFrame, questions: DataFrame, by_question: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(question_id, correct_answer, letter, accuracy, n, high): how many qualified users of each accuracy gave each letter to a live question,
    and whether they count as strong. The accuracy is that on all other questions.

    The strong ones of a question are those from the accuracy of the k-th place on. Answers are counted once, by question, accuracy and
    letter; places come from these counts, so a question that everybody answers is not sorted answer by answer. by_question may shuffle
    very many answers by question."""
    keys = questions.where("status = 'live' AND correct_answer IS NOT NULL").select("question_id", "correct_answer")
    rows = first.join(keys, "question_id", "left").withColumn("ok", (F.col("letter") == F.col("correct_answer")).cast("int"))
    own = rows.groupBy("user_id").agg(F.count("*").alias("n_all"), F.count("ok").alias("n"), F.sum("ok").alias("k")).where((F.col("n_all") >= QUALIFY) & (F.col("n") >= 2)).drop("n_all")
    rows = rows.where("ok IS NOT NULL").join(own, "user_id").withColumn("accuracy", F.bround((F.col("k") - F.col("ok")) / (F.col("n") - 1), 9))
    rows = by_question(rows.select("question_id", "correct_answer", "letter", "accuracy")) if by_question else rows
    counts = rows.groupBy("question_id", "correct_answer", "letter", "accuracy").agg(F.count("*").alias("n"))
    w = Window.partitionBy("question_id").orderBy(F.desc("accuracy"))
    responders, upto = F.sum("n").over(Window.partitionBy("question_id")), F.sum("n").over(w.rangeBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("responders", responders).withColumn("before", upto - F.sum("n").over(Window.partitionBy("question_id", "accuracy")))
    inside = F.col("before") < F.greatest(F.lit(HIGH), F.ceil(F.col("responders") * SHARE))
    counts = counts.where(F.col("responders") >= RESPONDERS).withColumn("high", inside)
    return counts.select("question_id", "correct_answer", "letter", "accuracy", "n", "high")


def verdicts(counts: DataFrame) -> DataFrame:
    """One row for each question: most popular letter of the strong ones (the key wins ties), counts, and whether the key is suspicious."""
    letters = counts.groupBy("question_id", "correct_answer", "letter").agg(F.sum(F.when(F.col("high"), F.col("n")).otherwise(0)).alias("high_n"), F.sum("n").alias("all_n"))
    best = F.max(F.struct("high_n", (F.col("letter") == F.col("correct_answer")).alias("is_key"), "letter"))
    found = letters.groupBy("question_id", "correct_answer").agg(best.alias("x"), F.sum("high_n").alias("high_n"), F.sum("all_n").alias("all_n"), F.sum(F.when(F.col("letter") == F.col("correct_answer"), F.col("high_n")).otherwise(0)).alias("key_n"))
    popular, n = F.col("x.letter"), F.col("x.high_n")
    bad = (popular != F.col("correct_answer")) & (2 * n > F.col("high_n")) & (n - F.col("key_n") >= MARGIN) & (F.col("high_n") >= HIGH)
    return found.select("question_id", F.col("correct_answer").alias("key_answer"), popular.alias("popular_answer"), n.alias("popular_n"), "key_n", "high_n", "all_n", bad.alias("suspicious"))


def suspicious(responses: DataFrame, users: DataFrame, questions: DataFrame) -> DataFrame:
    return verdicts(judged(first_answers(responses, users), questions)).where("suspicious").drop("suspicious")


def reconcile(queue: DataFrame, found: DataFrame) -> DataFrame:
    """The queue (question_id, status, handled_key) after a scan whose verdicts are found (question_id, key_answer, suspicious).

    status of each row kept: open or dismissed. action: new, kept, reopened, cleared (the row goes)."""
    rows = queue.join(found.select("question_id", "key_answer", "suspicious"), "question_id", "full_outer")
    judged_now, bad = F.col("suspicious").isNotNull(), F.coalesce("suspicious", F.lit(False))
    handled = F.col("status").isin("dismissed", "sent_back") & (F.col("handled_key") == F.col("key_answer"))
    action = (
        F.when(bad & F.col("status").isNull(), "new").when(bad & handled, "kept").when(bad & (F.col("status") != "open"), "reopened").when(bad, "kept")
        .when(judged_now & F.col("status").isNotNull() & (F.col("status") != "sent_back"), "cleared").when(~judged_now & (F.col("status") == "open"), "cleared").when(F.col("status").isNotNull(), "kept")
    )
    status = F.when(bad & handled, "dismissed").when(bad, "open").otherwise(F.col("status"))
    return rows.select("question_id", status.alias("status"), action.alias("action")).where("action IS NOT NULL")


def card(counts: DataFrame) -> DataFrame:
    """(question_id, letter, n, percent) for the letters A-E among all responders, of counts as judged gives them."""
    own = counts.groupBy("question_id").agg(F.sum("n").alias("total"), *[F.sum(F.when(F.col("letter") == x, F.col("n")).otherwise(0)).alias(x) for x in "ABCDE"])
    rows = own.select("question_id", "total", F.explode(F.array(*[F.struct(F.lit(x).alias("letter"), F.col(x).alias("n")) for x in "ABCDE"])).alias("x"))
    return rows.select("question_id", "x.letter", "x.n", F.bround(100.0 * F.col("x.n") / F.col("total"), 0).cast("int").alias("percent"))
