"""Lists and tables of the desk: filters, orders, pages, tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _flagged() -> Column:
    return F.size(F.coalesce("flags", F.array().cast("array<string>"))) > 0


# What the review list can show.
REVIEW = {
    "to_confirm": lambda: F.col("status").isin("draft", "needs_review"), "confirmed": lambda: F.col("status").isin("verified", "live"), "flagged": _flagged,
    "no_subject": lambda: F.col("subject").isNull(), "ai_answers": lambda: (F.col("answer_source") == "ai") & F.col("correct_answer").isNotNull(),
}


def review_list(questions: DataFrame, show: str, flagged_first: bool = True) -> DataFrame:
    """Questions not in quarantine that fit one of REVIEW, with `first`: flagged ones come first in a paper, then by number and id."""
    rows = questions.where("status != 'quarantined'").where(REVIEW[show]())
    return rows.withColumn("first", (~_flagged()).cast("int") if flagged_first else F.lit(0))


def in_order(rows: DataFrame) -> DataFrame:
    """A paper's questions as they are printed: by number, then id; with the order of review_list, where it is there."""
    return rows.orderBy("paper_id", *[c for c in ("first",) if c in rows.columns], F.asc_nulls_last("question_number"), "question_id")


def result_list(responses: DataFrame, show: str) -> DataFrame:
    """Responses that are wrong, skipped or shaky (guessed, whatever came of it)."""
    answered = F.col("selected_answer").isNotNull()
    fits = {"wrong": answered & ~F.coalesce("is_correct", F.lit(True)), "skipped": ~answered, "shaky": answered & F.col("confidence").isin("guessed", "no_idea")}
    return responses.where(fits[show])


def notebook_list(notebook: DataFrame, *, subject: str | None = None, topic: str | None = None, reason: str | None = None, state: str = "all") -> DataFrame:
    """Rows of a notebook (subject, topic, last_reason, state, ...). state revise: due and scheduled ones."""
    for column, value in (("subject", subject), ("topic", topic), ("last_reason", reason)):
        if value is not None:
            notebook = notebook.where(F.col(column) == value)
    states = {"revise": ["due", "scheduled"], "all": None}.get(state, [state])
    return notebook if states is None else notebook.where(F.col("state").isin(states))


def notebook_order(notebook: DataFrame, user: int, most: int = 100) -> DataFrame:
    """A user's first rows: due ones, the longest due first, then scheduled, guessed and mastered ones; then by question."""
    rank = F.when(F.col("state") == "due", 0).when(F.col("state") == "scheduled", 1).when(F.col("state") == "guessed", 2).otherwise(3)
    return notebook.where(F.col("user_id") == user).orderBy(rank, F.asc_nulls_last("days_until"), "question_id").limit(most)


def state_counts(notebook: DataFrame) -> DataFrame:
    """(user_id, due, scheduled, guessed, mastered, and of the due ones each reason's number)."""
    reasons = ["careless", "conceptual_confusion", "guess_miss", "knowledge_gap", "time_pressure"]
    due = F.col("state") == "due"
    return notebook.groupBy("user_id").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("due", "scheduled", "guessed", "mastered")], *[F.count_if(due & (F.col("last_reason") == r)).alias(f"due_{r}") for r in reasons])


def audit_page(log: DataFrame, *, action: str = "", paper: int | None = None, page: int = 1, size: int = 200) -> DataFrame:
    """One page of the log (log_id, action, paper_id, ...), newest first, with has_more: whether another page follows."""
    rows = log.where(F.col("action").startswith(action))
    if paper is not None:
        rows = rows.where(F.col("paper_id") == paper)
    # a page and one more row: the limit is the feature
    rows = rows.orderBy(F.desc("log_id")).offset((page - 1) * size).limit(size + 1)
    counted = rows.agg((F.count("*") > size).alias("has_more"))
    return rows.join(F.broadcast(counted)).orderBy(F.desc("log_id")).limit(size)


# Actions that are not news.
QUIET = ["login", "logout", "view"]


def recent_activity(log: DataFrame, most: int = 8, quiet: list[str] = QUIET) -> DataFrame:
    return log.where(~F.col("action").isin(quiet)).orderBy(F.desc("log_id")).limit(most)


def accuracy_bars(groups: DataFrame, name: str) -> DataFrame:
    """(user_id, label, value, value_text, highlight, tip): a bar for each group (see analytics.accuracy_by) with enough answers."""
    text = F.concat(F.col("accuracy").cast("string"), F.lit("%"))
    weak = F.when(F.col("weak"), " \u00b7 weak").otherwise("")
    tip = F.concat(text, F.lit(" right | "), F.col(name), F.lit(" \u00b7 "), F.col("right").cast("string"), F.lit(" of "), F.col("answered").cast("string"), F.lit(" answered"), weak)
    return groups.where("enough").select("user_id", F.col(name).alias("label"), F.col("accuracy").alias("value"), F.concat(text, weak).alias("value_text"), F.col("weak").alias("highlight"), tip.alias("tip"))


def trend_points(trend: DataFrame) -> DataFrame:
    """(user_id, place, x_label, value) from a trend (user_id, place, percent, completed_at)."""
    return trend.select("user_id", "place", F.date_format("completed_at", "dd MMM").alias("x_label"), F.col("percent").alias("value"))


def marked_questions(marks: DataFrame, live: DataFrame) -> DataFrame:
    """(user_id, question_id, subject, topic, marked_at): bookmarks or notes (user_id, question_id, marked_at) on live questions."""
    return marks.join(live.select("question_id", "subject", "topic"), "question_id").select("user_id", "question_id", "subject", "topic", "marked_at")


def review_state(papers: DataFrame, questions: DataFrame) -> DataFrame:
    """(paper_id, title, status, publish_status, total, to_confirm, confirmed) of papers that are not archived."""
    own = questions.where("status != 'quarantined'").groupBy("paper_id").agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("draft", "needs_review")).alias("to_confirm"))
    rows = papers.where(~F.col("archived")).join(own, "paper_id", "left").na.fill(0, ["total", "to_confirm"])
    return rows.select("paper_id", "title", "status", "publish_status", "total", "to_confirm", (F.col("total") - F.col("to_confirm")).alias("confirmed"))


def attention(state: DataFrame) -> DataFrame:
    """(paper_id, what, n): papers that failed to import, have questions to confirm, or could be published."""
    ready = F.col("status") == "ready"
    what = F.when(F.col("status") == "failed", "failed").when(ready & (F.col("to_confirm") > 0), "confirm").when(ready & (F.col("total") > 0) & (F.col("publish_status") != "published"), "publish")
    return state.select("paper_id", what.alias("what"), F.when(what == "confirm", F.col("to_confirm")).when(what == "publish", F.col("total")).otherwise(0).cast("long").alias("n")).where("what IS NOT NULL")


def tiles(users: DataFrame, papers: DataFrame, questions: DataFrame, attempts: DataFrame, now: str, days: int = 7) -> DataFrame:
    """(tile, n): the numbers of the dashboard. users: is_admin, status, last_active_at."""
    since = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    student = ~F.col("is_admin")
    shown = ~F.col("archived")
    timed = F.col("kind").isin("full_test", "section") & (F.col("status") != "in_progress")

    def rows(df: DataFrame, **numbers: Column) -> DataFrame:
        found = df.agg(*[F.count_if(c).alias(k) for k, c in numbers.items()])
        return found.select(F.explode(F.array(*[F.struct(F.lit(k).alias("tile"), F.col(k).alias("n")) for k in numbers])).alias("x")).select("x.*")

    out = rows(users, pending=student & (F.col("status") == "pending"), approved=student & (F.col("status") == "approved"), deactivated=student & (F.col("status") == "deactivated"), active=student & (F.col("status") == "approved") & F.coalesce(F.col("last_active_at") >= since, F.lit(False)))
    out = out.unionAll(rows(papers, published=shown & (F.col("publish_status") == "published"), drafts=shown & (F.col("publish_status") != "published")))
    return out.unionAll(rows(questions, live_questions=F.col("status") == "live")).unionAll(rows(attempts, tests=timed & (F.col("started_at") >= since)))
