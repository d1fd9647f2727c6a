"""Event-time jobs. Each takes a streaming (or batch) DataFrame and returns one; the caller starts it."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.revision import LADDER, PASS


def answers_per_day(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(user_id, day, n) of answer events (user_id, ts); late answers still count for their day until the watermark passes it."""
    rows = events.where("event_type = 'click'").withWatermark("ts", late)
    return rows.groupBy(F.window("ts", "1 day"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("window.start").cast("date").alias("day"), "n")


def failure_bursts(events: DataFrame, window: str = "15 minutes", slide: str = "1 minute", times: int = 5, late: str = "10 minutes") -> DataFrame:
    """(user_id, start, n): windows that hold `times` failures and more."""
    rows = events.where("event_type = 'error'").withWatermark("ts", late)
    return rows.groupBy(F.window("ts", window, slide), "user_id").agg(F.count("*").alias("n")).where(F.col("n") >= times).select("user_id", F.col("window.start").alias("start"), "n")


def last_writes(saves: DataFrame) -> DataFrame:
    """(attempt_id, question_id, answer, confidence, marked) after all saves (.., field, value, ts, seq): the last write of a field wins; an empty value clears it."""
    def last(field: str):
        return F.max_by(F.when(F.col("field") == field, F.nullif("value", F.lit(""))), F.when(F.col("field") == field, F.struct("ts", "seq"))).alias(field)

    return saves.groupBy("attempt_id", "question_id").agg(last("answer"), last("confidence"), last("marked"))


def expired(attempts: DataFrame, now: str, grace: int = 3) -> DataFrame:
    """(attempt_id, status, ended_at): running attempts past deadline and grace end at the deadline."""
    over = (F.col("status") == "in_progress") & (F.lit(now).cast("timestamp") > F.col("deadline_at") + F.expr(f"INTERVAL {grace} SECONDS"))
    return attempts.select("attempt_id", F.when(over, "expired").otherwise(F.col("status")).alias("status"), F.when(over, F.col("deadline_at")).otherwise(F.col("completed_at")).alias("ended_at"))


def closed_attempts(events: DataFrame, grace: int = 3, late: str = "10 seconds") -> DataFrame:
    """(attempt_id, status, started_at, ended_at, answered, rejected, answers) of timed attempts when they end, from a stream of events (attempt_id, kind, question_id,
    value, ts, deadline_at): kind start (with the deadline), save (an empty value clears) or submit.

    An attempt that nobody submits ends `grace` seconds after its deadline, as of the deadline, when the watermark passes that time. Saves
    after that are rejected. The state holds one letter for each question of the attempt."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        started, deadline, answers, rejected, ended = group.get if group.exists else (None, None, "{}", 0, False)
        answers = json.loads(answers)
        if group.hasTimedOut:
            yield _closed(key[0], "expired", started, pd.Timestamp(deadline), answers, rejected)
            group.update((started, deadline, "{}", rejected, True))
            return
        for row in pd.concat(list(batches)).sort_values(["ts", "question_id"]).itertuples():
            if row.kind == "start" and deadline is None:
                started, deadline = row.ts.isoformat(), row.deadline_at.isoformat()
            in_time = deadline is None or row.ts <= pd.Timestamp(deadline) + pd.Timedelta(seconds=grace)
            if ended or not in_time:
                rejected += row.kind == "save"
            elif row.kind == "save":
                answers[str(row.question_id)] = row.value
            elif row.kind == "submit":
                ended = True
                yield _closed(key[0], "submitted", started, row.ts, answers, rejected)
        group.update((started, deadline, json.dumps(answers), rejected, ended))
        if deadline is not None and not ended:
            group.setTimeoutTimestamp(max(int(pd.Timestamp(deadline).timestamp() * 1000) + 1000 * grace, group.getCurrentWatermarkMs() + 1))

    rows = events.withWatermark("ts", late).groupBy("attempt_id")
    found = rows.applyInPandasWithState(run, "attempt_id long, status string, started_at timestamp, ended_at timestamp, answered int, rejected int, answers string", "started string, deadline string, answers string, rejected int, ended boolean", "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumn("answers", F.from_json("answers", "map<string,string>"))


def _closed(attempt: int, status: str, started: str | None, ended_at: pd.Timestamp, answers: dict, rejected: int) -> pd.DataFrame:
    given = {q: v for q, v in answers.items() if v}
    return pd.DataFrame({"attempt_id": [attempt], "status": [status], "started_at": [pd.Timestamp(started) if started else pd.NaT], "ended_at": [ended_at], "answered": [len(given)], "rejected": [rejected], "answers": [json.dumps(given)]})


def closed_attempts_batch(events: DataFrame, now: str, grace: int = 3) -> DataFrame:
    """The same for a table of events, as of a moment: attempts submitted in time or past deadline and grace."""
    due = F.min(F.when(F.col("kind") == "start", F.col("deadline_at"))).alias("deadline_at")
    rows = events.drop("deadline_at").join(events.groupBy("attempt_id").agg(due), "attempt_id", "left")
    last = F.col("deadline_at") + F.expr(f"INTERVAL {grace} SECONDS")
    in_time = F.col("deadline_at").isNull() | (F.col("ts") <= last)
    submits = rows.where((F.col("kind") == "submit") & in_time).groupBy("attempt_id").agg(F.min("ts").alias("submitted_at"))
    rows = rows.join(submits, "attempt_id", "left")
    good = in_time & (F.col("submitted_at").isNull() | (F.col("ts") <= F.col("submitted_at")))
    saves = rows.where("kind = 'save'").groupBy("attempt_id", "question_id").agg(F.max_by(F.when(good, F.col("value")), F.when(good, F.col("ts"))).alias("value"), F.count_if(~good).alias("late"))
    given = F.when(F.coalesce("value", F.lit("")) != "", F.struct(F.col("question_id").cast("string").alias("key"), "value"))
    per = saves.groupBy("attempt_id").agg(F.map_from_entries(F.collect_list(given)).alias("answers"), F.count_if(F.coalesce("value", F.lit("")) != "").cast("int").alias("answered"), F.sum("late").cast("int").alias("rejected"))
    head = rows.groupBy("attempt_id").agg(F.min("deadline_at").alias("deadline_at"), F.min("submitted_at").alias("submitted_at"), F.min(F.when(F.col("kind") == "start", F.col("ts"))).alias("started_at"))
    over = F.col("deadline_at") + F.expr(f"INTERVAL {grace} SECONDS") < F.lit(now).cast("timestamp")
    out = head.where(F.col("submitted_at").isNotNull() | over).join(per, "attempt_id", "left")
    return out.select("attempt_id", F.when(F.col("submitted_at").isNotNull(), "submitted").otherwise("expired").alias("status"), "started_at", F.coalesce("submitted_at", "deadline_at").alias("ended_at"), F.coalesce("answered", F.lit(0)).alias("answered"), F.coalesce("rejected", F.lit(0)).alias("rejected"), F.coalesce("answers", F.create_map().cast("map<string,string>")).alias("answers"))


def screen_time(events: DataFrame, most: int = 300) -> DataFrame:
    """(attempt_id, question_id, seconds) whenever time is credited, from a stream of events (attempt_id, question_id, ts): the gap to the attempt's
    next event goes to the question on screen, whole seconds, `most` at most. Sums of the rows are activity.screen_time. The state of an
    attempt is its last event."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        at, question = rows["ts"].tolist(), rows["question_id"].tolist()
        if group.exists:
            seen, on = group.get
            at, question = [pd.Timestamp(seen), *at], [on, *question]
        group.update((at[-1].isoformat(), int(question[-1])))
        gaps = [min(most, max(0, int((b - a).total_seconds()))) for a, b in zip(at, at[1:])]
        if gaps:
            yield pd.DataFrame({"attempt_id": key[0], "question_id": question[:-1], "seconds": gaps}).groupby(["attempt_id", "question_id"], as_index=False).sum()

    return events.groupBy("attempt_id").applyInPandasWithState(run, "attempt_id long, question_id long, seconds long", "at string, question long", "append", GroupStateTimeout.NoTimeout)


def next_state(state: tuple | None, day, correct: bool, clean: bool) -> tuple | None:
    """(stage, streak, status, due) after one answer; the rule of operators.revision for one event."""
    if state is None or state[2] == "done":
        if correct:
            return state
        return (0, 0, "active", day + timedelta(LADDER[0]))
    stage, streak, status, due = state
    is_due = due <= day
    if not correct and not is_due:
        return (stage, 0, status, due)
    if correct and not is_due:
        return state
    if correct and clean and streak + 1 >= PASS:
        return (stage, streak + 1, "done", due)
    return (stage + 1, streak + 1 if correct and clean else 0, "active", day + timedelta(LADDER[min(stage + 1, len(LADDER) - 1)]))


def revision_schedule(answers: DataFrame) -> DataFrame:
    """(user_id, question_id, stage, streak, status, due) whenever it changes, from a stream of answers (user_id, question_id, day, seq,
    correct, confidence)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state = group.get if group.exists else None
        state = None if state is None else (state[0], state[1], state[2], pd.Timestamp(state[3]).date())
        rows = pd.concat(list(batches)).sort_values(["day", "seq"])
        for day, correct, confidence in zip(rows["day"], rows["correct"], rows["confidence"]):
            state = next_state(state, day, bool(correct), confidence not in ("guessed", "no_idea"))
        if state is not None:
            group.update((state[0], state[1], state[2], state[3].isoformat()))
            yield pd.DataFrame({"user_id": [key[0]], "question_id": [key[1]], "stage": [state[0]], "streak": [state[1]], "status": [state[2]], "due": [state[3]]})

    return answers.groupBy("user_id", "question_id").applyInPandasWithState(run, "user_id long, question_id long, stage int, streak int, status string, due date", "stage int, streak int, status string, due string", "update", GroupStateTimeout.NoTimeout)
