"""Jobs that keep a keyed state of their own: lock-outs after failed log-ins, and the answers of running tests as they are saved.

The stateful jobs are transformWithState processors, so streams need the RocksDB state store provider. Each has a twin over tables."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SECOND = 1_000_000
#: Seconds in which failures add up and for which a lock holds after the last one; failures that lock a name and an address.
WINDOW, LOCK, LIMITS = 15 * 60, 15 * 60, {"name": 5, "ip": 20}
LOCKED = "attempt_id long, kind string, key string, at timestamp, seconds long"


def name_key(name):
    """What a typed name is remembered by: people type passwords there, too."""
    return F.substring(F.sha2(F.lower(F.trim(F.coalesce(name, F.lit("")))), 256), 1, 16)


def keyed(attempts: DataFrame) -> DataFrame:
    """(kind, key, attempt_id, at, micros, name, ok): every attempt (attempt_id, name, ip, ok, ts) once for its name and once for its address.
    An unknown address is no key."""
    both = F.array(F.struct(F.lit("name").alias("kind"), name_key(F.col("name")).alias("key")), F.struct(F.lit("ip").alias("kind"), F.col("ip").alias("key")))
    rows = attempts.select("attempt_id", F.col("ts").alias("at"), F.unix_micros("ts").alias("micros"), name_key(F.col("name")).alias("name"), F.coalesce("ok", F.lit(False)).alias("ok"), F.explode(both).alias("k"))
    return rows.where("k.key IS NOT NULL").select("k.kind", "k.key", "attempt_id", "at", "micros", "name", "ok")


def judge(failures: list[tuple[int, str]], kind: str, at: int, name: str, ok: bool) -> tuple[int, list[tuple[int, str]]]:
    """Seconds for which a key is still locked at the time of an attempt, and its failures (time, name) afterwards.

    A key is locked while the LOCK after its last failure lasts, if that one was the limit's within its WINDOW. An attempt against a lock is not
    looked at and leaves no trace; a failure is remembered, and a success forgets the name's failures. Never more failures than the
    limit are kept, as those beyond a WINDOW before the last one do not matter."""
    if failures:
        last = failures[-1][0]
        burst = sum(t >= last - WINDOW * SECOND for t, _ in failures)
        left = last + LOCK * SECOND - at
        if burst >= LIMITS[kind] and left > 0:
            return -(-left // SECOND), failures
    if ok:
        return 0, [f for f in failures if f[1] != name]
    return 0, [f for f in failures if f[0] >= at - WINDOW * SECOND] + [(at, name)]


class Locks(StatefulProcessor):
    """The failures of one key, in a list state; a timer forgets a key that has been quiet for so long that nothing of it matters."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.failures = handle, handle.getListState("failures", "at long, name string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kind, name = key
        known = [(f[0], f[1]) for f in self.failures.get()]
        before = list(known)
        for r in sorted(rows, key=lambda r: (r.micros, r.attempt_id)):
            seconds, known = judge(known, kind, r.micros, r.name, r.ok)
            yield Row(attempt_id=r.attempt_id, kind=kind, key=name, at=r.at, seconds=seconds)
        if known != before:
            if known:
                self.failures.put(known)
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(max(known[-1][0] // 1000 + 1000 * (WINDOW + LOCK), timerValues.getCurrentWatermarkInMs() + 1))
            else:
                self.failures.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.failures.clear()
        return iter(())

    def close(self) -> None:
        pass


def lockouts(attempts: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(attempt_id, kind, key, at, seconds): for each attempt of a stream and each of its keys how long the key was still locked (0: not). An
    attempt is turned away if any of its keys says so, see verdicts. Each key judges by itself: a failure counts for an address
    even if the name was locked at the time. The attempts of a micro-batch are taken in order of time; a key holds as many failures as
    its limit at most."""
    rows = keyed(attempts.withWatermark("ts", late))
    return rows.groupBy("kind", "key").transformWithState(Locks(), LOCKED, "Append", "EventTime")


def lockouts_batch(attempts: DataFrame) -> DataFrame:
    """The same for a table. Rows of a key follow each other in a task, which remembers one key's failures at a time: a key of very many
    attempts is long, but never in memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, known = None, []
        for rows in batches:
            seconds = []
            for kind, key, at, name, ok in zip(rows["kind"], rows["key"], rows["micros"], rows["name"], rows["ok"]):
                if now != (kind, key):
                    now, known = (kind, key), []
                left, known = judge(known, kind, int(at), name, bool(ok))
                seconds.append(left)
            yield rows[["attempt_id", "kind", "key", "at"]].assign(seconds=seconds)

    return keyed(attempts).repartition("kind", "key").sortWithinPartitions("kind", "key", "micros", "attempt_id").mapInPandas(run, LOCKED)


def verdicts(locked: DataFrame) -> DataFrame:
    """(attempt_id, seconds): how long an attempt has to wait; 0 if it is looked at."""
    return locked.groupBy("attempt_id").agg(F.max("seconds").alias("seconds"))


SAVED = "attempt_id long, question_id long, field string, value string, ts timestamp, seq long, taken boolean"
FIELDS = ("answer", "confidence", "marked")


class Book(StatefulProcessor):
    """The last write of each field of each question of one attempt, in a map state. A timer empties it when nothing can change any more."""

    def __init__(self, grace: int):
        self.grace = timedelta(seconds=grace)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "question_id long, field string", "at long, seq long")
        self.deadline = handle.getValueState("deadline", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rows = sorted(rows, key=lambda r: (r.kind != "start", r.ts, r.seq))
        deadline = self.deadline.get()[0] if self.deadline.exists() else None
        for r in rows:
            at = _micros(r.ts)
            if r.kind == "start":
                if deadline is None and r.deadline_at is not None:
                    deadline = _micros(r.deadline_at)
                    self.deadline.update((deadline,))
                    self.handle.registerTimer(max(self._end(deadline) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
                continue
            taken = deadline is None or at <= self._end(deadline)
            if taken:
                place = (r.question_id, r.field)
                if self.last.containsKey(place) and tuple(self.last.getValue(place)) > (at, r.seq):
                    continue  # a later write has come before
                self.last.updateValue(place, (at, r.seq))
            yield Row(attempt_id=key[0], question_id=r.question_id, field=r.field, value=r.value or None, ts=r.ts, seq=r.seq, taken=taken)

    def _end(self, deadline: int) -> int:
        return deadline + int(self.grace.total_seconds()) * SECOND

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()  # the deadline stays, so that what still comes is turned away
        return iter(())

    def close(self) -> None:
        pass


def _micros(t: datetime) -> int:
    return int((t if t.tzinfo else t.astimezone()).astimezone(timezone.utc).timestamp() * 1000) * 1000 + t.microsecond % 1000


def saved_answers(events: DataFrame, grace: int = 3, late: str = "1 minute") -> DataFrame:
    """(attempt_id, question_id, field, value, ts, seq, taken): what each save of a stream does. events: (attempt_id, kind, question_id, field, value,
    ts, seq, deadline_at) of kind start (with the deadline) or save. A save up to `grace` seconds after the deadline is taken, any later
    one is turned away; an older write that arrives behind a newer one of its field does nothing and gives no row. The last row taken of
    a field, by (ts, seq), is its value, so a sink that overwrites by (attempt, question, field) holds them all."""
    return events.withWatermark("ts", late).groupBy("attempt_id").transformWithState(Book(grace), SAVED, "Update", "EventTime")


def current_answers(saved: DataFrame) -> DataFrame:
    """(attempt_id, question_id, answer, confidence, marked) after all rows that saved_answers gave."""
    rows = saved.where("taken")
    last = [F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.struct("ts", "seq"))).alias(f) for f in FIELDS]
    return rows.groupBy("attempt_id", "question_id").agg(*last)


def saves_in_time(events: DataFrame, grace: int = 3) -> DataFrame:
    """The twin of saved_answers and current_answers over a table."""
    due = events.where("kind = 'start'").groupBy("attempt_id").agg(F.min("deadline_at").alias("due"))
    rows = events.where("kind = 'save'").join(due, "attempt_id", "left")
    taken = F.col("due").isNull() | (F.col("ts") <= F.col("due") + F.expr(f"INTERVAL {grace} SECONDS"))
    return current_answers(rows.select("attempt_id", "question_id", "field", F.nullif("value", F.lit("")).alias("value"), "ts", "seq", taken.alias("taken")))


def graded(closed: DataFrame, sheets: DataFrame) -> DataFrame:
    """Attempts that end (jobs.closed_attempts, a stream or a table) with their score: (attempt_id, status, ended_at, total_questions, correct_count,
    wrong_count, skipped_count, score, max_marks, seconds). sheets: (attempt_id, question_id, correct_answer, marks_if_correct, penalty_if_wrong) of
    all attempts' questions, a table that a stream meets as it stands.

    A sheet is one row of an attempt's questions before it meets the attempt, so that grading needs no state. What is not answered costs
    nothing; an answer to a question without a key is wrong. seconds run from the start to the end, that is to the deadline, for
    those who did not hand in."""
    marks = F.struct("question_id", "correct_answer", "marks_if_correct", "penalty_if_wrong")
    own = sheets.groupBy("attempt_id").agg(F.collect_list(marks).alias("sheet"))
    said = lambda q: F.nullif(F.try_element_at("answers", q["question_id"].cast("string")), F.lit(""))
    right = lambda q: F.coalesce(said(q) == q["correct_answer"], F.lit(False))
    count = lambda test: F.size(F.filter("sheet", test))
    total = lambda value: F.aggregate(F.transform("sheet", value), F.lit(0.0), lambda a, x: a + x)
    zero = F.lit(0.0)
    earned = lambda q: F.when(right(q), F.coalesce(q["marks_if_correct"], zero)).when(said(q).isNotNull(), -F.coalesce(q["penalty_if_wrong"], zero)).otherwise(zero)
    rows = closed.join(own, "attempt_id")
    return rows.select(
        "attempt_id", "status", "ended_at", F.size("sheet").alias("total_questions"), count(right).alias("correct_count"), count(lambda q: said(q).isNotNull() & ~right(q)).alias("wrong_count"),
        count(lambda q: said(q).isNull()).alias("skipped_count"), total(earned).alias("score"), total(lambda q: F.coalesce(q["marks_if_correct"], zero)).alias("max_marks"),
        F.greatest(F.lit(0), F.floor(F.unix_micros("ended_at") / SECOND - F.unix_micros("started_at") / SECOND)).cast("long").alias("seconds"),
    )
