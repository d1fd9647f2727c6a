"""Registered queries of the jobs with state, over tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import guards, jobs
from .oracles import ORACLES
from .queries import Tables, attempt_events, query


def logins(t):
    """Log-ins from the events: every user's come from one of 7 addresses; purchases succeed."""
    n = F.col("event_id")
    return t.events.select(n.alias("attempt_id"), F.concat(F.lit(" User"), (F.col("user_id") % 60).cast("string")).alias("name"), F.when(n % 41 != 0, F.concat(F.lit("10.0.0."), (F.col("user_id") % 7).cast("string"))).alias("ip"), (F.col("event_type") == "purchase").alias("ok"), F.timestamp_seconds(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 40)).alias("ts"))


@query
def login_locks(spark, sf_dir):
    return guards.lockouts_batch(logins(Tables(spark, sf_dir))).select("attempt_id", "kind", "seconds")


@query
def login_waits(spark, sf_dir):
    return guards.verdicts(guards.lockouts_batch(logins(Tables(spark, sf_dir))))


def save_events(t):
    """Saves of three fields from the events, and starts with deadlines on most attempts."""
    field = F.when(F.col("event_type") == "click", "answer").when(F.col("event_type") == "view", "confidence").otherwise("marked")
    value = F.when(F.floor("value") % 5 == 0, "").otherwise(F.floor("value").cast("string"))
    ts, none = F.col("ts").cast("timestamp"), F.lit(None).cast("timestamp")
    rows = t.events.select(F.col("user_id").alias("attempt_id"), F.lit("save").alias("kind"), (F.col("event_id") % 20).alias("question_id"), field.alias("field"), value.alias("value"), ts.alias("ts"), F.col("event_id").alias("seq"), none.alias("deadline_at"))
    starts = rows.where("attempt_id % 7 > 0").groupBy("attempt_id").agg(F.min("ts").alias("ts")).select("attempt_id", F.lit("start").alias("kind"), F.lit(-1).cast("long").alias("question_id"), F.lit("").alias("field"), F.lit("").alias("value"), "ts", F.lit(-1).cast("long").alias("seq"), (F.col("ts") + F.expr("INTERVAL 300 HOURS")).alias("deadline_at"))
    return rows.unionByName(starts)


@query
def saves_in_time(spark, sf_dir):
    return guards.saves_in_time(save_events(Tables(spark, sf_dir)))


def sheets(t):
    """Twenty questions for each attempt of attempt_events."""
    n = F.col("question_id")
    rows = t.events.select(F.col("user_id").alias("attempt_id")).distinct().withColumn("question_id", F.explode(F.expr("sequence(0L, 19L)")))
    return rows.select("attempt_id", "question_id", F.when(n % 5 > 0, F.substring(F.lit("ABCD"), (1 + n % 2).cast("int"), 1)).alias("correct_answer"), F.lit(2.0).alias("marks_if_correct"), F.when(n % 3 > 0, 0.5).alias("penalty_if_wrong"))


@query
def graded_attempts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return guards.graded(jobs.closed_attempts_batch(attempt_events(t), "2024-02-10 00:00:00"), sheets(t))


_LOGINS = """k AS (SELECT event_id AS attempt_id, unnest([struct_pack(kind := 'name', key := CAST(user_id % 60 AS VARCHAR)), struct_pack(kind := 'ip', key := CASE WHEN event_id % 41 <> 0 THEN CAST(user_id % 7 AS VARCHAR) END)]) AS x, user_id % 60 AS name, event_type = 'purchase' AS ok, CAST(floor(floor(epoch(ts)) / 40) AS BIGINT) AS at_ FROM events),
a AS (SELECT attempt_id, x.kind AS kind, x.key AS key, name, ok, at_, row_number() OVER (PARTITION BY x.kind, x.key ORDER BY at_, attempt_id) AS r, CASE x.kind WHEN 'name' THEN 5 ELSE 20 END AS most FROM k WHERE x.key IS NOT NULL),
s AS (SELECT attempt_id, kind, key, r, CAST(0 AS BIGINT) AS seconds, CASE WHEN ok THEN [] ELSE [struct_pack(t := at_, n := name)] END AS fails FROM a WHERE r = 1
  UNION ALL SELECT attempt_id, kind, key, r, CASE WHEN locked THEN last + 900 - at_ ELSE 0 END, CASE WHEN locked THEN fails WHEN ok THEN list_filter(fails, lambda x: x.n <> name) ELSE list_append(fails, struct_pack(t := at_, n := name)) END
  FROM (SELECT a.*, s.fails, s.fails[-1].t AS last, coalesce(len(list_filter(s.fails, lambda x: x.t >= s.fails[-1].t - 900)) >= most AND s.fails[-1].t + 900 > a.at_, FALSE) AS locked FROM s JOIN a ON a.kind = s.kind AND a.key = s.key AND a.r = s.r + 1))"""
ORACLES["login_locks"] = f"WITH RECURSIVE {_LOGINS} SELECT attempt_id, kind, seconds FROM s"
ORACLES["login_waits"] = f"WITH RECURSIVE {_LOGINS} SELECT attempt_id, max(seconds) AS seconds FROM s GROUP BY ALL"
ORACLES["saves_in_time"] = """WITH e AS (SELECT user_id AS attempt_id, event_id % 20 AS question_id, CASE event_type WHEN 'click' THEN 'answer' WHEN 'view' THEN 'confidence' ELSE 'marked' END AS field, CASE WHEN floor(value) % 5 <> 0 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS v, ts, event_id AS seq, min(ts) OVER (PARTITION BY user_id) + INTERVAL 300 HOURS AS due FROM events),
l AS (SELECT *, row_number() OVER (PARTITION BY attempt_id, question_id, field ORDER BY ts DESC, seq DESC) AS b FROM e WHERE attempt_id % 7 = 0 OR ts <= due + INTERVAL 3 SECONDS)
SELECT attempt_id, question_id, max(v) FILTER (field = 'answer') AS answer, max(v) FILTER (field = 'confidence') AS confidence, max(v) FILTER (field = 'marked') AS marked FROM l WHERE b = 1 GROUP BY ALL"""
ORACLES["graded_attempts"] = """WITH e AS (SELECT user_id AS attempt_id, ts, event_id % 20 AS question_id, CASE WHEN event_id % 6 = 0 THEN '' ELSE 'A' END AS v, event_type = 'purchase' AS sub FROM events), h AS (SELECT attempt_id, min(ts) AS started, min(ts) + INTERVAL 450 HOURS AS due FROM e GROUP BY ALL),
z AS (SELECT h.*, (SELECT min(ts) FROM e WHERE e.attempt_id = h.attempt_id AND sub AND ts <= due + INTERVAL 3 SECONDS) AS handed FROM h), g AS (SELECT attempt_id, started, CASE WHEN handed IS NULL THEN 'expired' ELSE 'submitted' END AS status, coalesce(handed, due) AS ended_at, coalesce(handed, due + INTERVAL 3 SECONDS) AS last FROM z WHERE handed IS NOT NULL OR due + INTERVAL 3 SECONDS < TIMESTAMP '2024-02-10 00:00:00'),
w AS (SELECT g.attempt_id, e.question_id, arg_max(v, ts) AS v FROM g JOIN e ON e.attempt_id = g.attempt_id AND NOT sub AND ts <= last GROUP BY ALL),
q AS (SELECT attempt_id, status, ended_at, started, i AS question_id, CASE WHEN i % 5 > 0 THEN substr('ABCD', CAST(1 + i % 2 AS INT), 1) END AS ca, CASE WHEN i % 3 > 0 THEN 0.5e0 ELSE 0.0e0 END AS penalty FROM g, range(20) AS r(i)),
j AS (SELECT q.*, nullif(v, '') AS v, coalesce(nullif(v, '') = ca, FALSE) AS ok FROM q LEFT JOIN w USING (attempt_id, question_id))
SELECT attempt_id, status, ended_at, CAST(count(*) AS INT) AS total_questions, CAST(count(*) FILTER (ok) AS INT) AS correct_count, CAST(count(*) FILTER (v IS NOT NULL AND NOT ok) AS INT) AS wrong_count, CAST(count(*) FILTER (v IS NULL) AS INT) AS skipped_count,
  sum(CASE WHEN ok THEN 2.0e0 WHEN v IS NOT NULL THEN -penalty ELSE 0.0e0 END) AS score, 40.0e0 AS max_marks, CAST(floor(epoch(ended_at) - epoch(any_value(started))) AS BIGINT) AS seconds FROM j GROUP BY attempt_id, status, ended_at"""
