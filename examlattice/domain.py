"""The question bank's tables as views over the driver's tables; the same SQL text runs in Spark and in DuckDB. Spark joins the questions of
responses first, see `responses`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LINES = "SELECT l_orderkey AS attempt_id, l_partkey AS question_id, min(l_suppkey) AS s, CAST(min(l_quantity) AS INT) AS seconds, CASE min(l_returnflag) WHEN 'A' THEN 'sure' WHEN 'N' THEN 'guessed' ELSE 'no_idea' END AS confidence FROM {lineitem} GROUP BY l_orderkey, l_partkey"

#: name -> (source tables, SQL). A name in braces is a source table or another view.
VIEWS: dict[str, str] = {
    "questions": """
SELECT p_partkey AS question_id, CAST(1 + floor(p_partkey / 120.0) AS INT) AS paper_id, CAST(1 + p_partkey % 120 % 110 AS INT) AS question_number, p_name AS text,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_type END AS subject,
  CASE WHEN p_partkey % 5 = 0 OR p_partkey % 17 = 0 THEN NULL ELSE concat(p_type, '-', CAST(p_partkey % 4 AS STRING)) END AS topic,
  substr('ABCD', CAST(1 + p_partkey % 4 AS INT), 1) AS true_letter,
  CASE WHEN p_partkey % 97 = 3 THEN NULL WHEN p_partkey % 50 = 7 THEN substr('ABCD', CAST(1 + (p_partkey + 1) % 4 AS INT), 1) ELSE substr('ABCD', CAST(1 + p_partkey % 4 AS INT), 1) END AS correct_answer,
  CASE WHEN p_partkey % 29 = 0 THEN 'quarantined' WHEN p_partkey % 13 = 0 THEN 'needs_review' WHEN p_partkey % 37 = 0 THEN 'verified' WHEN p_partkey % 41 = 0 THEN 'draft' ELSE 'live' END AS status,
  CASE p_size % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty,
  p_partkey % 11 = 0 AS has_image, p_partkey % 22 <> 0 AS has_snapshot, p_partkey % 31 = 0 AS flagged, p_partkey % 62 = 0 AS acknowledged,
  CASE WHEN p_partkey % 7 = 0 THEN 'ai' ELSE 'key' END AS answer_source
FROM {part}""",
    "papers": """
SELECT paper_id, concat('Paper ', CAST(paper_id AS STRING)) AS title, CASE paper_id % 3 WHEN 0 THEN 'official' WHEN 1 THEN 'mock' ELSE 'book' END AS source_type,
  CAST(2000 + paper_id % 20 AS INT) AS year, 'ready' AS status, CASE WHEN paper_id = 5 THEN 'draft' ELSE 'published' END AS publish_status, paper_id = 7 AS archived,
  CAST(CASE WHEN paper_id % 2 = 0 THEN 100 ELSE 115 END AS INT) AS expected_total, CASE paper_id % 4 WHEN 0 THEN 'passed' WHEN 1 THEN 'pending' WHEN 2 THEN 'none' ELSE 'failed' END AS audit_state,
  CAST(CASE WHEN paper_id % 5 = 0 THEN 100 END AS INT) AS duration_minutes, CASE WHEN paper_id % 7 = 3 THEN NULL ELSE substr('ABCD', CAST(1 + paper_id % 4 AS INT), 1) END AS series, CASE WHEN paper_id % 4 = 0 THEN 0.0e0 ELSE 2.0e0 END AS marks_per_question, CASE WHEN paper_id % 6 = 0 THEN NULL ELSE 0.25e0 END AS negative_fraction
FROM (SELECT DISTINCT paper_id FROM {questions}) AS p""",
    "attempts": """
SELECT o_orderkey AS attempt_id, o_custkey AS user_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'full_test' WHEN '2-HIGH' THEN 'section' WHEN '3-MEDIUM' THEN 'practice' WHEN '4-NOT SPECIFIED' THEN 'mistakes' ELSE 'topic' END AS kind,
  CASE o_orderstatus WHEN 'F' THEN 'submitted' WHEN 'P' THEN 'expired' ELSE 'in_progress' END AS status,
  CAST(o_orderdate AS TIMESTAMP) AS started_at, CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' HOUR AS completed_at, concat('paper:', CAST(o_orderkey % 25 AS STRING)) AS rank_key
FROM {orders}""",
    "users": """
SELECT c_custkey AS user_id, c_name AS display_name, c_custkey % 500 = 0 AS is_admin, CASE WHEN c_custkey % 20 = 3 THEN 'pending' ELSE 'approved' END AS status, c_custkey % 7 <> 0 AS show_on_leaderboard FROM {customer}""",
    "responses": f"""
SELECT r.attempt_id, r.question_id, a.user_id, a.kind, a.status AS attempt_status, a.started_at, CAST(row_number() OVER (PARTITION BY r.attempt_id ORDER BY r.question_id) AS INT) AS position,
  r.selected_answer, q.correct_answer, q.subject, q.topic, q.paper_id,
  CASE WHEN r.selected_answer IS NULL OR q.correct_answer IS NULL THEN NULL ELSE r.selected_answer = q.correct_answer END AS is_correct, r.confidence, r.seconds,
  2.0e0 AS marks_if_correct, 0.5e0 AS penalty_if_wrong
FROM (SELECT g.*, CASE WHEN s % 10 = 9 THEN NULL WHEN (s * 7) % 100 < 30 + 6 * (o.o_custkey % 10) THEN substr('ABCD', CAST(1 + question_id % 4 AS INT), 1) ELSE substr('ABCD', CAST(1 + (question_id % 4 + 1 + s % 3) % 4 AS INT), 1) END AS selected_answer
  FROM ({_LINES}) AS g
  JOIN {{orders}} AS o ON g.attempt_id = o.o_orderkey) AS r
JOIN {{attempts}} AS a ON r.attempt_id = a.attempt_id JOIN {{questions}} AS q ON r.question_id = q.question_id""",
}
NEEDS = {"questions": ["part"], "papers": ["questions"], "attempts": ["orders"], "users": ["customer"], "responses": ["lineitem", "orders", "attempts", "questions"]}


#: The same for lines that have their question's columns already.
_ASKED = VIEWS["responses"].replace(f"({_LINES})", "{asked}").replace(" JOIN {questions} AS q ON r.question_id = q.question_id", "").replace("q.", "r.")

#: Lines for a task of a shuffle, so that its memory stays the same however many there are; questions that are sent to every task.
TASK_ROWS, SENT_ROWS = 500_000, 200_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by keys, in as many partitions as its `rows` rows need, one for each core at least; as it is, if one does for them. A fixed number:
    Spark gathers partitions of its own number by their bytes, in one for each core, however many rows these are."""
    n, session = -(-rows // TASK_ROWS), df.sparkSession
    if n <= 1:
        return df
    return df.repartition(max(n, min(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))), *keys)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or one of the driver's tables."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "responses":
        return responses(spark, sf_dir)
    return spark.sql(VIEWS[name], **{n: view(spark, sf_dir, n) for n in NEEDS[name]})


def n_lines(spark: SparkSession, sf_dir: str) -> int:
    """From the files' footers."""
    return view(spark, sf_dir, "lineitem").count()


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view of this name, by attempt. Lines are shuffled once by attempt, and before that once by question where the questions are too
    many to be sent to every task; nearly every line is an attempt's only one on its question, so none are counted together before."""
    lines, questions, rows = view(spark, sf_dir, "lineitem"), view(spark, sf_dir, "questions"), n_lines(spark, sf_dir)
    asked = questions.select("question_id", "correct_answer", "subject", "topic", "paper_id")

    def by(df: DataFrame, key: str) -> DataFrame:
        wide = spread(df, rows, key)
        return df.repartition(key) if wide is df else wide

    if questions.count() > SENT_ROWS:
        found = by(spark.sql(_LINES, lineitem=by(lines, "l_partkey")).join(asked.hint("shuffle_hash"), "question_id"), "attempt_id")
    else:
        found = spark.sql(_LINES, lineitem=by(lines, "l_orderkey")).join(F.broadcast(asked), "question_id")
    return spark.sql(_ASKED, asked=found, **{n: view(spark, sf_dir, n) for n in ("orders", "attempts")})


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL that may read the named views."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in order:
            for n in NEEDS[name]:
                add(n)
            order.append(name)

    for n in names:
        add(n)
    plain = {n: VIEWS[n] for n in order}
    for n, text in plain.items():
        for m in NEEDS[n]:
            text = text.replace("{" + m + "}", m)
        plain[n] = text
    return "WITH " + ",\n".join(f"{n} AS ({text})" for n, text in plain.items()) + sql.strip().replace("WITH ", ",\n", 1) if sql.strip().startswith("WITH ") else "WITH " + ",\n".join(f"{n} AS ({text})" for n, text in plain.items()) + "\n" + sql.strip()
