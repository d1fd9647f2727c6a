"""Printed lines, languages, details and streams of sessions."""

import json

from pyspark.sql import functions as F

from examlattice.functions import scrub, text
from examlattice.operators import activity
from examlattice.sources import files, importing, keys, lines
from examlattice.streaming import jobs

LINE = "paper_id long, page int, col int, line_no int, text string"


def printed(spark, *texts, paper=1):
    return spark.createDataFrame([(paper, 1, 0, i, t) for i, t in enumerate(texts)], LINE)


def test_questions_from_lines(spark):
    rows = printed(
        spark, "1. Which of these is", "a river?", "1. Ganga", "2. Alps", "(a) 1 only (b) 2 only", "(c) Both", "(d) Neither", "Answer: (a) It flows.", "2. Assertion (A): x. Reason (R): y.", "(a) one (b) two (c) three (d) four", "Ans- c", "since so",
        "7. Last (A) p (B) q (C) r (D) s", "Answer: (db)",
    )
    found = {r.number: r for r in lines.questions(rows).collect()}
    assert sorted(found) == [1, 2, 3]
    assert (found[1].text, found[1].options, found[1].answer, found[1].explanation) == ("Which of these is a river?\n1. Ganga\n2. Alps", ["1 only", "2 only", "Both", "Neither"], "A", "It flows.")
    assert (found[2].text, found[2].answer, found[2].explanation) == ("Assertion (A): x. Reason (R): y.", "C", "since so")
    assert (found[3].options, found[3].answer, found[3].flags) == (["p", "q", "r", "s"], None, ["answer_unclear"])


def test_key_at_the_end(spark):
    rows = printed(spark, "1. What? (a) x (b) y (c) z (d) w", "ANSWER KEY", "1-b 2-c 3-d", "4-a 5-b")
    assert lines.questions(rows).first().options[3] == "w"
    assert {r.number: r.letter for r in keys.parse_keys(lines.key_texts(rows)).collect()} == {1: "B", 2: "C", 3: "D", 4: "A", 5: "B"}
    short = printed(spark, "1. What? (a) x (b) y (c) z (d) w", "Answers", "1-b 2-c")
    assert lines.key_texts(short).isEmpty()


def test_hindi_columns_go(spark):
    rows = spark.createDataFrame([(1, 1, 0, 0, "\u0915" * 25), (1, 1, 1, 0, "a" * 25), (1, 2, 0, 0, "\u0915" * 25), (1, 2, 1, 0, "abc")], LINE)
    assert {(r.page, r.col) for r in lines.english_columns(rows).collect()} == {(1, 1), (2, 0), (2, 1)}


def test_secrets_go_at_any_depth(spark):
    detail = json.dumps({"a": [{"API-Key": "k", "n": {"userPassword": {"x": 1}}}], "token": 5, "ok": "token"})
    rows = spark.createDataFrame([(detail,), ("no json",), (None,), (json.dumps({"x": "y" * 5000}),)], "d string").select(scrub.scrubbed_json(F.col("d")).alias("d")).collect()
    assert json.loads(rows[0].d) == {"a": [{"API-Key": "[hidden]", "n": {"userPassword": "[hidden]"}}], "token": "[hidden]", "ok": "token"}
    assert rows[1].d == "no json" and rows[2].d is None and len(rows[3].d) == 4001


def test_display_modes(spark):
    none = F.array().cast("array<string>")
    four = F.array(*[F.lit(x) for x in "abcd"])
    rows = [("only English", F.lit("t"), four, F.lit(None).cast("string"), none, ("en hi both", "", "", "hi")), ("only Hindi", F.lit(""), none, F.lit("h"), four, ("", "en hi both", "en", "")), ("both", F.lit("t"), four, F.lit("h"), four, ("en both", "hi both", "", "")), ("Hindi incomplete", F.lit("t"), four, F.lit("h"), none, ("en hi both", "", "", "hi"))]
    for name, t, o, h, p, want in rows:
        s = spark.range(1).select(text.shown_in(text.available(t, o, h, p)).alias("s")).first().s
        assert (s.en, s.hi, s.note_en, s.note_hi) == want, name


def test_headers_are_remembered(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Frage;A;B\nwas?;x;y\n")
    rows = files.sheet_rows(files.read_files(spark, str(tmp_path / "a.csv")))
    signature = spark.range(1).select(files.header_signature(F.array(F.lit("b"), F.lit("FRAGE "), F.lit("a"))).alias("s")).first().s
    known = spark.createDataFrame([(signature, {"question": "Frage", "a": "A"})], "signature string, mapping map<string,string>")
    assert files.recalled(rows, known).first().fields == {"question": "was?", "a": "x"}


def test_types_of_fields(spark, tmp_path):
    q = [{"number": 1, "question": 5, "options": ["a"], "has_image": "yes", "answer": "a", "correct_answer": "b"}, {"number": 2, "question": "x", "options": {}, "has_image": "True", "answer_hi": "a"}, {"number": 3, "question": None, "explanation": "e"}]
    (tmp_path / "p.json").write_text("Covered questions 1 to 4.\n" + json.dumps({"questions": q}))
    read = files.read_files(spark, str(tmp_path / "p.json"))
    found = {(r.place, r.code) for r in importing.raw_issues(files.raw_questions(files.json_objects(read))).collect()}
    assert found == {(0, "question_type"), (0, "options_type"), (0, "has_image_type"), (0, "answers_disagree"), (1, "answer_hi_unsupported")}
    assert [(r.first, r.last) for r in files.covered_ranges(read).collect()] == [(1, 4)]


def test_streams_of_sessions(spark, tmp_path):
    rows = [(1, "start", -1, "", "2024-01-01 00:00:00", "2024-01-01 01:00:00"), (1, "save", 1, "A", "2024-01-01 00:10:00", None), (1, "save", 2, "B", "2024-01-01 01:00:02", None), (1, "save", 2, "", "2024-01-01 01:00:05", None), (2, "start", -1, "", "2024-01-01 00:00:00", "2024-01-01 01:00:00"), (2, "save", 1, "A", "2024-01-01 00:05:00", None), (2, "save", 1, "", "2024-01-01 00:06:00", None), (2, "submit", -1, "", "2024-01-01 00:30:00", None)]
    events = spark.createDataFrame(rows, "attempt_id long, kind string, question_id long, value string, ts string, deadline_at string").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("deadline_at", F.col("deadline_at").cast("timestamp"))
    late = spark.createDataFrame([(3, "save", 1, "A", "2024-01-02 00:00:00", None)], "attempt_id long, kind string, question_id long, value string, ts string, deadline_at string").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("deadline_at", F.col("deadline_at").cast("timestamp"))
    path = str(tmp_path / "events")
    events.write.parquet(path)
    run = jobs.closed_attempts(spark.readStream.schema(events.schema).parquet(path)).writeStream.outputMode("append").format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "c1")).start()
    run.processAllAvailable()
    late.write.mode("append").parquet(path)
    run.processAllAvailable()
    late.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY")).write.mode("append").parquet(path)
    run.processAllAvailable()
    run.stop()
    want = {(1, "expired", 2), (2, "submitted", 0)}
    assert {(r.attempt_id, r.status, r.answered) for r in spark.table("closed").collect()} == want
    assert {(r.attempt_id, r.status, r.answered) for r in jobs.closed_attempts_batch(events, "2024-01-02 00:00:00").collect()} == want

    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").alias("attempt_id"), (F.col("event_id") % 20).alias("question_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    table.write.parquet(str(tmp_path / "screens"))
    run = jobs.screen_time(spark.readStream.schema(table.schema).parquet(str(tmp_path / "screens"))).writeStream.outputMode("append").format("memory").queryName("screens").option("checkpointLocation", str(tmp_path / "c2")).start()
    run.processAllAvailable()
    run.stop()
    got = {(r.attempt_id, r.question_id): r.seconds for r in spark.table("screens").groupBy("attempt_id", "question_id").agg(F.sum("seconds").alias("seconds")).collect()}
    assert {k: v for k, v in got.items() if v} == {(r.attempt_id, r.question_id): r.seconds for r in activity.screen_time(table).collect() if r.seconds}


def test_key_files_and_reports(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("1-b 2-c 3-d \u00e9".encode("latin-1"))
    (tmp_path / "b.txt").write_bytes("1-a 2-1 1-b".encode("utf-16"))
    read = files.key_files(files.read_files(spark, f"{tmp_path}/*.txt"))
    parsed = keys.parse_keys(read)
    assert {(r.key_id[-5], r.number, r.letter) for r in parsed.collect()} == {("a", 1, "B"), ("a", 2, "C"), ("a", 3, "D"), ("b", 1, "A")}
    errors = keys.key_errors(read, parsed)
    assert [(r.key_id[-5], r.error, r.number) for r in errors.collect()] == [("b", "conflict", 1)]
    importing.write_report(errors.withColumn("level", F.lit("error")), f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").count() == 1


def test_lines_are_normalised_once(spark, tmp_path):
    """Lines are cut and normalised in one place of the plan, and words leave single spaces alone."""
    from examlattice.plans import queries

    rows = [(i, f"Head of {'A' if i % 2 else 'a'}\n{'--  ' if i % 3 else 'w' + str(i)}\n" + "\n".join(f"own {i} {k}" for k in range(18)) + "\n  foot\u0964  9 ", "s") for i in range(9)] + [(90, " \n--", "s"), (91, None, "s"), (92, "Only, this", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("line_repeats", "running_lines"):
        found = queries.QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, found.collect())) == [("s", "foot 9", 9), ("s", "head of a", 9)]
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") <= 3 and plan.count("regexp_replace(") == 1 and plan.count("Generate ") == 1
    odd = ["a b", "a  b", " a b ", "a, b", "a ,b", "a\tb", "\u0964", " ", "", "A-B c", "x \u00e9 y", "a \n b", ".a", "a.", "..", ". a .. b  .", None, "\u0915 \u0916", "a\u00a0b", "a \u00a0b"]
    q = spark.createDataFrame([(x,) for x in odd], "s string").select(text.words(F.col("s")), F.trim(F.regexp_replace(F.lower(F.coalesce("s", F.lit(""))), text.WORD, " ")), F.coalesce(text.has_words(F.col("s")), F.lit(False)))
    assert all(a == b and (a != "") == c for a, b, c in q.collect())
