"""Texts, duplicates, files, keys and streams."""

import json

import pytest
from pyspark.sql import functions as F

from examlattice.functions import text
from examlattice.operators import dedup, review
from examlattice.sources import files, importing, keys


def one(spark, column, **values):
    names = list(values)
    kinds = {str: "string", int: "long", list: "array<string>", type(None): "string"}
    schema = ", ".join(f"{n} {kinds[type(values[n])]}" for n in names)
    return spark.createDataFrame([tuple(values[n] for n in names)], schema).select(column.alias("x")).first().x


def test_normal_forms(spark):
    assert one(spark, text.words(F.col("s")), s="  The  RED-Fox, कुत्ता! ") == "the red fox कुत्ता"
    a = one(spark, text.norm_hash(F.col("s"), F.col("o")), s="Which one?", o=["Alpha", "B b", "c", "d"])
    b = one(spark, text.norm_hash(F.col("s"), F.col("o")), s="which  ONE", o=["d", "c", "bb", "alpha"])
    assert a == b and len(a) == 16


@pytest.mark.parametrize(("s", "want"), [("c", "C"), ("(B)", "B"), ("ग", None), ("3", None), ("e", None), ("Option B", "B"), ("answer: b", "B"), ("Ans- d", "D"), ("choice c)", "C"), ("b or c", None), (None, None)])
def test_answer_letters(spark, s, want):
    assert one(spark, text.sheet_answer(F.col("s")), s=s) == want


@pytest.mark.parametrize(("s", "want"), [("The correct answer is (c).", "C"), ("Hence, option (b) is correct", "B"), ("A is true", None), ("correct answer is (a); correct option: (b)", None), (None, None)])
def test_explanations(spark, s, want):
    assert one(spark, text.explanation_says(F.col("s")), s=s) == want


@pytest.mark.parametrize(("s", "want"), [("1/3", 0.3333), ("0.33", 0.33), ("2", None), ("x", None), ("1/0", None)])
def test_fractions(spark, s, want):
    assert one(spark, text.fraction(F.col("s")), s=s) == want


def test_language_and_sanity_flags(spark):
    q = dict(t="What is it called?", o=["a", "b", "c", "d"], h="यह क्या कहलाता है", p=["क", "ख", "ग"])
    assert one(spark, text.language_flags(F.col("t"), F.col("o"), F.col("h"), F.col("p")), **q) == ["language_mismatch"]
    assert one(spark, text.language_flags(F.col("t"), F.col("o"), F.col("h"), F.col("p")), t=q["h"], o=q["o"], h=q["t"], p=["a", "b", "c", "d"]) == ["language_swapped"]
    assert one(spark, text.sanity_flags(F.col("t"), F.col("o")), t="x", o=["1 2 3 4", "1 1 3 4", "4 3 2 1", "2 1 4 3"]) == ["check_code_row"]
    assert one(spark, text.sanity_flags(F.col("t"), F.col("o")), t="", o=["", "b\u00a9", "c" * 301, "d"]) == ["empty_stem", "empty_option", "very_long_option", "odd_characters"]
    assert one(spark, text.devanagari_share(F.col("t")), t="abc") is None


def test_duplicates(spark):
    stem = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [(1, stem, "p q", "h1"), (2, stem.replace("nine", "nina"), "p q", "h2"), (3, stem, "p q", "h1"), (4, stem.replace("two", "twp"), "completely other words", "h4"), (5, "short", "p q", "h5"), (6, "shorts", "p q", "h6")]
    q = spark.createDataFrame(rows, "question_id long, stem string, options_text string, norm_hash string")
    assert [tuple(r) for r in dedup.exact_pairs(q).collect()] == [(3, 1)]
    assert [(r.newer, r.older) for r in dedup.near_pairs(q).collect()] == [(2, 1)]
    assert dedup.indel_ratio("abcd", "abxd") == 75.0 and dedup.indel_ratio("", "") == 100.0


def test_near_pairs_equal_brute_force(spark):
    q = spark.createDataFrame(
        [(r.doc_id, r.text[:150]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()], "question_id long, stem string"
    ).select("question_id", text.words(F.col("stem")).alias("stem"), F.lit("o").alias("options_text"), F.md5("stem").alias("norm_hash"))
    rows = {r.stem: (r.question_id, r.norm_hash) for r in q.orderBy(F.desc("question_id")).collect()}
    want = {(max(a, b), min(a, b)) for s, (a, h) in rows.items() for t, (b, g) in rows.items() if h < g and dedup.indel_ratio(s, t) >= 90}
    assert {(r.newer, r.older) for r in dedup.near_pairs(q, kept=None).collect()} == want
    assert {(r.newer, r.older) for r in dedup.near_pairs(q).collect()} <= want


KEYS = [
    ("1-b 2-d 3-a", None, {1: "B", 2: "D", 3: "A"}), ("1. (b)\n2) C\nQ3: a", None, {1: "B", 2: "C", 3: "A"}), ("1 = c | 2 = d", None, {1: "C", 2: "D"}), ("1-2 2-3 3-4", None, {}),
    ("1 A B C D\n2 B C D A\n3 C D A B", "B", {1: "B", 2: "C", 3: "D"}), ("1 A B C D\n2 B C D A\n3 C D A B", None, {}), ("Series A\n1-a 2-b\nSeries B\n1-c 2-d", "B", {1: "C", 2: "D"}),
    ("1. Ans- (c) because\n2. Ans- (a) so\n3. Ans- (d)", None, {1: "C", 2: "A", 3: "D"}),
]


@pytest.mark.parametrize(("key", "series", "want"), KEYS)
def test_answer_keys(spark, key, series, want):
    found = keys.parse_keys(spark.createDataFrame([(1, key, series)], "key_id long, text string, series string"))
    assert {r.number: r.letter for r in found.collect()} == want


def test_conflicting_key(spark):
    found = keys.parse_keys(spark.createDataFrame([(1, "1-a 2-b 1-c", None)], "key_id long, text string, series string"))
    assert {r.number: (r.letter, r.letters) for r in found.collect()} == {1: ("A", 2), 2: ("B", 1)}


def test_files(spark, tmp_path):
    q = {"number": 1, "question": "What is what in all this?", "options": {"a": "1", "b": "2", "c": "3", "d": "4"}, "correct_answer": "b"}
    (tmp_path / "p.json").write_text("Covered questions 1 to 2.\n```json\n" + json.dumps({"questions": [q, q | {"number": 2, "correct_answer": "3"}]}) + "\n```\n" + '{"questions": [' + json.dumps(q | {"number": 3}) + ', {"number": 4, "quest')
    objects = files.json_objects(files.read_files(spark, str(tmp_path / "p.json")))
    found = files.json_questions(objects)
    assert sorted(r.q.number for r in found.collect()) == [1, 2]  # the second object breaks off, and only a first one is salvaged
    assert objects.where("issue IS NOT NULL").count() == 1
    issues = {(r.number, r.code) for r in importing.question_issues(found, []).collect()}
    assert (2, "answer_form") in issues and not any(n == 1 for n, c in issues if c != "subject_unknown")
    (tmp_path / "s.csv").write_bytes("No;Question;A;B;Ans\n1;caf\xe9;x;y;b\n\n2;z\n".encode("cp1252"))
    rows = files.map_headers(files.sheet_rows(files.read_files(spark, str(tmp_path / "s.csv"))))
    assert [(r.line, r.fields) for r in rows.orderBy("line").collect()] == [(2, {"number": "1", "question": "café", "a": "x", "b": "y", "answer": "b"}), (4, {"number": "2", "question": "z", "a": "", "b": "", "answer": ""})]
    (tmp_path / "c.json").write_text(json.dumps({"subject": "S", "chapter_no": 2, "chapter": "x", "question_count": 1, "questions": [{"id": "a", "number": 1, "question": "q"}]}))
    assert [r.book_number for r in files.book_chapters(spark, str(tmp_path / "c.json")).collect()] == [1]


@pytest.mark.parametrize(("mode", "want"), [("skip", {1: "a", 2: "b", 3: "C"}), ("replace", {1: "a", 2: "B", 3: "C"}), ("fill", {1: "a", 2: "b", 3: "C"}), ("append", {1: "a", 2: "b", 3: "A", 4: "B", 5: "C"})])
def test_imports(spark, mode, want):
    have = spark.createDataFrame([(1, "a", "live"), (2, "b", "needs_review")], "number int, text string, status string")
    new = spark.createDataFrame([(1, "A", "x"), (2, "B", "x"), (3, "C", "x")], "number int, text string, status string")
    assert {r.number: r.text for r in importing.apply_import(have, new, mode).collect()} == want


def test_sample_size(spark):
    q = spark.range(170).select(F.col("id").alias("question_id"), F.when(F.col("id") < 150, 1).when(F.col("id") < 167, 2).otherwise(3).alias("paper_id"), F.lit("live").alias("status"))
    assert {r.paper_id: r.n for r in review.audit_sample(q).groupBy("paper_id").agg(F.count("*").alias("n")).collect()} == {1: 15, 2: 5, 3: 3}


def test_streams_equal_their_batch_twins(spark, tmp_path):
    from examlattice.operators import revision
    from examlattice.streaming import jobs

    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    table.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "events"))
    run = jobs.answers_per_day(stream, "60 days").writeStream.outputMode("complete").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "c1")).start()
    run.processAllAvailable()
    run.stop()
    assert sorted(map(tuple, spark.table("days").collect())) == sorted(map(tuple, jobs.answers_per_day(table).collect()))

    answers = table.select("user_id", (F.col("event_id") % 5).alias("question_id"), F.col("ts").cast("date").alias("day"), F.col("event_id").alias("seq"), (F.floor("value") % 2 == 0).alias("correct"), F.lit("sure").alias("confidence"))
    answers.write.parquet(str(tmp_path / "answers"))
    stream = spark.readStream.schema(answers.schema).parquet(str(tmp_path / "answers"))
    run = jobs.revision_schedule(stream).writeStream.outputMode("update").format("memory").queryName("plan").option("checkpointLocation", str(tmp_path / "c2")).start()
    run.processAllAvailable()
    run.stop()
    assert sorted(map(tuple, spark.table("plan").collect())) == sorted(map(tuple, revision.schedule(answers).collect()))


def test_registry():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
