"""Import rules, warnings, hints, draws, moments and snapshots, on cases worked by hand or by brute force."""

import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from examlattice.functions import text
from examlattice.operators import hints, review, sessions
from examlattice.sources import files, importing, lines, running, snapshots

FOUR = ["one", "two", "three", "four"]
HINDI = ["अब", "बक", "गम", "दन"]
PART = "file string, number int, part int, place long, text string, options array<string>, text_hi string, options_hi array<string>, answer string, explanation string, explanation_hi string, subject string, topic string, page int, lang_flags array<string>, has_image boolean, uncertain boolean"


def version(part, number=5, text="What is it?", options=FOUR, text_hi=None, options_hi=None, answer=None, explanation=None, explanation_hi=None, subject=None, topic=None, page=None, flags=(), image=False, uncertain=False):
    return ("f", number, part, 0, text, options, text_hi, options_hi, answer, explanation, explanation_hi, subject, topic, page, list(flags), image, uncertain)


def merged(spark, later_wins, *versions):
    row = importing.merge_parts(spark.createDataFrame(list(versions), PART), later_wins).first()
    return row, [(n.level, n.kind, n.part, n.other, n.fields) for n in row.notes]


def test_equal_versions_fill_each_other_in(spark):
    for later in (False, True):
        row, notes = merged(spark, later, version(1, answer="A", flags=["b"]), version(2, text=" what  IS it?", options=["ONE", *FOUR[1:]], explanation="so", text_hi="यह", options_hi=HINDI, flags=["a"], uncertain=True), version(3, text="", options=None, text_hi="यह", options_hi=HINDI, topic="t"))
        assert (row.text, row.answer, row.explanation, row.text_hi, row.topic, row.lang_flags, row.uncertain, row.has_image, row.versions) == ("What is it?", "A", "so", "यह", "t", ["a", "b"], True, False, 3)
        assert notes == [("info", "overlap", 2, 1, ""), ("info", "overlap", 3, 1, "")]


def test_fields_that_differ(spark):
    a, b = version(1, answer="A", page=1), version(2, answer="B", explanation="so", page=1)
    row, notes = merged(spark, False, a, b)
    assert (row.answer, row.explanation) == ("A", None) and notes == [("error", "fields", 2, 1, "answer")]
    row, notes = merged(spark, True, a, b)
    assert (row.answer, row.explanation, row.part) == ("B", "so", 1) and notes == [("info", "overlap", 2, 1, "")]


def test_other_questions_and_languages(spark):
    a, b, c = version(1, answer="A", explanation="of one"), version(2, text="Another one?", answer="B"), version(3, text="", options=None, text_hi="यह", options_hi=HINDI)
    row, notes = merged(spark, False, a, b, c)
    assert (row.text, row.answer, row.explanation) == ("What is it?", "A", "of one") and [n[:2] for n in notes] == [("error", "different"), ("error", "incomparable")]
    row, notes = merged(spark, True, a, b, c)
    assert (row.text, row.text_hi, row.answer, row.explanation, row.part) == ("", "यह", None, None, 3)
    assert notes == [("warning", "different", 2, 1, ""), ("warning", "incomparable", 3, 2, "")]
    row, _ = merged(spark, True, a, b)
    assert (row.text, row.answer, row.explanation) == ("Another one?", "B", None)
    assert importing.merge_parts(spark.createDataFrame([version(1, number=None)], PART)).count() == 0
    assert [(r.number, r.kind) for r in importing.merge_report(importing.merge_parts(spark.createDataFrame([a, b], PART))).collect()] == [(5, "different")]


@pytest.mark.parametrize(("head", "want"), [
    (["Q No", "Question", "A", "B", "C", "D", "Ans"], {"number": 0, "question": 1, "a": 2, "b": 3, "c": 4, "d": 5, "answer": 6}),
    (["Question number", "Question in full"], {"number": 0, "question": 1}), (["question numbers", "questionno", "x"], {"number": 1, "question": 0}), (["the correct one", "Key"], {"answer": 1}), (["Answer", "answer"], {"answer": 0}),
    (["my answer", "my solution", "Subject (main)", "Topic name"], {"answer": 0, "explanation": 1, "subject": 2, "topic": 3}), (["", None, "?"], {}), (["text", "question"], {"question": 0}),
])
def test_headers(spark, head, want):
    assert spark.createDataFrame([(head,)], "h array<string>").select(files.header_mapping(F.col("h")).alias("m")).first().m == want


def test_language_warnings(spark):
    def flags(t="What is it called", o=FOUR, h=None, p=None, e=None, eh=None):
        row = spark.createDataFrame([(t, o, h, p, e, eh)], "t string, o array<string>, h string, p array<string>, e string, eh string")
        return row.select(text.language_flags(*[F.col(c) for c in ("t", "o", "h", "p", "e", "eh")]).alias("f")).first().f

    whole = dict(h="यह क्या कहलाता है", p=HINDI)
    assert flags() == flags(**whole) == []
    assert flags(o=["", None, " "], **whole) == ["language_incomplete"] and flags(h="यह क्या कहलाता है") == ["language_incomplete"]
    assert flags(o=FOUR[:3], h="यह क्या कहलाता है") == []  # neither is complete
    assert flags(h="written in English words", p=HINDI) == ["language_swapped"] and flags(e="यह क्या कहलाता है और फिर क्या") == ["language_swapped"]
    assert flags(h="यह", p=HINDI, eh="in English the whole of it is explained") == ["language_swapped"]
    assert flags(t="What is\nit called", **whole) == ["language_mismatch"] and flags(o=FOUR[:3], **whole) == ["language_mismatch"]
    kept = spark.createDataFrame([(["language_swapped", "x"], ["language_mismatch"], "live", True), (["language_mismatch"], ["language_mismatch"], "live", True), (None, ["language_swapped"], "draft", True)], "f array<string>, w array<string>, s string, a boolean")
    found = [tuple(r.x) for r in kept.select(text.refreshed(F.col("f"), F.col("w"), F.col("s"), F.col("a")).alias("x")).collect()]
    assert found == [(["x", "language_mismatch"], False), (["language_mismatch"], True), (["language_swapped"], True)]


def test_hints_are_exact_words(spark):
    words = {"One": ["no-confidence", "quit india", "acid", "C++"], "Two": ["no confidence", "gene"]}
    rows = [(1, "The No-Confidence vote", ["Quit  India", "acid"]), (2, "no confidence", None), (3, "placid genes", ["gene therapy", "acid-gene"]), (4, None, None), (5, "", []), (6, "quit india; gene", ["x"]), (7, "c++ acid", None)]
    q = spark.createDataFrame(rows, "question_id long, text string, options array<string>")
    assert {(r.question_id, r.subject, r.score) for r in hints.subject_hints(q, hints.keyword_table(spark, words)).collect()} == {(1, "One", 2), (2, "Two", 2), (3, None, None), (4, None, None), (5, None, None), (6, "One", 2), (7, "One", 2)}
    many = {f"S{i}": [f"word{i} x{j}" for j in range(10)] for i in range(60)}
    assert hints.subject_hints(spark.createDataFrame([(1, "word7 x3", None)], "question_id long, text string, options array<string>"), hints.keyword_table(spark, many)).first().subject == "S7"


def test_draws_are_random_and_without_repeats(spark):
    pool = hints.draw_pool(spark.range(1000).select(F.col("id").alias("question_id"), F.concat(F.lit("T"), F.col("id") % 3).alias("topic")), "topic")
    assert {(r.area, r.at) for r in pool.collect()} == {(f"topic:T{i}", k) for i in range(3) for k in range(334 if i == 0 else 333)}
    asked = spark.range(3000).select(F.col("id").alias("user_id"), F.array(F.lit("topic:T1"), F.lit("topic:T2")).alias("areas"), F.lit(20).alias("count"))
    drawn = {}
    for r in sessions.practice_draw(asked, pool).collect():
        drawn.setdefault(r.user_id, []).append((r.position, r.question_id))
    assert len(drawn) == 3000 and all(sorted(p for p, _ in x) == list(range(1, 21)) and len({q for _, q in x}) == 20 and all(q % 3 for _, q in x) for x in drawn.values())
    times = Counter(q for x in drawn.values() for _, q in x)
    assert len(times) == 666 and 40 < min(times.values()) and max(times.values()) < 150  # 90 each
    near = sum(abs(a - b) == 3 for x in drawn.values() for (_, a), (_, b) in itertools.combinations(x, 2))
    assert near / (3000 * 190) < 2 * 664 / (666 * 665 / 2)
    few = sessions.practice_draw(spark.createDataFrame([(1, ["topic:T1", "topic:none"], 500), (2, ["topic:none"], 5), (3, ["topic:T0"], 0)], "user_id long, areas array<string>, count int"), pool)
    assert {r.user_id: r.n for r in few.groupBy("user_id").agg(F.count_distinct("question_id").alias("n")).collect()} == {1: sessions.MOST, 3: 1}


def test_moments_meet_the_last_version(spark):
    r = random.Random(3)
    rows = [(r.randrange(4), f"2024-01-0{r.randrange(1, 6)} 0{r.randrange(10)}:00:00", i, f"v{i}") for i in range(300)] + [(None, "2024-01-01 00:00:00", 900, "x"), (1, None, 901, "y")]
    asked = [(i, r.randrange(6), f"2024-01-0{r.randrange(1, 8)} 0{r.randrange(10)}:00:00") for i in range(200)] + [(900, 1, None), (901, None, "2024-01-03 00:00:00")]
    v = spark.createDataFrame(rows, "entity long, at string, seq long, value string").withColumn("at", F.col("at").cast("timestamp"))
    m = spark.createDataFrame(asked, "moment_id long, entity long, at string").withColumn("at", F.col("at").cast("timestamp"))
    want = {(i, max(((a, s, x) for e2, a, s, x in rows if e2 == e and e is not None and a and at and a <= at), default=(0, 0, None))[2]) for i, e, at in asked}
    for span in ("day", "hour", "year"):
        assert {(x.moment_id, x.value) for x in review.as_of_each(v, m, ["value"], span).collect()} == want


def test_running_lines(spark):
    rows, pages = [], []
    for page in range(5):
        pages.append((1, page, 0.0, 1000.0))
        rows += [(1, page, 0, 0, 10.0, 20.0, f"Sectional Test 7 | {page}"), (1, page, 0, 1, 30.0, 40.0, f"{page + 1}. A question in the band"), (1, page, 0, 2, 500.0, 510.0, "the same line in the middle"), (1, page, 0, 3, 300.0 + 50 * page, 310.0, f"mail{page}@site.example"), (1, page, page % 2, 4, 980.0, 990.0, "- 4 -"), (1, page, 0, 5, 60.0, 70.0, f"Item {page}: text"), (1, page, 0, 6, 970.0, 980.0, "(a) yes (b) no")]
    rows += [(2, page, 0, 0, 10.0, 20.0, "Head") for page in range(2)]
    table = spark.createDataFrame(rows, "paper_id long, page int, col int, line_no int, top double, bottom double, text string")
    boxes = spark.createDataFrame(pages + [(2, page, 0.0, 1000.0) for page in range(2)], "paper_id long, page int, top double, bottom double")
    kept = Counter((r.paper_id, r.line_no) for r in running.without_running_lines(table, boxes).collect())
    assert kept == {(1, 1): 5, (1, 2): 5, (1, 4): 2, (1, 5): 5, (1, 6): 5, (2, 0): 2}


def test_a_paper_ends_after_its_last_question(spark):
    rows = [(1, 1, 0, n, f"{n}. Question {n}? (a) x (b) y (c) z (d) w") for n in range(1, lines.LAST + 3)]
    found = {r.number: r for r in lines.questions(spark.createDataFrame(rows, "paper_id long, page int, col int, line_no int, text string")).collect()}
    assert len(found) == lines.LAST and found[lines.LAST].options == ["x", "y", "z", "w"]


def test_snapshots_of_imports(spark, tmp_path):
    store, schema = snapshots.Snapshots(spark, str(tmp_path / "bank")), "paper_id long, number int, text string, status string"
    assert store.read() is None and store.versions() == []

    def state(number=None):
        return {(r.number, r.text, r.status) for r in store.read(number).collect()}

    first = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "", "x")], schema)
    assert snapshots.import_batch(store, first, "skip", "s.0") == 1 == snapshots.import_batch(store, first, "append", "s.0")
    assert state() == {(1, "a", "needs_review"), (2, "", "needs_review")}
    more = spark.createDataFrame([(1, 1, "A", "x"), (1, 2, "B", "x"), (1, 3, "C", "x")], schema)
    by_mode = {"skip": {(1, "a"), (2, ""), (3, "C")}, "fill": {(1, "a"), (2, "B"), (3, "C")}, "replace": {(1, "A"), (2, "B"), (3, "C")}, "append": {(1, "a"), (2, ""), (3, "A"), (4, "B"), (5, "C")}}
    for mode, want in by_mode.items():
        own = snapshots.Snapshots(spark, str(tmp_path / mode))
        snapshots.import_batch(own, first, "skip", "a")
        for _ in range(2):  # a repeated batch changes nothing
            assert snapshots.import_batch(own, more, mode, "b") == 2
        assert {(r.number, r.text) for r in own.read().collect()} == want and own.read(1).count() == 2
    (tmp_path / "bank" / "_draft-dead").mkdir()
    for part in (first, more):
        part.write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        run = snapshots.import_stream(store, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "append", str(tmp_path / "c")).trigger(availableNow=True).start()
        run.awaitTermination()
    assert [n for n, _ in store.versions()] == list(range(1, len(store.versions()) + 1)) and store.read().count() == 7
    with pytest.raises(ValueError, match="token"):
        store.write(first, "../x")


def test_sheet_cells_never_name_digits_or_words(spark):
    cells = [a + b for a in ("", "(", "option ", "Answer: ", "choice", "key ", "x") for b in ("a", "D", "e", "1", "ab", "b)", "c.", "क")]
    found = spark.createDataFrame([(c,) for c in cells], "s string").select("s", text.sheet_answer(F.col("s")).alias("a")).collect()
    for r in found:
        bare = re.sub(r"[\s().:]", "", re.sub(r"^(option|answer|choice)", "", r.s.lower()))
        assert r.a == (bare.upper() if bare in set("abcd") else None), r.s


def test_parts_of_json_files(spark, tmp_path):
    q = lambda n: f'{{"number": {n}, "question": "What is {n}?"}}'
    texts = {
        "a": f'```json\n{{"schema_version": 2, "questions": [{q(1)}]}}\n```\nCovered questions 1 to 1.\n{{"questions": [{q(2)}]}}', "b": f"Here you are: [{q(1)}, {q(2)}] Good luck", "c": f'{{"schema_version": 2, "questions": [{q(1)}, {q(2)}, {{"number": 3, "ques',
        "d": f'{{"schema_version": 1, "questions": [{q(1)}]}} {{"schema_version": 1, "questions": [{q(7)}', "e": "nothing", "f": '{"schema_version": true, "questions": []}', "g": '{"schema_version": 2, "questions": {}}', "h": b"\xff\xe9{}",
    }
    for name, content in texts.items():
        (tmp_path / name).write_bytes(content if isinstance(content, bytes) else content.encode())
    objects = files.json_objects(files.read_files(spark, f"{tmp_path}/*"))
    issues = sorted((r.file[-1], r.part, r.level, r.code, r.number) for r in importing.part_issues(objects).collect())
    assert issues == [
        ("a", 2, "warning", "no_schema_version", None), ("b", 1, "warning", "bare_list", None), ("b", 1, "warning", "text_before", None), ("b", 2, "warning", "text_after", None), ("c", 1, "error", "broken", 3), ("d", 2, "error", "broken_rest", 7),
        ("e", 1, "error", "no_json", None), ("f", 1, "error", "schema_version", None), ("g", 1, "error", "no_question_list", None), ("h", 1, "error", "not_utf8", None),
    ]
    assert sorted((r.file[-1], r.part, r.q.number) for r in files.json_questions(objects).collect()) == [("a", 1, 1), ("a", 2, 2), ("b", 1, 1), ("b", 1, 2), ("c", 1, 1), ("c", 1, 2), ("d", 1, 1)]


def test_two_books_of_a_subject_are_numbered_apart(spark, tmp_path):
    import json

    for book in ("one", "two"):
        (tmp_path / book).mkdir()
        for chapter in (2, 1):
            body = {"subject": "S", "chapter_no": chapter, "chapter": f"c{chapter}", "question_count": 2, "questions": [{"id": "x", "number": n, "question": f"{book} {chapter} {n}"} for n in (2, 1)]}
            (tmp_path / book / f"{chapter}.json").write_text(json.dumps(body))
    (tmp_path / "two" / "3.json").write_text("{broken")
    found = sorted((r.book[-3:], r.book_number, r.q.question) for r in files.book_chapters(spark, f"{tmp_path}/*").collect())
    assert found == [(b, i + 1, f"{b} {c} {n}") for b in ("one", "two") for i, (c, n) in enumerate(itertools.product((1, 2), (1, 2)))]
    chapters = {(r.file[-10:], r.chapter_no, r.n, r.corrupt) for r in files.chapter_files(spark, f"{tmp_path}/*").collect()}
    assert chapters == {(f"{b}/{c}.json", c, 2, None) for b in ("one", "two") for c in (1, 2)} | {("two/3.json", None, 0, "{broken")}


def test_a_paper_in_order(spark):
    from examlattice.operators import lists

    q = spark.createDataFrame([(1, 1, None, 9), (1, 0, 3, 4), (1, 0, 2, 8), (1, 1, 1, 2), (1, 0, 2, 7)], "paper_id int, first int, question_number int, question_id long")
    assert [r.question_id for r in lists.in_order(q).collect()] == [7, 8, 4, 2, 9] and [r.question_id for r in lists.in_order(q.drop("first")).collect()] == [2, 7, 8, 4, 9]
