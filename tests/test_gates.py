"""Publishing, audits, keys and reports."""

from pyspark.sql import functions as F

from examlattice.operators import hints, review, sessions

QUESTION = "question_id long, paper_id int, status string, correct_answer string, flagged boolean, acknowledged boolean, answer_source string, has_image boolean, has_snapshot boolean"


def paper(spark, n, **changes):
    row = dict(paper_id=1, status="verified", correct_answer="A", flagged=False, acknowledged=False, answer_source="key", has_image=False, has_snapshot=False) | changes
    names = [c.split()[0] for c in QUESTION.split(", ")]
    return spark.createDataFrame([tuple({"question_id": i, **row}[c] for c in names) for i in range(n)], QUESTION)


def papers(spark, audit="none", status="ready"):
    return spark.createDataFrame([(1, status, False, audit)], "paper_id int, status string, archived boolean, audit_state string")


def versions(spark, *rows):
    return spark.createDataFrame(list(rows), "question_id long, reason string")


def blockers(spark, q, p, v):
    return review.publish_blockers(p, q, v).first().blockers


def test_what_keeps_a_paper_back(spark):
    none = versions(spark)
    assert blockers(spark, paper(spark, 4), papers(spark), none) == ""
    assert blockers(spark, paper(spark, 5), papers(spark), none) == "audit"
    assert blockers(spark, paper(spark, 5), papers(spark, "passed"), none) == ""
    assert blockers(spark, paper(spark, 3), papers(spark, "pending"), none) == "audit"
    assert blockers(spark, paper(spark, 3, flagged=True), papers(spark), none) == "flagged"
    assert blockers(spark, paper(spark, 3, flagged=True, acknowledged=True), papers(spark), none) == ""
    assert blockers(spark, paper(spark, 3, flagged=True, status="draft"), papers(spark), none) == "to_confirm"
    assert blockers(spark, paper(spark, 3, correct_answer="F"), papers(spark), none) == "no_answer"
    assert blockers(spark, paper(spark, 3, status="quarantined"), papers(spark, status="reading"), none) == "not_ready,empty"


def test_what_counts_as_an_edit(spark):
    q = paper(spark, 6)
    v = versions(spark, (0, "pages 3-4 read again"), (1, "bulk subject change"), (2, "text"), (3, None), (4, "subject/topic/difficulty"))
    assert {r.question_id for r in review.unedited_confirmed(q, v).collect()} == {0, 1, 4, 5}


def test_a_failed_audit_sends_the_pool_back(spark):
    q = paper(spark, 10)
    pool = review.unedited_confirmed(q, versions(spark, (9, "text")))
    for wrong, want in ((2, {0, 1}), (3, set(range(9)))):
        checked = q.where("question_id < 5").select("paper_id", "question_id", (F.col("question_id") < wrong).alias("wrong"))
        after = review.audit_finish(q, pool, checked)
        assert {r.question_id for r in after.where("status = 'needs_review'").collect()} == want


def test_keys_fill_and_replace(spark):
    rows = [(1, 1, 1, "A", "live", True, ["answer_unclear", "x"], 4, None), (2, 1, 2, None, "verified", True, ["no_answer_found"], 4, "own"), (3, 1, 3, "B", "draft", False, [], 4, None), (4, 1, 4, None, "draft", False, [], 4, None), (5, 1, 5, None, "draft", False, [], 5, None)]
    q = spark.createDataFrame(rows, "question_id long, paper_id int, question_number int, correct_answer string, status string, acknowledged boolean, flags array<string>, n_options int, explanation string")
    key = spark.createDataFrame([(1, 1, "C", "so"), (1, 2, "D", "so"), (1, 3, "B", None), (1, 4, "E", None), (1, 5, "E", None)], "paper_id int, question_number int, letter string, explanation string")
    found = {r.question_id: r for r in review.key_apply(q, key).collect()}
    assert [found[i].action for i in range(1, 6)] == ["kept", "filled", "unchanged", "ignored", "filled"]
    assert (found[2].status, found[2].flags, found[2].explanation, found[1].explanation) == ("needs_review", [], "own", "so")
    found = {r.question_id: r for r in review.key_apply(q, key, replace=True).collect()}
    assert (found[1].action, found[1].correct_answer, found[1].status, found[1].acknowledged, found[1].flags) == ("replaced", "C", "needs_review", False, ["x"])


def test_reports_have_limits(spark):
    reports = spark.createDataFrame([(1, i, f"2024-01-01 00:{i:02d}:00", "resolved") for i in range(20)] + [(2, 5, "2024-01-01 00:00:00", "open")], "user_id long, question_id long, at string, status string")
    asked = spark.createDataFrame([(1, 1, 50, "2024-01-01 12:00:00"), (2, 1, 50, "2024-01-02 00:05:30"), (3, 2, 5, "2024-01-03 00:00:00"), (4, 2, 6, "2024-01-03 00:00:00")], "request_id long, user_id long, question_id long, at string")
    assert {r.request_id: r.verdict for r in sessions.report_verdicts(asked, reports).collect()} == {1: "limit", 2: "taken", 3: "open", 4: "taken"}


def test_draws_are_whole_and_differ(spark):
    pool = hints.draw_pool(spark.range(500).select(F.col("id").alias("question_id"), F.lit("S").alias("subject")), "subject")
    asked = spark.createDataFrame([(u, ["subject:S"], n) for u, n in ((1, 10), (2, 10), (3, 1000))], "user_id long, areas array<string>, count int")
    found = {}
    for r in sessions.practice_draw(asked, pool).collect():
        found.setdefault(r.user_id, set()).add(r.question_id)
    assert {u: len(x) for u, x in found.items()} == {1: 10, 2: 10, 3: 100} and found[1] != found[2]
