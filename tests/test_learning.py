"""Rules with hand-worked numbers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from examlattice.operators import activity, analytics, grading, leaderboard, revision, suspicion

RESPONSE = "attempt_id long, question_id long, user_id long, kind string, attempt_status string, started_at timestamp, position int, selected_answer string, correct_answer string, subject string, topic string, is_correct boolean, confidence string, seconds int, marks_if_correct double, penalty_if_wrong double"
T0 = dt.datetime(2024, 1, 1)


def responses(spark, rows, kind="full_test", status="submitted", user=1, attempt=1):
    """rows: (R, W or None, confidence, seconds, subject)."""
    out = []
    for i, (mark, confidence, seconds, subject) in enumerate(rows, 1):
        chosen = {"R": "A", "W": "B", None: None}[mark]
        out.append((attempt, i, user, kind, status, T0, i, chosen, "A", subject, None, None if mark is None else mark == "R", confidence, seconds, 2.0, 1.0))
    return spark.createDataFrame(out, RESPONSE)


WORKED = [("R", "sure", 40, "H"), ("R", "guessed", 30, "H"), ("W", "sure", 5, "H"), ("W", "sure", 200, "H"), ("W", "sure", 40, "H"), ("W", "guessed", 60, "H"), ("W", "no_idea", 50, "H"), ("R", "no_idea", 45, "H"), (None, "skipped", None, "H"), (None, "skipped", None, "H")]


def test_worked_attempt(spark):
    r = responses(spark, WORKED)
    attempts = spark.createDataFrame([(1, "full_test", T0, T0 + dt.timedelta(hours=1))], "attempt_id long, kind string, started_at timestamp, completed_at timestamp")
    t = grading.attempt_totals(r, attempts).first()
    assert (t.score, t.max_marks, t.correct, t.wrong, t.skipped, t.gained, t.lost, t.time_taken, t.accuracy, t.attempt_rate) == (1.0, 20.0, 3, 5, 2, 6.0, 5.0, 3600, 38, 80)
    assert grading.typical_seconds(r).first().typical == 42.5
    assert {x.question_id: x.reason for x in grading.mistake_reasons(r).collect()} == {3: "careless", 4: "time_pressure", 5: "conceptual_confusion", 6: "guess_miss", 7: "knowledge_gap"}
    g = grading.guessing_report(r).first()
    assert (g.shaky_marks, g.score_if_skipped, g.guessing) == (2.0, -1.0, "helped")
    w = grading.worth_attempting(r).first()
    assert (w.worth, w.expected_gain, w.break_even) == (2, 0.25, 33)


@pytest.mark.parametrize(("confidence", "seconds", "typical", "want"), [
    ("sure", 14, 60, "careless"), ("sure", 15, 60, "conceptual_confusion"), ("sure", 7, 10, "careless"), ("sure", 8, 10, "conceptual_confusion"), ("sure", 150, 60, "conceptual_confusion"), ("sure", 151, 60, "time_pressure"),
    ("sure", None, 60, "conceptual_confusion"), ("sure", 0, 60, "conceptual_confusion"), ("guessed", 1, 60, "guess_miss"), ("no_idea", 999, 60, "knowledge_gap"), (None, 5, 60, "unset"),
])
def test_mistake_reasons(spark, confidence, seconds, typical, want):
    r = responses(spark, [("W", confidence, seconds, "H"), *[("R", "sure", typical, "H")] * 6])
    assert grading.mistake_reasons(r).first().reason == want


@pytest.mark.parametrize(("marks", "negative", "want"), [(1.0, 0.0, (1.0, 0.0)), (2.5, 0.2, (2.5, 0.5)), (4.0, 0.25, (4.0, 1.0)), (None, None, (2.0, 0.666667)), (0.0, 0.25, (2.0, 0.5))])
def test_scheme(spark, marks, negative, want):
    s = spark.createDataFrame([(marks, negative)], "m double, n double").select(grading.scheme(F.col("m"), F.col("n")).alias("s")).first().s
    assert tuple(s) == want


def test_progress(spark):
    a = [("R", "sure", 10, "History"), ("W", "sure", 20, "History"), ("R", "sure", 30, "History"), ("W", "sure", 40, "History"), ("W", "sure", None, "History"), ("W", "sure", 60, "History"), ("R", "sure", 50, "History"), ("W", "sure", 70, "History")]
    b = [("R", "sure", 5, "Polity"), ("R", "sure", 5, "Polity"), ("R", "sure", 5, "Polity"), ("W", "sure", 5, "Polity")]
    r = responses(spark, a, "practice").unionAll(responses(spark, b, "practice", attempt=2))
    by = {x.subject: x for x in analytics.accuracy_by(r, "subject").collect()}
    assert (by["History"].accuracy, by["History"].weak, by["Polity"].accuracy, by["Polity"].enough) == (38, True, 75, False)
    assert [(x.kind, x.name) for x in analytics.weak_areas(r).collect()] == [("subject", "History")]
    tests = spark.createDataFrame([(1, 60.0), (1, 75.0), (1, 30.0)], "user_id long, percent double")
    o = analytics.overview(r, tests).first()
    assert (o.answered, o.right, o.accuracy, o.tests, o.mean_score) == (12, 6, 50, 3, 55)


def test_ranks_and_percentiles(spark):
    rows = spark.createDataFrame([("t", 1, 90.0, 50.0), ("t", 2, 80.0, 40.0), ("t", 3, 80.0, 40.0), ("t", 4, 80.0, None), ("t", 5, 10.0, 5.0)], "board string, user_id long, value double, seconds double")
    found = {r.user_id: (r.rank_pos, r.percentile) for r in leaderboard.ranked(rows, "board").collect()}
    assert found == {1: (1, 100), 2: (2, 50), 3: (2, 50), 4: (4, 25), 5: (5, 0)}
    few = leaderboard.ranked(rows.where("user_id < 5"), "board")
    assert few.where("percentile IS NOT NULL").count() == 0


@pytest.mark.parametrize(("offsets", "want"), [([0], (1, 1)), ([1], (1, 1)), ([2], (0, 1)), ([0, 1, 2], (3, 3)), ([0, 2, 3, 4, 5], (1, 4)), ([1, 2, 10, 11, 12], (2, 3)), ([-1, 0], (1, 1)), ([399, 400], (0, 1))])
def test_streaks(spark, offsets, want):
    today = dt.date(2024, 6, 1)
    daily = spark.createDataFrame([(1, today - dt.timedelta(o), 3) for o in offsets], "user_id long, day date, n long")
    r = activity.streaks(daily, "2024-06-01").first()
    assert (r.current_streak, r.best_streak) == want


SEQUENCES = [  # (day, correct, confidence) ..., (stage, streak, status, due day)
    ([(0, False, "sure")], (0, 0, "active", 1)), ([(0, True, "sure")], None), ([(0, False, "sure"), (1, True, "sure"), (4, True, "sure")], (1, 2, "done", 4)),
    ([(0, False, "sure"), (1, False, "sure")], (1, 0, "active", 4)), ([(0, False, "sure"), (0, False, "sure")], (0, 0, "active", 1)), ([(0, False, "sure"), (1, True, "guessed"), (4, True, "sure")], (2, 1, "active", 11)),
    ([(0, False, "sure"), (1, True, "sure"), (2, False, "sure"), (4, True, "sure"), (11, True, "sure")], (2, 2, "done", 11)), ([(0, False, "sure"), (1, True, "sure"), (4, True, "sure"), (9, False, "sure")], (0, 0, "active", 10)),
]


@pytest.mark.parametrize(("answers", "want"), SEQUENCES)
def test_schedule(spark, answers, want):
    from examlattice.streaming.jobs import next_state

    start = dt.date(2024, 1, 1)
    rows = [(1, 1, start + dt.timedelta(d), i, ok, c) for i, (d, ok, c) in enumerate(answers)]
    found = revision.schedule(spark.createDataFrame(rows, "user_id long, question_id long, day date, seq long, correct boolean, confidence string")).first()
    state = None
    for _, _, day, _, ok, c in rows:
        state = next_state(state, day, ok, c not in ("guessed", "no_idea"))
    if want is None:
        assert found is None and state is None
    else:
        assert (found.stage, found.streak, found.status, found.due) == (*want[:3], start + dt.timedelta(want[3])) == state


def test_suspicion(spark):
    users = spark.createDataFrame([(u, False) for u in range(16)], "user_id long, is_admin boolean")
    questions = spark.createDataFrame([(q, "live", "A") for q in range(24)], "question_id long, status string, correct_answer string")
    rows = []
    for u in range(16):
        for q in range(24):
            letter = "B" if q == 0 and u < 5 else "A" if q == 0 or u < 8 or q < 24 - u else "C"
            rows.append((u, q, u, "full_test", "submitted", T0, q, letter, "A", None, None, letter == "A", "sure", 10, 2.0, 1.0))
    r = spark.createDataFrame(rows, RESPONSE)
    found = suspicion.suspicious(r, users, questions).collect()
    assert [(x.question_id, x.popular_answer, x.popular_n, x.high_n) for x in found] == [(0, "B", 5, 8)]
    queue = spark.createDataFrame([(0, "dismissed", "A"), (5, "open", "A"), (6, "sent_back", "A"), (99, "open", "A"), (98, "dismissed", "A")], "question_id long, status string, handled_key string")
    after = {x.question_id: (x.status, x.action) for x in suspicion.reconcile(queue, suspicion.verdicts(suspicion.judged(suspicion.first_answers(r, users), questions))).collect()}
    assert after == {0: ("dismissed", "kept"), 5: ("open", "cleared"), 6: ("sent_back", "kept"), 99: ("open", "cleared"), 98: ("dismissed", "kept")}
