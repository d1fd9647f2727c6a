"""The queries in SQL for DuckDB, over the same tables."""

from __future__ import annotations

from ..domain import with_views

RIGHT = "(selected_answer IS NOT NULL AND coalesce(is_correct, FALSE))"
WRONG = "(selected_answer IS NOT NULL AND NOT coalesce(is_correct, TRUE))"
GRADED = "selected_answer IS NOT NULL AND is_correct IS NOT NULL"
MARKS = f"CASE WHEN {RIGHT} THEN marks_if_correct WHEN {WRONG} THEN -penalty_if_wrong END"


def percent(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN CAST(round_even(100.0e0 * ({part}) / ({whole}), 0) AS INT) END"


LIVE = """live AS (SELECT q.*, p.source_type, p.year FROM questions q JOIN papers p USING (paper_id) WHERE q.status = 'live' AND q.correct_answer IN ('A','B','C','D','E') AND NOT (has_image AND NOT has_snapshot)
  AND p.status = 'ready' AND p.publish_status = 'published' AND NOT p.archived)"""
TOTALS = f"""totals AS (SELECT r.attempt_id, r.total, r.correct, r.wrong, r.skipped, r.score, r.max_marks, r.gained, r.lost,
  CASE WHEN a.kind IN ('full_test', 'section') THEN CAST(epoch(a.completed_at) - epoch(a.started_at) AS BIGINT) ELSE r.screen END AS time_taken,
  {percent('r.correct', 'r.correct + r.wrong')} AS accuracy, {percent('r.correct + r.wrong', 'r.total')} AS attempt_rate, a.kind, a.status, a.user_id, a.rank_key, a.started_at, a.completed_at
  FROM (SELECT attempt_id, count(*) AS total, count(*) FILTER ({RIGHT}) AS correct, count(*) FILTER ({WRONG}) AS wrong, count(*) FILTER (selected_answer IS NULL) AS skipped, round_even(coalesce(sum(m), 0), 6) AS score, round_even(sum(marks_if_correct), 6) AS max_marks,
    round_even(coalesce(sum(m) FILTER (m > 0), 0), 6) AS gained, round_even(coalesce(sum(-m) FILTER (m < 0), 0), 6) AS lost, CAST(sum(seconds) AS BIGINT) AS screen FROM (SELECT *, {MARKS} AS m FROM responses) GROUP BY attempt_id) r JOIN attempts a USING (attempt_id))"""
TESTS = "tests AS (SELECT *, CASE WHEN max_marks > 0 THEN round_even(100 * score / max_marks, 1) END AS percent FROM totals WHERE kind IN ('full_test', 'section') AND status IN ('submitted', 'expired'))"
TYPICAL = "typical AS (SELECT attempt_id, CASE WHEN count(t) >= 3 THEN median(t) ELSE 72.0e0 END AS typical FROM (SELECT attempt_id, CASE WHEN selected_answer IS NOT NULL AND seconds > 0 THEN seconds END AS t FROM responses) GROUP BY attempt_id)"
REASONS = f"""{TYPICAL}, reasons AS (SELECT attempt_id, question_id, CASE confidence WHEN 'no_idea' THEN 'knowledge_gap' WHEN 'guessed' THEN 'guess_miss' WHEN 'sure' THEN
  CASE WHEN coalesce(seconds, 0) = 0 THEN 'conceptual_confusion' WHEN seconds < greatest(8.0e0, 0.25e0 * typical) THEN 'careless' WHEN seconds > 2.5e0 * typical THEN 'time_pressure' ELSE 'conceptual_confusion' END ELSE 'unset' END AS reason
  FROM responses JOIN typical USING (attempt_id) WHERE {WRONG})"""


def accuracy_by(key: str, rows: str = "responses") -> str:
    col = "topic" if key == "topic" else "coalesce(subject, 'No subject set')"
    cond = " AND topic IS NOT NULL" if key == "topic" else ""
    return f"""SELECT *, enough AND accuracy < 60 AS weak FROM (SELECT user_id, {key}, answered, "right", {percent('"right"', 'answered')} AS accuracy, answered >= 5 AS enough
      FROM (SELECT user_id, {col} AS {key}, count(*) AS answered, count(*) FILTER ({RIGHT}) AS "right" FROM {rows} WHERE {GRADED}{cond} GROUP BY ALL))"""


DAILY = f"daily AS (SELECT user_id, CAST(started_at AS DATE) AS day, count(*) AS n FROM responses WHERE {GRADED} GROUP BY ALL)"
TODAY = "DATE '2000-06-15'"
FOLD = f"""x AS (SELECT user_id, question_id, CAST(started_at AS DATE) AS day, is_correct AS correct, coalesce(confidence NOT IN ('guessed', 'no_idea'), TRUE) AS clean,
    row_number() OVER (PARTITION BY user_id, question_id ORDER BY CAST(started_at AS DATE), attempt_id * 100 + position) AS i FROM responses WHERE {GRADED} AND attempt_status <> 'in_progress'),
f AS (SELECT user_id, question_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS INT) AS stage, CAST(NULL AS INT) AS streak, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS DATE) AS due FROM (SELECT DISTINCT user_id, question_id FROM x)
  UNION ALL
  SELECT f.user_id, f.question_id, x.i,
    CASE WHEN NOT correct AND (f.status IS NULL OR f.status = 'done') THEN 0 WHEN NOT correct THEN CASE WHEN due <= day THEN stage + 1 ELSE stage END WHEN f.status IS NULL OR f.status = 'done' OR due > day THEN stage WHEN NOT clean THEN stage + 1 WHEN streak + 1 >= 2 THEN stage ELSE stage + 1 END,
    CASE WHEN NOT correct THEN 0 WHEN f.status IS NULL OR f.status = 'done' OR due > day THEN streak WHEN NOT clean THEN 0 ELSE streak + 1 END,
    CASE WHEN NOT correct THEN 'active' WHEN f.status IS NULL OR f.status = 'done' OR due > day OR NOT clean THEN f.status WHEN streak + 1 >= 2 THEN 'done' ELSE 'active' END,
    CASE WHEN NOT correct AND (f.status IS NULL OR f.status = 'done') THEN day + 1 WHEN NOT correct AND due > day THEN due WHEN correct AND (f.status IS NULL OR f.status = 'done' OR due > day OR (clean AND streak + 1 >= 2)) THEN due ELSE day + [1, 3, 7, 15][least(stage + 1, 3) + 1] END
  FROM f JOIN x ON f.user_id = x.user_id AND f.question_id = x.question_id AND x.i = f.i + 1),
items AS (SELECT user_id, question_id, stage, streak, status, due FROM (SELECT *, row_number() OVER (PARTITION BY user_id, question_id ORDER BY i DESC) AS b FROM f) WHERE b = 1 AND status IS NOT NULL)"""


def board(key: str, source: str) -> str:
    return f"""SELECT {key}, user_id, value, seconds, rank_pos, n, CASE WHEN n >= 5 THEN CAST(round_even(100.0e0 * (n - upto) / (n - 1), 0) AS INT) END AS percentile FROM (
  SELECT *, rank() OVER (PARTITION BY {key} ORDER BY round_even(value, 6) DESC, seconds ASC NULLS LAST) AS rank_pos, count(*) OVER (PARTITION BY {key}) AS n,
    count(*) OVER (PARTITION BY {key} ORDER BY round_even(value, 6) DESC, seconds ASC NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM ({source}))"""


FIRST = "firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, rank_key ORDER BY started_at, attempt_id) AS turn FROM tests) WHERE turn = 1 AND max_marks > 0 AND user_id IN (SELECT user_id FROM users WHERE status = 'approved' AND NOT is_admin))"
SUSPICION = """fa AS (SELECT user_id, question_id, selected_answer AS letter FROM (SELECT *, row_number() OVER (PARTITION BY user_id, question_id ORDER BY attempt_id, position) AS turn FROM responses
  WHERE attempt_status <> 'in_progress' AND selected_answer IN ('A','B','C','D','E') AND user_id IN (SELECT user_id FROM users WHERE NOT is_admin)) WHERE turn = 1),
qa AS (SELECT fa.*, q.correct_answer, CAST(letter = q.correct_answer AS INT) AS ok FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n_all FROM fa) fa JOIN questions q USING (question_id) WHERE n_all >= 20 AND q.status = 'live' AND q.correct_answer IS NOT NULL),
ac AS (SELECT *, round_even(CAST(k - ok AS DOUBLE) / (n - 1), 9) AS accuracy, count(*) OVER (PARTITION BY question_id) AS responders FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, sum(ok) OVER (PARTITION BY user_id) AS k FROM qa) WHERE n >= 2),
pl AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY accuracy DESC, user_id) AS place FROM ac WHERE responders >= 12),
hi AS (SELECT *, accuracy >= min(accuracy) FILTER (place <= greatest(5, ceil(responders * 0.25))) OVER (PARTITION BY question_id) AS high FROM pl),
le AS (SELECT question_id, correct_answer, letter, count(*) FILTER (high) AS hn, count(*) AS an FROM hi GROUP BY ALL),
ve AS (SELECT question_id, correct_answer AS key_answer, max(struct_pack(hn := hn, k := letter = correct_answer, l := letter)) AS b, CAST(sum(hn) AS BIGINT) AS high_n, CAST(sum(an) AS BIGINT) AS all_n, CAST(sum(CASE WHEN letter = correct_answer THEN hn ELSE 0 END) AS BIGINT) AS key_n FROM le GROUP BY ALL)"""

R = ("responses", "questions", "attempts")
ORACLES: dict[str, str] = {
    "live_pool": with_views(f"WITH {LIVE} SELECT question_id, paper_id, source_type, year, subject, topic, difficulty FROM live", "questions", "papers"),
    "unattempted_by_user": with_views(f"WITH {LIVE} SELECT user_id, (SELECT count(*) FROM live) - coalesce(done, 0) AS n_open FROM users LEFT JOIN (SELECT user_id, count(DISTINCT question_id) AS done FROM responses WHERE selected_answer IS NOT NULL AND question_id IN (SELECT question_id FROM live) GROUP BY user_id) USING (user_id)", "papers", "users", *R),
    "practice_filter": with_views(f"WITH {LIVE} SELECT question_id, paper_id, subject FROM live WHERE source_type = 'official' AND difficulty = 'hard'", "papers", *R),
    "filter_options": with_views(f"WITH {LIVE} " + " UNION ALL ".join(f"SELECT '{k}' AS kind, CAST({k} AS VARCHAR) AS value, count(*) AS n FROM live WHERE {k} IS NOT NULL GROUP BY ALL" for k in ("source_type", "year", "subject", "topic", "difficulty")), "papers", "questions"),
    "topic_frequency": with_views(f"WITH {LIVE}, o AS (SELECT * FROM live WHERE source_type = 'official') SELECT name, count(*) AS n, (SELECT count(*) FROM o) AS total FROM (SELECT CASE WHEN (SELECT count(topic) FROM o) > 0 THEN topic ELSE subject END AS name FROM o) WHERE name IS NOT NULL GROUP BY name ORDER BY n DESC, name LIMIT 15", "papers", "questions"),
    "seen_state": with_views("SELECT user_id, question_id, over_ AS has_seen, over_ AND NOT locked AS can_reveal, locked FROM (SELECT user_id, question_id, bool_or(kind IN ('full_test','section') AND attempt_status = 'in_progress') AS locked, bool_or(attempt_status <> 'in_progress' OR (kind NOT IN ('full_test','section') AND selected_answer IS NOT NULL)) AS over_ FROM responses GROUP BY ALL)", *R),
    "attempt_totals": with_views(f"WITH {TOTALS} SELECT attempt_id, total, correct, wrong, skipped, score, max_marks, gained, lost, time_taken, accuracy, attempt_rate FROM totals", *R),
    "mistake_reasons": with_views(f"WITH {REASONS} SELECT * FROM reasons", *R),
    "mistake_reason_counts": with_views(f"WITH {REASONS} SELECT attempt_id, reason, count(*) AS n FROM reasons GROUP BY ALL", *R),
    "guessing_report": with_views(f"""SELECT *, round_even(score - shaky_marks, 6) AS score_if_skipped, CASE WHEN shaky_marks > 0 THEN 'helped' WHEN shaky_marks < 0 THEN 'cost' ELSE 'even' END AS guessing FROM (SELECT attempt_id,
      {', '.join(f"count(*) FILTER (confidence = '{c}') AS {c}_answered, count(*) FILTER (confidence = '{c}' AND {RIGHT}) AS {c}_right, round_even(coalesce(sum(m) FILTER (confidence = '{c}'), 0), 6) AS {c}_marks" for c in ('sure', 'guessed', 'no_idea'))},
      round_even(coalesce(sum(m) FILTER (confidence <> 'sure'), 0), 6) AS shaky_marks, round_even(coalesce(sum(m), 0), 6) AS score FROM (SELECT *, {MARKS} AS m FROM responses WHERE selected_answer IS NOT NULL) GROUP BY attempt_id)""", *R),
    "subject_breakdown": with_views(f"""SELECT *, {percent('"right"', 'answered')} AS accuracy FROM (SELECT attempt_id, coalesce(subject, 'No subject set') AS subject, count(*) AS total, count(selected_answer) AS answered, count(*) FILTER ({RIGHT}) AS "right", count(*) FILTER ({WRONG}) AS wrong, count(*) - count(selected_answer) AS skipped, round_even(coalesce(sum({MARKS}), 0), 6) AS marks FROM responses GROUP BY ALL)""", *R),
    "worth_attempting": with_views(f"""WITH d AS (SELECT * FROM responses WHERE attempt_status <> 'in_progress' AND {GRADED}), s AS (SELECT user_id, subject, count(*) AS n1, count(*) FILTER ({RIGHT}) AS k1 FROM d WHERE subject IS NOT NULL GROUP BY ALL),
      u AS (SELECT user_id, count(*) AS n2, count(*) FILTER ({RIGHT}) AS k2 FROM d GROUP BY ALL), o AS (SELECT attempt_id, count(*) AS n3, count(*) FILTER ({RIGHT}) AS k3 FROM responses WHERE {GRADED} GROUP BY ALL),
      g AS (SELECT r.attempt_id, marks_if_correct AS m, penalty_if_wrong AS p, CASE WHEN n1 >= 5 THEN CAST(k1 AS DOUBLE) / n1 WHEN n2 >= 5 THEN CAST(k2 AS DOUBLE) / n2 WHEN n3 > 0 THEN CAST(k3 AS DOUBLE) / n3 END AS c FROM responses r LEFT JOIN s ON r.user_id = s.user_id AND r.subject = s.subject LEFT JOIN u ON r.user_id = u.user_id LEFT JOIN o ON r.attempt_id = o.attempt_id WHERE selected_answer IS NULL),
      e AS (SELECT attempt_id, round_even(c * m - (1 - c) * p, 9) AS gain, p / (m + p) AS even FROM g) SELECT attempt_id, count(*) FILTER (gain > 0) AS worth, round_even(coalesce(sum(gain) FILTER (gain > 0), 0), 6) AS expected_gain, CAST(round_even(100 * max(even), 0) AS INT) AS break_even FROM e GROUP BY attempt_id""", *R),
    "paper_schemes": with_views("SELECT paper_id, m AS marks, round(m * coalesce(negative_fraction, 1.0e0 / 3.0e0), 6) AS penalty FROM (SELECT *, coalesce(nullif(marks_per_question, 0), 2.0e0) AS m FROM papers)", "papers"),
    "learner_overview": with_views(f"""WITH {TOTALS}, {TESTS} SELECT a.user_id, answered, "right", {percent('"right"', 'answered')} AS accuracy, mean_seconds, coalesce(tests, 0) AS tests, mean_score FROM (SELECT user_id, count(*) AS answered, count(*) FILTER ({RIGHT}) AS "right", CAST(round_even(avg(seconds) FILTER (seconds > 0), 0) AS INT) AS mean_seconds FROM responses WHERE {GRADED} GROUP BY user_id) a
      LEFT JOIN (SELECT user_id, count(*) AS tests, CAST(round_even(avg(percent), 0) AS INT) AS mean_score FROM tests GROUP BY user_id) t ON a.user_id = t.user_id""", *R),
    "accuracy_by_subject": with_views(accuracy_by("subject"), *R),
    "accuracy_by_topic": with_views(accuracy_by("topic"), *R),
    "weak_areas": with_views(f"""WITH w AS (SELECT user_id, 'topic' AS kind, topic AS name, accuracy, answered FROM ({accuracy_by('topic')}) WHERE weak UNION ALL SELECT user_id, 'subject', subject, accuracy, answered FROM ({accuracy_by('subject', '(SELECT * FROM responses WHERE subject IS NOT NULL)')}) WHERE weak),
      h AS (SELECT *, bool_or(kind = 'topic') OVER (PARTITION BY user_id) AS ht FROM w), p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY accuracy, answered DESC, name) AS place FROM h WHERE kind = 'topic' OR NOT ht) SELECT user_id, kind, name, accuracy, CAST(place AS INT) AS place FROM p WHERE place <= 3""", *R),
    "score_trend": with_views(f"WITH {TOTALS}, {TESTS} SELECT user_id, attempt_id, percent, CAST(row_number() OVER (PARTITION BY user_id ORDER BY back DESC) AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY completed_at DESC, attempt_id DESC) AS back FROM tests) WHERE back <= 30", *R),
    "test_leaderboard": with_views(f"WITH {TOTALS}, {TESTS}, {FIRST} " + board("rank_key", "SELECT rank_key, user_id, percent AS value, time_taken AS seconds FROM firsts"), "users", *R),
    "weekly_leaderboard": with_views(f"WITH {TOTALS}, {TESTS}, {FIRST} " + board("week", "SELECT CAST(date_trunc('week', completed_at) AS DATE) AS week, user_id, round_even(avg(percent), 6) AS value, round_even(avg(time_taken), 6) AS seconds FROM firsts WHERE kind = 'full_test' GROUP BY ALL"), "users", *R),
    "answers_per_day": with_views(f"WITH {DAILY} SELECT * FROM daily", *R),
    "streaks": with_views(f"""WITH {DAILY}, r AS (SELECT user_id, count(*) AS len, max(day) AS last FROM (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS island FROM daily WHERE day <= {TODAY} AND day > {TODAY} - 400) GROUP BY user_id, island)
      SELECT user_id, coalesce(max(len) FILTER (last >= {TODAY} - 1), 0) AS current_streak, max(len) AS best_streak FROM r GROUP BY user_id""", *R),
    "screen_time": "SELECT user_id AS attempt_id, event_id % 20 AS question_id, CAST(sum(CASE WHEN nx IS NULL THEN 0 ELSE least(CAST(floor((epoch_us(nx) - epoch_us(ts)) / 1000000.0) AS BIGINT), 300) END) AS BIGINT) AS seconds FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events) GROUP BY ALL",
    "burst_failures": "SELECT user_id AS key, event_id, recent, sec + 900 AS locked_until FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS recent FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events WHERE event_type = 'error')) WHERE recent >= 2",
    "suspicious_answers": with_views(f"WITH {SUSPICION} SELECT question_id, key_answer, b.l AS popular_answer, b.hn AS popular_n, key_n, high_n, all_n FROM ve WHERE b.l <> key_answer AND 2 * b.hn > high_n AND b.hn - key_n >= 2 AND high_n >= 5", "users", *R),
    "revision_schedule": with_views(f"WITH {FOLD} SELECT * FROM items", *R).replace("WITH ", "WITH RECURSIVE ", 1),
    "mistake_notebook": with_views(f"""WITH {REASONS}, {FOLD}, n AS (SELECT user_id, question_id, count(*) FILTER (NOT is_correct) AS wrong_n, count(*) FILTER (is_correct AND confidence IN ('guessed', 'no_idea')) AS guessed_n, max(struct_pack(a := attempt_id, p := position, r := reason)) FILTER (NOT is_correct) AS m, CAST(max(started_at) AS DATE) AS last_day
      FROM responses LEFT JOIN reasons USING (attempt_id, question_id) WHERE {GRADED} GROUP BY ALL)
      SELECT n.user_id, n.question_id, wrong_n, guessed_n, m.r AS last_reason, last_day, CASE WHEN status = 'done' THEN 'mastered' WHEN status = 'active' AND due <= {TODAY} THEN 'due' WHEN status = 'active' THEN 'scheduled' ELSE 'guessed' END AS state, CASE WHEN status = 'active' THEN CAST(due - {TODAY} AS INT) END AS days_until
      FROM n LEFT JOIN items i ON n.user_id = i.user_id AND n.question_id = i.question_id WHERE wrong_n > 0 OR guessed_n > 0""", *R).replace("WITH ", "WITH RECURSIVE ", 1),
    "revision_due": with_views(f"WITH {FOLD}, {LIVE} SELECT user_id, count(*) AS n FROM items WHERE status = 'active' AND due <= {TODAY} AND question_id IN (SELECT question_id FROM live) GROUP BY user_id", "papers", *R).replace("WITH ", "WITH RECURSIVE ", 1),
}

_W = "[^a-z0-9\\x{0900}-\\x{0963}\\x{0970}-\\x{097F}]+"
STEMS = f"""stems AS (SELECT question_id, substr(sha1(regexp_replace(lower(coalesce(text, '')), '{_W}', '', 'g') || '|' || array_to_string(list_sort(list_transform(o, lambda x: regexp_replace(lower(x), '{_W}', '', 'g'))), '|')), 1, 16) AS norm_hash
  FROM (SELECT doc_id AS question_id, text, CASE WHEN length(coalesce(source, '')) % 2 = 1 THEN ['Red', 'Green', 'Blue', 'Neither 1 nor 2'] ELSE ['1 only', '2 only', 'Both 1 and 2', 'Neither 1 nor 2'] END AS o FROM documents))"""
NAMED = f"""named AS (SELECT question_id, status, regexp_replace(lower(text), '{_W}', '', 'g') AS norm_hash, CASE correct_answer WHEN 'A' THEN 'alpha' WHEN 'B' THEN 'beta' WHEN 'C' THEN 'gamma' WHEN 'D' THEN 'delta' END AS answer_words FROM questions)"""
EXACT = "ex AS (SELECT a.question_id AS newer, min(b.question_id) AS older FROM named a JOIN named b ON a.norm_hash = b.norm_hash AND b.question_id < a.question_id GROUP BY a.question_id)"
STORED = f"{NAMED}, {EXACT}, sp AS (SELECT newer, older, 'exact' AS kind, CAST(90 + newer % 11 AS INT) AS score, CASE newer % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'kept_both' ELSE 'merged' END AS status FROM ex)"
MERGED = f"{STORED}, done AS (SELECT newer, older, older AS keep, newer AS dropped FROM sp WHERE status = 'open' AND newer % 5 = 0)"
EDITS = """ed AS (SELECT CAST(1 + (event_id // 3) % 1000 AS BIGINT) AS question_id, CASE event_type WHEN 'click' THEN 'pages 1-3 read again' WHEN 'view' THEN 'bulk subject change' WHEN 'purchase' THEN 'text' END AS reason FROM events WHERE event_id % 3 = 0),
un AS (SELECT * FROM questions WHERE status IN ('verified', 'live') AND question_id NOT IN (SELECT question_id FROM ed WHERE NOT (coalesce(reason, '') LIKE 'pages % read again') AND coalesce(reason, '') NOT IN ('subject/topic/difficulty', 'bulk subject change', 'subject suggestion accepted')))"""
_hits = {"Size": [("small", 1), ("large", 1), ("tiny", 1), ("small ring", 2)], "Colour": [("red", 1), ("blue", 1), ("green", 1), ("red widget", 2)], "Thing": [("ring", 1), ("bolt", 1), ("widget", 1), ("gear", 1)]}
_score = {k: " + ".join(f"CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9]){w}($|[^a-z0-9])') THEN {n} ELSE 0 END" for w, n in v) for k, v in _hits.items()}
HINTS = f"""hints AS (SELECT question_id, CASE WHEN b[1].score >= 2 AND b[1].score > b[2].score THEN b[1].subject END AS subject, CASE WHEN b[1].score >= 2 AND b[1].score > b[2].score THEN b[1].score END AS score FROM (SELECT question_id, list_reverse_sort([{', '.join(f"struct_pack(score := {v}, subject := '{k}')" for k, v in _score.items())}]) AS b FROM questions))"""
SAMPLE = f"{EDITS}, sample AS (SELECT paper_id, question_id, CAST(place AS INT) AS place, correct_answer IS DISTINCT FROM true_letter AS wrong FROM (SELECT *, count(*) OVER (PARTITION BY paper_id) AS n, row_number() OVER (PARTITION BY paper_id ORDER BY sha1('1:' || question_id), question_id) AS place FROM un) WHERE place <= greatest(5, ceil(0.1 * n)))"
OPEN = "status IN ('draft', 'needs_review')"
REPORTS = "rep AS (SELECT event_id AS report_id, user_id, 1 + event_id % 150 AS question_id, event_type AS kind, substr('ABCD', CAST(1 + event_id % 4 AS INT), 1) AS answer_at_report, CASE event_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'resolved' ELSE 'dismissed' END AS status, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events)"
PRINTED = "pr AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY question_id) AS nth FROM (SELECT * REPLACE (CAST(floor((paper_id - 1) / 4.0) AS INT) + 1 AS paper_id) FROM questions))"
_SUBJECTS = "('economy', 'small', 'medium', 'promo', 'standard')"


def bulk(good: str) -> str:
    good = f"{OPEN} AND correct_answer IS NOT NULL{good}"
    return f"SELECT question_id, CASE WHEN {good} THEN 'verified' ELSE status END AS status, CASE WHEN {good} THEN acknowledged OR flagged ELSE acknowledged END AS acknowledged FROM questions"


def key_applied(kept: str) -> str:
    return f"""WITH key AS (SELECT paper_id, question_number, CASE WHEN question_id % 31 = 0 THEN 'E' ELSE true_letter END AS want, CASE WHEN question_id % 3 = 0 THEN 'told' END AS told FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, question_number ORDER BY question_id) AS b FROM questions WHERE question_id % 7 <> 0) WHERE b = 1),
      k AS (SELECT q.*, correct_answer AS have, want, told FROM questions q LEFT JOIN key USING (paper_id, question_number) WHERE status <> 'quarantined'),
      a AS (SELECT *, CASE WHEN want IS NULL THEN 'none' WHEN want = 'E' THEN 'ignored' WHEN have = want THEN 'unchanged' WHEN have IS NULL THEN 'filled' ELSE '{kept}' END AS action FROM k), c AS (SELECT *, action IN ('filled', 'replaced') AS changed FROM a)
      SELECT question_id, CASE WHEN changed THEN want ELSE have END AS correct_answer, CASE WHEN changed AND status IN ('verified', 'live') THEN 'needs_review' ELSE status END AS status, acknowledged AND NOT (changed AND status IN ('verified', 'live')) AS acknowledged,
      CASE WHEN question_id % 4 <> 0 THEN '' WHEN changed THEN 'check_table' ELSE 'no_answer_found,check_table' END AS flags, CASE WHEN question_id % 5 = 0 THEN 'own' ELSE told END AS explanation, action FROM c"""


def issues(source: str, columns: str, rules: list[tuple[str, str, str]]) -> str:
    """One branch for each rule that is broken."""
    return " UNION ALL ".join(f"SELECT {columns}, '{level}' AS level, '{code}' AS code FROM {source} WHERE {cond}" for cond, level, code in rules)


ORACLES |= {
    "question_hashes": f"WITH {STEMS} SELECT * FROM stems",
    "exact_duplicates": f"WITH {STEMS} SELECT a.question_id AS newer, min(b.question_id) AS older FROM stems a JOIN stems b ON a.norm_hash = b.norm_hash AND b.question_id < a.question_id GROUP BY a.question_id",
    "exact_duplicate_links": f"WITH {STEMS} SELECT a.question_id, least(a.question_id, min(b.question_id)) AS oldest, count(*) AS n_links FROM stems a JOIN stems b ON a.norm_hash = b.norm_hash AND b.question_id <> a.question_id GROUP BY a.question_id",
    "answer_conflicts": with_views(f"WITH {NAMED} SELECT a.question_id, count(*) AS n_conflicts FROM named a JOIN named b ON a.norm_hash = b.norm_hash AND a.question_id <> b.question_id WHERE a.status <> 'quarantined' AND b.status <> 'quarantined' AND a.answer_words <> b.answer_words GROUP BY a.question_id", "questions"),
    "stored_conflicts": with_views(f"WITH {STORED}, b AS (SELECT newer AS q, older AS o FROM sp WHERE status <> 'merged' UNION SELECT older, newer FROM sp WHERE status <> 'merged') SELECT q AS question_id, o AS other_id FROM b JOIN named x ON q = x.question_id JOIN named y ON o = y.question_id WHERE x.status <> 'quarantined' AND y.status <> 'quarantined' AND x.answer_words <> y.answer_words", "questions"),
    "conflict_flags": with_views(f"""WITH {NAMED}, c AS (SELECT DISTINCT a.question_id FROM named a JOIN named b ON a.norm_hash = b.norm_hash AND a.question_id <> b.question_id WHERE a.status <> 'quarantined' AND b.status <> 'quarantined' AND a.answer_words <> b.answer_words), x AS (SELECT question_id AS q, question_id IN (SELECT question_id FROM c) AS c FROM named)
      SELECT q AS question_id, concat_ws(',', CASE WHEN q % 10 = 3 AND c THEN 'source_conflict' END, CASE WHEN q % 10 IN (3, 4) THEN 'other' END, CASE WHEN q % 10 <> 3 AND c THEN 'source_conflict' END) AS flags, q % 2 = 0 AND NOT (c AND q % 10 <> 3) AS flags_acknowledged, CASE WHEN c AND q % 10 <> 3 THEN 'set' WHEN NOT c AND q % 10 = 3 THEN 'cleared' END AS change FROM x""", "questions"),
    "duplicate_pair_counts": with_views(f"WITH {NAMED} SELECT a.question_id, count(*) AS n FROM named a JOIN named b ON a.norm_hash = b.norm_hash AND a.question_id <> b.question_id GROUP BY a.question_id", "questions"),
    "duplicate_reconcile": with_views(f"""WITH {NAMED}, {EXACT}, st AS (SELECT n2 AS newer, older, 95 AS score, min(st) AS status FROM (SELECT newer + CASE WHEN newer % 6 = 1 THEN 1 ELSE 0 END AS n2, older, CASE WHEN newer % 2 = 0 THEN 'open' ELSE 'kept_both' END AS st FROM ex WHERE newer % 3 > 0) GROUP BY ALL)
      SELECT coalesce(p.newer, st.newer) AS newer, coalesce(p.older, st.older) AS older, CASE WHEN st.status IS NULL OR st.status = 'open' THEN CASE WHEN p.newer IS NOT NULL THEN 100 ELSE st.score END ELSE st.score END AS score, coalesce(st.status, 'open') AS status,
      CASE WHEN st.status IS NULL THEN 'insert' WHEN st.status = 'open' AND p.newer IS NULL THEN 'delete' WHEN st.status = 'open' THEN 'update' ELSE 'leave' END AS action FROM ex p FULL JOIN st ON p.newer = st.newer AND p.older = st.older""", "questions"),
    "duplicate_neighbours": with_views(f"""WITH {NAMED}, ch AS (SELECT question_id FROM named WHERE question_id % 400 = 1 OR question_id % 90 = 9), src AS (SELECT question_id AS a, question_id + 4 AS b FROM named WHERE question_id % 90 = 5)
      SELECT question_id FROM ch UNION SELECT b.question_id FROM named a JOIN named b ON a.norm_hash = b.norm_hash WHERE a.question_id IN (SELECT question_id FROM ch) UNION SELECT a FROM src WHERE b IN (SELECT question_id FROM ch) UNION SELECT b FROM src WHERE a IN (SELECT question_id FROM ch)""", "questions"),
    "duplicate_page": with_views(f"WITH {STORED} SELECT * FROM sp WHERE status = 'open' ORDER BY kind, score DESC, newer, older LIMIT 40 OFFSET 40", "questions"),
    "duplicate_merges": with_views(f"WITH {MERGED} SELECT sp.newer, sp.older, kind, score, CASE WHEN keep IS NOT NULL THEN 'merged' ELSE status END AS status, keep AS merged_into FROM sp LEFT JOIN done ON sp.newer = done.newer AND sp.older = done.older WHERE keep IS NOT NULL OR status <> 'open' OR NOT (sp.newer IN (SELECT dropped FROM done) OR sp.older IN (SELECT dropped FROM done))", "questions"),
    "merged_questions": with_views(f"WITH {MERGED} SELECT question_id, CASE WHEN question_id IN (SELECT dropped FROM done) THEN 'quarantined' ELSE status END AS status FROM questions", "questions"),
    "also_appeared": with_views(f"WITH {NAMED}, {EXACT} SELECT older AS question_id, newer AS from_question_id, concat_ws(' \u00b7 ', title, CAST(year AS VARCHAR), 'Q' || question_number) AS label FROM ex JOIN questions q ON ex.newer = q.question_id JOIN papers p ON q.paper_id = p.paper_id", "papers", "questions"),
    "subject_hints": with_views(f"WITH {HINTS} SELECT * FROM hints", "questions"),
    "answer_key_roundtrip": with_views("SELECT paper_id AS key_id, question_number AS number, arg_min(correct_answer, question_id) AS letter, count(DISTINCT correct_answer) AS letters FROM questions WHERE correct_answer IS NOT NULL AND question_number BETWEEN 1 AND 999 GROUP BY ALL", "questions"),
    "key_compare": with_views("""WITH f AS (SELECT paper_id, question_number, arg_min(status, question_id) AS status, arg_min_null(correct_answer, question_id) AS correct_answer, arg_min(true_letter, question_id) AS letter, min(question_id) AS id FROM questions GROUP BY ALL), k AS (SELECT paper_id, question_number + CASE WHEN id % 11 = 0 THEN 1000 ELSE 0 END AS question_number, letter FROM f WHERE id % 7 <> 0), q AS (SELECT * FROM f WHERE status <> 'quarantined')
      SELECT coalesce(q.paper_id, k.paper_id) AS paper_id, coalesce(q.question_number, k.question_number) AS question_number, q.correct_answer AS have, k.letter AS want, CASE WHEN q.id IS NULL THEN 'extra' WHEN k.letter IS NULL THEN 'missing' WHEN q.correct_answer IS NULL THEN 'new' WHEN q.correct_answer = k.letter THEN 'same' ELSE 'different' END AS verdict
      FROM q FULL JOIN k ON q.paper_id = k.paper_id AND q.question_number = k.question_number""", "questions"),
    "review_counters": with_views(f"""SELECT paper_id, count(*) FILTER (act) AS total, count(*) FILTER (act AND {OPEN}) AS to_confirm, count(*) FILTER (act AND NOT {OPEN}) AS confirmed, count(*) FILTER (status = 'live') AS live, count(*) FILTER (act AND flagged) AS flagged, count(*) FILTER (act AND {OPEN} AND NOT flagged) AS clean,
      count(*) FILTER (act AND {OPEN} AND correct_answer IS NOT NULL AND NOT flagged AND answer_source <> 'ai') AS bulk_confirmable, count(*) FILTER (act AND correct_answer IS NOT NULL AND answer_source = 'ai') AS ai_answers, count(*) FILTER (act AND subject IS NULL) AS no_subject, count(*) FILTER (act AND subject IS NULL AND question_id % 2 = 0) AS suggested,
      count(*) FILTER (act AND question_id % 6 = 0 AND question_id % 12 <> 0) AS bilingual, count(*) FILTER (act AND question_id % 12 = 0) AS hindi_only, count(*) FILTER (NOT act) AS quarantined FROM (SELECT *, status <> 'quarantined' AS act FROM questions) GROUP BY paper_id""", "questions"),
    "bulk_confirmed": with_views(bulk(" AND NOT flagged AND answer_source <> 'ai'"), "questions"),
    "bulk_acknowledged": with_views(bulk(""), "questions"),
    "unedited_confirmed": with_views(f"WITH {EDITS} SELECT paper_id, question_id FROM un", "questions"),
    "publish_blockers": with_views(f"""WITH {EDITS}, c AS (SELECT paper_id, count(*) AS n, count(*) FILTER ({OPEN}) AS o, count(*) FILTER (correct_answer IS NULL OR correct_answer NOT IN ('A','B','C','D','E')) AS u, count(*) FILTER (status IN ('verified', 'live') AND flagged AND NOT acknowledged) AS f FROM questions WHERE status <> 'quarantined' GROUP BY paper_id), w AS (SELECT paper_id, count(*) AS pool FROM un GROUP BY paper_id)
      SELECT paper_id, concat_ws(',', CASE WHEN status <> 'ready' THEN 'not_ready' END, CASE WHEN archived THEN 'archived' END, CASE WHEN coalesce(n, 0) = 0 THEN 'empty' END, CASE WHEN o > 0 THEN 'to_confirm' END, CASE WHEN u > 0 THEN 'no_answer' END, CASE WHEN f > 0 THEN 'flagged' END, CASE WHEN audit_state IN ('pending', 'failed') OR (audit_state = 'none' AND coalesce(pool, 0) >= 5) THEN 'audit' END) AS blockers FROM papers LEFT JOIN c USING (paper_id) LEFT JOIN w USING (paper_id)""", "papers"),
    "published_questions": with_views("SELECT question_id, CASE WHEN paper_id % 2 = 0 AND status = 'verified' AND NOT (has_image AND NOT has_snapshot) THEN 'live' ELSE status END AS status FROM questions", "questions"),
    "template_fits": with_views("SELECT p.paper_id, t.paper_id AS template_id FROM papers p JOIN (SELECT paper_id, CASE WHEN paper_id % 3 > 0 THEN series END AS s FROM papers WHERE paper_id <= 6) t ON t.s IS NULL OR p.series IS NULL OR t.s = p.series", "papers"),
    "suggestion_updates": with_views(f"WITH {HINTS}, x AS (SELECT q.question_id, q.subject AS own, status, CASE WHEN q.question_id % 3 = 0 THEN 'Size' END AS old, h.subject AS hint FROM questions q JOIN hints h ON q.question_id = h.question_id), y AS (SELECT *, CASE WHEN own IS NOT NULL THEN NULL WHEN status = 'quarantined' OR old IS NOT NULL THEN old ELSE hint END AS suggested FROM x) SELECT question_id, suggested, suggested IS NOT NULL AND suggested IS DISTINCT FROM old AS changed FROM y", "questions"),
    "numbers_beyond": with_views("SELECT DISTINCT paper_id, question_number FROM questions JOIN papers USING (paper_id) WHERE question_number > expected_total", "papers", "questions"),
    "missing_numbers": with_views("SELECT paper_id, CAST(unnest(range(1, expected_total + 1)) AS INT) AS question_number FROM papers EXCEPT SELECT paper_id, question_number FROM questions", "papers", "questions"),
    "audit_sample": with_views(f"WITH {SAMPLE} SELECT paper_id, question_id, place FROM sample", "questions"),
    "audit_outcome": with_views(f"WITH {SAMPLE} SELECT paper_id, checked, wrong, wrong < 3 AS passed FROM (SELECT paper_id, count(*) AS checked, count(*) FILTER (wrong) AS wrong FROM sample GROUP BY ALL)", "questions"),
    "audit_finish": with_views(f"""WITH {SAMPLE}, ck AS (SELECT paper_id, question_id, wrong OR paper_id % 3 = 0 AS wrong FROM sample), back AS (SELECT question_id FROM ck WHERE wrong UNION SELECT question_id FROM un WHERE paper_id IN (SELECT paper_id FROM ck WHERE wrong GROUP BY paper_id HAVING count(*) >= 3)), g AS (SELECT *, question_id IN (SELECT question_id FROM back) AND status IN ('verified', 'live') AS goes FROM questions)
      SELECT question_id, CASE WHEN goes THEN 'needs_review' ELSE status END AS status, acknowledged AND NOT goes AS acknowledged FROM g""", "questions"),
    "key_applied": with_views(key_applied("kept"), "questions"),
    "key_replaced": with_views(key_applied("replaced"), "questions"),
    "printed_answers": with_views("""WITH x AS (SELECT question_id, question_id % 5 > 0 AS has_key, CASE WHEN question_id % 3 > 0 THEN true_letter END AS p, CASE WHEN question_id % 5 > 0 AND question_id % 4 > 0 THEN correct_answer END AS k FROM questions)
      SELECT question_id, coalesce(k, p) AS answer, CASE WHEN k IS NOT NULL THEN 'key_pdf' WHEN p IS NOT NULL THEN 'inline' END AS answer_source, CASE WHEN k IS NOT NULL THEN CASE WHEN p <> k THEN 'answer_conflict' ELSE '' END WHEN has_key THEN 'answer_unclear,no_answer_in_key' ELSE 'answer_unclear' END AS flags FROM x""", "questions"),
    "status_transitions": with_views("SELECT question_id, CASE WHEN question_id % 3 <> 0 THEN status WHEN question_id % 4 = 0 THEN 'quarantined' WHEN question_id % 4 = 1 AND status = 'quarantined' THEN 'needs_review' WHEN question_id % 8 = 2 AND status = 'live' THEN 'needs_review' WHEN question_id % 8 = 6 AND status IN ('verified', 'live') THEN 'needs_review' WHEN question_id % 4 = 3 AND status = 'needs_review' AND correct_answer IS NOT NULL THEN 'live' ELSE status END AS status FROM questions", "questions"),
    "answer_summary": with_views(f"""WITH x AS (SELECT paper_id, count(*) AS total, count(correct_answer) AS with_answer, count(*) - count(correct_answer) AS without_answer, {', '.join(f"count(*) FILTER (correct_answer IS NOT NULL AND {c}) AS {k}_answers" for k, c in (("ai", "answer_source = 'ai'"), ("key", "answer_source = 'key'"), ("other", "answer_source NOT IN ('ai', 'key')")))},
      {', '.join(f"count(*) FILTER (correct_answer = '{c}') AS {c.lower()}" for c in "ABCDE")}, count(*) FILTER (question_id % 6 = 0 AND true_letter <> correct_answer) AS mismatches FROM questions WHERE status <> 'quarantined' GROUP BY paper_id)
      SELECT x.*, with_answer >= 10 AND 2 * greatest(a, b, c, d, e) > with_answer AS lopsided, expected_total <> total AS count_off FROM x JOIN papers USING (paper_id)""", "papers", "questions"),
    "key_distribution": with_views(f"WITH f AS (SELECT paper_id, question_number, arg_min(correct_answer, question_id) AS letter FROM questions WHERE correct_answer IS NOT NULL GROUP BY ALL), x AS (SELECT paper_id AS key_id, count(*) AS found, {', '.join(f"count(*) FILTER (letter = '{c}') AS {c.lower()}" for c in 'ABCDE')} FROM f GROUP BY ALL) SELECT *, found >= 10 AND 2 * greatest(a, b, c, d, e) > found AS lopsided FROM x", "questions"),
    "test_catalogue": with_views(f"""WITH {LIVE}, n AS (SELECT paper_id, count(*) AS n, substr(sha1(string_agg(CAST(question_id AS VARCHAR), ',' ORDER BY question_id)), 1, 8) AS fingerprint FROM live WHERE source_type <> 'book' GROUP BY paper_id), t AS (SELECT CAST(substr(rank_key, 7) AS INT) AS paper_id, count(*) AS taken, max(attempt_id) FILTER (status = 'in_progress') AS running FROM attempts WHERE kind = 'full_test' GROUP BY ALL)
      SELECT paper_id, n, CAST(coalesce(nullif(duration_minutes, 0), greatest(1, ceil(n * 72 / 60.0))) AS INT) AS minutes, fingerprint, coalesce(taken, 0) AS taken, running FROM n JOIN papers USING (paper_id) LEFT JOIN t USING (paper_id)""", "papers", *R),
    "section_catalogue": with_views(f"WITH {LIVE} SELECT paper_id, subject, n, n * 72 AS seconds, concat_ws(':', 'paper', CAST(paper_id AS VARCHAR), 'subject', subject, f) AS rank_key FROM (SELECT paper_id, subject, count(*) AS n, substr(sha1(string_agg(CAST(question_id AS VARCHAR), ',' ORDER BY question_id)), 1, 8) AS f FROM live WHERE source_type <> 'book' AND subject IS NOT NULL GROUP BY ALL)", "papers", "questions"),
    "restored_versions": "WITH v AS (SELECT user_id AS entity, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS version_no, event_type FROM events) SELECT *, FALSE AS restored FROM v UNION ALL SELECT entity, m + 1, event_type, TRUE FROM v JOIN (SELECT entity, max(version_no) AS m FROM v GROUP BY ALL) USING (entity) WHERE version_no = 2 AND entity % 3 = 0",
    "version_history": "SELECT entity, seq, CAST(v AS INT) AS version_no, CASE WHEN v = 1 THEN '' ELSE concat_ws(',', CASE WHEN event_type IS DISTINCT FROM pe THEN 'event_type' END, CASE WHEN level IS DISTINCT FROM pl THEN 'level' END) END AS changed FROM (SELECT *, row_number() OVER w AS v, lag(event_type) OVER w AS pe, lag(level) OVER w AS pl FROM (SELECT user_id AS entity, ts AS at_, event_id AS seq, event_type, floor(value) % 3 AS level FROM events) WINDOW w AS (PARTITION BY entity ORDER BY at_, seq))",
    "versions_as_of": "SELECT user_id AS entity, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00') WHERE b = 1",
    "report_queue": with_views(f"WITH {REPORTS} SELECT r.question_id, count(*) FILTER (r.status = 'open') AS n_open, count(*) FILTER (r.status = 'resolved') AS n_resolved, count(*) FILTER (r.status = 'dismissed') AS n_dismissed, string_agg(DISTINCT kind, ',' ORDER BY kind) FILTER (r.status = 'open') AS kinds, bool_or(answer_at_report IS DISTINCT FROM correct_answer) FILTER (r.status = 'open') AS key_changed FROM rep r JOIN questions q ON r.question_id = q.question_id GROUP BY r.question_id HAVING count(*) FILTER (r.status = 'open') > 0", "questions"),
    "report_verdicts": f"""WITH {REPORTS}, st AS (SELECT * FROM rep WHERE report_id % 5 <> 2), x AS (SELECT a.report_id AS request_id, count(s.report_id) AS recent, bool_or(s.question_id = a.question_id AND s.status = 'open' AND s.sec <= a.sec) AS recent_open, a.user_id, a.question_id, a.sec FROM rep a LEFT JOIN st s ON a.user_id = s.user_id AND s.sec BETWEEN a.sec - 864000 AND a.sec WHERE a.report_id % 5 = 2 GROUP BY ALL)
      SELECT request_id, recent, CASE WHEN EXISTS (SELECT 1 FROM st WHERE st.user_id = x.user_id AND st.question_id = x.question_id AND st.status = 'open' AND st.sec <= x.sec) THEN 'open' WHEN recent >= 3 THEN 'limit' ELSE 'taken' END AS verdict FROM x""",
    "subject_by_range": with_views("SELECT question_id, CASE WHEN question_number BETWEEN 25 AND 60 THEN 'Geography' ELSE 'History' END AS subject FROM questions WHERE question_number BETWEEN 1 AND 60", "questions"),
    "line_repeats": f"""WITH l AS (SELECT source AS paper_id, doc_id AS page, trim(regexp_replace(lower(unnest(string_split(text, chr(10)))), '{_W}', ' ', 'g')) AS line FROM documents), p AS (SELECT paper_id, count(DISTINCT page) AS pages FROM l WHERE line <> '' GROUP BY ALL), f AS (SELECT paper_id, line, count(DISTINCT page) AS n FROM l WHERE line <> '' GROUP BY ALL) SELECT paper_id, line, n FROM f JOIN p USING (paper_id) WHERE n >= greatest(3.0, 0.02 * pages)""",
    "import_replace": with_views("SELECT question_id AS number, CASE question_id % 3 WHEN 0 THEN text WHEN 2 THEN text || '!' ELSE CASE WHEN status IN ('needs_review', 'draft') THEN text || '!' ELSE text END END AS text, CASE WHEN question_id % 3 = 2 OR (question_id % 3 = 1 AND status = 'draft') THEN 'needs_review' ELSE status END AS status, CASE question_id % 3 WHEN 0 THEN 'kept' WHEN 2 THEN 'created' ELSE CASE WHEN status IN ('needs_review', 'draft') THEN 'replaced' ELSE 'skipped' END END AS action FROM questions", "questions"),
    "suspicion_cards": with_views(f"WITH {SUSPICION} SELECT question_id, l.letter, coalesce(n, 0) AS n, CAST(round_even(100.0e0 * coalesce(n, 0) / total, 0) AS INT) AS percent FROM (SELECT question_id, count(*) AS total FROM hi GROUP BY ALL) t CROSS JOIN (SELECT unnest(['A','B','C','D','E']) AS letter) l LEFT JOIN (SELECT question_id, letter, count(*) AS n FROM hi GROUP BY ALL) c USING (question_id, letter)", "users", *R),
    "suspicion_queue": with_views(f"""WITH {SUSPICION}, v AS (SELECT question_id, key_answer, b.l <> key_answer AND 2 * b.hn > high_n AND b.hn - key_n >= 2 AND high_n >= 5 AS bad FROM ve), q AS (SELECT question_id, CASE question_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'dismissed' ELSE 'sent_back' END AS status, true_letter AS handled_key FROM questions WHERE question_id % 25 = 7),
      j AS (SELECT coalesce(q.question_id, v.question_id) AS question_id, status, bad IS NOT NULL AS judged, coalesce(bad, FALSE) AS bad, coalesce(status IN ('dismissed', 'sent_back') AND handled_key = key_answer, FALSE) AS handled FROM q FULL JOIN v ON q.question_id = v.question_id),
      a AS (SELECT question_id, CASE WHEN bad AND handled THEN 'dismissed' WHEN bad THEN 'open' ELSE status END AS status, CASE WHEN bad AND status IS NULL THEN 'new' WHEN bad AND handled THEN 'kept' WHEN bad AND status <> 'open' THEN 'reopened' WHEN bad THEN 'kept' WHEN judged AND status <> 'sent_back' THEN 'cleared' WHEN NOT judged AND status = 'open' THEN 'cleared' WHEN status IS NOT NULL THEN 'kept' END AS action FROM j) SELECT * FROM a WHERE action IS NOT NULL""", "users", *R),
    "target_progress": with_views(f"WITH {DAILY} SELECT user_id, n, CAST(least(100, round_even(100.0e0 * n / 5, 0)) AS INT) AS percent, greatest(0, 5 - n) AS remaining, n >= 5 AS met FROM daily WHERE day = {TODAY}", *R),
    "shown_board": with_views(f"WITH {TOTALS}, {TESTS}, {FIRST} SELECT rank_key, rank_pos, value, CASE WHEN user_id = 42 OR show_on_leaderboard THEN display_name ELSE 'Anonymous' END AS name, user_id = 42 AS is_viewer FROM (" + board("rank_key", "SELECT rank_key, user_id, percent AS value, time_taken AS seconds FROM firsts") + ") JOIN users USING (user_id) WHERE rank_pos <= 10 OR user_id = 42", "users", *R),
    "stream_daily_answers": "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY ALL",
    "stream_failure_windows": "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL HAVING count(*) >= 2",
    "last_writes": "SELECT attempt_id, question_id, nullif(arg_max(value, struct_pack(a := ts, b := seq)) FILTER (field = 'answer'), '') AS answer, nullif(arg_max(value, struct_pack(a := ts, b := seq)) FILTER (field = 'confidence'), '') AS confidence, nullif(arg_max(value, struct_pack(a := ts, b := seq)) FILTER (field = 'marked'), '') AS marked FROM (SELECT user_id AS attempt_id, event_id % 20 AS question_id, CASE event_type WHEN 'click' THEN 'answer' WHEN 'view' THEN 'confidence' ELSE 'marked' END AS field, CASE WHEN floor(value) % 5 = 0 THEN '' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS value, ts, event_id AS seq FROM events) GROUP BY ALL",
    "expired_attempts": with_views(f"SELECT attempt_id, CASE WHEN status = 'in_progress' AND TIMESTAMP '2000-06-15 00:00:00' > completed_at + INTERVAL '3' SECOND THEN 'expired' ELSE status END AS status, completed_at AS ended_at FROM attempts", "attempts"),
}
ORACLES["performance_list"] = with_views(
    f"""WITH {TOTALS}, {TESTS}, w AS (SELECT user_id, 'topic' AS kind, topic AS name, accuracy, answered FROM ({accuracy_by('topic')}) WHERE weak UNION ALL SELECT user_id, 'subject', subject, accuracy, answered FROM ({accuracy_by('subject', '(SELECT * FROM responses WHERE subject IS NOT NULL)')}) WHERE weak),
      h AS (SELECT *, bool_or(kind = 'topic') OVER (PARTITION BY user_id) AS ht FROM w), p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY accuracy, answered DESC, name) AS place FROM h WHERE kind = 'topic' OR NOT ht),
      ar AS (SELECT user_id, string_agg(name, ', ' ORDER BY place) AS weak_areas FROM p WHERE place <= 3 GROUP BY user_id), t AS (SELECT user_id, count(*) AS tests FROM tests GROUP BY user_id),
      o AS (SELECT user_id, count(*) AS answered, {percent(f'count(*) FILTER ({RIGHT})', 'count(*)')} AS accuracy FROM responses WHERE {GRADED} GROUP BY user_id), l AS (SELECT user_id, CAST(max(started_at) AS DATE) AS last_active FROM responses GROUP BY user_id)
      SELECT u.user_id, display_name, o.answered, o.accuracy, CASE WHEN o.user_id IS NOT NULL THEN coalesce(tests, 0) END AS tests, weak_areas, last_active FROM users u LEFT JOIN o ON u.user_id = o.user_id LEFT JOIN t ON u.user_id = t.user_id LEFT JOIN ar ON u.user_id = ar.user_id LEFT JOIN l ON u.user_id = l.user_id WHERE status = 'approved' AND NOT is_admin""",
    "users", *R,
)

_NOTEBOOK = ORACLES["mistake_notebook"]
_WEAK = ORACLES["weak_areas"]
_IMPORT = "im AS (SELECT *, CAST(paper_id AS VARCHAR) AS file, CAST(question_id % 2 + 1 AS INT) AS part, question_id AS place, CASE WHEN question_id % 41 <> 3 THEN question_number END AS number, count(*) OVER (PARTITION BY paper_id, question_id % 2, CASE WHEN question_id % 41 <> 3 THEN question_number END) AS twice, CASE WHEN question_id % 19 = 4 THEN '3' ELSE correct_answer END AS said FROM questions)"
_SHEET = f"""sh0 AS (SELECT question_id AS line, CAST(paper_id AS VARCHAR) AS file, paper_id, text, subject, topic, CASE WHEN question_id % 50 <> 9 THEN question_number END AS number, CASE WHEN question_id % 19 = 4 THEN '3' ELSE coalesce(correct_answer, '') END AS said, CASE WHEN lower(subject) IN {_SUBJECTS} THEN lower(subject) END AS s FROM questions),
sh AS (SELECT *, CASE WHEN number IS NOT NULL THEN min(line) OVER (PARTITION BY file, number) END AS first_line, EXISTS (SELECT 1 FROM questions k WHERE k.question_id % 4 < 2 AND lower(k.subject) = s AND lower(k.topic) = lower(sh0.topic)) AS known FROM sh0)"""
_CHAPTERS = """ch0 AS (SELECT 'c' || paper_id AS file, CASE WHEN paper_id % 9 <> 2 THEN 'Physics' END AS subject, CAST(floor(paper_id / 2.0) AS INT) AS chapter_no, CASE WHEN paper_id % 5 = 0 THEN ' ' ELSE 'Light' END AS chapter, CASE WHEN paper_id % 3 = 0 THEN 7 END AS question_count, count(*) AS n FROM questions GROUP BY paper_id),
ch AS (SELECT *, CAST(NULL AS INT) AS number, row_number() OVER (PARTITION BY lower(subject), chapter_no ORDER BY file) AS twice FROM ch0),
cq0 AS (SELECT 'c' || paper_id AS file, question_id AS n, text, CASE WHEN question_id % 41 <> 3 THEN question_number END AS number, CASE WHEN question_id % 19 = 4 THEN 'x' WHEN question_id % 23 = 4 THEN 'e' ELSE lower(correct_answer) END AS answer FROM questions),
cq AS (SELECT *, row_number() OVER (PARTITION BY file, number ORDER BY n) AS again FROM cq0)"""
ORACLES |= {
    "import_issues": with_views(f"WITH {_IMPORT} " + issues("im", "file, part, place, number", [
        ("number IS NULL", "error", "number_missing"), ("number NOT BETWEEN 1 AND 999", "error", "number_range"), ("number IS NOT NULL AND twice > 1", "error", "number_twice"), ("question_id % 43 = 2", "error", "text_missing"), ("question_id % 43 <> 2 AND length(trim(text)) < 15", "warning", "text_short"),
        ("question_id % 37 = 5", "error", "options_few"), ("question_id % 37 = 5", "error", "option_numbered"), ("said = '3'", "error", "answer_form"), ("said IS NULL", "info", "answer_missing"), (f"subject IS NOT NULL AND lower(trim(subject)) NOT IN {_SUBJECTS}", "warning", "subject_unknown"),
        ("topic IS NOT NULL AND subject IS NULL", "warning", "topic_without_subject"), ("question_id % 23 = 0", "info", "uncertain"),
    ]), "questions"),
    "import_counts": with_views(f"WITH {_IMPORT}, h AS (SELECT DISTINCT paper_id, question_number FROM questions WHERE question_id % 8 = 0) SELECT file, count(*) AS questions, count(said) AS with_answer, count(*) - count(said) AS without_answer, 0 AS with_explanation, count(*) FILTER (question_id % 23 = 0) AS uncertain, count(*) FILTER (has_image) AS images, count(*) FILTER (subject IS NULL) AS no_subject, 0 AS both, count(*) FILTER (question_id % 43 <> 2) AS english_only, 0 AS hindi_only, count(h.paper_id) AS existing FROM im LEFT JOIN h ON im.paper_id = h.paper_id AND im.number = h.question_number GROUP BY file", "questions"),
    "import_parts": with_views(f"WITH {_IMPORT} SELECT file, part, count(*) AS n, min(number) AS first, max(number) AS last FROM im GROUP BY ALL", "questions"),
    "import_uncovered": with_views(f"WITH {_IMPORT}, w AS (SELECT CAST(paper_id AS VARCHAR) AS file, CAST(unnest(range(5, expected_total + 1)) AS INT) AS number FROM papers) SELECT file, number FROM w EXCEPT SELECT file, number FROM im WHERE number IS NOT NULL", "papers", "questions"),
    "import_duplicates": with_views(f"WITH {NAMED}, x AS (SELECT CAST(paper_id AS VARCHAR) AS file, n.question_id AS number, norm_hash FROM named n JOIN questions q ON n.question_id = q.question_id) SELECT file, number, 'file' AS of FROM x WHERE EXISTS (SELECT 1 FROM x y WHERE y.file = x.file AND y.norm_hash = x.norm_hash AND y.number < x.number) UNION ALL SELECT file, number, 'bank' FROM x WHERE norm_hash IN (SELECT norm_hash FROM x WHERE number % 300 = 1)", "questions"),
    "import_topics": with_views("SELECT question_id, subject, CASE WHEN EXISTS (SELECT 1 FROM questions k WHERE k.question_id % 4 < 2 AND k.subject = q.subject AND k.topic = q.topic) THEN topic END AS topic FROM questions q", "questions"),
    "sheet_issues": with_views(f"WITH {_SHEET} " + issues("sh", "file, line, number, first_line", [
        ("paper_id % 10 = 4", "error", "no_column_d"), ("number IS NULL", "error", "number_unreadable"), ("first_line < line", "error", "number_twice"), ("line % 45 = 2 OR trim(text) = ''", "error", "text_missing"), ("line % 35 = 3", "error", "option_b_empty"),
        ("said = '3'", "warning", "answer_unclear"), ("said = ''", "warning", "no_answer_found"), ("subject IS NOT NULL AND s IS NULL", "warning", "subject_unknown"), ("topic IS NOT NULL AND NOT known", "warning", "topic_unknown"),
    ]), "questions"),
    "chapter_issues": with_views(f"WITH {_CHAPTERS} " + issues("ch", "file, number", [
        ("coalesce(chapter_no, 0) < 1", "error", "chapter_no"), ("trim(chapter) = ''", "error", "chapter_name"), ("twice > 1", "error", "chapter_twice"), ("subject IS NULL", "error", "subject_missing"), ("question_count <> n", "warning", "question_count")]) + " UNION ALL " + issues("cq", "file, number", [
        ("coalesce(number, 0) < 1", "error", "number"), ("number IS NOT NULL AND again > 1", "error", "number_twice"), ("n % 43 = 2 OR trim(text) = ''", "error", "text_missing"), ("n % 37 = 5", "error", "option_empty"), ("n % 37 = 5", "error", "options"), ("answer = 'x'", "error", "answer_form"),
        ("answer = 'e' OR (n % 37 = 5 AND answer IN ('b', 'd'))", "error", "answer_without_option"), ("answer IS NULL", "warning", "answer_missing"), ("n % 29 = 1", "warning", "marked_for_review"),
    ]), "questions"),
    "import_fill": with_views("SELECT paper_id, question_id AS number, CASE WHEN question_id % 3 = 0 AND question_id % 2 = 1 THEN NULL ELSE text END AS text, CASE WHEN question_id % 3 = 2 OR (question_id % 3 = 1 AND question_id % 2 = 1) THEN 'needs_review' ELSE status END AS status, CASE WHEN question_id % 3 = 0 THEN 'kept' WHEN question_id % 3 = 2 THEN 'created' WHEN question_id % 2 = 1 THEN 'replaced' ELSE 'skipped' END AS action FROM questions", "questions"),
    "import_append": with_views(f"WITH {NAMED}, f AS (SELECT q.paper_id, q.question_id, q.text, row_number() OVER (PARTITION BY q.paper_id ORDER BY q.question_id) AS k FROM questions q JOIN named n ON q.question_id = n.question_id WHERE q.question_id % 3 = 0 AND q.question_id BETWEEN 1 AND 10000000 AND norm_hash NOT IN (SELECT norm_hash FROM named WHERE question_id % 90 = 1)), t AS (SELECT paper_id, max(question_id) AS top FROM questions WHERE question_id % 3 > 0 GROUP BY ALL) SELECT paper_id, question_id AS number, text, status, 'kept' AS action FROM questions WHERE question_id % 3 > 0 UNION ALL SELECT paper_id, coalesce(top, 0) + k, text, 'needs_review', 'created' FROM f LEFT JOIN t USING (paper_id)", "questions"),
    "printed_questions": with_views(f"WITH {PRINTED} SELECT CAST(paper_id AS BIGINT) AS paper_id, CAST(nth AS INT) AS number, text || ' is called what?' AS text, 'Alpha|Beta|Gamma|Delta' AS options, CASE WHEN paper_id % 2 = 0 THEN correct_answer END AS answer, CASE WHEN paper_id % 2 = 0 THEN CASE WHEN correct_answer IS NULL THEN '(?) as said' ELSE 'as said' END END AS explanation, CASE WHEN paper_id % 2 = 0 AND correct_answer IS NULL THEN 'answer_unclear' ELSE '' END AS flags FROM pr WHERE nth <= 300", "questions"),
    "printed_keys": with_views(f"WITH {PRINTED} SELECT CAST(paper_id AS BIGINT) AS key_id, CAST(nth AS INT) AS number, correct_answer AS letter FROM pr WHERE paper_id % 2 = 1 AND correct_answer IS NOT NULL AND (SELECT count(*) FROM pr p WHERE p.paper_id = pr.paper_id AND p.correct_answer IS NOT NULL) >= 5", "questions"),
    "english_columns": "SELECT doc_id AS page, 0 AS col FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 1 FROM documents WHERE text IS NOT NULL AND NOT (doc_id % 2 = 0 AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 20)",
    "review_list": with_views(f"SELECT paper_id, question_number, question_id, CAST(NOT flagged AS INT) AS first FROM questions WHERE {OPEN}", "questions"),
    "review_list_flagged": with_views("SELECT question_id FROM questions WHERE flagged AND status <> 'quarantined'", "questions"),
    "shaky_answers": with_views("SELECT attempt_id, question_id FROM responses WHERE selected_answer IS NOT NULL AND confidence IN ('guessed', 'no_idea')", *R),
    "wrong_answers": with_views(f"SELECT attempt_id, question_id FROM responses WHERE {WRONG}", *R),
    "notebook_revise": with_views(f"SELECT nb.user_id, nb.question_id, state FROM ({_NOTEBOOK}) nb JOIN questions q ON nb.question_id = q.question_id WHERE subject = 'ECONOMY' AND state IN ('due', 'scheduled')", "questions"),
    "notebook_first": f"SELECT question_id, state, days_until FROM ({_NOTEBOOK}) WHERE user_id = 42 ORDER BY CASE state WHEN 'due' THEN 0 WHEN 'scheduled' THEN 1 WHEN 'guessed' THEN 2 ELSE 3 END, days_until NULLS LAST, question_id LIMIT 100",
    "notebook_counts": f"SELECT user_id, {', '.join(f"count(*) FILTER (state = '{x}') AS {x}" for x in ('due', 'scheduled', 'guessed', 'mastered'))}, {', '.join(f"count(*) FILTER (state = 'due' AND last_reason = '{x}') AS due_{x}" for x in ('careless', 'conceptual_confusion', 'guess_miss', 'knowledge_gap', 'time_pressure'))} FROM ({_NOTEBOOK}) GROUP BY user_id",
    "audit_log_page": "WITH p AS (SELECT event_id AS log_id, 'question.' || event_type AS action, 1 + event_id % 17 AS paper_id FROM events WHERE event_type LIKE 'c%' ORDER BY event_id DESC LIMIT 51 OFFSET 50) SELECT *, (SELECT count(*) FROM p) > 50 AS has_more FROM p ORDER BY log_id DESC LIMIT 50",
    "recent_activity": "SELECT event_id AS log_id, 'question.' || event_type AS action FROM events WHERE event_type <> 'view' ORDER BY event_id DESC LIMIT 8",
    "audit_details": """SELECT event_id AS log_id, '{"page": ' || (1 + event_id % 17) || ', "by": {"api_key": "[hidden]", "name": "question.' || event_type || '"}}' AS detail FROM events""",
    "audit_fields": "SELECT event_id AS log_id, '[hidden]' AS token, 'question.' || event_type AS what FROM events",
    "accuracy_bars": with_views(f"""SELECT user_id, subject AS label, accuracy AS value, accuracy || '%' || CASE WHEN weak THEN ' \u00b7 weak' ELSE '' END AS value_text, weak AS highlight, accuracy || '% right | ' || subject || ' \u00b7 ' || "right" || ' of ' || answered || ' answered' || CASE WHEN weak THEN ' \u00b7 weak' ELSE '' END AS tip FROM ({accuracy_by('subject')}) WHERE enough""", *R),
    "trend_points": with_views(f"SELECT s.user_id, place, strftime(completed_at, '%d %b') AS x_label, percent AS value FROM ({ORACLES['score_trend']}) s JOIN attempts a ON s.attempt_id = a.attempt_id", "attempts"),
    "bookmarked_questions": with_views(f"WITH {LIVE} SELECT DISTINCT e.user_id, e.q AS question_id, subject, topic FROM (SELECT user_id, 1 + event_id % 500 AS q FROM events WHERE event_type = 'view') e JOIN live ON e.q = live.question_id", "papers", "questions"),
    "review_state": with_views(f"SELECT p.paper_id, title, p.status, publish_status, count(q.question_id) AS total, count(*) FILTER (q.{OPEN}) AS to_confirm, count(q.question_id) - count(*) FILTER (q.{OPEN}) AS confirmed FROM papers p LEFT JOIN questions q ON p.paper_id = q.paper_id AND q.status <> 'quarantined' WHERE NOT archived GROUP BY ALL", "papers", "questions"),
    "attention": with_views(f"""WITH x AS (SELECT p.paper_id, CASE WHEN p.paper_id % 6 = 1 THEN 'failed' ELSE p.status END AS status, publish_status, count(q.question_id) AS total, count(*) FILTER (q.{OPEN}) AS o FROM papers p LEFT JOIN questions q ON p.paper_id = q.paper_id AND q.status <> 'quarantined' AND (q.paper_id % 4 <> 2 OR q.status = 'live') WHERE NOT archived GROUP BY ALL),
      y AS (SELECT *, CASE WHEN status = 'failed' THEN 'failed' WHEN status = 'ready' AND o > 0 THEN 'confirm' WHEN status = 'ready' AND total > 0 AND publish_status <> 'published' THEN 'publish' END AS what FROM x) SELECT paper_id, what, CASE what WHEN 'confirm' THEN o WHEN 'publish' THEN total ELSE 0 END AS n FROM y WHERE what IS NOT NULL""", "papers", "questions"),
    "dashboard_tiles": with_views(f"""WITH l AS (SELECT user_id, max(started_at) AS at_ FROM attempts GROUP BY ALL) {' UNION ALL '.join(f"SELECT '{k}' AS tile, count(*) AS n FROM {t} WHERE {c}" for k, t, c in (
        ('pending', 'users', "NOT is_admin AND status = 'pending'"), ('approved', 'users', "NOT is_admin AND status = 'approved'"), ('deactivated', 'users', "NOT is_admin AND status = 'deactivated'"), ('active', 'users JOIN l USING (user_id)', f"NOT is_admin AND status = 'approved' AND at_ >= {TODAY} - 400"),
        ('published', 'papers', "NOT archived AND publish_status = 'published'"), ('drafts', 'papers', "NOT archived AND publish_status <> 'published'"), ('live_questions', 'questions', "status = 'live'"), ('tests', 'attempts', f"kind IN ('full_test', 'section') AND status <> 'in_progress' AND started_at >= {TODAY} - 400")))}""", "papers", "users", *R),
    "palette": with_views(f"SELECT attempt_id, position, CASE WHEN kind IN ('full_test', 'section') AND attempt_status = 'in_progress' THEN CASE WHEN selected_answer IS NOT NULL THEN 'answered' WHEN seconds % 2 = 0 THEN 'unanswered' ELSE 'notvisited' END WHEN {RIGHT} THEN 'correct' WHEN selected_answer IS NOT NULL THEN 'wrong' WHEN attempt_status <> 'in_progress' THEN 'skipped' ELSE 'unanswered' END AS state, question_id % 5 > 0 AND question_id % 9 = 0 AS marked FROM responses", *R),
    "next_positions": with_views("SELECT attempt_id, CASE WHEN any_value(kind) IN ('full_test', 'section') AND any_value(attempt_status) = 'in_progress' AND attempt_id % 4 > 0 AND max(position) > attempt_id % 3 THEN CAST(1 + attempt_id % 3 AS INT) ELSE coalesce(min(position) FILTER (selected_answer IS NULL), max(position)) END AS next_position FROM responses GROUP BY attempt_id", *R),
    "attempt_summaries": with_views("SELECT attempt_id, count(*) AS total, count(selected_answer) AS answered, count(*) - count(selected_answer) AS unanswered, count(*) FILTER (seconds % 2 <> 0) AS not_visited, count(*) FILTER (question_id % 5 > 0 AND question_id % 9 = 0) AS marked, count(*) FILTER (selected_answer IS NOT NULL AND coalesce(confidence, 'skipped') = 'skipped') AS unrated FROM responses GROUP BY ALL", *R),
    "filter_errors": with_views("""WITH r AS (SELECT question_id AS request_id, CASE question_id % 5 WHEN 0 THEN 'radio' WHEN 1 THEN 'official' END AS source, CASE question_id % 7 WHEN 0 THEN 'Nowhere' WHEN 1 THEN 'SMALL' ELSE subject END AS subject, CASE WHEN question_id % 11 = 0 THEN 'No topic' ELSE topic END AS topic, CASE WHEN question_id % 13 = 0 THEN 'odd' ELSE 'Easy' END AS difficulty FROM questions)
      SELECT request_id, CASE WHEN source NOT IN ('official', 'mock', 'book') THEN 'unknown_source' WHEN subject IS NOT NULL AND subject NOT IN (SELECT subject FROM questions WHERE subject IS NOT NULL) THEN 'unknown_subject' WHEN topic IS NOT NULL AND topic NOT IN (SELECT topic FROM questions WHERE topic IS NOT NULL) THEN 'unknown_topic'
        WHEN topic IS NOT NULL AND subject IS NOT NULL AND (subject, topic) NOT IN (SELECT (subject, topic) FROM questions WHERE topic IS NOT NULL AND subject IS NOT NULL) THEN 'topic_of_other_subject' WHEN lower(difficulty) NOT IN ('easy', 'medium', 'hard') THEN 'unknown_difficulty' END AS error FROM r""", "questions"),
    "unattempted_pool": with_views(f"WITH {LIVE} SELECT question_id FROM live WHERE source_type = 'mock' AND question_id NOT IN (SELECT question_id FROM responses WHERE user_id = 42 AND selected_answer IS NOT NULL)", "papers", *R),
    "own_reasons": with_views(f"WITH {REASONS} SELECT attempt_id, question_id, CASE WHEN question_id % 10 = 0 THEN 'misread' ELSE reason END AS reason FROM reasons", *R),
    "custom_tests": with_views(f"""WITH {LIVE}, z AS (SELECT paper_id, count(*) AS n FROM live GROUP BY ALL), x AS (SELECT attempt_id, marks_per_question AS mpq, negative_fraction AS nf, CAST(coalesce(nullif(duration_minutes, 0), greatest(1, ceil(n * 72 / 60.0))) * 60 AS BIGINT) AS usual, coalesce(CASE WHEN attempt_id % 5 = 0 THEN 3.0e0 WHEN attempt_id % 7 = 0 THEN -1.0e0 END, nullif(marks_per_question, 0), 2.0e0) AS marks,
        coalesce(CASE WHEN attempt_id % 11 = 0 THEN 1.5e0 END, negative_fraction, 1.0e0 / 3.0e0) AS neg, CASE WHEN attempt_id % 3 = 0 THEN attempt_id % 700 END AS mins FROM attempts a JOIN papers p ON CAST(substr(rank_key, 7) AS INT) = p.paper_id JOIN z ON p.paper_id = z.paper_id WHERE kind = 'full_test'),
      y AS (SELECT *, coalesce(mins * 60, usual) AS seconds, CASE WHEN mins NOT BETWEEN 1 AND 600 THEN 'minutes' WHEN marks <= 0 THEN 'marks' WHEN neg NOT BETWEEN 0 AND 1 THEN 'negative' END AS error FROM x)
      SELECT attempt_id, marks, round_even(marks * neg, 6) AS penalty, seconds, error, coalesce(marks = mpq AND neg = nf AND seconds = usual, FALSE) AND error IS NULL AS ranked FROM y""", "papers", "attempts", "questions"),
    "language_modes": with_views("""WITH x AS (SELECT question_id AS n, text, question_id % 5 <> 0 AS en, question_id % 3 = 0 AS hi, question_id % 5 <> 0 AND question_id % 7 <> 0 AS we, question_id % 6 = 0 AS wh FROM questions), y AS (SELECT *, CASE WHEN we OR wh THEN we ELSE en END AS e, CASE WHEN we OR wh THEN wh ELSE hi END AS h FROM x)
      SELECT n AS question_id, CASE WHEN en OR NOT hi THEN 'en' ELSE 'hi' END AS "primary", CASE WHEN n % 7 <> 0 OR n % 6 = 0 THEN 4 ELSE 0 END AS n_options, CASE WHEN hi THEN '\u092a\u094d\u0930\u0936\u094d\u0928' WHEN en THEN text ELSE '' END AS line,
      concat_ws(' ', CASE WHEN e THEN 'en' END, CASE WHEN e AND NOT h THEN 'hi' END, CASE WHEN e THEN 'both' END) AS en, concat_ws(' ', CASE WHEN h AND NOT e THEN 'en' END, CASE WHEN h THEN 'hi' END, CASE WHEN h THEN 'both' END) AS hi, CASE WHEN h AND NOT e THEN 'en' ELSE '' END AS note_en, CASE WHEN e AND NOT h THEN 'hi' ELSE '' END AS note_hi FROM y""", "questions"),
    "explanation_trust": with_views("""SELECT question_id, CASE WHEN question_id % 9 = 0 THEN 'Verified' WHEN question_id % 3 = 0 THEN 'AI-supplied, unverified' WHEN question_id % 3 = 1 THEN 'Unverified (imported from a file)' ELSE 'Unverified (as printed in the answer PDF)' END AS label,
      concat_ws(',', 'check_table', CASE WHEN question_id % 4 = 0 AND true_letter <> correct_answer THEN 'explanation_mismatch' END, CASE WHEN question_id % 2 = 0 THEN 'language_mismatch' END) AS flags, rtrim(rtrim(printf('%.2f', question_id / 4.0), '0'), '.') AS marks,
      CASE WHEN question_id >= 3600 THEN printf('%dh %02dm', question_id // 3600, question_id % 3600 // 60) WHEN question_id >= 60 THEN printf('%dm %02ds', question_id // 60, question_id % 60) ELSE printf('%ds', question_id) END AS duration FROM questions""", "questions"),
    "closed_attempts": """WITH r AS (SELECT user_id AS a, ts, event_id % 20 AS q, CASE WHEN event_id % 6 = 0 THEN '' ELSE 'A' END AS v, event_type = 'purchase' AS sub FROM events), d AS (SELECT a, min(ts) + INTERVAL '450' HOUR AS dl FROM r GROUP BY a), s AS (SELECT r.a, min(ts) AS sub_at FROM r JOIN d USING (a) WHERE sub AND ts <= dl + INTERVAL '3' SECOND GROUP BY r.a),
      l AS (SELECT r.a, q, arg_max(v, ts) AS v FROM r JOIN d USING (a) LEFT JOIN s USING (a) WHERE NOT sub AND ts <= dl + INTERVAL '3' SECOND AND (sub_at IS NULL OR ts <= sub_at) GROUP BY ALL), n AS (SELECT a, count(*) FILTER (v <> '') AS k FROM l GROUP BY a)
      SELECT d.a AS attempt_id, CASE WHEN sub_at IS NOT NULL THEN 'submitted' ELSE 'expired' END AS status, coalesce(sub_at, dl) AS ended_at, CAST(coalesce(k, 0) AS INT) AS answered FROM d LEFT JOIN s USING (a) LEFT JOIN n USING (a) WHERE sub_at IS NOT NULL OR dl + INTERVAL '3' SECOND < TIMESTAMP '2024-02-10 00:00:00'""",
}
ORACLES |= {
    "remaining_seconds": with_views("SELECT attempt_id, CASE WHEN d IS NOT NULL THEN CAST(greatest(0, ceil(epoch(d) - epoch(TIMESTAMP '1997-06-15 00:00:30'))) AS BIGINT) END AS remaining, coalesce(epoch(d) + 3 < epoch(TIMESTAMP '1997-06-15 00:00:30'), FALSE) AS overdue FROM (SELECT attempt_id, status, CASE WHEN attempt_id % 5 > 0 THEN completed_at END AS d FROM attempts) WHERE status = 'in_progress'", "attempts"),
    "running_lines": f"""WITH s AS (SELECT source AS paper_id, doc_id AS page, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT paper_id, page, trim(regexp_replace(lower(unnest(ls)), '{_W}', ' ', 'g')) AS line, (unnest(range(len(ls))) + 0.5e0) / len(ls) AS place FROM s), k AS (SELECT * FROM l WHERE line <> ''), p AS (SELECT paper_id, count(DISTINCT page) AS pages FROM k GROUP BY ALL)
      SELECT paper_id, line, n FROM (SELECT paper_id, line, count(DISTINCT page) AS n FROM k WHERE place < 0.1e0 OR place > 0.9e0 GROUP BY ALL) JOIN p USING (paper_id) WHERE n >= greatest(3.0, 0.01 * pages)""",
    "same_tests": with_views("WITH x AS (SELECT question_id AS paper_id, coalesce(subject, '') AS s, question_id % 700 AS t FROM questions WHERE question_id % 9 > 0) SELECT a.paper_id, min(b.paper_id) AS first FROM x a JOIN x b ON a.s = b.s AND a.t = b.t AND b.paper_id < a.paper_id GROUP BY a.paper_id", "questions"),
    "key_errors": with_views("""WITH f AS (SELECT paper_id, question_number, count(DISTINCT correct_answer) AS k FROM questions WHERE correct_answer IS NOT NULL GROUP BY ALL) SELECT paper_id AS key_id, 'conflict' AS error, question_number AS number FROM f WHERE k + CASE WHEN paper_id % 4 = 0 AND question_number = 3 THEN 1 ELSE 0 END > 1 AND paper_id % 4 IN (0, 2)
      UNION ALL SELECT DISTINCT paper_id, CASE WHEN paper_id % 4 = 1 THEN 'digits' ELSE 'empty' END, CAST(NULL AS INT) FROM f WHERE paper_id % 4 IN (1, 3)""", "questions"),
    "key_explanations": with_views("SELECT paper_id AS key_id, question_number AS number, 'as told' AS explanation, count(*) AS n FROM questions WHERE correct_answer IS NOT NULL AND paper_id % 4 = 2 GROUP BY ALL", "questions"),
    "range_errors": with_views("""SELECT question_id, '1-30' AS part FROM questions WHERE subject IS NULL UNION ALL SELECT question_id, (question_id % 60) || '-40 Maths' FROM questions WHERE question_id % 60 > 40 UNION ALL SELECT question_id, 'all the rest' FROM questions WHERE question_id % 3 = 0""", "questions"),
}
