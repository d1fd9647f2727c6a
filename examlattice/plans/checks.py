"""Registered queries on import rules, warnings, hints, draws and moments, with their SQL twins beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..domain import with_views
from ..functions import text
from ..operators import activity, analytics, dedup, hints, lists, review, revision, sessions
from ..sources import files, importing, running
from .oracles import _WEAK, LIVE, ORACLES, R
from .queries import KEYWORDS, Tables, mistake_notebook, named_questions, numbered, query, stored_pairs

# Inputs, in SQL that Spark and DuckDB both read: questions in two languages, cells of sheets, versions of parts.
LANGUAGES = """
SELECT question_id, status, question_id % 2 = 0 AS acknowledged,
  CASE WHEN question_id % 5 = 0 THEN NULL WHEN question_id % 9 = 1 THEN 'यह प्रश्न कौन सा है' WHEN question_id % 8 = 3 THEN concat(text, chr(10), 'second line') WHEN question_id % 11 = 1 THEN concat(text, ' ©') WHEN question_id % 11 = 2 THEN '' ELSE text END AS t,
  CASE WHEN question_id % 7 = 0 THEN NULL WHEN question_id % 7 = 1 THEN 'Alpha|Beta|Gamma' WHEN question_id % 7 = 2 THEN '2 1 4 3|1 2 3 4|4 3 2 1|1 1 2 3' WHEN question_id % 7 = 3 THEN '2 1 4 3|1 2 3 4|4 3 2 1|3 1 2 4' WHEN question_id % 7 = 4 THEN '|b|c|d' WHEN question_id % 7 = 5 THEN concat(repeat('x', 301), '|b|c c|d') ELSE 'Alpha|Beta|Gamma|Delta' END AS o,
  CASE WHEN question_id % 3 = 0 THEN 'प्रश्न यह है' WHEN question_id % 12 = 4 THEN 'this is in English words' END AS h,
  CASE WHEN question_id % 6 = 0 THEN 'अब|बक|गम|दन' WHEN question_id % 6 = 3 THEN 'अब|बक' WHEN question_id % 12 = 8 THEN 'अब|बक|गम|दन' END AS p,
  CASE WHEN question_id % 10 = 0 THEN 'because so' WHEN question_id % 10 = 3 THEN 'क्योंकि ऐसा ही है और ऐसा ही था और ऐसा ही होगा' END AS e, CASE WHEN question_id % 12 = 6 THEN 'because in English it is so and was so' END AS eh,
  CASE WHEN question_id % 4 = 0 THEN 'language_swapped|check_table' WHEN question_id % 4 = 1 THEN 'other' END AS f
FROM {questions}"""
CELLS = """
SELECT question_id, CASE question_id % 19 WHEN 0 THEN concat('(', a, ')') WHEN 1 THEN concat('Option ', a) WHEN 2 THEN concat('answer: ', lower(a)) WHEN 3 THEN concat('choice ', lower(a)) WHEN 4 THEN 'e' WHEN 5 THEN 'E' WHEN 6 THEN 'ग' WHEN 7 THEN '2'
  WHEN 8 THEN concat(a, a) WHEN 9 THEN concat(' ', lower(a), '. ') WHEN 10 THEN concat('[', a, ']') WHEN 11 THEN concat('ANS – ', a) WHEN 12 THEN concat('answer is ', a) WHEN 13 THEN '' WHEN 14 THEN concat('ans.', a) WHEN 15 THEN concat('choice', a, ')') WHEN 16 THEN concat('key ', a) WHEN 17 THEN NULL ELSE a END AS s
FROM (SELECT question_id, true_letter AS a FROM {questions}) AS x"""
VERSIONS = """
SELECT CAST(paper_id AS STRING) AS file, question_number AS number, CAST(1 + floor(question_id % 120 / 110.0) AS INT) AS part, question_id AS place, text, 'Alpha|Beta|Gamma|Delta' AS o, CAST(NULL AS STRING) AS text_hi, CAST(NULL AS STRING) AS oh,
  correct_answer AS answer, CASE WHEN question_id % 6 = 0 THEN 'own' END AS explanation, CAST(NULL AS STRING) AS explanation_hi, subject, topic, CAST(1 AS INT) AS page, CAST(NULL AS STRING) AS lf, has_image, FALSE AS uncertain FROM {questions}
UNION ALL SELECT CAST(paper_id AS STRING), question_number, 3, question_id, concat(upper(text), '  '), 'ALPHA|Beta |gamma|Delta', NULL, NULL, CASE question_id % 12 WHEN 0 THEN NULL WHEN 3 THEN substr('ABCD', CAST(1 + (question_id + 2) % 4 AS INT), 1) ELSE correct_answer END,
  'told', NULL, subject, NULL, CASE WHEN question_id % 9 = 0 THEN 1 END, 'language_swapped', FALSE, TRUE FROM {questions} WHERE question_id % 3 = 0
UNION ALL SELECT CAST(paper_id AS STRING), question_number, 4, question_id, '', NULL, concat('प्रश्न ', CAST(question_id AS STRING)), 'अब|बक|गम|दन', correct_answer, NULL, 'कथन', NULL, topic, 1, 'language_incomplete', FALSE, FALSE FROM {questions} WHERE question_id % 3 = 1
UNION ALL SELECT CAST(paper_id AS STRING), question_number, 5, question_id, text, 'Alpha|Beta|Gamma|Delta', 'प्रश्न', 'अब|बक|गम|दन', correct_answer, 'later', NULL, subject, topic, 1, 'language_mismatch', TRUE, FALSE FROM {questions} WHERE question_id % 3 = 2
UNION ALL SELECT CAST(paper_id AS STRING), CASE WHEN question_id % 18 = 4 THEN NULL ELSE question_number END, 6, question_id, text, 'Alpha|Beta|Gamma|Delta', concat('प्रश्न  ', CAST(question_id AS STRING)), 'अब|बक|गम|दन', correct_answer, NULL, NULL, subject, topic, 1, NULL, FALSE, FALSE FROM {questions} WHERE question_id % 9 = 4"""


def listed(column: str):
    return F.split(column, r"\|")


def languages(t):
    rows = t.spark.sql(LANGUAGES, questions=t.questions)
    return rows.select("question_id", "status", "acknowledged", "t", listed("o").alias("o"), "h", listed("p").alias("p"), "e", "eh", listed("f").alias("f"))


@query
def language_warnings(spark, sf_dir):
    c = F.col
    wanted = text.language_flags(c("t"), c("o"), c("h"), c("p"), c("e"), c("eh"))
    rows = languages(Tables(spark, sf_dir)).withColumn("wanted", wanted)
    rows = rows.withColumn("x", text.refreshed(c("f"), c("wanted"), c("status"), c("acknowledged")))
    return rows.select("question_id", F.array_join("wanted", ",").alias("language"), F.array_join("x.flags", ",").alias("flags"), "x.acknowledged")


@query
def sanity_warnings(spark, sf_dir):
    return languages(Tables(spark, sf_dir)).select("question_id", F.array_join(text.sanity_flags(F.col("t"), F.col("o")), ",").alias("flags"))


@query
def sheet_answers(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return spark.sql(CELLS, questions=t.questions).select("question_id", text.sheet_answer(F.col("s")).alias("answer"))


def merged(spark, sf_dir, later_wins):
    t = Tables(spark, sf_dir)
    rows = spark.sql(VERSIONS, questions=t.questions).withColumns({"options": listed("o"), "options_hi": listed("oh"), "lang_flags": listed("lf")})
    found = importing.merge_parts(rows, later_wins)
    notes = F.array_join(F.transform("notes", lambda x: F.concat_ws(":", x["level"], x["kind"], x["part"].cast("string"), x["other"].cast("string"), x["fields"])), ";")
    return found.select("file", "number", "part", "text", F.array_join("options", "|").alias("options"), "text_hi", F.array_join("options_hi", "|").alias("options_hi"), *importing.MERGED, F.array_join("lang_flags", ",").alias("lang_flags"), "has_image", "uncertain", "versions", notes.alias("notes"))


@query
def merged_import(spark, sf_dir):
    return merged(spark, sf_dir, True)


@query
def merged_import_strict(spark, sf_dir):
    return merged(spark, sf_dir, False)


HEADS = {
    0: ["Q. No.", "Question", "Option A", "Option B", "Option C", "Option D", "Correct Answer", "Explanation", "Subject", "Topic"], 1: ["S.No", "Question Text", "a", "b", "c", "d", "The right answer", "Solution (long)", "Subject area", "Sub-topic"],
    2: ["question no", "questionnaire item", "Choice 1", "Choice 2", "Choice 3", "Choice 4", "is correct?", "reason", "section", "chapter"], 3: ["id", "stem", "text", "A", "A", "B", "C", "D", "key", "answer key"], 4: ["Frage", "question number", "Opt1", "Opt 2", "OPT-3", "opt4", "Answer", "correct", "notes", "x"],
}


@query
def sheet_headers(spark, sf_dir):
    """Which column each field of sheets takes; the sheets' heads are of five kinds, by paper."""
    t = Tables(spark, sf_dir)
    heads = F.element_at(F.create_map(*[x for k, v in HEADS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.pmod("paper_id", F.lit(5)).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: i.cast("string"))
    rows = t.questions.select(F.col("paper_id").cast("string").alias("file"), F.col("question_id").alias("line"), heads.alias("headers"), cells.alias("cells"))
    return files.map_headers(rows).select("line", F.array_join(F.array_sort(F.transform(F.map_entries("fields"), lambda x: F.concat_ws("=", x["key"], x["value"]))), " ").alias("fields"))


def keyword_rows(t):
    n = F.col("question_id")
    return t.questions.select("question_id", "text", F.when(n % 4 == 0, F.array(F.lit("Red"), F.lit(""), F.lit("gear"))).alias("options"))


@query
def subject_hints(spark, sf_dir):
    return hints.subject_hints(keyword_rows(Tables(spark, sf_dir)), hints.keyword_table(spark, KEYWORDS))


@query
def cleaned_lines(spark, sf_dir):
    """The documents as pages of papers, eight to a paper, with heads, feet and overlays; without them."""
    docs = Tables(spark, sf_dir).documents.where("doc_id IS NOT NULL")
    paper, page = F.floor(F.col("doc_id") / 8).alias("paper_id"), (F.col("doc_id") % 8).alias("page")
    number = (F.col("page") + 1).cast("string")
    rows = docs.select(paper, page, F.split(F.coalesce("text", F.lit("")), "\n").alias("body"))
    extra = F.array(F.concat(F.lit("Sectional Test "), F.col("paper_id").cast("string"), F.lit(" | "), number), F.when(F.col("page") % 2 == 0, "12. Which of these").otherwise("Name of the test 7"), F.concat(F.lit("mail"), number, F.lit("@site.example")), F.lit("Call 98765432100"), F.concat(F.lit("item "), number, F.lit(" of")))
    every = F.concat(F.transform(extra, lambda x, i: F.struct((-1 - i).alias("line_no"), (4 + 8.0 * i).alias("top"), x.alias("text"))), F.transform("body", lambda x, i: F.struct(i.alias("line_no"), (44 + 10.0 * i).alias("top"), x.alias("text"))))
    placed = rows.select("paper_id", "page", F.lit(0).alias("col"), F.explode(every).alias("x")).select("paper_id", "page", "col", "x.line_no", "x.top", (F.col("x.top") + 8).alias("bottom"), "x.text")
    pages = rows.select("paper_id", "page", F.lit(0.0).alias("top"), (F.size("body") * 10 + 100.0).alias("bottom"))
    return running.without_running_lines(placed, pages).select("paper_id", "page", "line_no", "text")


def pools(t):
    return hints.draw_pool(t.live, "topic").unionAll(hints.draw_pool(t.live, "subject"))


@query
def weak_area_draw(spark, sf_dir):
    t = Tables(spark, sf_dir)
    weak = analytics.weak_areas(t.responses).groupBy("user_id").agg(F.collect_list(F.concat_ws(":", "kind", "name")).alias("areas"))
    return sessions.practice_draw(weak.withColumn("count", F.lit(10)), pools(t))


@query
def practice_draw(spark, sf_dir):
    t = Tables(spark, sf_dir)
    asked = t.attempts.groupBy("user_id").agg(F.min("attempt_id").alias("a")).join(t.live.where("subject IS NOT NULL").groupBy().agg(F.array_sort(F.collect_set("subject")).alias("s")))
    return sessions.practice_draw(asked.select("user_id", F.array(F.concat(F.lit("subject:"), F.get("s", F.pmod("a", F.size("s")).cast("int")))).alias("areas"), (1 + F.col("a") % 130).alias("count")), pools(t), seed="2")


@query
def mistake_draw(spark, sf_dir):
    return sessions.mistake_draw(revision.schedule(Tables(spark, sf_dir).graded_days).where("status = 'active'"), 5)


@query
def mistake_draw_shuffled(spark, sf_dir):
    return sessions.mistake_draw(mistake_notebook(spark, sf_dir).withColumn("due", F.lit(None).cast("date")), 5, shuffled=True)


@query
def values_as_of(spark, sf_dir):
    """What every user's last event was an hour after each event."""
    events = Tables(spark, sf_dir).events.select("event_id", F.col("user_id").alias("entity"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), "event_type", "value")
    moments = events.select(F.col("event_id").alias("moment_id"), "entity", (F.col("at") - F.expr("INTERVAL 30 HOURS")).alias("at"))
    return review.as_of_each(events.where("event_id % 2 = 0"), moments, ["event_type", "value"]).select("moment_id", "entity", "event_type", "value")


@query
def decided_pairs(spark, sf_dir):
    t = Tables(spark, sf_dir)
    pairs = stored_pairs(named_questions(t)).withColumn("decided_at", F.when(F.col("newer") % 11 > 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("newer") * 7 % 365).cast("int"))))
    return dedup.decided_page(pairs, 50, t.questions.where("paper_id % 2 = 0"))


@query
def practice_screen_time(spark, sf_dir):
    """Practice: what is answered counts no further time."""
    events = Tables(spark, sf_dir).events
    ts = F.col("ts").cast("timestamp")
    return activity.screen_time(events.select(F.col("user_id").alias("attempt_id"), (F.col("event_id") % 20).alias("question_id"), ts.alias("ts"), "event_id", F.when(F.col("event_id") % 3 > 0, ts + F.expr("INTERVAL 40 SECONDS")).alias("answered_at")))


@query
def cleaned_texts(spark, sf_dir):
    n = F.col("doc_id")
    odd = F.when(n % 3 == 0, F.concat(F.lit("a\\n b \t c\u0001 \u00a0\n"), F.col("text"))).when(n % 3 == 1, F.concat(F.translate("text", "\n", " "), F.lit("\\n \\n end\r"))).otherwise(F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")))
    return Tables(spark, sf_dir).documents.select("doc_id", text.clean(odd).alias("text"))


@query
def import_skip(spark, sf_dir):
    q = numbered(Tables(spark, sf_dir))
    return importing.apply_import(q.where("number % 3 < 2"), q.where("number % 3 > 0").withColumn("text", F.concat("text", F.lit("!"))), "skip").select("number", "text", "status", "action")


#: Ways to name an answer, with a letter in them; and ways to write a share of a mark.
SAYINGS = ["The correct answer is ({})", "hence option ({}) is correct.", "Answer: ({}) right", "so option ({})  is the right one", "final option - option ( {} )", "The answer is {}", "option ({}) is wrong, answer ({}) is correct", "correct answer ({}); right option (d)", ""]
SHARES = ["1/3", " 2 / 3", "0.25", "1", "1.5", "0", "3/2", "1/0", "x", "", "-1/3", "1/3/2"]


@query
def explanation_letters(spark, sf_dir):
    n = F.col("question_id")
    said = F.element_at(F.array(*map(F.lit, SAYINGS)), (1 + n % len(SAYINGS)).cast("int"))
    rows = Tables(spark, sf_dir).questions.select("question_id", F.replace(said, F.lit("{}"), F.when(n % 2 == 0, F.col("true_letter")).otherwise(F.lower("true_letter"))).alias("s"))
    return rows.select("question_id", text.explanation_says(F.col("s")).alias("letter"))


@query
def question_languages(spark, sf_dir):
    rows = languages(Tables(spark, sf_dir))
    return rows.select("question_id", text.which(F.col("t"), F.col("h")).alias("languages"), F.bround(text.devanagari_share(F.concat_ws(" ", "t", "h")), 6).alias("share"))


@query
def mark_shares(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, SHARES)), (1 + F.col("question_id") % len(SHARES)).cast("int"))
    return Tables(spark, sf_dir).questions.select("question_id", text.fraction(said).alias("share"))


def review_kind(show):
    def make(spark, sf_dir):
        q = Tables(spark, sf_dir).questions.withColumn("flags", F.when(F.col("flagged"), F.array(F.lit("odd"))))
        return lists.review_list(q, show).select("question_id", "first")

    make.__name__ = f"review_list_{show}"
    return query(make)


for _show in ("confirmed", "no_subject", "ai_answers"):
    review_kind(_show)


def listing(column: str) -> str:
    return f"string_split({column}, '|')"


_FOUR = "['Alpha', 'Beta', 'Gamma', 'Delta']"
_TRIMMED = lambda c: f"list_filter(coalesce({listing(c)}, []), lambda x: trim(x) <> '')"
_LETTERS, _OWN = r"[\p{L}\x{0900}-\x{0963}\x{0970}-\x{097F}]", r"[\x{0900}-\x{0963}\x{0970}-\x{097F}]"
_SHARE = lambda c: f"CASE WHEN len(regexp_extract_all({c}, '{_LETTERS}')) >= 4 THEN len(regexp_extract_all({c}, '{_OWN}')) / CAST(len(regexp_extract_all({c}, '{_LETTERS}')) AS DOUBLE) END"
_LINES = lambda c: f"len(list_filter(string_split({c}, chr(10)), lambda x: trim(x) <> ''))"
_MARKS = r""".,;:\'"’‘“”()\[\]/%&+\-–—?!=°$₹*<>""".replace(r"\'", "''")
ORACLES["language_warnings"] = with_views(f"""WITH l AS ({LANGUAGES.replace('{questions}', 'questions')}), a AS (SELECT *, coalesce(trim(t), '') <> '' AS en, coalesce(trim(h), '') <> '' AS hi, {_TRIMMED('o')} AS eo, {_TRIMMED('p')} AS ho FROM l),
b AS (SELECT *, concat_ws(' ', coalesce(t, ''), array_to_string(eo, ' '), coalesce(e, '')) AS te, concat_ws(' ', coalesce(h, ''), array_to_string(ho, ' '), coalesce(eh, '')) AS th FROM a),
c AS (SELECT *, list_filter([CASE WHEN (en <> (len(eo) > 0) AND hi AND len(ho) = 4) OR (hi <> (len(ho) > 0) AND en AND len(eo) = 4) THEN 'language_incomplete' END, CASE WHEN coalesce({_SHARE('th')} < 0.6, FALSE) OR coalesce({_SHARE('te')} > 0.2, FALSE) THEN 'language_swapped' END,
  CASE WHEN en AND (hi OR len(ho) > 0) AND ((len(eo) > 0 AND len(ho) > 0 AND len(eo) <> len(ho)) OR (hi AND {_LINES("coalesce(t, '')")} <> {_LINES("coalesce(h, '')")})) THEN 'language_mismatch' END], lambda x: x IS NOT NULL) AS w, coalesce({listing('f')}, []) AS fl FROM b)
SELECT question_id, array_to_string(w, ',') AS language, array_to_string(list_concat(list_filter(fl, lambda x: x NOT IN ('language_incomplete', 'language_swapped', 'language_mismatch')), w), ',') AS flags,
  acknowledged AND NOT (status IN ('verified', 'live') AND len(list_filter(w, lambda x: NOT list_contains(fl, x))) > 0) AS acknowledged FROM c""", "questions")  # fmt: skip
ORACLES["sanity_warnings"] = with_views(f"""WITH l AS ({LANGUAGES.replace('{questions}', 'questions')}), a AS (SELECT question_id, coalesce(t, '') AS t, {listing('o')} AS o FROM l)
SELECT question_id, CASE WHEN o IS NULL THEN 'options_not_found' ELSE concat_ws(',', CASE WHEN t = '' THEN 'empty_stem' END, CASE WHEN list_contains(o, '') THEN 'empty_option' END, CASE WHEN len(list_filter(o, lambda x: length(x) > 300)) > 0 THEN 'very_long_option' END,
  CASE WHEN regexp_matches(concat_ws(' ', t, array_to_string(o, ' ')), '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}{_MARKS}]') THEN 'odd_characters' END,
  CASE WHEN len(list_filter(o, lambda x: regexp_full_match(x, '\\w \\w \\w \\w'))) = len(o) AND len(list_filter(o, lambda x: list_sort(string_split(x, ' ')) <> ['1', '2', '3', '4'])) > 0 THEN 'check_code_row' END) END AS flags FROM a""", "questions")  # fmt: skip
ORACLES["sheet_answers"] = with_views(f"""WITH c AS ({CELLS.replace('{questions}', 'questions')}) SELECT question_id, nullif(upper(regexp_extract(trim(s), '^(?i)(?:(?:option|answer|ans|choice)\\s*[:\\-–.]?\\s*)?[(\\[]?\\s*([a-dA-D])\\s*[)\\].:]?$', 1)), '') AS answer FROM c""", "questions")


def _folded(later_wins: bool) -> str:
    words = lambda x: f"trim(regexp_replace(lower(coalesce(CAST({x} AS VARCHAR), '')), '[\\s\\p{{Z}}]+', ' ', 'g'))"
    four = lambda x: "concat_ws('#', " + ", ".join(words(f"{listing(x)}[{i}]") for i in (1, 2, 3, 4)) + ")"
    fields = list(importing.MERGED)
    en, en2, hi, hi2 = "coalesce(f.text, '') <> ''", "coalesce(v.text, '') <> ''", "(coalesce(f.text_hi, '') <> '' OR f.oh IS NOT NULL)", "(coalesce(v.text_hi, '') <> '' OR v.oh IS NOT NULL)"
    same = f"CASE WHEN NOT ({en} AND {en2}) AND NOT ({hi} AND {hi2}) THEN NULL WHEN {en} AND {en2} AND ({words('f.text')} <> {words('v.text')} OR {four('f.o')} <> {four('v.o')}) THEN FALSE WHEN {hi} AND {hi2} AND ({words('f.text_hi')} <> {words('v.text_hi')} OR {four('f.oh')} <> {four('v.oh')}) THEN FALSE ELSE TRUE END"
    differ = "concat_ws(',', " + ", ".join(f"CASE WHEN f.{x} IS NOT NULL AND v.{x} IS NOT NULL AND {words(f'f.{x}')} <> {words(f'v.{x}')} THEN '{x}' END" for x in fields) + ")"
    take = {x: f"coalesce(v.{x}, f.{x})" if later_wins else f"coalesce(f.{x}, v.{x})" for x in fields}
    take |= {"part": "f.part", "has_image": "f.has_image OR v.has_image", "uncertain": "f.uncertain OR v.uncertain", "lf": "array_to_string(list_sort(list_distinct(list_filter(string_split(concat_ws('|', f.lf, v.lf), '|'), lambda x: x <> ''))), '|')"}
    take |= {x: f"CASE WHEN NOT {en} AND {en2} THEN v.{x} ELSE f.{x} END" for x in ("text", "o")} | {x: f"CASE WHEN NOT {hi} AND {hi2} THEN v.{x} ELSE f.{x} END" for x in ("text_hi", "oh")}
    merge, replace = ("j.same", "coalesce(NOT j.same, TRUE)") if later_wins else ("j.same AND j.differ = ''", "FALSE")
    columns = ", ".join(f"CASE WHEN {merge} THEN {take[x]} WHEN {replace} THEN v.{x} ELSE f.{x} END AS {x}" for x in ("part", "text", "o", "text_hi", "oh", *fields, "lf", "has_image", "uncertain"))
    bad = "warning" if later_wins else "error"
    kind = f"CASE WHEN j.same IS NULL THEN '{bad}:incomparable' WHEN NOT j.same THEN '{bad}:different' WHEN NOT ({merge}) THEN '{bad}:fields' ELSE 'info:overlap' END"
    note = f"concat_ws(':', {kind}, v.part, f.part, CASE WHEN j.same AND NOT ({merge}) THEN j.differ ELSE '' END)"
    view = with_views(f"""WITH RECURSIVE_ v AS (SELECT *, row_number() OVER (PARTITION BY file, number ORDER BY part, place) AS r, count(*) OVER (PARTITION BY file, number) AS versions FROM ({VERSIONS.replace('{questions}', 'questions')}) WHERE number IS NOT NULL),
f AS (SELECT file, number, r, versions, part, text, o, text_hi, oh, {', '.join(fields)}, lf, has_image, uncertain, '' AS notes FROM v WHERE r = 1
 UNION ALL SELECT f.file, f.number, v.r, f.versions, {columns}, concat_ws(';', nullif(f.notes, ''), {note}) AS notes FROM f JOIN v ON v.file = f.file AND v.number = f.number AND v.r = f.r + 1, LATERAL (SELECT {same} AS same, {differ} AS differ) AS j)
SELECT file, number, part, text, o AS options, text_hi, oh AS options_hi, {', '.join(fields)}, coalesce(replace(lf, '|', ','), '') AS lang_flags, has_image, uncertain, CAST(versions AS INT) AS versions, notes FROM f WHERE r = versions""", "questions")  # fmt: skip
    return view.replace("RECURSIVE_ ", "").replace("WITH ", "WITH RECURSIVE ", 1)


ORACLES["merged_import"], ORACLES["merged_import_strict"] = _folded(True), _folded(False)
#: Read off the heads by hand: the place of each field's column.
_PLACES = {
    0: "a=2 answer=6 b=3 c=4 d=5 explanation=7 number=0 question=1 subject=8 topic=9", 1: "a=2 answer=6 b=3 c=4 d=5 explanation=7 number=0 question=1 subject=8 topic=9", 2: "a=2 answer=6 b=3 c=4 d=5 explanation=7 number=0 question=1 subject=8 topic=9",
    3: "a=3 answer=8 b=5 c=6 d=7 number=0 question=1", 4: "a=2 answer=6 b=3 c=4 d=5 number=1",
}
ORACLES["sheet_headers"] = with_views("SELECT question_id AS line, CASE paper_id % 5 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _PLACES.items()) + " END AS fields FROM questions", "questions")
ORACLES["subject_hints"] = ORACLES["subject_hints"].replace("lower(text)", "lower(text || CASE WHEN question_id % 4 = 0 THEN ' Red gear' ELSE '' END)")
ORACLES["cleaned_lines"] = """
WITH s AS (SELECT doc_id // 8 AS paper_id, doc_id % 8 AS page, string_split(coalesce(text, ''), chr(10)) AS body FROM documents WHERE doc_id IS NOT NULL),
x AS (SELECT paper_id, page, len(body) * 10 + 100.0 AS high, unnest([struct_pack(n := -1, top := 4.0, t := concat('Sectional Test ', paper_id, ' | ', page + 1)), struct_pack(n := -2, top := 12.0, t := CASE WHEN page % 2 = 0 THEN '12. Which of these' ELSE 'Name of the test 7' END), struct_pack(n := -3, top := 20.0, t := concat('mail', page + 1, '@site.example')),
  struct_pack(n := -4, top := 28.0, t := 'Call 98765432100'), struct_pack(n := -5, top := 36.0, t := concat('item ', page + 1, ' of'))]) AS y FROM s
  UNION ALL SELECT paper_id, page, len(body) * 10 + 100.0, struct_pack(n := CAST(i AS INT), top := 44.0 + 10 * i, t := body[i + 1]) FROM (SELECT *, unnest(range(len(body))) AS i FROM s)),
l AS (SELECT paper_id, page, y.n AS line_no, y.t AS text, CASE WHEN y.top < 0.1 * high OR y.top + 8 > 0.9 * high THEN concat(round_even(y.top / 8, 0), '#', regexp_replace(y.t, '\\d+\\s*[-–|]?\\s*$', '#')) END AS head,
  CASE WHEN lower(y.t) LIKE '%@%' OR lower(y.t) LIKE '%.com%' OR lower(y.t) LIKE '%www.%' OR regexp_matches(y.t, '\\d{8,}') THEN regexp_replace(lower(y.t), '\\d+', '#', 'g') END AS over FROM x),
p AS (SELECT paper_id, count(*) AS pages FROM s GROUP BY ALL),
h AS (SELECT paper_id, head FROM l JOIN p USING (paper_id) WHERE head IS NOT NULL GROUP BY paper_id, head, pages HAVING count(DISTINCT page) >= greatest(3, 0.4 * pages)), o AS (SELECT paper_id, over FROM l WHERE over IS NOT NULL GROUP BY ALL HAVING count(DISTINCT page) >= 3)
SELECT paper_id, page, line_no, text FROM l JOIN p USING (paper_id) WHERE pages < 3 OR regexp_matches(text, '^(\\d{1,3})[.)](?:\\s+(.*))?$') OR regexp_matches(text, '\\(\\s*([a-dA-D])\\s*\\)') OR regexp_matches(text, '^(?i)Ans(?:wer)?\\s*(?:[-–—:.]|\\()')
  OR ((paper_id, head) NOT IN (SELECT paper_id, head FROM h) IS NOT FALSE AND (paper_id, over) NOT IN (SELECT paper_id, over FROM o) IS NOT FALSE)"""
_POOL = "pool AS (SELECT area, question_id, row_number() OVER (PARTITION BY area ORDER BY question_id % 64, question_id) - 1 AS at_ FROM (SELECT 'topic:' || topic AS area, question_id FROM live WHERE topic IS NOT NULL UNION ALL SELECT 'subject:' || subject, question_id FROM live WHERE subject IS NOT NULL)), size AS (SELECT area, count(*) AS n FROM pool GROUP BY ALL)"


def _drawn(seed: str) -> str:
    """From asked (user_id, area, count): the numbers drawn and what they stand for."""
    chance = lambda x: f"CAST('0x' || substr(sha1('{seed}:' || user_id || ':' || {x}), 1, 15) AS BIGINT)"
    return f"""sized AS (SELECT a.*, n, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY area) - n AS BIGINT) AS begin_, CAST(sum(n) OVER (PARTITION BY user_id) AS BIGINT) AS total FROM (SELECT DISTINCT * FROM asked) a JOIN size USING (area)),
u AS (SELECT DISTINCT user_id, total, least(greatest(count, 1), 100, total) AS k FROM sized),
d AS (SELECT user_id, list_reduce(list_prepend(CAST([] AS BIGINT[]), list_transform(range(total - k, total), lambda j: [j])), lambda taken, x: list_append(taken, CASE WHEN list_contains(taken, {chance('x[1]')} % (x[1] + 1)) THEN x[1] ELSE {chance('x[1]')} % (x[1] + 1) END)) AS ts FROM u),
m AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY {chance("'order:' || t")}, t) AS position FROM (SELECT user_id, unnest(ts) AS t FROM d))
SELECT user_id, CAST(position AS INT) AS position, question_id FROM m JOIN sized USING (user_id) JOIN pool ON pool.area = sized.area AND pool.at_ = t - begin_ WHERE t >= begin_ AND t < begin_ + n"""


ORACLES["weak_area_draw"] = with_views(f"WITH {LIVE}, {_POOL}, asked AS (SELECT user_id, kind || ':' || name AS area, 10 AS count FROM ({_WEAK})), {_drawn('1')}", "papers", "questions", *R)
ORACLES["practice_draw"] = with_views(f"""WITH {LIVE}, {_POOL}, s AS (SELECT list_sort(list_distinct(list(subject))) AS s FROM live WHERE subject IS NOT NULL),
asked AS (SELECT user_id, 'subject:' || s[CAST(min(attempt_id) % len(s) AS INT) + 1] AS area, 1 + min(attempt_id) % 130 AS count FROM attempts, s GROUP BY user_id, s), {_drawn('2')}""", "papers", "questions", "attempts")  # fmt: skip
ORACLES["values_as_of"] = """WITH v AS (SELECT user_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS b FROM events WHERE event_id % 2 = 0) WHERE b = 1)
SELECT e.event_id AS moment_id, e.user_id AS entity, v.event_type, v.value FROM (SELECT event_id, user_id, ts - INTERVAL 30 HOURS AS at_ FROM events) e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.at_ >= v.ts"""
ORACLES["mistake_draw"] = f"SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY due NULLS LAST, question_id) AS INT) AS position, question_id FROM ({ORACLES['revision_schedule']}) WHERE status = 'active' QUALIFY position <= 5"
ORACLES["mistake_draw_shuffled"] = f"SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY sha1('1:' || user_id || ':' || question_id)) AS INT) AS position, question_id FROM ({ORACLES['mistake_notebook']}) QUALIFY position <= 5"
_PAIRS = ORACLES["duplicate_page"][: ORACLES["duplicate_page"].index("SELECT * FROM sp")]
ORACLES["decided_pairs"] = _PAIRS + """SELECT * FROM (SELECT *, CASE WHEN newer % 11 > 0 THEN DATE '2024-01-01' + CAST(newer * 7 % 365 AS INT) END AS decided_at FROM sp) WHERE status <> 'open'
  AND (newer IN (SELECT question_id FROM questions WHERE paper_id % 2 = 0) OR older IN (SELECT question_id FROM questions WHERE paper_id % 2 = 0)) ORDER BY decided_at DESC NULLS LAST, newer, older LIMIT 50"""
ORACLES["practice_screen_time"] = """SELECT user_id AS attempt_id, event_id % 20 AS question_id, CAST(sum(CASE WHEN nx IS NULL THEN 0 ELSE least(CAST(floor((epoch_us(CASE WHEN event_id % 3 > 0 AND nx > ts + INTERVAL 40 SECONDS THEN ts + INTERVAL 40 SECONDS ELSE nx END) - epoch_us(ts)) / 1000000.0) AS BIGINT), 300) END) AS BIGINT) AS seconds
FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events) GROUP BY ALL"""
ORACLES["cleaned_texts"] = """WITH o AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'a\\n b ' || chr(9) || ' c' || chr(1) || ' ' || chr(160) || chr(10) || text WHEN 1 THEN translate(text, chr(10), ' ') || '\\n \\n end' || chr(13) ELSE replace(text, chr(10), chr(13) || chr(10)) END AS t FROM documents),
l AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\\r\\n?', chr(10), 'g'), '[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') AS t FROM o), r AS (SELECT doc_id, CASE WHEN contains(t, chr(10)) THEN t ELSE replace(t, '\\n', chr(10)) END AS t FROM l)
SELECT doc_id, regexp_replace(array_to_string(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \\t]+', ' ', 'g'), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), chr(10)), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS text FROM r"""
ORACLES["import_skip"] = with_views("SELECT question_id AS number, CASE WHEN question_id % 3 = 2 THEN text || '!' ELSE text END AS text, CASE WHEN question_id % 3 = 2 THEN 'needs_review' ELSE status END AS status, CASE question_id % 3 WHEN 0 THEN 'kept' WHEN 1 THEN 'skipped' ELSE 'created' END AS action FROM questions", "questions")
for _show, _rule in {"confirmed": "status IN ('verified', 'live')", "no_subject": "subject IS NULL", "ai_answers": "answer_source = 'ai' AND correct_answer IS NOT NULL"}.items():
    ORACLES[f"review_list_{_show}"] = with_views(f"SELECT question_id, CAST(NOT flagged AS INT) AS first FROM questions WHERE status <> 'quarantined' AND {_rule}", "questions")
ORACLES["explanation_letters"] = with_views(f"""WITH s AS (SELECT question_id, replace(({SAYINGS!r})[CAST(1 + question_id % {len(SAYINGS)} AS INT)], '{{}}', CASE WHEN question_id % 2 = 0 THEN true_letter ELSE lower(true_letter) END) AS s FROM questions),
f AS (SELECT question_id, list_distinct(list_transform(list_concat(list_concat(regexp_extract_all(s, '(?i)(?:correct|right|desired|final)\\s+(?:answer|option)\\s*(?:is|:|=|-)?\\s*(?:option\\s*)?\\(\\s*([a-e])\\s*\\)', 1),
  regexp_extract_all(s, '(?i)(?:answer|option)\\s*(?:is|:|=)?\\s*\\(\\s*([a-e])\\s*\\)\\s*(?:is\\s+)?(?:the\\s+)?(?:correct|right)', 1)), regexp_extract_all(s, '(?i)\\boption\\s*\\(\\s*([a-e])\\s*\\)\\s+is\\s+(?:the\\s+)?(?:correct|right)', 1)), lambda x: upper(x))) AS l FROM s)
SELECT question_id, CASE WHEN len(l) = 1 THEN l[1] END AS letter FROM f""", "questions")
ORACLES["question_languages"] = with_views(f"""WITH l AS ({LANGUAGES.replace('{questions}', 'questions')}), a AS (SELECT question_id, coalesce(trim(t), '') <> '' AS en, coalesce(trim(h), '') <> '' AS hi, concat_ws(' ', t, h) AS x FROM l)
SELECT question_id, CASE WHEN en AND hi THEN 'both' WHEN hi THEN 'hi' WHEN en THEN 'en' ELSE 'none' END AS languages, round_even({_SHARE('x')}, 6) AS share FROM a""", "questions")
ORACLES["mark_shares"] = with_views(f"""SELECT question_id, (['0.3333', '0.6667', '0.25', '1', NULL, '0', NULL, NULL, NULL, NULL, NULL, NULL])[CAST(1 + question_id % {len(SHARES)} AS INT)]::DOUBLE AS share FROM questions""", "questions")
