"""What is wrong with imported questions, how parts merge, and what an import writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ENGLISH_MOST, HINDI_LEAST, LONG_OPTION, devanagari_share, option_key, sheet_answer


def _issue(cond: Column, level: str, code: str, message: Column | None = None) -> Column:
    return F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), (F.lit(code) if message is None else message).alias("message")))


# Fixed value: the length below which a question is doubtful.
SHORT_TEXT = 15


def question_issues(questions: DataFrame, subjects: list[str]) -> DataFrame:
    """(file, part, place, number, level, code, message) for questions (file, part, place, q): each rule that a question breaks. Questions
    with an error are not imported; those with warnings are flagged."""
    q = lambda f: F.col(f"q.{f}")
    none = F.create_map().cast("map<string,string>")
    options, options_hi = F.coalesce(q("options"), none), F.coalesce(q("options_hi"), none)
    filled = lambda m: F.filter(F.map_values(m), lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
    n_options, n_hindi = F.size(filled(options)), F.size(filled(options_hi))
    keys = F.concat(F.map_keys(options), F.map_keys(options_hi))
    letters = F.transform(F.map_keys(options), option_key)
    answer = option_key(q("correct_answer"))
    given = F.coalesce(F.trim(q("correct_answer")), F.lit("")) != ""
    text = F.coalesce(F.trim(q("question")), F.lit(""))
    hindi = F.coalesce(F.trim(q("question_hi")), F.lit(""))
    told = lambda s, m: F.concat_ws(" ", s, F.array_join(filled(m), " "))
    twice = F.count("*").over(Window.partitionBy("file", "part", "q.number"))
    rows = questions.withColumn("twice", twice)
    number = q("number")
    lacks = F.array_join(F.array_except(F.array(*[F.lit(x) for x in "ABCD"]), letters), ", ")
    rules = [
        _issue(number.isNull(), "error", "number_missing", F.lit("no number")), _issue(~number.between(1, 999), "error", "number_range", F.concat(F.lit("number "), number.cast("string"))),
        _issue(number.isNotNull() & (F.col("twice") > 1), "error", "number_twice", F.concat(F.lit("number "), number.cast("string"), F.lit(" stands "), F.col("twice").cast("string"), F.lit(" times"))),
        _issue((text == "") & (hindi == ""), "error", "text_missing", F.lit("no text")), _issue(F.length(text) > 5000, "warning", "text_long", F.concat(F.length(text).cast("string"), F.lit(" characters"))),
        _issue((text != "") & (F.length(text) < SHORT_TEXT), "warning", "text_short", text), _issue((hindi != "") & (F.length(hindi) < SHORT_TEXT), "warning", "text_hi_short", hindi),
        _issue(q("options").isNull() & q("options_hi").isNull(), "error", "options_missing", F.lit("no options")), _issue((n_options > 0) & (n_options < 4), "error", "options_few", F.concat(F.lit("lacks "), lacks)), _issue((n_hindi > 0) & (n_hindi < 4), "error", "options_hi_few", F.concat(n_hindi.cast("string"), F.lit(" options"))),
        _issue(F.exists(keys, lambda k: k.rlike("^[1-4]$")), "error", "option_numbered", F.lit("options are numbered")), _issue(F.exists(keys, lambda k: option_key(k).isNull() & ~k.rlike("^[1-4]$")), "error", "option_key", F.array_join(keys, ", ")),
        _issue(F.size(F.array_distinct(letters)) < F.size(letters), "error", "option_key_twice", F.array_join(F.map_keys(options), ", ")), _issue(F.exists(keys, lambda k: k.rlike("[\u0915-\u0918]")), "warning", "option_key_hindi", F.array_join(keys, ", ")),
        _issue(F.exists(F.concat(F.map_values(options), F.map_values(options_hi)), lambda x: F.length(x) > LONG_OPTION), "warning", "option_long", F.lit("an option is long")),
        _issue(F.coalesce(F.size(F.array_distinct(F.transform(F.map_values(options), lambda x: F.lower(F.trim(x))))) < F.size(options), F.lit(False)), "warning", "options_equal", F.lit("two options are equal")),
        _issue(given & answer.isNull(), "error", "answer_form", F.substring(q("correct_answer"), 1, 30)), _issue((answer == "E") & (n_options < 5), "error", "answer_without_option", F.lit("E")), _issue(~given, "info", "answer_missing", F.lit("no answer")),
        _issue(q("subject").isNotNull() & ~F.lower(F.trim(q("subject"))).isin([s.lower() for s in subjects]), "warning", "subject_unknown", F.substring(q("subject"), 1, 40)), _issue(q("topic").isNotNull() & q("subject").isNull(), "warning", "topic_without_subject", q("topic")),
        _issue(F.coalesce(q("page") < 1, F.lit(False)), "warning", "page_range", q("page").cast("string")), _issue(F.coalesce(q("uncertain"), F.lit(False)), "info", "uncertain", F.lit("uncertain")),
        _issue((text.contains("[IMAGE]") | hindi.contains("[IMAGE]")) & ~F.coalesce(q("has_image"), F.lit(False)), "warning", "image_unmarked", F.lit("[IMAGE]")),
        _issue(((text != "") != (n_options > 0)) & (hindi != "") & (n_hindi >= 4), "warning", "english_incomplete", F.lit("English has only text or only options")), _issue(((hindi != "") != (n_hindi > 0)) & (text != "") & (n_options >= 4), "warning", "hindi_incomplete", F.lit("Hindi has only text or only options")),
        _issue(F.coalesce(devanagari_share(told(hindi, options_hi)) < HINDI_LEAST, F.lit(False)), "warning", "hindi_script", F.lit("Hindi is hardly Devanagari")), _issue(F.coalesce(devanagari_share(told(text, options)) > ENGLISH_MOST, F.lit(False)), "warning", "english_script", F.lit("English is Devanagari")),
    ]
    return rows.select("file", "part", "place", F.col("q.number").alias("number"), F.explode(F.array_compact(F.array(*rules))).alias("x")).select("file", "part", "place", "number", "x.level", "x.code", "x.message")


# How grave each code of files.json_objects is; all others are errors.
PART_WARNINGS = ["bare_list", "no_schema_version", "text_before", "text_after"]


def part_issues(objects: DataFrame) -> DataFrame:
    """(file, part, level, code, number) of the parts of files (files.json_objects): what is wrong with their form, and the question near
    which one breaks off."""
    rows = objects.select("file", "part", F.explode("codes").alias("code"), F.col("near").alias("number"))
    return rows.select("file", "part", F.when(F.col("code").isin(PART_WARNINGS), "warning").otherwise("error").alias("level"), "code", "number")


def raw_issues(raw: DataFrame) -> DataFrame:
    """(file, part, place, level, code) for questions as JSON texts (file, part, place, raw): fields of a wrong type, and two answers."""
    x = F.parse_json("raw")
    kind = lambda f: F.schema_of_variant(F.variant_get(x, F.lit(f"$.{f}"), "variant"))
    wrong = lambda f, *kinds: F.coalesce(~kind(f).isin("VOID", *kinds) & (kind(f) != ""), F.lit(False))
    value = lambda f: F.try_variant_get(x, F.lit(f"$.{f}"), "string")
    is_object = lambda f: kind(f).startswith("OBJECT") | (kind(f) == "VOID")
    rules = [_issue(wrong(f, "STRING"), "error", f"{f}_type") for f in ("question", "question_hi", "explanation", "explanation_hi")]
    rules += [_issue(F.coalesce(~is_object(f), F.lit(False)), "error", f"{f}_type") for f in ("options", "options_hi")]
    rules += [_issue(wrong(f, "BOOLEAN") & ~F.lower(value(f)).isin("true", "false"), "warning", f"{f}_type") for f in ("has_image", "uncertain")]
    rules += [_issue(kind(f).isNotNull(), "error", f"{f}_unsupported") for f in ("answer_en", "answer_hi")]
    rules += [_issue(F.coalesce((F.nullif(value("answer"), F.lit("")) != F.nullif(value("correct_answer"), F.lit(""))), F.lit(False)), "error", "answers_disagree")]
    return raw.select("file", "part", "place", F.explode(F.array_compact(F.array(*rules))).alias("x")).select("file", "part", "place", "x.level", "x.code")


def known_topics(questions: DataFrame, topics: DataFrame) -> DataFrame:
    """questions whose topic is null unless it exists under their subject (in any case); topics: all (subject, topic)."""
    known = topics.select(F.lower("subject").alias("s"), F.lower("topic").alias("t")).distinct().withColumn("known", F.lit(True))
    rows = questions.withColumn("s", F.lower("subject")).withColumn("t", F.lower("topic")).join(known, ["s", "t"], "left")
    return rows.withColumn("topic", F.when(F.col("known"), F.col("topic"))).drop("s", "t", "known")


def part_summary(questions: DataFrame) -> DataFrame:
    """(file, part, n, first, last) of the questions of each part."""
    n = F.col("q.number")
    return questions.groupBy("file", "part").agg(F.count("*").alias("n"), F.min(n).alias("first"), F.max(n).alias("last"))


def uncovered(questions: DataFrame, covered: DataFrame) -> DataFrame:
    """(file, number): numbers that a file says it covers (file, first, last), but that no question has."""
    wanted = covered.where("last >= first").select("file", F.explode(F.sequence("first", "last")).alias("number"))
    return wanted.join(questions.select("file", F.col("q.number").cast("int").alias("number")), ["file", "number"], "left_anti").distinct()


def report_counts(questions: DataFrame, existing: DataFrame) -> DataFrame:
    """Per file: what an import would bring. existing: (file, number) that are there already."""
    q = lambda f: F.coalesce(F.trim(F.col(f"q.{f}")), F.lit("")) != ""
    here = existing.select("file", F.col("number").alias("n_")).distinct().withColumn("here", F.lit(True))
    rows = questions.withColumn("n_", F.col("q.number")).join(here, ["file", "n_"], "left")
    hindi = q("question_hi") | F.coalesce(F.size("q.options_hi") > 0, F.lit(False))
    true = lambda c: F.coalesce(c, F.lit(False))
    numbers = {
        "with_answer": q("correct_answer"), "without_answer": ~q("correct_answer"), "with_explanation": q("explanation"), "uncertain": true(F.col("q.uncertain")), "images": true(F.col("q.has_image")), "no_subject": F.col("q.subject").isNull(),
        "both": q("question") & hindi, "english_only": q("question") & ~hindi, "hindi_only": ~q("question") & hindi, "existing": true(F.col("here")),
    }
    return rows.groupBy("file").agg(F.count("*").alias("questions"), *[F.count_if(c).alias(k) for k, c in numbers.items()])


def import_duplicates(questions: DataFrame, known: DataFrame) -> DataFrame:
    """(file, number, of): questions (file, number, norm_hash) that are equal to one with a smaller number of their file (of: file), or to
    one in the bank (of: bank). known: norm_hash."""
    first = questions.groupBy("file", "norm_hash").agg(F.min("number").alias("first"))
    within = questions.join(first, ["file", "norm_hash"]).where("number > first").select("file", "number", F.lit("file").alias("of"))
    return within.unionAll(questions.join(known.select("norm_hash"), "norm_hash", "left_semi").select("file", "number", F.lit("bank").alias("of")))


# What a sheet needs, and how many of a problem a report lists.
REQUIRED = ["question", "a", "b", "c", "d"]


def sheet_issues(rows: DataFrame, subjects: list[str], topics: DataFrame) -> DataFrame:
    """(file, line, number, level, code) for rows of sheets (file, line, fields; see files.map_headers). topics: all (subject, topic).

    A row without a number column counts its place. A number that stands twice names its first line as `first_line`."""
    cell = lambda f: F.coalesce(F.trim(F.try_element_at(F.col("fields"), F.lit(f))), F.lit(""))
    has = lambda f: F.col("fields").isNotNull() & F.array_contains(F.map_keys("fields"), f)
    place = F.row_number().over(Window.partitionBy("file").orderBy("line")).cast("int")
    number = F.when(has("number"), F.regexp_extract(cell("number"), r"\d+", 0).try_cast("int")).otherwise(place)
    found = rows.withColumn("number", number)
    found = found.withColumn("first_line", F.when(F.col("number").isNotNull(), F.min("line").over(Window.partitionBy("file", "number"))))
    canon = F.create_map(*[F.lit(x) for s in subjects for x in (s.lower(), s)]) if subjects else F.create_map().cast("map<string,string>")
    found = found.withColumn("s", F.lower(F.try_element_at(canon, F.lower(cell("subject"))))).withColumn("t", F.lower(cell("topic")))
    known = topics.select(F.lower("subject").alias("s"), F.lower("topic").alias("t")).distinct().withColumn("known", F.lit(True))
    found = found.join(known, ["s", "t"], "left")
    lacking = [f for f in REQUIRED]
    rules = [
        *[_issue(~has(f), "error", f"no_column_{f}") for f in lacking], _issue(F.col("number").isNull(), "error", "number_unreadable"), _issue(F.col("first_line") < F.col("line"), "error", "number_twice"),
        _issue(has("question") & (cell("question") == ""), "error", "text_missing"), *[_issue(has(x) & (cell(x) == ""), "error", f"option_{x}_empty") for x in "abcd"],
        _issue((cell("answer") != "") & sheet_answer(cell("answer")).isNull(), "warning", "answer_unclear"), _issue(cell("answer") == "", "warning", "no_answer_found"),
        _issue((cell("subject") != "") & F.col("s").isNull(), "warning", "subject_unknown"), _issue((cell("topic") != "") & F.col("known").isNull(), "warning", "topic_unknown"),
    ]
    return found.select("file", "line", "number", "first_line", F.explode(F.array_compact(F.array(*rules))).alias("x")).select("file", "line", "number", "first_line", "x.level", "x.code")


def chapter_issues(chapters: DataFrame, questions: DataFrame) -> DataFrame:
    """(file, number, level, code) of book chapters (file, subject, chapter_no, chapter, question_count, n) and their questions (file, place,
    q; see files.book_chapters). Rows of a chapter have no number."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    twice = F.row_number().over(Window.partitionBy(F.lower("subject"), "chapter_no").orderBy("file"))
    c = chapters.withColumn("twice", twice)
    rules = [
        _issue(~F.coalesce(F.col("chapter_no") >= 1, F.lit(False)), "error", "chapter_no"), _issue(blank("chapter"), "error", "chapter_name"), _issue(F.col("chapter_no").isNotNull() & (F.col("twice") > 1), "error", "chapter_twice"),
        _issue(blank("subject"), "error", "subject_missing"), _issue(F.coalesce(F.col("question_count") != F.col("n"), F.lit(False)), "warning", "question_count"),
    ]
    of_chapters = c.select("file", F.lit(None).cast("int").alias("number"), F.explode(F.array_compact(F.array(*rules))).alias("x"))
    q = lambda f: F.col(f"q.{f}")
    options = F.coalesce(q("options"), F.create_map().cast("map<string,string>"))
    keys = F.array_sort(F.transform(F.map_keys(options), lambda k: F.lower(F.trim(k))))
    answer = F.lower(F.trim(q("answer")))
    marks = F.filter(F.coalesce(q("needs_review"), F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    again = F.row_number().over(Window.partitionBy("file", "q.number").orderBy("place"))
    rules = [
        _issue(~F.coalesce(q("number") >= 1, F.lit(False)), "error", "number"), _issue(q("number").isNotNull() & (F.col("again") > 1), "error", "number_twice"), _issue(blank(q("question")), "error", "text_missing"),
        _issue(F.exists(keys, lambda k: ~k.rlike("^[a-e]$")), "error", "option_key"), _issue(F.exists(F.map_values(options), lambda v: F.coalesce(F.trim(v), F.lit("")) == ""), "error", "option_empty"),
        _issue(~F.array_join(F.filter(keys, lambda k: k.rlike("^[a-e]$")), "").isin("abcd", "abcde"), "error", "options"), _issue((answer != "") & ~answer.rlike("^[a-e]$"), "error", "answer_form"),
        _issue(answer.rlike("^[a-e]$") & ~F.array_contains(keys, answer), "error", "answer_without_option"), _issue(blank(q("answer")), "warning", "answer_missing"), _issue(F.size(marks) > 0, "warning", "marked_for_review"),
    ]
    of_questions = questions.withColumn("again", again).select("file", F.col("q.number").cast("int").alias("number"), F.explode(F.array_compact(F.array(*rules))).alias("x"))
    return of_chapters.unionAll(of_questions).select("file", "number", "x.level", "x.code")


#: Fields that two versions of one question may fill in for each other.
MERGED = ("answer", "explanation", "explanation_hi", "subject", "topic", "page")
WHOLE = ("part", "text", "options", "text_hi", "options_hi", *MERGED, "lang_flags", "has_image", "uncertain")


def same_words(s: Column) -> Column:
    """Lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(s.cast("string"), F.lit(""))), r"[\s\p{Z}]+", " "))


def _merged(later_wins: bool):
    """One step of the fold: (q, notes) and the next version of the same number."""

    def has(q: Column) -> tuple[Column, Column]:
        given = lambda c: F.coalesce(c, F.lit("")) != ""
        return given(q["text"]), given(q["text_hi"]) | (F.coalesce(F.size(q["options_hi"]), F.lit(0)) > 0)

    def alike(a: Column, b: Column, text: str, options: str) -> Column:
        four = lambda q: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: same_words(F.get(q[options], i)))
        return (same_words(a[text]) == same_words(b[text])) & (four(a) == four(b))

    def judged(state: Column, new: Column) -> Column:
        old = state["q"]
        (en, hi), (en2, hi2) = has(old), has(new)
        both_en, both_hi = en & en2, hi & hi2
        same = F.when(both_en | both_hi, (~both_en | alike(old, new, "text", "options")) & (~both_hi | alike(old, new, "text_hi", "options_hi")))
        differ = F.array_compact(F.array(*[F.when(old[f].isNotNull() & new[f].isNotNull() & (same_words(old[f]) != same_words(new[f])), f) for f in MERGED]))
        return F.struct(old.alias("q"), state["notes"].alias("notes"), new.alias("new"), same.alias("same"), differ.alias("differ"), en.alias("en"), hi.alias("hi"), en2.alias("en2"), hi2.alias("hi2"))

    def step(state: Column, new: Column) -> Column:
        once = F.transform(F.array(judged(state, new)), settle)
        return F.get(once, F.lit(0))

    def settle(s: Column) -> Column:
        old, new, later = s["q"], s["new"], F.lit(later_wins)
        same = F.coalesce(s["same"], F.lit(False))
        blocked = same & (F.size(s["differ"]) > 0) & ~later
        merge, replace = same & ~blocked, ~same & later
        own = {f: F.coalesce(new[f], old[f]) if later_wins else F.coalesce(old[f], new[f]) for f in MERGED}
        own |= {f: F.when(~s["en"] & s["en2"], new[f]).otherwise(old[f]) for f in ("text", "options")} | {f: F.when(~s["hi"] & s["hi2"], new[f]).otherwise(old[f]) for f in ("text_hi", "options_hi")}
        own |= {"part": old["part"], "lang_flags": F.array_sort(F.array_union(old["lang_flags"], new["lang_flags"])), "has_image": old["has_image"] | new["has_image"], "uncertain": old["uncertain"] | new["uncertain"]}
        q = F.struct(*[F.when(merge, own[f]).when(replace, new[f]).otherwise(old[f]).alias(f) for f in WHOLE])
        kind = F.when(s["same"].isNull(), "incomparable").when(~same, "different").when(blocked, "fields").otherwise("overlap")
        level = F.when(merge, "info").otherwise("warning" if later_wins else "error")
        note = F.struct(level.alias("level"), kind.alias("kind"), new["part"].alias("part"), old["part"].alias("other"), F.when(blocked, F.array_join(s["differ"], ",")).otherwise("").alias("fields"))
        return F.struct(q.alias("q"), F.array_append(s["notes"], note).alias("notes"))

    return step


NOTES = "array<struct<level:string,kind:string,part:int,other:int,fields:string>>"


def merge_parts(questions: DataFrame, later_wins: bool = False, keys: tuple[str, ...] = ("file", "number")) -> DataFrame:
    """One row for each key of the parts' questions (keys, part int, place, and the fields of WHOLE): the parts' versions of a number are
    folded in the order of part and place. notes says what each further version met; versions counts them.

    Two versions are the same question if every language that both have agrees in text and options (case and spacing aside). The same
    question merges: what one lacks the other fills in, a missing language too, and warnings add up (overlap); if both say different
    things in a field, that is an error that changes nothing (fields), or the later version's field stands where later parts win. Another
    question under the number (different), or one that shares no language with it (incomparable), is an error that changes
    nothing, or replaces the earlier one as a whole. Rows without a number are left out. A number's versions are as few as the parts."""
    none = F.array().cast("array<string>")
    order = [F.col("part").cast("int").alias("part"), F.col("place").cast("long").alias("place")]
    filled = {"lang_flags": F.coalesce("lang_flags", none), "has_image": F.coalesce("has_image", F.lit(False)), "uncertain": F.coalesce("uncertain", F.lit(False)), "part": F.col("part").cast("int"), "page": F.col("page").cast("int")}
    rest = [filled.get(f, F.col(f)).alias(f) for f in WHOLE]
    rows = questions.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*rest).alias("q")))).alias("x"))
    versions = F.transform("x", lambda x: x["q"])
    begin = F.struct(F.get(versions, F.lit(0)).alias("q"), F.array().cast(NOTES).alias("notes"))
    folded = F.aggregate(F.slice(versions, F.lit(2), F.greatest(F.lit(1), F.size("x"))), begin, _merged(later_wins))
    return rows.select(*keys, F.size("x").alias("versions"), folded.alias("f")).select(*keys, "f.q.*", "versions", "f.notes")


def merge_report(merged: DataFrame, keys: tuple[str, ...] = ("file", "number")) -> DataFrame:
    """(keys, level, kind, part, other, fields): the notes of merge_parts as rows. A file with an error is not imported."""
    return merged.select(*keys, F.explode("notes").alias("x")).select(*keys, "x.*")


def screened(incoming: DataFrame, known: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """incoming (number, norm_hash, ...) without questions that the bank knows (known: norm_hash) and without numbers beyond 1..most."""
    if known is not None:
        incoming = incoming.join(known.select("norm_hash"), "norm_hash", "left_anti")
    return incoming if most is None else incoming.where(F.col("number").between(1, most))


def apply_import(existing: DataFrame, incoming: DataFrame, mode: str) -> DataFrame:
    """(number, text, status, action) of a paper after an import. existing, incoming: number, text, status. With a paper_id in both, of
    every paper, each by itself.

    mode: skip (existing numbers stay), replace (those still under review are replaced), fill (only blank texts are), append (all
    get new numbers after the paper's last). See screened for questions to leave out."""
    paper = ["paper_id"] if "paper_id" in existing.columns else []
    if mode == "append":
        if not paper:
            existing, incoming = existing.withColumn("paper_id", F.lit(0)), incoming.withColumn("paper_id", F.lit(0))
        top = existing.groupBy("paper_id").agg(F.max("number").alias("top"))
        k = F.row_number().over(Window.partitionBy("paper_id").orderBy("number", "text"))
        fresh = incoming.withColumn("k", k).join(top, "paper_id", "left").select("paper_id", (F.coalesce("top", F.lit(0)) + F.col("k")).alias("number"), "text", F.lit("needs_review").alias("status"), F.lit("created").alias("action"))
        both = existing.select("paper_id", "number", "text", "status", F.lit("kept").alias("action")).unionByName(fresh)
        return both if paper else both.drop("paper_id")
    a, b = existing.select(*paper, "number", F.col("text").alias("old"), "status"), incoming.select(*paper, "number", F.col("text").alias("new"))
    rows = a.join(b, [*paper, "number"], "full_outer")
    is_new, both = F.col("status").isNull(), F.col("status").isNotNull() & F.col("new").isNotNull()
    over = both & {"skip": F.lit(False), "replace": F.col("status").isin("needs_review", "draft"), "fill": F.coalesce(F.trim("old"), F.lit("")) == ""}[mode]
    return rows.select(*paper, "number", F.when(is_new | over, F.col("new")).otherwise(F.col("old")).alias("text"), F.when(is_new | over, "needs_review").otherwise(F.col("status")).alias("status"), F.when(is_new, "created").when(over, "replaced").when(both, "skipped").otherwise("kept").alias("action"))


def write_report(issues: DataFrame, path: str) -> None:
    """Writes issues, counts or a queue as JSON lines, in folders by level where there is one, for whoever mends the files."""
    writer = issues.write.mode("overwrite")
    (writer.partitionBy("level") if "level" in issues.columns else writer).json(path)
