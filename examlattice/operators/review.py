"""Review, gates, samples, keys and history of papers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


# A sample audit's share, least size and failing number; reasons of versions that change no content.
SHARE, LEAST, FAIL = 0.1, 5, 3
FILING = ["subject/topic/difficulty", "bulk subject change", "subject suggestion accepted"]
CONFIRMED = ["verified", "live"]


def counters(questions: DataFrame) -> DataFrame:
    """Per paper: how many questions that are not in quarantine stand where in review. questions: text and text_hi tell the languages."""
    open_ = F.col("status").isin("draft", "needs_review")
    answered = F.col("correct_answer").isNotNull()
    clean = ~F.col("flagged")
    en, hi = F.coalesce(F.trim("text"), F.lit("")) != "", F.coalesce(F.trim("text_hi"), F.lit("")) != ""
    active = F.col("status") != "quarantined"
    counted = {
        "total": F.lit(True), "to_confirm": open_, "confirmed": ~open_, "live": F.col("status") == "live", "flagged": F.col("flagged"), "clean": open_ & clean, "bulk_confirmable": open_ & answered & clean & (F.col("answer_source") != "ai"),
        "ai_answers": answered & (F.col("answer_source") == "ai"), "no_subject": F.col("subject").isNull(), "suggested": F.col("subject").isNull() & F.col("suggested").isNotNull(), "bilingual": en & hi, "hindi_only": hi & ~en,
    }
    return questions.groupBy("paper_id").agg(*[F.count_if(active & c).alias(k) for k, c in counted.items()], F.count_if(~active).alias("quarantined"))


def bulk_confirm(questions: DataFrame, acknowledge: bool = False) -> DataFrame:
    """questions after a bulk confirmation: open ones with an answer become verified, if they carry no warning and the answer is not an
    AI's; with acknowledge those with warnings and AI answers as well, whose warnings then count as seen."""
    open_ = F.col("status").isin("draft", "needs_review") & F.col("correct_answer").isNotNull()
    good = open_ if acknowledge else open_ & ~F.col("flagged") & (F.col("answer_source") != "ai")
    rows = questions.withColumn("acknowledged", F.when(good, F.col("acknowledged") | F.col("flagged")).otherwise(F.col("acknowledged")))
    return rows.withColumn("status", F.when(good, "verified").otherwise(F.col("status")))


def unedited_confirmed(questions: DataFrame, versions: DataFrame) -> DataFrame:
    """Confirmed questions whose content nobody has edited. versions (question_id, reason): pages read again and filings are no edits;
    a version without a reason is one."""
    reason = F.coalesce("reason", F.lit(""))
    edited = versions.where(~reason.rlike("(?s)^pages .* read again$") & ~reason.isin(FILING)).select("question_id")
    return questions.where(F.col("status").isin(CONFIRMED)).join(edited, "question_id", "left_anti")


def audit_blockers(papers: DataFrame, pool: DataFrame, least: int = LEAST) -> DataFrame:
    """(paper_id, audit): why the sample audit keeps a paper from being published: pending, failed or missing (never passed though `least`
    questions of the pool were confirmed unedited); null if it does not. papers: audit_state."""
    own = pool.groupBy("paper_id").agg(F.count("*").alias("pool"))
    state = F.coalesce("audit_state", F.lit("none"))
    audit = F.when(state == "pending", "pending").when(state == "failed", "failed").when((state == "none") & (F.coalesce("pool", F.lit(0)) >= least), "missing")
    return papers.join(own, "paper_id", "left").select("paper_id", audit.alias("audit"))


def publish_blockers(papers: DataFrame, questions: DataFrame, versions: DataFrame) -> DataFrame:
    """(paper_id, blockers): why a paper cannot be published, comma-joined in a fixed order; empty if it can."""
    c = F.col
    active = questions.where("status != 'quarantined'")
    own = active.groupBy("paper_id").agg(
        F.count("*").alias("n"), F.count_if(c("status").isin("draft", "needs_review")).alias("open"), F.count_if(~F.coalesce(c("correct_answer").isin(*"ABCDE"), F.lit(False))).alias("unanswered"),
        F.count_if(c("status").isin(CONFIRMED) & c("flagged") & ~c("acknowledged")).alias("flags"))
    rows = papers.join(own, "paper_id", "left").join(audit_blockers(papers, unedited_confirmed(questions, versions)), "paper_id", "left")
    why = [(c("status") != "ready", "not_ready"), (c("archived"), "archived"), (F.coalesce("n", F.lit(0)) == 0, "empty"), (c("open") > 0, "to_confirm"), (c("unanswered") > 0, "no_answer"), (c("flags") > 0, "flagged"), (c("audit").isNotNull(), "audit")]
    return rows.select("paper_id", F.array_join(F.array_compact(F.array(*[F.when(cond, name) for cond, name in why])), ",").alias("blockers"))


def publish(questions: DataFrame, blockers: DataFrame) -> DataFrame:
    """questions after each paper without blockers is published: verified ones go live, but those held back for a missing picture."""
    free = blockers.where("blockers = ''").select("paper_id", F.lit(True).alias("free"))
    goes = F.col("free") & (F.col("status") == "verified") & ~(F.col("has_image") & ~F.col("has_snapshot"))
    return questions.join(free, "paper_id", "left").withColumn("status", F.when(goes, "live").otherwise(F.col("status"))).drop("free")


def missing_numbers(questions: DataFrame, papers: DataFrame) -> DataFrame:
    """(paper_id, question_number) of 1..expected (or the largest seen) that no question has."""
    top = papers.join(questions.groupBy("paper_id").agg(F.max("question_number").alias("seen")), "paper_id", "left").select("paper_id", F.coalesce("expected_total", "seen").alias("top"))
    wanted = top.where("top > 0").select("paper_id", F.explode(F.sequence(F.lit(1), "top")).alias("question_number"))
    return wanted.join(questions.select("paper_id", "question_number"), ["paper_id", "question_number"], "left_anti")


def numbers_beyond(questions: DataFrame, papers: DataFrame) -> DataFrame:
    """(paper_id, question_number) beyond the number of questions that a paper should have."""
    return questions.join(papers.select("paper_id", "expected_total"), "paper_id").where("question_number > expected_total").select("paper_id", "question_number").distinct()


def audit_sample(pool: DataFrame, share: float = SHARE, least: int = LEAST, seed: str = "1") -> DataFrame:
    """(paper_id, question_id, place): a tenth of each paper's pool (see unedited_confirmed), five at least, drawn by a seeded hash."""
    w = Window.partitionBy("paper_id")
    order = F.sha1(F.concat_ws(":", F.lit(seed), F.col("question_id").cast("string")))
    rows = pool.withColumn("n", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy(order, "question_id")))
    return rows.where(F.col("place") <= F.greatest(F.lit(least), F.ceil(share * F.col("n")))).select("paper_id", "question_id", "place")


def audit_outcome(checked: DataFrame, allowed: int = FAIL) -> DataFrame:
    """Per paper of checked (paper_id, question_id, wrong): counts and whether it passes."""
    return checked.groupBy("paper_id").agg(F.count("*").alias("checked"), F.count_if("wrong").alias("wrong")).withColumn("passed", F.col("wrong") < allowed)


def audit_finish(questions: DataFrame, pool: DataFrame, checked: DataFrame) -> DataFrame:
    """questions after the audits of checked: what was found wrong goes back to review, and all of the pool of a paper that failed."""
    failed = audit_outcome(checked).where("NOT passed").select("paper_id")
    back = checked.where("wrong").select("question_id").unionAll(pool.join(failed, "paper_id", "left_semi").select("question_id")).distinct()
    goes = F.coalesce("back", F.lit(False)) & F.col("status").isin(CONFIRMED)
    rows = questions.join(back.withColumn("back", F.lit(True)), "question_id", "left")
    return rows.withColumn("acknowledged", F.col("acknowledged") & ~goes).withColumn("status", F.when(goes, "needs_review").otherwise(F.col("status"))).drop("back")


def transition(questions: DataFrame, commands: DataFrame) -> DataFrame:
    """questions after commands (question_id, command): quarantine, restore, reopen, confirm, send_back. One command for a question."""
    rows = questions.join(commands.select("question_id", "command"), "question_id", "left")
    c, s = F.col("command"), F.col("status")
    new = (
        F.when((c == "quarantine"), "quarantined").when((c == "restore") & (s == "quarantined"), "needs_review").when((c == "reopen") & (s == "live"), "needs_review")
        .when((c == "send_back") & s.isin(CONFIRMED), "needs_review").when((c == "confirm") & (s == "needs_review") & F.col("correct_answer").isNotNull(), "live").otherwise(s)
    )
    return rows.withColumn("status", new).drop("command")


def suggestions(questions: DataFrame, hint: str = "hint", redo: bool = False) -> DataFrame:
    """(question_id, suggested, changed): the suggested subject after a scan that found `hint`. A question with a subject needs none, one
    in quarantine keeps its own; a stored suggestion stays unless all are made again."""
    old, new = F.col("suggested"), F.col(hint)
    suggested = F.when(F.col("subject").isNotNull(), None).when((F.col("status") == "quarantined") | (old.isNotNull() & ~F.lit(redo)), old).otherwise(new)
    return questions.select("question_id", suggested.alias("suggested"), (suggested.isNotNull() & ~suggested.eqNullSafe(old)).alias("changed"))


def fitting_templates(papers: DataFrame, templates: DataFrame) -> DataFrame:
    """(paper_id, template_id): templates of a paper's series; those without a series fit all papers, and a paper without one fits all.
    templates is a small table that a person keeps."""
    first = F.substring(F.upper(F.trim("series")), 1, 1)
    p = papers.select("paper_id", F.nullif(first, F.lit("")).alias("series"))
    t = templates.select("template_id", F.nullif(first, F.lit("")).alias("own"))
    # every template has its series as a key, and stands under "any" as well; papers without a series meet all
    every = t.select("template_id", F.explode(F.array(F.coalesce("own", F.lit("any")))).alias("key"))
    by_series = p.where("series IS NOT NULL").select("paper_id", F.explode(F.array("series", F.lit("any"))).alias("key")).join(every, "key")
    free = p.where("series IS NULL").select("paper_id", F.explode(F.array(*[F.lit(k) for k in ("A", "B", "C", "D", "any")])).alias("key")).join(every, "key")
    return by_series.unionAll(free).select("paper_id", "template_id")


def key_compare(questions: DataFrame, key: DataFrame) -> DataFrame:
    """(paper_id, question_number, have, want, verdict): same, different, new, missing (no key), extra (no question)."""
    q = questions.where("status != 'quarantined'").select("paper_id", "question_number", F.col("correct_answer").alias("have"), F.lit(True).alias("q"))
    rows = q.join(key.select("paper_id", "question_number", F.col("letter").alias("want")), ["paper_id", "question_number"], "full_outer")
    verdict = F.when(F.col("q").isNull(), "extra").when(F.col("want").isNull(), "missing").when(F.col("have").isNull(), "new").when(F.col("have") == F.col("want"), "same").otherwise("different")
    return rows.select("paper_id", "question_number", "have", "want", verdict.alias("verdict"))


def key_apply(questions: DataFrame, key: DataFrame, replace: bool = False) -> DataFrame:
    """(question_id, correct_answer, status, acknowledged, flags, explanation, action) after an answer key (paper_id, question_number,
    letter, explanation) is applied to questions that are not in quarantine.

    A key fills gaps; with replace it also changes answers. E needs a fifth option. A confirmed question whose answer changes goes back to
    review, and warnings about a missing answer go. Explanations only fill gaps. action: filled, replaced, kept, unchanged, ignored
    or none (not in the key)."""
    rows = questions.where("status != 'quarantined'").join(key.select("paper_id", "question_number", "letter", F.col("explanation").alias("told")), ["paper_id", "question_number"], "left")
    have, want = F.col("correct_answer"), F.col("letter")
    action = (
        F.when(want.isNull(), "none").when((want == "E") & (F.coalesce("n_options", F.lit(0)) < 5), "ignored").when(have == want, "unchanged")
        .when(have.isNotNull() & ~F.lit(replace), "kept").when(have.isNull(), "filled").otherwise("replaced")
    )
    rows = rows.withColumn("action", action)
    changed = F.col("action").isin("filled", "replaced")
    back = changed & F.col("status").isin(CONFIRMED)
    gone = F.array(*[F.lit(f) for f in ("no_answer_found", "answer_unclear", "no_answer_in_key")])
    flags = F.when(changed, F.array_except("flags", gone)).otherwise(F.col("flags"))
    return rows.select("question_id", F.when(changed, want).otherwise(have).alias("correct_answer"), F.when(back, "needs_review").otherwise(F.col("status")).alias("status"), (F.col("acknowledged") & ~back).alias("acknowledged"), flags.alias("flags"), F.coalesce("explanation", "told").alias("explanation"), "action")


def printed_and_key(rows: DataFrame) -> DataFrame:
    """rows (printed, keyed, has_key, flags: a question's printed answer, its answer in the key file, whether there is such a file) with
    answer, answer_source and flags: the key wins, and a disagreement is a warning."""
    none = F.array().cast("array<string>")
    keyed, printed = F.col("keyed"), F.col("printed")
    flags = F.when(keyed.isNotNull(), F.array_except("flags", F.array(F.lit("no_answer_found"), F.lit("answer_unclear")))).otherwise(F.col("flags"))
    more = F.when(keyed.isNotNull() & (printed != keyed), F.array(F.lit("answer_conflict"))).when(F.col("has_key") & keyed.isNull(), F.array(F.lit("no_answer_in_key"))).otherwise(none)
    return rows.withColumn("flags", F.array_union(flags, more)).withColumn("answer", F.coalesce(keyed, printed)).withColumn("answer_source", F.when(keyed.isNotNull(), "key_pdf").when(printed.isNotNull(), "inline"))


def answer_summary(questions: DataFrame, papers: DataFrame) -> DataFrame:
    """Per paper: with and without answer, answers by source, the numbers of each letter, whether one has over half of ten and more, how
    many explanations name another answer, and whether the number of questions is not the expected one. questions: answer_source,
    explanation_says."""
    have = F.col("correct_answer").isNotNull()
    source = F.coalesce("answer_source", F.lit("manual"))
    letters = {x: F.count_if(F.col("correct_answer") == x).alias(x.lower()) for x in "ABCDE"}
    own = questions.where("status != 'quarantined'").groupBy("paper_id").agg(
        F.count("*").alias("total"), F.count_if(have).alias("with_answer"), F.count_if(~have).alias("without_answer"), F.count_if(have & (source == "ai")).alias("ai_answers"), F.count_if(have & (source == "key")).alias("key_answers"), F.count_if(have & ~source.isin("ai", "key")).alias("other_answers"),
        *letters.values(), F.count_if(have & F.coalesce(F.col("explanation_says") != F.col("correct_answer"), F.lit(False))).alias("mismatches"))
    most = F.greatest(*"abcde")
    rows = own.join(papers.select("paper_id", "expected_total"), "paper_id", "left")
    return rows.withColumn("lopsided", (F.col("with_answer") >= 10) & (2 * most > F.col("with_answer"))).withColumn("count_off", F.coalesce(F.col("expected_total") != F.col("total"), F.lit(False))).drop("expected_total")


def key_distribution(key: DataFrame) -> DataFrame:
    """(key_id, found, a, b, c, d, e, lopsided): how often each letter stands in a key (key_id, number, letter)."""
    own = key.groupBy("key_id").agg(F.count("*").alias("found"), *[F.count_if(F.col("letter") == x).alias(x.lower()) for x in "ABCDE"])
    return own.withColumn("lopsided", (F.col("found") >= 10) & (2 * F.greatest(*"abcde") > F.col("found")))


def catalogue(live: DataFrame, papers: DataFrame, tests: DataFrame, key: str = "paper_id") -> DataFrame:
    """Full tests: live questions of each paper that is no book, its own minutes or 72 s a question, fingerprint of its questions, times
    taken and a running attempt, where there is one. tests: paper_id, attempt_id, status. A paper holds a bounded number of questions."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("question_id")), lambda x: x.cast("string")), ",")
    own = live.where("source_type != 'book'").groupBy("paper_id").agg(F.count("*").alias("n"), F.substring(F.sha1(ids), 1, 8).alias("fingerprint"))
    taken = tests.groupBy("paper_id").agg(F.count("*").alias("taken"), F.max(F.when(F.col("status") == "in_progress", F.col("attempt_id"))).alias("running"))
    rows = own.join(papers.select("paper_id", "duration_minutes"), "paper_id").join(taken, "paper_id", "left")
    minutes = F.coalesce(F.nullif("duration_minutes", F.lit(0)), F.greatest(F.lit(1), F.ceil(F.col("n") * 72 / 60).cast("int")))
    return rows.select("paper_id", "n", minutes.cast("int").alias("minutes"), "fingerprint", F.coalesce("taken", F.lit(0)).alias("taken"), "running")


def sections(live: DataFrame) -> DataFrame:
    """Section tests: live questions of each paper (no books) and subject, 72 s each, with the key under which they are ranked."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("question_id")), lambda x: x.cast("string")), ",")
    own = live.where("source_type != 'book' AND subject IS NOT NULL").groupBy("paper_id", "subject").agg(F.count("*").alias("n"), F.substring(F.sha1(ids), 1, 8).alias("fingerprint"))
    return own.select("paper_id", "subject", "n", (F.col("n") * 72).alias("seconds"), F.concat_ws(":", F.lit("paper"), F.col("paper_id").cast("string"), F.lit("subject"), "subject", "fingerprint").alias("rank_key"))


def restored(versions: DataFrame, restores: DataFrame, fields: list[str]) -> DataFrame:
    """versions (entity, version_no, fields) after restores (entity, to_version): the older version stands again as a new last one. One
    restore for an entity."""
    last = versions.groupBy("entity").agg(F.max("version_no").alias("last"))
    back = versions.join(restores, "entity").where("version_no = to_version").join(last, "entity").select("entity", (F.col("last") + 1).alias("version_no"), *fields, F.lit(True).alias("restored"))
    return versions.select("entity", "version_no", *fields, F.lit(False).alias("restored")).unionByName(back)


def version_history(versions: DataFrame, fields: list[str]) -> DataFrame:
    """versions (entity, at, seq, fields...) with version_no and changed: the fields that differ from the version before."""
    w = Window.partitionBy("entity").orderBy("at", "seq")
    changed = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.lag(f).over(w)), f) for f in fields]))
    return versions.withColumn("version_no", F.row_number().over(w)).withColumn("changed", F.when(F.col("version_no") == 1, "").otherwise(F.array_join(changed, ",")))


def as_of(versions: DataFrame, moment: str, fields: list[str]) -> DataFrame:
    """Each entity's last version up to a moment."""
    own = versions.where(F.col("at") <= F.lit(moment).cast("timestamp")).groupBy("entity").agg(F.max(F.struct("at", "seq", *fields)).alias("x"))
    return own.select("entity", *[F.col(f"x.{f}").alias(f) for f in fields])


def as_of_each(versions: DataFrame, moments: DataFrame, fields: list[str], span: str = "day") -> DataFrame:
    """moments (moment_id, entity, at) with the fields of the entity's last version (entity, at, seq, fields...) up to each moment; nulls, where
    there is none. Versions without an entity or a time are never met; moments without one get nulls.

    Versions and moments are lined up by entity and `span` of time, and carry the last version on; what the spans before leave behind is one
    row for each span. So an entity with very many versions is split, and no version meets every moment."""
    held = F.struct(F.lit(True).alias("there"), *fields)
    slot = F.date_trunc(span, F.col("at")).alias("slot")
    past = versions.where("entity IS NOT NULL AND at IS NOT NULL").select("entity", "at", slot, F.lit(0).alias("asks"), F.col("seq").cast("long").alias("seq"), held.alias("held"), F.lit(None).cast("long").alias("moment_id"))
    asked = moments.select("entity", "at", slot, F.lit(1).alias("asks"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast(past.schema["held"].dataType).alias("held"), F.col("moment_id").cast("long").alias("moment_id"))
    left = past.groupBy("entity", "slot").agg(F.max_by("held", F.struct("at", "seq")).alias("left"))
    slots = left.unionByName(asked.select("entity", "slot").distinct().withColumn("left", F.lit(None).cast(past.schema["held"].dataType)))
    slots = slots.groupBy("entity", "slot").agg(F.max("left").alias("left"))
    earlier = Window.partitionBy("entity").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select("entity", "slot", F.last("left", ignorenulls=True).over(earlier).alias("carried"))
    upto = Window.partitionBy("entity", "slot").orderBy("at", "asks", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = past.unionByName(asked).withColumn("own", F.last("held", ignorenulls=True).over(upto)).where("asks = 1")
    rows = rows.join(carried, ["entity", "slot"], "left").withColumn("x", F.when(F.col("at").isNotNull(), F.coalesce("own", "carried")))
    return rows.select("moment_id", "entity", "at", *[F.col(f"x.{f}").alias(f) for f in fields])


def report_queue(reports: DataFrame, questions: DataFrame) -> DataFrame:
    """Reports (question_id, kind, answer_at_report, status) by question with an open one: how many of each status, the open ones' kinds, and
    whether the key has changed since any open one."""
    open_ = F.col("status") == "open"
    own = reports.groupBy("question_id").agg(
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("open", "resolved", "dismissed")], F.array_join(F.array_sort(F.collect_set(F.when(open_, F.col("kind")))), ",").alias("kinds"),
        F.collect_set(F.when(open_, F.coalesce("answer_at_report", F.lit("-")))).alias("was"))
    rows = own.where("n_open > 0").join(questions.select("question_id", "correct_answer"), "question_id")
    changed = F.exists("was", lambda x: x != F.coalesce("correct_answer", F.lit("-")))
    return rows.select("question_id", "n_open", "n_resolved", "n_dismissed", "kinds", changed.alias("key_changed"))


def subject_by_range(questions: DataFrame, ranges: DataFrame) -> DataFrame:
    """(question_id, subject): the last range (paper_id, first, last, subject, place) that holds a question's number."""
    rows = questions.select("question_id", "paper_id", "question_number").join(ranges, "paper_id").where("question_number BETWEEN first AND last")
    return rows.groupBy("question_id").agg(F.max_by("subject", "place").alias("subject"))


def line_repeats(lines: DataFrame, least: int = 3, share: float = 0.4, band: float | None = None, pages: DataFrame | None = None) -> DataFrame:
    """(paper_id, line): normalised lines that stand on `share` of a paper's pages, and on `least`: running heads and overlays. band: only
    lines in the upper and lower tenth (say) of a page count; they then have a place (0 top, 1 bottom). pages (paper_id, page): the pages
    that hold a line, where they can be told without making all lines a second time."""
    pages = (lines if pages is None else pages).groupBy("paper_id").agg(F.count_distinct("page").alias("pages"))
    if band is not None:
        lines = lines.where((F.col("place") < band) | (F.col("place") > 1 - band))
    found = lines.groupBy("paper_id", "line").agg(F.count_distinct("page").alias("n"))
    return found.join(pages, "paper_id").where(F.col("n") >= F.greatest(F.lit(float(least)), share * F.col("pages"))).select("paper_id", "line", "n")
