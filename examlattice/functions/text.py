"""Column functions on question texts: normal forms, languages, flags, answers and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Devanagari letters and signs that count as word characters; words that mark a subject.
LETTERS = r"a-z0-9\x{0900}-\x{0963}\x{0970}-\x{097F}"
WORD = rf"[^{LETTERS}]+"
#: The same without single spaces, which words() would put back one by one.
GAP = rf"[^{LETTERS} ][^{LETTERS}]*+| [^{LETTERS}]++"
DEVANAGARI = r"[^\x{0900}-\x{097F}]"
HINDI_KEYS = {"क": "A", "ख": "B", "ग": "C", "घ": "D"}


def words(s: Column) -> Column:
    """Lower case, only word characters, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), GAP, " "))


def has_words(s: Column) -> Column:
    """Whether words is not empty, told by the first word character."""
    return F.lower(s).rlike(f"[{LETTERS}]")


def squeeze(s: Column) -> Column:
    """words without spaces."""
    return F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), WORD, "")


def norm_hash(text: Column, options: Column) -> Column:
    """16 hexadecimal digits that re-casing, spacing and the order of options do not change."""
    return F.substring(F.sha1(F.concat(squeeze(text), F.lit("|"), F.array_join(F.array_sort(F.transform(options, squeeze)), "|"))), 1, 16)


def _filled(options: Column) -> Column:
    """The options that are not blank."""
    return F.filter(F.coalesce(options, F.array().cast("array<string>")), lambda o: F.coalesce(F.trim(o), F.lit("")) != "")


def has_hindi(text_hi: Column, options_hi: Column) -> Column:
    return (F.coalesce(F.trim(text_hi), F.lit("")) != "") | (F.size(_filled(options_hi)) > 0)


def primary(text: Column, options: Column, text_hi: Column, options_hi: Column) -> Column:
    """(lang, text, options): English where there is an English text or no Hindi at all, else Hindi. A fifth option stays."""
    english = (F.coalesce(F.trim(text), F.lit("")) != "") | ~has_hindi(text_hi, options_hi)
    return F.struct(F.when(english, "en").otherwise("hi").alias("lang"), F.when(english, text).otherwise(text_hi).alias("text"), F.when(english, options).otherwise(options_hi).alias("options"))


def which(text: Column, text_hi: Column) -> Column:
    en, hi = F.coalesce(F.trim(text), F.lit("")) != "", F.coalesce(F.trim(text_hi), F.lit("")) != ""
    return F.when(en & hi, "both").when(hi, "hi").when(en, "en").otherwise("none")


def answer_text(letter: Column, options: Column) -> Column:
    """The words of the option that the key points to."""
    option = F.get(options, F.ascii(letter) - 65)
    return F.when(option.isNotNull(), words(option))


def devanagari_share(s: Column) -> Column:
    """Of all letters, Devanagari vowel signs among them; null with fewer than four."""
    letters, own = F.regexp_count(s, F.lit(r"[\p{L}\x{0900}-\x{0963}\x{0970}-\x{097F}]")), F.regexp_count(s, F.lit(r"[\x{0900}-\x{0963}\x{0970}-\x{097F}]"))
    return F.when(letters >= 4, own / letters)


def _flags(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, name) for cond, name in pairs]))


# The warnings about languages, and the shares of Devanagari letters that Hindi needs and English may have.
LANGUAGE_FLAGS = ["language_incomplete", "language_swapped", "language_mismatch"]
HINDI_LEAST, ENGLISH_MOST = 0.6, 0.2


def language_flags(text: Column, options: Column, text_hi: Column, options_hi: Column, explanation: Column | None = None, explanation_hi: Column | None = None) -> Column:
    """LANGUAGE_FLAGS that a question deserves: a language with only a text or only options while the other one is complete; fields in the
    other language's script, options and explanations counted; two languages with unequal numbers of options or of lines of the text."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    en, hi = F.trim(blank(text)) != "", F.trim(blank(text_hi)) != ""
    own, own_hi = _filled(options), _filled(options_hi)
    n, n_hi = F.size(own), F.size(own_hi)
    none = F.lit("")
    told = lambda t, o, e: devanagari_share(F.concat_ws(" ", blank(t), F.array_join(o, " "), blank(none if e is None else e)))
    lines = lambda c: F.size(F.filter(F.split(blank(c), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{0085}\x{2028}\x{2029}]"), lambda x: F.trim(x) != ""))
    incomplete = ((en != (n > 0)) & hi & (n_hi == 4)) | ((hi != (n_hi > 0)) & en & (n == 4))
    swapped = F.coalesce(told(text_hi, own_hi, explanation_hi) < HINDI_LEAST, F.lit(False)) | F.coalesce(told(text, own, explanation) > ENGLISH_MOST, F.lit(False))
    mismatch = en & (hi | (n_hi > 0)) & (((n > 0) & (n_hi > 0) & (n != n_hi)) | (hi & (lines(text) != lines(text_hi))))
    return _flags(*zip((incomplete, swapped, mismatch), LANGUAGE_FLAGS))


# Characters besides letters, digits, underscores and white space that a printed question may hold; an option's usual length.
PRINTED_MARKS = """.,;:'"\u2019\u2018\u201c\u201d()[]/%&+-\u2013\u2014?!=\u00b0$\u20b9*<>"""
LONG_OPTION = 300


def sanity_flags(text: Column, options: Column) -> Column:
    """options_not_found alone where there are no options; else empty_stem, empty_option, very_long_option, odd_characters, and
    check_code_row where all options are four single characters but one of them is no order of 1 to 4."""
    stem = F.coalesce(text, F.lit(""))
    marks = "".join(f"\\{c}" if c.isascii() else c for c in PRINTED_MARKS)
    odd = F.concat_ws(" ", stem, F.array_join(options, " ")).rlike(rf"[^\p{{L}}\p{{N}}_\s\x{{0085}}\p{{Z}}{marks}]")
    codes = F.transform(options, lambda o: F.split(F.trim(o), r"\s+"))
    rows = F.forall(codes, lambda r: (F.size(r) == 4) & F.forall(r, lambda c: c.rlike(r"^[\p{L}\p{N}]$")))
    wrong = F.exists(codes, lambda r: F.array_join(F.array_sort(r), "") != "1234")
    flags = _flags(
        (stem == "", "empty_stem"), (F.exists(options, lambda o: o == ""), "empty_option"), (F.exists(options, lambda o: F.length(o) > LONG_OPTION), "very_long_option"), (odd, "odd_characters"), (rows & wrong, "check_code_row"),
    )
    return F.when(options.isNull(), F.array(F.lit("options_not_found"))).otherwise(flags)


def clean(s: Column) -> Column:
    """One kind of line end, no control characters, a written-out \\n as a line end where there is no real one, single spaces inside lines
    and none around them."""
    blank = r"[\s\p{Z}\x{0085}]+"
    out = F.regexp_replace(F.regexp_replace(s, r"\r\n?", "\n"), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    out = F.when(out.contains("\n"), out).otherwise(F.replace(out, F.lit("\\n"), F.lit("\n")))
    lines = F.transform(F.split(out, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), rf"^{blank}|{blank}$", ""))
    return F.regexp_replace(F.array_join(lines, "\n"), rf"^{blank}|{blank}$", "")


def option_key(s: Column) -> Column:
    """A-E from a-e, (b), ग; null for anything else, digits too."""
    bare = F.upper(F.regexp_replace(s, r"[\s().:\]\[]", ""))
    for hindi, letter in HINDI_KEYS.items():
        bare = F.when(bare == hindi, letter).otherwise(bare)
    return F.when(bare.rlike("^[A-E]$"), bare)


# How a sheet's cell names one of four options, and the phrasings in which an explanation names the answer.
SHEET_ANSWER = r"(?:(?:option|answer|ans|choice)\s*[:\-–.]?\s*)?[(\[]?\s*([a-dA-D])\s*[)\].:]?"
EXPLANATION_SAYS = [
    r"(?:correct|right|desired|final)\s+(?:answer|option)\s*(?:is|:|=|-)?\s*(?:option\s*)?\(\s*([a-eA-E])\s*\)",
    r"(?:answer|option)\s*(?:is|:|=)?\s*\(\s*([a-eA-E])\s*\)\s*(?:is\s+)?(?:the\s+)?(?:correct|right)",
    r"\boption\s*\(\s*([a-eA-E])\s*\)\s+is\s+(?:the\s+)?(?:correct|right)",
]


def sheet_answer(s: Column) -> Column:
    """The letter A to D of 'b', '(B)', 'Option B', 'answer: b', 'choice b'; null for digits, E, Hindi letters and all else."""
    found = F.regexp_extract(F.trim(s), rf"(?i)^(?:{SHEET_ANSWER})\z", 1)
    return F.when(found != "", F.upper(found))


def explanation_says(s: Column) -> Column:
    """The letter that an explanation names as the answer, if it names exactly one."""
    said = F.array_distinct(F.transform(F.concat(*[F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(f"(?i){p}"), F.lit(1)) for p in EXPLANATION_SAYS]), F.upper))
    return F.when(F.size(said) == 1, F.get(said, F.lit(0)))


def fraction(s: Column) -> Column:
    """1/3 or 0.33 as a number of four places in [0, 1]; null otherwise."""
    parts = F.split(F.trim(s), "/")
    number = lambda x: F.try_to_number(F.trim(x), F.lit("9999.9999")).cast("double")
    value = F.when(F.size(parts) == 2, F.try_divide(number(F.get(parts, F.lit(0))), number(F.get(parts, F.lit(1))))).otherwise(number(s))
    return F.when(value.between(0, 1), F.bround(value, 4))


def marks(x: Column) -> Column:
    """Marks with two places at most and no closing zeros: 2, 0.67, -1.5."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", F.bround(x, 2)), "0+$", ""), r"\.$", "")


def source_label(title: Column, year: Column, number: Column) -> Column:
    """Where a question stood: 'title \u00b7 year \u00b7 Qn'; without the year, if it is unknown."""
    return F.concat_ws(" \u00b7 ", title, year.cast("string"), F.concat(F.lit("Q"), number.cast("string")))


def option_rows(options: Column, options_hi: Column) -> Column:
    """Array of (letter, text, text_hi) of the options that have a text in a language, in order."""
    none = F.array().cast("array<string>")
    pairs = F.arrays_zip(F.coalesce(options, none).alias("en"), F.coalesce(options_hi, none).alias("hi"))
    rows = F.transform(pairs, lambda x, i: F.struct(F.substr(F.lit("ABCDE"), i + 1, F.lit(1)).alias("letter"), F.coalesce(F.trim(x["en"]), F.lit("")).alias("text"), F.nullif(F.trim(x["hi"]), F.lit("")).alias("text_hi")))
    return F.filter(rows, lambda x: (x["text"] != "") | x["text_hi"].isNotNull())


def list_text(text: Column, text_hi: Column, language: str) -> Column:
    """One line for a list: the text in the language, or in the other one."""
    en, hi = F.nullif(F.trim(text), F.lit("")), F.nullif(F.trim(text_hi), F.lit(""))
    return F.coalesce(*((hi, en) if language == "hi" else (en, hi)), F.lit(""))


def available(text: Column, options: Column, text_hi: Column, options_hi: Column) -> Column:
    """(en, hi): the languages in which a question can be shown. A text with four options is complete; if no language is, any text
    counts."""
    en, hi = F.coalesce(F.trim(text), F.lit("")) != "", F.coalesce(F.trim(text_hi), F.lit("")) != ""
    whole = en & (F.size(_filled(options)) >= 4)
    whole_hi = hi & (F.size(_filled(options_hi)) >= 4)
    neither = ~whole & ~whole_hi
    return F.struct(F.when(neither, en).otherwise(whole).alias("en"), F.when(neither, has_hindi(text_hi, options_hi)).otherwise(whole_hi).alias("hi"))


def shown_in(languages: Column) -> Column:
    """(en, hi, note_en, note_hi): display modes (en, hi, both) in which each version and each note is shown, by languages (en, hi). A
    mode whose own version is missing shows the other one with a note; both shows what there is."""
    en, hi = languages["en"], languages["hi"]

    def modes(own: Column, other: Column, name: str, else_name: str) -> Column:
        order = ("en", "hi", "both")
        fits = {name: own, "both": own, else_name: own & ~other}
        return F.concat_ws(" ", *[F.when(fits[m], m) for m in order])

    return F.struct(modes(en, hi, "en", "hi").alias("en"), modes(hi, en, "hi", "en").alias("hi"), F.when(hi & ~en, "en").otherwise("").alias("note_en"), F.when(en & ~hi, "hi").otherwise("").alias("note_hi"))


def trust_label(status: Column, source: Column) -> Column:
    """How far an explanation can be trusted; verified only if somebody said so."""
    return F.when(status == "verified", "Verified").when(source == "ai_json", "AI-supplied, unverified").when(source.isin("csv", "xlsx", "docx"), "Unverified (imported from a file)").otherwise("Unverified (as printed in the answer PDF)")


def renewed_flags(flags: Column, language: Column) -> Column:
    """flags with their language warnings replaced by those of `language`; all others stay."""
    none = F.array().cast("array<string>")
    known = F.array(*[F.lit(f) for f in LANGUAGE_FLAGS])
    return F.concat(F.filter(F.coalesce(flags, none), lambda f: ~F.array_contains(known, f)), F.coalesce(language, none))


def refreshed(flags: Column, language: Column, status: Column, acknowledged: Column) -> Column:
    """(flags, acknowledged) after language_flags were worked out anew: a confirmed question that gets one it did not have must be looked
    at again."""
    none = F.array().cast("array<string>")
    added = F.size(F.array_except(F.coalesce(language, none), F.coalesce(flags, none))) > 0
    return F.struct(renewed_flags(flags, language).alias("flags"), (acknowledged & ~(added & status.isin("verified", "live"))).alias("acknowledged"))


def mismatch_flag(flags: Column, says: Column, answer: Column) -> Column:
    """flags with explanation_mismatch where the explanation names another answer than the key, without it elsewhere."""
    rest = F.array_remove(F.coalesce(flags, F.array().cast("array<string>")), "explanation_mismatch")
    return F.when(F.coalesce(says != answer, F.lit(False)), F.array_append(rest, F.lit("explanation_mismatch"))).otherwise(rest)


def duration(seconds: Column) -> Column:
    """1h 02m, 3m 05s or 12s."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    return F.when(h > 0, F.format_string("%dh %02dm", h, m)).when(m > 0, F.format_string("%dm %02ds", m, s)).otherwise(F.format_string("%ds", s))


def number_ranges(s: Column) -> Column:
    """Array of (first, last, subject, place) from '1-30 History, 31-60 Geography'; parts that do not fit are left out, see
    range_errors."""
    parts = F.transform(F.split(s, "[,;\n]"), lambda p, i: F.struct(
        F.regexp_extract(p, r"^\s*(\d{1,3})\s*(?:-|–|to)\s*(\d{1,3})\s+(.+?)\s*$", 1).alias("a"), F.regexp_extract(p, r"^\s*(\d{1,3})\s*(?:-|–|to)\s*(\d{1,3})\s+(.+?)\s*$", 2).alias("b"),
        F.regexp_extract(p, r"^\s*(\d{1,3})\s*(?:-|–|to)\s*(\d{1,3})\s+(.+?)\s*$", 3).alias("subject"), i.alias("place")))
    good = F.filter(parts, lambda x: x["subject"] != "")
    return F.transform(good, lambda x: F.struct(x["a"].cast("int").alias("first"), x["b"].cast("int").alias("last"), x["subject"].alias("subject"), x["place"].alias("place")))


def range_errors(s: Column) -> Column:
    """Array of the parts of a text of ranges that say no range, or one that runs backwards."""
    parts = F.filter(F.transform(F.split(F.coalesce(s, F.lit("")), "[,;\n]"), lambda p: F.trim(p)), lambda p: p != "")
    bounds = r"^(\d{1,3})\s*(?:-|–|to)\s*(\d{1,3})\s+\S.*$"
    return F.filter(parts, lambda p: ~p.rlike(bounds) | (F.regexp_extract(p, bounds, 1).try_cast("int") > F.regexp_extract(p, bounds, 2).try_cast("int")))
