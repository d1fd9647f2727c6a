"""Answer keys as texts: four formats, tried in order, to (number, letter)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The notations of answer keys.
LABELLED = r"(?m)^\s*(\d{1,3})\s*[.)]\s*Ans\w*\s*[–—\-:]*\s*\(?\s*([a-eA-E])\s*\)?"
SERIES_ROW = r"(?m)^[ \t]*(?:Q\.?[ \t]*)?(\d{1,3})[\s|,;:.)\-]+([A-Da-d])[\s|,;:/\-]+([A-Da-d])[\s|,;:/\-]+([A-Da-d])[\s|,;:/\-]+([A-Da-d])[ \t]*$"
SERIES_HEAD = r"^[ \t]*(?:Series|Set|Code|Booklet)[ \t]*[:\-]?[ \t]*([A-Da-d])\b.*$"
DIGIT_PAIR = r"(?<![\w/])(\d{1,3})\s*[-–—:.)=|,]\s*\(?\s*([1-4])\s*\)?(?![A-Za-z0-9])"
PAIR = r"(?<![\w/])(?:Q(?:uestions?|s)?\.?\s*)?(\d{1,3})(?:\s*[-–—:.)=|,]\s*|\s+|(?=[A-Ea-e(]))\(?\s*([A-Ea-e])\s*\)?(?![A-Za-z0-9])"

_HEAD = f"(?im){SERIES_HEAD}"


def _pairs(text: Column, pattern: str, group: Column | int = 2) -> Column:
    letters = F.regexp_extract_all(text, F.lit(pattern), F.lit(group) if isinstance(group, int) else group)
    numbers = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.transform(F.arrays_zip(numbers.alias("n"), letters.alias("l")), lambda x, i: F.struct(x["n"].cast("int").alias("number"), F.upper(x["l"]).alias("letter"), i.alias("place")))


def parse_keys(keys: DataFrame) -> DataFrame:
    """(key_id, number, letter, letters, format) from keys (key_id, text, series). letters: how many different ones a number got; the
    first counts. Digits are never taken for letters. A key of several series without a series gives nothing."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n")
    count = lambda p: F.size(F.regexp_extract_all("t", F.lit(p), F.lit(1)))
    rows = keys.select("key_id", text.alias("t"), F.upper(F.substring(F.trim(F.coalesce("series", F.lit(""))), 1, 1)).alias("s"))
    form = F.when(count(LABELLED) >= 3, "labelled").when(count(SERIES_ROW) >= 3, "table").when(count(_HEAD) >= 2, "blocks").otherwise("pairs")
    rows = rows.withColumn("format", form)
    heads, blocks = F.transform(F.regexp_extract_all("t", F.lit(_HEAD), F.lit(1)), F.upper), F.split("t", _HEAD, -1)
    own = F.get(blocks, F.array_position(heads, F.col("s")).cast("int"))
    block = F.when((F.col("s") != "") & F.array_contains(heads, F.col("s")), own).otherwise("")
    column = F.greatest(F.ascii("s") - 63, F.lit(2))
    table = F.when(F.col("s").rlike("^[A-D]$"), _pairs(F.col("t"), SERIES_ROW, column)).otherwise(F.array().cast("array<struct<number:int,letter:string,place:int>>"))
    found = F.when(F.col("format") == "labelled", _pairs(F.col("t"), LABELLED)).when(F.col("format") == "table", table).when(F.col("format") == "blocks", _pairs(block, PAIR)).otherwise(_pairs(F.col("t"), PAIR))
    pairs = rows.select("key_id", "format", F.explode(found).alias("x")).select("key_id", "format", "x.*").where("number BETWEEN 1 AND 999")
    return pairs.groupBy("key_id", "format", "number").agg(F.min_by("letter", "place").alias("letter"), F.count_distinct("letter").alias("letters"))


def key_explanations(keys: DataFrame) -> DataFrame:
    """(key_id, number, explanation): what a labelled line says behind its letter, up to the next labelled line, on one line."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n")
    rows = keys.select("key_id", text.alias("t"))
    numbers, behind = F.regexp_extract_all("t", F.lit(LABELLED), F.lit(1)), F.split("t", LABELLED, -1)
    told = F.arrays_zip(numbers.alias("n"), F.slice(behind, F.lit(2), F.greatest(F.lit(1), F.size(numbers))).alias("x"))
    rows = rows.where(F.size(numbers) >= 3).select("key_id", F.explode(told).alias("y"))
    one_line = F.trim(F.regexp_replace(F.regexp_replace("y.x", r"\s+", " "), r"^[\s.:\-–—]+", ""))
    return rows.select("key_id", F.col("y.n").cast("int").alias("number"), one_line.alias("explanation")).where("explanation != ''")


def key_errors(keys: DataFrame, parsed: DataFrame) -> DataFrame:
    """(key_id, error, number) of keys that cannot be applied as they are: conflict (a number has several letters), series (the key is of several
    series and names none), digits (the answers are digits, which are never taken for letters) or empty."""
    found = parsed.groupBy("key_id").agg(F.count("*").alias("n"))
    conflicts = parsed.where("letters > 1").select("key_id", F.lit("conflict").alias("error"), "number")
    text = F.coalesce("text", F.lit(""))
    many = (F.size(F.regexp_extract_all(text, F.lit(SERIES_ROW), F.lit(1))) >= 3) | (F.size(F.regexp_extract_all(text, F.lit(_HEAD), F.lit(1))) >= 2)
    digits = F.size(F.regexp_extract_all(text, F.lit(DIGIT_PAIR), F.lit(1))) >= 3
    rest = keys.join(found, "key_id", "left_anti")
    error = F.when(many, "series").when(digits, "digits").otherwise("empty")
    return conflicts.unionAll(rest.select("key_id", error.alias("error"), F.lit(None).cast("int").alias("number")))


def key_text(questions: DataFrame) -> DataFrame:
    """(key_id, text, series) that says the keys of each paper's questions, as pairs."""
    own = questions.where("correct_answer IS NOT NULL").groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("question_number", "question_id", "correct_answer"))), lambda x: F.concat(x["question_number"].cast("string"), F.lit("-"), x["correct_answer"])), " ").alias("text"))
    return own.select(F.col("paper_id").alias("key_id"), "text", F.lit(None).cast("string").alias("series"))
