"""Question files: delimited sheets, JSON parts with salvage, book chapters. One row in for each file, many rows out."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What a column may be called, by what it holds and in the order in which fields choose; words that a column's name
# may contain where no name fits; ends of names that speak of a number.
HEADERS = {
    "number": "no number qno qn qnum questionno questionnumber sno srno slno sl serial serialno id",
    "question": "question questions q stem questiontext text prompt statement",
    "a": "optiona opta a choicea option1 opt1 choice1 answera",
    "b": "optionb optb b choiceb option2 opt2 choice2 answerb",
    "c": "optionc optc c choicec option3 opt3 choice3 answerc",
    "d": "optiond optd d choiced option4 opt4 choice4 answerd",
    "answer": "answer ans correctanswer correctoption correct key answerkey rightanswer correctchoice",
    "explanation": "explanation explanations solution rationale reason description",
    "subject": "subject subj section",
    "topic": "topic subtopic chapter",
}
CONTAINED = {"answer": "answer correct", "explanation": "explanation solution", "subject": "subject", "topic": "topic"}
NUMBERING = "(no|number|num)$"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content, sha256) of whole files; copies of one file have one sha256."""
    found = spark.read.format("binaryFile").load(path)
    return found.select(F.col("path").alias("file"), "content", F.sha2("content", 256).alias("sha256"))


def decode(content: bytes, fallback: str = "cp1252") -> str:
    """UTF-8 with or without a mark, UTF-16 with one, else Windows-1252 (or what the fallback is)."""
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return content.decode("utf-16", errors="replace")
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode(fallback, errors="replace")


def key_files(files: DataFrame) -> DataFrame:
    """(key_id, text, series) of answer keys in text files, for keys.parse_keys; their fallback is Latin-1. The series is unknown."""
    text = F.pandas_udf(lambda contents: contents.map(lambda c: decode(bytes(c), "latin-1")), "string")
    return files.select(F.col("file").alias("key_id"), text("content").alias("text"), F.lit(None).cast("string").alias("series"))


def sheet_rows(files: DataFrame) -> DataFrame:
    """(file, line, headers, cells): rows of delimited files. The delimiter is the most frequent of , ; tab and | in the first line;
    blank rows go, short rows are padded, an empty header is called by its place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, content in zip(batch["file"], batch["content"]):
                text = decode(content)
                first = next((x for x in text.splitlines() if x.strip()), "")
                delimiter = max(",;\t|", key=first.count)
                rows = [(n, r) for n, r in enumerate(csv.reader(io.StringIO(text), delimiter=delimiter), 1) if any(c.strip() for c in r)]
                if not rows:
                    continue
                width = max(len(r) for _, r in rows)
                head = [h.strip() or f"Column {i + 1}" for i, h in enumerate(rows[0][1] + [""] * (width - len(rows[0][1])))]
                out += [(file, n, head, [c.strip() for c in r] + [""] * (width - len(r))) for n, r in rows[1:]]
            yield pd.DataFrame(out, columns=["file", "line", "headers", "cells"])

    return files.select("file", "content").mapInPandas(run, "file string, line long, headers array<string>, cells array<string>")


def header_mapping(headers: Column) -> Column:
    """Map from what a column holds to its place (from 0). Fields choose in turn, each the first column that is left: first by names, then
    by words that a name contains, at last the question by a name that begins with it and speaks of no number."""
    turns = [(f, rf"^({names.replace(' ', '|')})$") for f, names in HEADERS.items()] + [(f, words.replace(" ", "|")) for f, words in CONTAINED.items()] + [("question", rf"^question(?!.*{NUMBERING})")]
    bare = F.transform(headers, lambda h: F.regexp_replace(F.lower(F.coalesce(h, F.lit(""))), "[^a-z0-9]+", ""))
    rules = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(p).alias("pattern")) for f, p in turns])

    def choose(found: Column, rule: Column) -> Column:
        taken, done = F.map_values(found), F.map_contains_key(found, rule["field"])
        free = F.transform(bare, lambda h, i: ~F.array_contains(taken, i) & F.call_function("rlike", h, rule["pattern"]))
        place = F.array_position(free, F.lit(True)).cast("int") - 1
        return F.when(done | (place < 0), found).otherwise(F.map_concat(found, F.create_map(rule["field"], place)))

    return F.aggregate(rules, F.create_map().cast("map<string,int>"), choose)


def map_headers(rows: DataFrame) -> DataFrame:
    """(file, line, fields): a map from what a column holds to its cell, see header_mapping, which is worked out once for each head."""
    heads = rows.select("headers").distinct().withColumn("mapping", header_mapping(F.col("headers")))
    found = rows.join(heads, "headers")
    return found.select("file", "line", F.transform_values("mapping", lambda k, i: F.get("cells", i)).alias("fields"))


def header_signature(headers: Column) -> Column:
    """16 hexadecimal digits that the order, case and punctuation of a sheet's headers do not change."""
    bare = F.filter(F.transform(headers, lambda h: F.regexp_replace(F.lower(h), "[^a-z0-9]+", "")), lambda h: h != "")
    return F.substring(F.sha1(F.array_join(F.array_sort(bare), "|")), 1, 16)


def recalled(rows: DataFrame, remembered: DataFrame) -> DataFrame:
    """(file, line, fields) like map_headers, but a sheet whose headers were mapped by hand before is read that way. remembered: signature,
    mapping (a map from what a column holds to its header)."""
    guessed = map_headers(rows).withColumnRenamed("fields", "guess")
    known = rows.withColumn("signature", header_signature("headers")).join(remembered, "signature")
    cell = lambda h: F.get("cells", F.array_position("headers", h).cast("int") - 1)
    told = known.select("file", "line", F.map_filter(F.transform_values("mapping", lambda k, h: cell(h)), lambda k, v: v.isNotNull()).alias("told"))
    return guessed.join(told, ["file", "line"], "left").select("file", "line", F.coalesce("told", "guess").alias("fields"))


def same_tests(papers: DataFrame) -> DataFrame:
    """(paper_id, first): papers of one source, test and series (in any case), each with the first of them."""
    key = [F.lower(F.trim(F.coalesce(c, F.lit("")))).alias(c) for c in ("source_type", "test", "series")]
    named = papers.where("test IS NOT NULL").select("paper_id", *key)
    first = named.groupBy("source_type", "test", "series").agg(F.min("paper_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return named.join(first, ["source_type", "test", "series"]).where("paper_id != first").select("paper_id", "first")


def covered_ranges(files: DataFrame) -> DataFrame:
    """(file, first, last) that files of JSON parts say they cover."""
    said = r"(?i)covered\s+questions?\s+(\d+)\s*(?:to|-|–|—)\s*(\d+)"
    text = F.col("content").cast("string")
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(said), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(said), F.lit(2)).alias("b"))
    return files.select("file", F.explode(both).alias("x")).select("file", F.col("x.a").cast("int").alias("first"), F.col("x.b").cast("int").alias("last"))


def raw_questions(objects: DataFrame) -> DataFrame:
    """(file, part, place, raw): every question of the parts as JSON text, for importing.raw_issues."""
    parsed = objects.where("json IS NOT NULL").select("file", "part", F.from_json("json", "struct<questions:array<string>>").alias("x"))
    return parsed.select("file", "part", F.posexplode("x.questions").alias("place", "raw"))


# What may stand between JSON objects, and the versions of their form that are read.
BETWEEN = r"(?i)```(?:json)?|^json$|covered\s+questions?\s+\d+\s*(?:to|-|–|—)\s*\d+[^\n]*"
VERSIONS = (1, 2)


def _salvaged(text: str) -> list[dict]:
    """The complete question objects of a list of questions that breaks off."""
    begin, decoder, found = re.search(r'"questions"\s*:\s*\[', text), json.JSONDecoder(), []
    at = begin.end() if begin else len(text)
    while step := re.compile(r"[\s,]*(?=\{)").match(text, at):
        try:
            value, at = decoder.raw_decode(text, step.end())
        except ValueError:
            break
        found.append(value)
    return found


def _form(value) -> tuple[dict | None, list[str]]:
    """An object of questions, and what is wrong with its form; nothing, if that keeps it from being read."""
    if isinstance(value, list):
        return {"questions": value}, ["bare_list"]
    version, codes = value.get("schema_version"), []
    if version is None:
        codes.append("no_schema_version")
    elif isinstance(version, bool) or version not in VERSIONS:
        return None, ["schema_version"]
    if not isinstance(value.get("questions"), list):
        return None, [*codes, "no_question_list"]
    return value, codes


def _parts(content: bytes) -> Iterator[tuple[dict | None, list[str], str | None, int | None]]:
    """(object, codes, message, number near a break) for each JSON value of a file."""
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        yield None, ["not_utf8"], None, None
        return
    decoder, opening, at, n = json.JSONDecoder(), re.compile(r"[{\[]"), 0, 0
    while start := opening.search(text, at):
        codes = ["text_before"] if n == 0 and re.sub(BETWEEN, "", text[: start.start()], flags=re.M).strip(" \n\t`\"'") else []
        try:
            value, at = decoder.raw_decode(text, start.start())
        except ValueError as e:
            numbers = re.findall(r'"number"\s*:\s*(\d+)', text[: getattr(e, "pos", 0) or len(text)])
            saved = _salvaged(text[start.start() :]) if n == 0 else []
            yield {"schema_version": 2, "questions": saved} if saved else None, [*codes, "broken_rest" if n else "broken"], f"broken after {len(saved)} questions: {e.args[0]}", int(numbers[-1]) if numbers else None
            return
        n += 1
        good, wrong = _form(value)
        yield good, codes + wrong, None, None
    if not n:
        yield None, ["no_json"], "no JSON object", None
    elif re.sub(BETWEEN, "", text[at:], flags=re.M).strip(" \n\t`\"'"):
        yield None, ["text_after"], None, None


def json_objects(files: DataFrame) -> DataFrame:
    """(file, part, json, issue, codes, near): the JSON objects of files that may hold several, between fences and lines that say what they cover.
    A bare list counts as a list of questions. codes: what is wrong with a part, see importing.part_issues. Where the first object of
    a file breaks off, its complete questions are salvaged; issue says where it broke, near which question. Part numbers count
    what was found in a file, text behind the last object included."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(file, n, json.dumps(value, ensure_ascii=False) if value is not None else None, issue, codes, near) for file, content in zip(batch["file"], batch["content"]) for n, (value, codes, issue, near) in enumerate(_parts(bytes(content)), 1)]
            yield pd.DataFrame(out, columns=["file", "part", "json", "issue", "codes", "near"]).astype({"near": "Int32"})

    return files.select("file", "content").mapInPandas(run, "file string, part int, json string, issue string, codes array<string>, near int")


QUESTION = "struct<number:int,question:string,options:map<string,string>,question_hi:string,options_hi:map<string,string>,correct_answer:string,explanation:string,subject:string,topic:string,has_image:boolean,page:int,uncertain:boolean>"


def json_questions(objects: DataFrame) -> DataFrame:
    """(file, part, place, q) of every question in the parts."""
    parsed = objects.where("json IS NOT NULL").select("file", "part", F.from_json("json", f"struct<questions:array<{QUESTION}>>").alias("x"))
    return parsed.select("file", "part", F.posexplode("x.questions").alias("place", "q"))


def book_chapters(spark: SparkSession, path: str) -> DataFrame:
    """(file, book, subject, chapter_no, chapter, book_number, q): chapters of one object each, numbered through the book. A folder holds the
    chapters of a book; its questions are as many as one task can number."""
    from pyspark.sql.window import Window

    schema = "subject string, chapter_no int, chapter string, question_count int, questions array<struct<id:string,number:int,question:string,options:map<string,string>,answer:string,explanation:string,page:int,needs_review:array<string>>>, _corrupt_record string"
    found = spark.read.schema(schema).option("multiLine", True).json(path).where("chapter_no IS NOT NULL").select(F.col("_metadata.file_path").alias("file"), "subject", "chapter_no", "chapter", F.posexplode("questions").alias("place", "q"))
    found = found.withColumn("book", F.regexp_replace("file", "/[^/]*$", ""))
    w = Window.partitionBy("book", "subject").orderBy("chapter_no", "q.number", "file", "place")
    return found.withColumn("book_number", F.row_number().over(w))


def chapter_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, subject, chapter_no, chapter, question_count, n, corrupt): one row for each chapter file; corrupt: its text, if it is no JSON."""
    schema = "subject string, chapter_no int, chapter string, question_count int, questions array<string>, _corrupt_record string"
    found = spark.read.schema(schema).option("multiLine", True).json(path)
    return found.select(F.col("_metadata.file_path").alias("file"), "subject", "chapter_no", "chapter", "question_count", F.greatest(F.size("questions"), F.lit(0)).alias("n"), F.col("_corrupt_record").alias("corrupt"))
