"""Secrets in texts, in DataFrame functions only: known shapes, and high entropy in sliding windows.

A candidate string is a run of 20 and more characters of base64 and its web form that holds a digit and a letter. A window of 20
slides over it; the counts of its characters change by one leaving and one entering, and so does the sum of c * log2(c), kept in
whole millionths so that nothing drifts. The window's Shannon entropy is log2(20) - sum / 20. A window is judged by its own character
class: the limit is lower if it holds hexadecimal digits only. A candidate whose windows reach it gives one span, from the first such
window to the last, unless the allow-list knows the candidate. Runs without any digit, or without any letter, are not judged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The shapes, in the order in which equal starts are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "entropy"]

WINDOW = 20
#: Bits that a window must reach, by character class.
LIMITS = {"hex": 3.0, "mixed": 3.7}
#: Candidates that are no secrets: numbers, UUIDs, dates and versions, one word or path with a number behind it, repetitions, examples.
ALLOWED = [
    r"^[0-9+/_=-]+$", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"^[A-Za-z+/_=-]+[0-9]{1,4}$", r"^[0-9]{1,4}[A-Za-z+/_=-]+$",
    r"(.)\1{7}", r"(?i)example|sample|placeholder|xxxx",
]


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _running(values: Column, begin: int, op) -> Column:
    """For each value what op makes of begin and all values before it. In blocks of about the root of their number, so that an array of
    n values takes n * sqrt(n) steps and not n * n."""
    first = F.lit(begin)

    def blocks(x: Column) -> Column:
        block = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x))).cast("int"))
        whole = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")), lambda k: F.aggregate(F.slice(x, k * block + 1, block), first, op))
        return F.struct(x.alias("x"), block.alias("block"), whole.alias("whole"))

    def before(s: Column) -> Column:
        return F.struct(s["x"].alias("x"), s["block"].alias("block"), F.transform(s["whole"], lambda _, k: F.aggregate(F.slice(s["whole"], F.lit(1), k), first, op)).alias("before"))

    def each(s: Column) -> Column:
        def one(_: Column, i: Column) -> Column:
            block = F.floor(i / s["block"]).cast("int")
            return F.aggregate(F.slice(s["x"], block * s["block"] + 1, i - block * s["block"]), F.get(s["before"], block), op)

        return F.transform(s["x"], one)

    return F.when(F.size(values) > 0, _let(_let(_let(values, blocks), before), each)).otherwise(F.array().cast("array<int>"))


def _spans(text: Column, pattern: str, found: Column) -> Column:
    """(start, end, s) of each match, in characters: the lengths of the matches and of the pieces between them tell where they stand."""
    pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("p"), found.alias("s"))

    def placed(pairs: Column) -> Column:
        sizes = F.transform(pairs, lambda x: F.length(x["p"]) + F.length(x["s"]))
        return F.zip_with(pairs, _running(sizes, 0, lambda a, x: a + x), lambda x, b: F.struct((b + F.length(x["p"])).alias("start"), (b + F.length(x["p"]) + F.length(x["s"])).alias("end"), x["s"].alias("s")))

    return F.when(F.size(found) > 0, _let(pairs, placed)).otherwise(F.array().cast("array<struct<start:int,end:int,s:string>>"))


def _clear_of(base: Column, more: Column) -> Column:
    """base (start, rank, end; ranks below 3) and those of more (rank 3) that overlap none of them, by start and rank."""
    def sifted(all_: Column) -> Column:
        ends = _running(F.transform(all_, lambda x: F.when(x["rank"] < 3, x["end"]).otherwise(-1)), -1, lambda a, x: F.greatest(a, x))
        starts = F.reverse(_running(F.reverse(F.transform(all_, lambda x: F.when(x["rank"] < 3, x["start"]).otherwise((1 << 31) - 1))), (1 << 31) - 1, lambda a, x: F.least(a, x)))
        rows = F.arrays_zip(all_.alias("x"), ends.alias("e"), starts.alias("s"))
        return F.transform(F.filter(rows, lambda r: (r["x"]["rank"] < 3) | ((r["e"] <= r["x"]["start"]) & (r["s"] >= r["x"]["end"]))), lambda r: r["x"])

    return F.when(F.size(more) == 0, base).when(F.size(base) == 0, more).otherwise(_let(F.array_sort(F.concat(base, more)), sifted))


def _millionths(x: float) -> int:
    return round(x * 1_000_000)


def _entropic(s: Column) -> Column:
    """(first, last): the first and last window of s that reach the limit of the window's own class; null if none does."""
    table = F.array(*[F.lit(_millionths(c * math.log2(c)) if c else 0).cast("long") for c in range(WINDOW + 1)])
    limit = {k: F.lit(_millionths(WINDOW * (math.log2(WINDOW) - x))).cast("long") for k, x in LIMITS.items()}
    base = F.array(F.struct(F.split(s, "").alias("c"), F.array_distinct(F.split(s, "")).alias("a"), table.alias("t")))
    hexadecimal = lambda c: c.rlike("^[0-9a-fA-F]$")

    def scan(x: Column) -> Column:
        chars, alphabet, t = x["c"], x["a"], x["t"]
        counts = F.transform(alphabet, lambda a: F.size(F.filter(F.slice(chars, 1, WINDOW), lambda c: c == a)))
        total = F.aggregate(counts, F.lit(0).cast("long"), lambda acc, n: acc + F.get(t, n))
        other = F.size(F.filter(F.slice(chars, 1, WINDOW), lambda c: ~hexadecimal(c)))
        fits = total <= F.when(other == 0, limit["hex"]).otherwise(limit["mixed"])
        begin = F.struct(counts.alias("n"), other.alias("other"), total.alias("sum"), F.when(fits, 0).alias("first"), F.when(fits, 0).alias("last"))

        def slide(acc: Column, w: Column) -> Column:
            out, new = F.get(chars, w - 1), F.get(chars, w + WINDOW - 1)
            n_out = F.get(acc["n"], F.array_position(alphabet, out).cast("int") - 1)
            n_new = F.get(acc["n"], F.array_position(alphabet, new).cast("int") - 1)
            total = F.when(out == new, acc["sum"]).otherwise(acc["sum"] - F.get(t, n_out) + F.get(t, n_out - 1) - F.get(t, n_new) + F.get(t, n_new + 1))
            n = F.when(out == new, acc["n"]).otherwise(F.zip_with(acc["n"], alphabet, lambda v, a: v - F.when(a == out, 1).otherwise(0) + F.when(a == new, 1).otherwise(0)))
            other = acc["other"] - F.when(hexadecimal(out), 0).otherwise(1) + F.when(hexadecimal(new), 0).otherwise(1)
            fits = total <= F.when(other == 0, limit["hex"]).otherwise(limit["mixed"])
            return F.struct(n.alias("n"), other.alias("other"), total.alias("sum"), F.coalesce(acc["first"], F.when(fits, w)).alias("first"), F.when(fits, w).otherwise(acc["last"]).alias("last"))

        windows = F.when(F.size(chars) > WINDOW, F.sequence(F.lit(1), F.size(chars) - WINDOW)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(windows, begin, slide, lambda acc: F.when(acc["first"].isNotNull(), F.struct(acc["first"].alias("first"), acc["last"].alias("last"))))

    return F.get(F.transform(base, scan), F.lit(0))


def scan(docs: DataFrame, *, text: str = "text", allowed: list[str] = ALLOWED) -> DataFrame:
    """docs with secrets: an array of (start, rank, end) by start and rank, where KINDS[rank] is the kind; ends are exclusive,
    places are in characters. Null text counts as empty. A column named secrets is replaced; all others stay.

    assign: value of six and more characters. access: AKIA and 16 more capitals or digits. hex: 24 and more. entropy: see above;
    only where no span of the other kinds lies.
    """
    kept = [c for c in docs.columns if c not in ("secrets", "__t", "__a", "__k", "__h", "__e", "__base", "__more")]  # names of its own
    t = F.col("__t")
    found = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    found = found.select(*kept, "__t", _found(t, ASSIGN).alias("__a"), _found(t, ACCESS).alias("__k"), _found(t, HEX).alias("__h"), _found(t, CANDIDATE).alias("__e"))

    def kind(rank: int, pattern: str, column: str) -> Column:
        good = _spans(t, pattern, F.col(column))
        if rank == 0:
            good = F.filter(good, lambda x: F.length(F.regexp_extract(x["s"], ASSIGN, 1)) >= 6)
        return F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end")))

    base = F.array_sort(F.concat(kind(0, ASSIGN, "__a"), kind(1, ACCESS, "__k"), kind(2, HEX, "__h")))
    likely = F.filter(_spans(t, CANDIDATE, F.col("__e")), lambda x: x["s"].rlike("[0-9]") & x["s"].rlike("[A-Za-z]") & ~x["s"].rlike("|".join(f"(?:{p})" for p in allowed)))
    found = found.select(*kept, "__t", base.alias("__base"), F.when(F.exists("__e", lambda s: s.rlike("[0-9]")), likely).otherwise(F.array().cast("array<struct<start:int,end:int,s:string>>")).alias("__e"))
    ent = F.transform("__e", lambda x: F.struct(x["start"].alias("start"), _entropic(x["s"]).alias("w")))
    ent = F.transform(F.filter(ent, lambda x: x["w"].isNotNull()), lambda x: F.struct((x["start"] + x["w"]["first"]).alias("start"), F.lit(3).alias("rank"), (x["start"] + x["w"]["last"] + WINDOW).alias("end")))
    found = found.select(*kept, "__base", F.when(F.size("__e") > 0, ent).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int>>")).alias("__more"))
    return found.select(*kept, _clear_of(F.col("__base"), F.col("__more")).alias("secrets"))


def listing(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
