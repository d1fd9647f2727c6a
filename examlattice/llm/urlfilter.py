"""URL filter: host and path rules, and a weighted vocabulary found by Aho-Corasick.

A rule names a host and a path; it fits the host and its subdomains where the url's path starts with the rule's, and the longest
fitting rule decides. Where none fits, the vocabulary does: terms count where no letter or digit touches them. One strict term
rejects, and so do soft terms if several distinct ones stand in the url.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The vocabulary. Strict terms reject alone; soft ones are common words that reject only in company.
STRICT = [
    "porn", "porno", "pornhub", "xxx", "xnxx", "xvideos", "hentai", "milf", "bdsm", "blowjob", "camgirl", "camgirls", "camsex", "sexcam", "livesex", "nudes", "incest", "bestiality", "escorts", "hookers", "fetish", "gangbang", "creampie",
    "malware", "ransomware", "phishing", "keylogger", "botnet", "warez", "keygen", "crackz", "serialz", "nulled", "viagra", "cialis", "levitra", "kamagra", "tramadol", "xanax", "oxycontin", "slotxo", "sbobet", "judi", "togel", "carding", "cvv",
]
SOFT = [
    "adult", "sex", "sexy", "nude", "naked", "cam", "cams", "escort", "dating", "hookup", "singles", "webcam", "erotic", "erotica", "lingerie", "strip", "casino", "poker", "slots", "slot", "bet", "bets", "betting", "gambling", "jackpot", "roulette", "lottery", "bingo", "odds", "bonus", "win", "winner", "prize",
    "free", "cheap", "discount", "deal", "deals", "coupon", "offer", "buy", "pills", "pill", "pharmacy", "meds", "drugs", "generic", "loan", "loans", "payday", "credit", "debt", "cash", "money", "earn", "rich", "invest", "forex", "crypto", "bitcoin", "replica", "rolex", "diet", "weight", "keto",
    "spam", "farm", "ads", "ad", "track", "tracker", "popup", "click", "clickbait", "doorway", "linkfarm", "seo", "backlinks", "hack", "hacks", "cracked", "crack", "torrent", "torrents", "pirate", "cheats", "download", "apk", "serial", "proxy", "vpn", "xx",
]
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; empty without ://, or if null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(verdict, rule) of the longest rule that fits, null if none does. Of equally long ones the first in order decides."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1]), reverse=True)[::-1]:
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


class Vocabulary:
    """Counts of the distinct strict and soft terms of a string."""

    def __init__(self, strict: list[str], soft: list[str]):
        self.strict, self.soft = strict, soft
        self._built = None

    def __getstate__(self):
        return {"strict": self.strict, "soft": self.soft, "_built": None}

    def count(self, url: str) -> tuple[int, int]:
        if self._built is None:
            import ahocorasick

            self._built = ahocorasick.Automaton()
            for terms, weight in ((self.soft, 0), (self.strict, 1)):
                for term in terms:
                    self._built.add_word(term, (term, weight))
            if len(self._built):
                self._built.make_automaton()
        found: tuple[set, set] = (set(), set())
        for end, (term, weight) in self._built.iter(url) if len(self._built) else ():
            start = end + 1 - len(term)
            if (start == 0 or not _word(url[start - 1])) and (end + 1 == len(url) or not _word(url[end + 1])):
                found[weight].add(term)
        return len(found[1]), len(found[0])


def _word(c: str) -> bool:
    return c in "abcdefghijklmnopqrstuvwxyz0123456789"


def judge(pages: DataFrame, *, url: str = "url", rules: list[tuple[str, str]] = RULES, strict: list[str] = STRICT, soft: list[str] = SOFT, several: int = 2) -> DataFrame:
    """pages with host, path, rule, verdict (allow or block), n_strict and n_soft (distinct terms). A null url is allowed: it has
    no host, no path and no terms. Columns of pages with these names are replaced, and __terms and __rule are dropped; all others
    stay. Terms are in lower case; an empty vocabulary finds none."""
    words = Vocabulary(strict, soft)

    @F.arrow_udf("struct<strict:int,soft:int>")
    def terms(urls: pa.Array) -> pa.Array:
        found = [words.count(u) if u else (0, 0) for u in urls.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([a for a, _ in found], pa.int32()), pa.array([b for _, b in found], pa.int32())], ["strict", "soft"])

    new = ["host", "path", "rule", "verdict", "n_strict", "n_soft"]
    kept = [c for c in pages.columns if c not in [*new, "__terms", "__rule"] or c == url]
    own = F.struct(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), terms(F.translate(F.col(url), _UPPER, _LOWER)).alias("terms"))
    found = pages.select(*[F.col(c) for c in kept], own.alias("__terms"))
    x = F.col("__terms")
    found = found.select(*[F.col(c) for c in kept], x.alias("__terms"), rule_of(x["host"], x["path"], rules).alias("__rule"))
    rejected = (x["terms"]["strict"] > 0) | (x["terms"]["soft"] >= several)
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(rejected, "block").otherwise("allow"))
    return found.select(*[F.col(c) for c in kept], x["host"].alias("host"), x["path"].alias("path"), F.col("__rule.rule").alias("rule"), verdict.alias("verdict"), x["terms"]["strict"].alias("n_strict"), x["terms"]["soft"].alias("n_soft"))
