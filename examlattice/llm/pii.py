"""Personal data: detection by patterns and keyed surrogates, in DataFrame functions only.

An entity's surrogate depends on a secret key, its kind and its canonical form (an e-mail in lower case, the digits of a phone
number, ...), so every mention of it in any text gets the same one. Surrogates keep the kind's format: separators and country
prefix of a phone, network digit and check digit of a card, the letters-and-digits shape of an e-mail's local part, country and check digits
of an IBAN; a name keeps its title, the gender that the title tells, its script and its capitals. All distinct entities are
checked: where two would share a surrogate, or a surrogate is itself a real entity, one draws again. Given names are entities of
their own, by script and gender, so that two people of one surname never share a surrogate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import BROADCAST_IDS, Scratch

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# Titles by the gender they tell, given names and syllables by script.
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"]
NEUTRAL = ["Dr", "Prof"]
GIVEN = {
    ("latin", "male"): ["Adrian", "Bruno", "Carl", "Dario", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karim", "Leo", "Marco", "Nils", "Oscar", "Paul"],
    ("latin", "female"): ["Alma", "Berta", "Clara", "Dora", "Elsa", "Flora", "Greta", "Helena", "Irma", "Julia", "Karla", "Lea", "Maria", "Nora", "Olga", "Paula"],
    ("latin", "neutral"): ["Alexis", "Andrea", "Charlie", "Dominique", "Eden", "Florian", "Gael", "Jules", "Kim", "Luca", "Maxime", "Noa", "Robin", "Sascha", "Toni", "Yael"],
    ("cyrillic", "male"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Илья", "Кирилл", "Лев", "Марк", "Никита", "Олег", "Павел", "Роман", "Юрий"],
    ("cyrillic", "female"): ["Анна", "Белла", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Инна", "Кира", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Рита", "Юлия"],
    ("greek", "male"): ["Άγγελος", "Βασίλης", "Γιάννης", "Δημήτρης", "Ηλίας", "Θωμάς", "Κώστας", "Λουκάς", "Μάριος", "Νίκος", "Πέτρος", "Σπύρος", "Τάσος", "Φίλιππος", "Χρήστος", "Ορέστης"],
    ("greek", "female"): ["Άννα", "Βάσω", "Γεωργία", "Δήμητρα", "Ελένη", "Ζωή", "Ηρώ", "Θάλεια", "Ιωάννα", "Κατερίνα", "Μαρία", "Νίκη", "Ουρανία", "Ρένα", "Σοφία", "Χαρά"],
}
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "hu", "ka", "le", "mi", "no", "pu", "ra", "se", "ti", "vo", "wu", "za"],
    "cyrillic": ["ба", "ве", "ги", "до", "жу", "за", "ке", "ли", "мо", "ну", "па", "ре", "си", "то", "фу", "ша"],
    "greek": ["βα", "γε", "δι", "ζο", "θυ", "κα", "λε", "μι", "νο", "πυ", "ρα", "σε", "τι", "φο", "χυ", "ψα"],
}
_TITLES = "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))
_NAME = r"\p{Lu}[\p{L}'-]+(?![\p{L}\p{N}])"
# No group of variable width is repeated without a small bound: Java's regex would recurse once for each round of it.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}",
    "ip": rf"(?<![0-9A-Za-z.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9A-Za-z]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "card": r"(?<![0-9A-Za-z])(?:3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}|[2-6][0-9]{3}(?:[ -]?[0-9]{4}){3})(?![0-9A-Za-z])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])",
    "person": rf"(?<!\p{{L}})(?:{_TITLES})\.? {_NAME}(?: {_NAME})?",
}
KINDS = list(PATTERNS)
#: Only texts with an @ pay for the search of e-mails; all else begins with a digit, a bracket, a plus or a capital.
WITHOUT_AT = rf"(?=[0-9(+\p{{Lu}}])(?:{'|'.join(f'(?:{PATTERNS[k]})' for k in KINDS[1:])})"
ANY = f"(?:{PATTERNS['email']})|{WITHOUT_AT}"


def _by_at(text: Column, make) -> Column:
    return F.when(text.contains("@"), make(ANY)).otherwise(make(WITHOUT_AT))


def mentions(text: Column) -> Column:
    """All entities of a text, in order."""
    return _by_at(text, lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0)))


def between(text: Column) -> Column:
    """What stands before, between and after them."""
    return _by_at(text, lambda p: F.split(text, p, -1))


def kind_of(entity: Column) -> Column:
    """The first kind whose pattern fits the whole entity."""
    out = F.lit("person")
    for k in reversed(KINDS[:-1]):
        out = F.when(entity.rlike(rf"^(?:{PATTERNS[k]})$"), k).otherwise(out)
    return out


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _prefix(phone: Column) -> Column:
    return F.regexp_extract(phone, r"^\+[0-9]{1,3}", 0)


def _title(person: Column) -> Column:
    return F.regexp_extract(person, rf"^((?:{_TITLES})\.?) ", 1)


def canonical(kind: Column, entity: Column) -> Column:
    """What two mentions of one entity have in common; of a person the last name."""
    rest = F.regexp_replace(entity, r"^\+[0-9]{1,3}", "")
    return (
        F.when(kind == "email", F.lower(entity)).when(kind == "phone", _digits(rest)).when(kind.isin("card", "ssn"), _digits(entity))
        .when(kind == "iban", F.regexp_replace(entity, " ", "")).when(kind == "person", F.lower(F.substring_index(entity, " ", -1))).otherwise(entity)
    )


def given_of(person: Column) -> Column:
    """Script, gender and given name of a person; null without a given name."""
    title = F.regexp_replace(_title(person), r"\.", "")
    names = F.split(F.regexp_replace(person, rf"^(?:{_TITLES})\.? ", ""), " ")
    gender = F.when(title.isin(MALE), "male").when(title.isin(FEMALE), "female").otherwise("neutral")
    return F.when(F.size(names) > 1, F.concat_ws(" ", _script(F.get(names, F.lit(0))), gender, F.lower(F.get(names, F.lit(0)))))


def named(entities: DataFrame, *keep: str) -> DataFrame:
    """(keep, kind, canon) of each entity e, and of each given name as an entity of kind given."""
    rows = entities.select(*keep, kind_of(F.col("e")).alias("kind"), "e").select(*keep, "kind", canonical(F.col("kind"), F.col("e")).alias("canon"), F.when(F.col("kind") == "person", given_of(F.col("e"))).alias("given"))
    own, given = F.struct("kind", "canon"), F.struct(F.lit("given").alias("kind"), F.col("given").alias("canon"))
    return rows.select(*keep, F.explode(F.when(F.col("given").isNull(), F.array(own)).otherwise(F.array(own, given))).alias("x")).select(*keep, "x.kind", "x.canon")


def _digest(key: str, *parts: Column) -> Column:
    """64 hexadecimal digits that only the key's owner can compute from the parts."""
    return F.sha2(F.concat(F.lit(key + "\u001f"), F.sha2(F.concat_ws("\u001f", F.lit(key), *parts), 256)), 256)


def _fill(template: Column, figures: Column, letters: Column) -> Column:
    """template with each digit and each letter replaced by one from figures and letters (64 of each)."""
    def one(c: Column, i: Column) -> Column:
        at = F.pmod(i, F.lit(64)) + 1
        letter = F.substr(letters, at, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substr(figures, at, F.lit(1))).when(c.rlike("[a-z]"), letter).when(c.rlike("[A-Z]"), F.upper(letter)).otherwise(c)

    return F.array_join(F.transform(F.split(template, ""), one), "")


#: From this many draws on a kind's space is so full that surrogates get longer: four figures more for each so many draws.
DENSE = 6


def _wider(attempt: Column) -> Column:
    return F.least(F.lit(12), 4 * F.floor(attempt / DENSE)).cast("int")


def _number(digest: Column, at: int, most: int) -> Column:
    return F.pmod(F.conv(F.substr(digest, F.lit(at), F.lit(7)), 16, 10).cast("long"), F.lit(most))


def _luhn(digits: Column) -> Column:
    """The check digit for the digits before it."""
    def value(c: Column, i: Column) -> Column:
        twice = c.cast("int") * F.when((F.length(digits) - i) % 2 == 1, 2).otherwise(1)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda a, b: a + b)
    return ((10 - total % 10) % 10).cast("string")


def _iban_check(bare: Column) -> Column:
    """Check digits for an IBAN's body, country and two zeros."""
    figures = F.array_join(F.transform(F.split(bare, ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
    left = F.aggregate(F.split(figures, ""), F.lit(0), lambda a, c: (a * 10 + c.cast("int")) % 97)
    return F.lpad((98 - left).cast("string"), 2, "0")


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.split(F.lit(" ".join(values)), " "), (n + 1).cast("int"))


def _script(x: Column) -> Column:
    return F.when(x.rlike(r"\p{IsCyrillic}"), "cyrillic").when(x.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def cores(drawn: Column, key: str) -> Column:
    """drawn: array of (kind, canon, attempt). With core: the surrogate in canonical form; attempt is how often it had to draw again.

    Done in steps, each over the array that the last one made, so that no expression is written twice."""
    def keep(x: Column, *names: str) -> list[Column]:
        return [x[n].alias(n) for n in names]

    base = ("kind", "canon", "attempt")
    x = F.transform(drawn, lambda x: F.struct(*keep(x, *base), _digest(key, x["kind"], x["canon"], x["attempt"].cast("string")).alias("d"), _digest(key, F.lit("domain"), F.substring_index(x["canon"], "@", -1)).alias("domain")))
    x = F.transform(x, lambda x: F.struct(*keep(x, *base, "d", "domain"), F.translate(x["d"], "abcdef", "012345").alias("f"), F.translate(x["d"], "0123456789", "ghijklmnop").alias("l")))
    x = F.transform(x, lambda x: F.struct(
        *keep(x, *base, "d", "domain", "f"),
        F.when(x["kind"] == "email", _fill(F.substring_index(x["canon"], "@", 1), x["f"], x["l"]))
        .when(x["kind"] == "iban", F.concat(_fill(F.substr(x["canon"], F.lit(5)), x["f"], x["l"]), F.substr(x["f"], F.lit(50), _wider(x["attempt"]))))
        .when(x["kind"] == "card", F.concat(F.substr(x["canon"], F.lit(1), F.lit(1)), F.substr(x["f"], F.lit(1), F.length(x["canon"]) - 2 + _wider(x["attempt"]))))
        .when(x["kind"] == "given", F.substring_index(x["canon"], " ", 2)).when(x["kind"] == "person", _script(x["canon"])).alias("body")))

    def core(x: Column) -> Column:
        d, f, canon, body = x["d"], x["f"], x["canon"], x["body"]
        again = F.when(x["attempt"] > 0, F.substr(f, F.lit(58), F.lit(6))).otherwise("")
        country = F.substr(canon, F.lit(1), F.lit(2))
        syllables = F.split(F.when(body.startswith("cyrillic"), " ".join(SYLLABLES["cyrillic"])).when(body.startswith("greek"), " ".join(SYLLABLES["greek"])).otherwise(" ".join(SYLLABLES["latin"])), " ")

        def spoken(last: Column) -> Column:
            return F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: F.element_at(syllables, (F.pmod(F.conv(F.substr(d, 1 + 8 * i, F.lit(7)), 16, 10).cast("long"), F.lit(16)) + 1).cast("int"))), "")

        given = _pick(GIVEN["latin", "neutral"], _number(d, 49, 16))
        for (script, gender), names in GIVEN.items():
            fits = body == f"{script} {gender}"
            given = F.when(fits | (body == f"{script} neutral") if gender == "male" and script != "latin" else fits, _pick(names, _number(d, 49, 16))).otherwise(given)
        given = F.when(x["attempt"] > 0, F.concat(given, spoken(F.when(x["attempt"] > 1, 5).otherwise(2)))).otherwise(given)
        person = F.initcap(spoken(F.when(x["attempt"] >= DENSE, 7).when(x["attempt"] > 0, 5).otherwise(3)))
        return (
            F.when(x["kind"] == "email", F.concat(body, again, F.lit("@d"), F.substr(x["domain"], F.lit(1), F.lit(10)), F.lit(".example")))
            .when((x["kind"] == "ip") & (x["attempt"] >= DENSE), F.concat(F.lit("2001:db8::"), F.substr(d, F.lit(1), F.lit(4)), F.lit(":"), F.substr(d, F.lit(5), F.lit(4)), F.lit(":"), F.substr(d, F.lit(9), F.lit(4))))
            .when(x["kind"] == "ip", F.concat_ws(".", *[(1 + _number(d, 1, 223)).cast("string"), *[_number(d, 9 + 8 * i, 256).cast("string") for i in range(3)]]))
            .when(x["kind"] == "card", F.concat(body, _luhn(body)))
            .when(x["kind"] == "ssn", F.concat(F.lit("9"), F.substr(f, F.lit(1), F.length(canon) - 1 + _wider(x["attempt"]))))
            .when(x["kind"] == "iban", F.concat(country, _iban_check(F.concat(body, country, F.lit("00"))), body))
            .when(x["kind"] == "phone", F.substr(f, F.lit(1), F.length(canon) + _wider(x["attempt"]))).when(x["kind"] == "given", given)
            .otherwise(person)
        )

    return F.transform(x, lambda x: F.struct(*keep(x, *base), core(x).alias("core")))


def _lay_out(template: Column, figures: Column) -> Column:
    """The digits (and letters) of figures in the places of those of the template; further ones behind it."""
    size = F.length(F.regexp_replace(template, "[^0-9A-Z]", ""))

    def one(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substr(template, F.lit(1), i), "[^0-9A-Z]", ""))
        return F.when(c.rlike("[0-9A-Z]"), F.substr(figures, before + 1, F.lit(1))).otherwise(c)

    return F.concat(F.array_join(F.transform(F.split(template, ""), one), ""), F.substr(figures, size + 1))


def surrogates(found: Column, key: str, attempts: Column | None = None) -> Column:
    """The texts that take the places of an array of entities. attempts: map from 'kind:canonical form' to further draws."""
    kinds = F.transform(found, lambda e: F.struct(e.alias("e"), kind_of(e).alias("kind")))
    known = F.transform(kinds, lambda x: F.struct(x["e"].alias("e"), x["kind"].alias("kind"), canonical(x["kind"], x["e"]).alias("canon"), F.when(x["kind"] == "person", given_of(x["e"])).alias("given")))

    def attempt(kind: Column, canon: Column) -> Column:
        return F.lit(0) if attempts is None else F.coalesce(F.try_element_at(attempts, F.concat(kind, F.lit(":"), canon)), F.lit(0))

    new = cores(F.transform(known, lambda x: F.struct(x["kind"].alias("kind"), x["canon"].alias("canon"), attempt(x["kind"], x["canon"]).alias("attempt"))), key)
    people = F.filter(known, lambda x: x["given"].isNotNull())
    given = cores(F.transform(people, lambda x: F.struct(F.lit("given").alias("kind"), x["given"].alias("canon"), attempt(F.lit("given"), x["given"]).alias("attempt"))), key)
    given = F.map_from_entries(F.array_distinct(F.transform(given, lambda x: F.struct(x["canon"], x["core"]))))

    def parts(s: Column) -> Column:
        return F.zip_with(s["known"], s["new"], lambda x, y: F.struct(
            x["e"].alias("e"), x["kind"].alias("kind"), y["core"].alias("core"), _prefix(x["e"]).alias("prefix"), _title(x["e"]).alias("title"), F.try_element_at(s["given"], x["given"]).alias("given"),
            F.when(x["kind"] == "person", F.split(F.regexp_replace(x["e"], rf"^(?:{_TITLES})\.? ", ""), " ")).alias("names")))

    def person(x: Column) -> Column:
        name = F.concat(F.when(F.size(x["names"]) > 1, F.concat(x["given"], F.lit(" "))).otherwise(""), x["core"])
        shouted = F.forall(x["names"], lambda n: (n == F.upper(n)) & (F.length(n) > 1))
        return F.concat(x["title"], F.lit(" "), F.when(shouted, F.upper(name)).otherwise(name))

    # all three are computed once, and not anew for each entity
    once = F.get(F.transform(F.array(F.struct(known.alias("known"), new.alias("new"), given.alias("given"))), parts), F.lit(0))
    return F.transform(once, lambda x: (
        F.when(x["kind"] == "phone", F.concat(x["prefix"], _lay_out(F.substr(x["e"], F.length(x["prefix"]) + 1), x["core"])))
        .when(x["kind"].isin("card", "ssn", "iban"), _lay_out(x["e"], x["core"])).when(x["kind"] == "person", person(x)).otherwise(x["core"])))


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, canon) of each distinct entity of the texts, given names among them."""
    found = docs.select(F.explode(mentions(F.col(text))).alias("e"))
    return named(found).distinct()


def _few(rows: DataFrame, n: int) -> DataFrame:
    """rows, of which there are n at most, as a broadcast side if they are few."""
    return F.broadcast(rows) if n <= BROADCAST_IDS // 8 else rows


def further_draws(docs: DataFrame, key: str, scratch: Scratch, text: str = "text") -> DataFrame:
    """(kind, canon, attempt) of the entities that must draw again so that all surrogates are distinct and none is real. Where a kind's
    space is full (all numbers of a length are real, say), later draws are longer, so that this ends.

    Each round shuffles only those who still draw, by unique keys (a surrogate's smallest claimant, then the claimant itself), so that
    a surrogate that many draw is no hot key."""
    known = scratch.keep(entities(docs, text))

    def at(kind: str, core: str) -> Column:
        """What surrogates are compared by. Two that share a hash by chance only draw once more than they need."""
        return F.xxhash64(kind, F.lower(core)).alias("at")

    taken = [known.select(at("kind", "canon"))]  # real entities, then the surrogates settled so far
    drawing, written, settled_rounds, attempt = known, [known], [], 0
    while True:
        drawn = drawing.select("kind", "canon", F.lit(attempt).alias("attempt"))
        drawn = drawn.select(F.explode(cores(F.array(F.struct("kind", "canon", "attempt")), key)).alias("x")).select("x.kind", "x.canon", at("x.kind", "x.core"))
        claims = best = scratch.keep(drawn.groupBy("at").agg(F.min(F.struct("canon", "kind")).alias("x")).select("at", "x.kind", "x.canon"))
        n = best.count()
        for table in taken:
            best = best.join(_few(table.join(_few(best.select("at"), n), "at", "left_semi"), n), "at", "left_anti")
        settled = scratch.keep(best)
        again = scratch.keep(drawing.join(settled.select("kind", "canon"), ["kind", "canon"], "left_anti").select("kind", "canon"))
        written += [claims, settled, again]
        settled_rounds.append(settled.select("kind", "canon", F.lit(attempt).alias("attempt")))
        taken.append(settled.select("at"))
        if again.isEmpty():
            break
        drawing, attempt = again, attempt + 1
    draws = known.select("kind", "canon", F.lit(0).alias("attempt")).limit(0)
    for later in settled_rounds[1:]:
        draws = draws.unionAll(later)
    draws = scratch.keep(draws)
    scratch.drop(*written)
    return draws


def pseudonymise(docs: DataFrame, key: str, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with its personal data replaced in `text`, and pii: a map from kind to the number of entities replaced.

    Null text stays null, with an empty map. A column of docs named pii is replaced, and columns whose names begin with __pii_ are
    dropped; all others stay. Repeated rows are treated alike. Names are found behind a title only (Mr, Frau, Dr and the like), and may be of any length, as may an e-mail's
    parts; a host is a run of letters, digits, dots and hyphens that ends in a dot and two or more letters. The key must be kept secret: who has it can test guesses.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pii")
    kept = [c for c in docs.columns if c != "pii" and not c.startswith("__pii_")]
    draws = further_draws(docs, key, scratch, text)
    found = docs.select(*kept, mentions(F.col(text)).alias("__pii_found"))
    attempts = None
    if not draws.isEmpty():
        mention = named(found.select(doc_id, F.explode("__pii_found").alias("e")), doc_id)
        chars = draws.agg(F.sum(32 + F.length("canon"))).first()[0]
        own = mention.join(_few(draws, chars // 32), ["kind", "canon"]).select(F.col(doc_id).alias("__pii_id"), F.struct(F.concat("kind", F.lit(":"), "canon").alias("key"), "attempt").alias("x"))
        own = own.groupBy("__pii_id").agg(F.map_from_entries(F.collect_set("x")).alias("__pii_draws"))
        found = found.join(own, found[doc_id].eqNullSafe(own["__pii_id"]), "left").drop("__pii_id")
        attempts = F.coalesce("__pii_draws", F.create_map().cast("map<string,int>"))
    pieces = between(F.col(text))
    new = surrogates(F.col("__pii_found"), key, attempts)
    joined = F.array_join(F.zip_with(pieces, new, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    kinds = F.transform("__pii_found", kind_of)
    counts = F.map_from_arrays(F.array_distinct(kinds), F.transform(F.array_distinct(kinds), lambda k: F.size(F.filter(kinds, lambda x: x == k))))
    rewritten = F.when(F.size("__pii_found") > 0, joined).otherwise(F.col(text))
    empty = F.create_map().cast("map<string,int>")
    return found.select(*[rewritten.alias(text) if c == text else F.col(c) for c in kept], F.when(F.size("__pii_found") > 0, counts).otherwise(empty).alias("pii"))
