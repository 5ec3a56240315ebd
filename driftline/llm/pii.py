"""Personal data replaced by surrogates, in DataFrame functions only.

One expression finds all entities of a text. Each is given a keyed surrogate of its type: digits become digits,
letters become letters of the same case and script, separators stay; card and account numbers pass their check-sum
tests, address octets keep their width, telephone numbers keep their country code, names keep the gender of their
title and their script. The surrogate depends only on key, type and canonical value, so an entity has the same
surrogate wherever and however it is written; a person named with a title is replaced in the rest of that text too.
Two entities of a type that would get the same surrogate, or one that would get another entity's true value, are
found by grouping the distinct entities and moved on until none are left. Where that takes many moves the format is
full (there are 10,000 addresses of one-digit octets), and the next moves draw from a wider one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import drop_written, written

#: Fixed patterns by type, in the order in which they are tried at a place.
PATTERNS: dict[str, str] = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "secret": r"(?<=[\"'])(?<=\b(?:token|secret|password|passwd|api_key|apikey|access_key) ?[=:] ?[\"'])[^\"'\s]{8,}(?=[\"'])",
    "access_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "phone": r"(?<![\d+])\+(?=(?:[ .()-]*\d){7,15}(?!\d))\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,5}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}\b|\b\d{3}-\d{3}-\d{4}\b|(?<![\d.])0\d(?:[ .-]\d{2}){4}(?![\d.])|(?<![\d.,])0\d{2,4}[ /-]\d{5,8}(?![\d.,])",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "ipv4": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "ipv6": r"(?<![:\w])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![:\w])",
    "card": r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\d)",
    "name": r"\b(?:Mr|Mrs|Ms|Miss|Herr|Frau|Mme|Mlle|Señora|Señor|M\.|Sr\.|Sra\.|г-н|г-жа)\.? \p{Lu}\p{L}+(?: \p{Lu}\p{L}+)?",
}
#: Titles of women, and given names by gender and script.
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Señora", "Sra.", "г-жа"]
GIVEN = {
    ("f", "latin"): ["Alma", "Berta", "Carla", "Dora", "Elena", "Flora", "Greta", "Hanna", "Irma", "Julia", "Klara", "Lena", "Marta", "Nora", "Olga", "Petra"],
    ("m", "latin"): ["Adam", "Bruno", "Carlo", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Martin", "Nils", "Oscar", "Paul"],
    ("f", "cyrillic"): ["Анна", "Вера", "Дарья", "Елена", "Зоя", "Ирина", "Лидия", "Ольга"],
    ("f", "greek"): ["Άννα", "Δάφνη", "Ελένη", "Ζωή", "Ιρις", "Μαρία", "Νίκη", "Σοφία"],
    ("m", "greek"): ["Άγγελος", "Γιώργος", "Ηλίας", "Κώστας", "Λουκάς", "Μάριος", "Νίκος", "Πέτρος"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Иван", "Олег", "Павел"],
}
SYLLABLES = {"latin": ["ba", "den", "fal", "gor", "hem", "kin", "lor", "mar", "nel", "pas", "rin", "sol", "tam", "ven", "wes", "zor"], "cyrillic": ["ба", "ве", "го", "ди", "жа", "ко", "ла", "ми", "но", "пе", "ри", "со", "ту", "фе", "ха", "ча"], "greek": ["βα", "γο", "δη", "ζε", "θα", "κι", "λο", "με", "νι", "πα", "ρο", "σα", "τε", "φι", "χα", "ψε"]}

#: A text without any of these holds no entity: each pattern needs one of them. Most texts are passed over by this look.
GATE = r"[@0-9\"']|AKIA|ASIA|[a-fA-F]:[a-fA-F]|M(?:r|s|iss|me|lle|\.)|Herr|Frau|S(?:eñor|r\.|ra\.)|г-"
ALL = "(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
#: The codes of countries by their first digits; all others have three.
COUNTRY = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: What a domain keeps, its last label, or two where the one before is a registry's own.
SUFFIX = r"(?i)(?<=.)(\.(?:co|com|org|net|gov|gob|edu|ac|or|ne)\.[a-z]{2}|\.[^.]+)$"
#: From this attempt on surrogates are drawn from a wider format.
WIDE = 8
_TITLE = r"^(Mrs|Mr|Ms|Miss|Herr|Frau|Mme|Mlle|Señora|Señor|M\.|Sr\.|Sra\.|г-н|г-жа)\.? "


def _at(digest: Column, k: Column, n: int) -> Column:
    """A keyed number below n at place k."""
    return F.pmod(F.conv(F.substring(digest, F.pmod(k, F.lit(31)) * 4 + 1, F.lit(4)), 16, 10).cast("int"), F.lit(n))


def kind_of(surface: Column) -> Column:
    """The type of an entity as matched; null for digits that fail the card check-sum, which stay as they are."""
    whole = None
    for name, pattern in PATTERNS.items():
        # Around a single entity there is nothing to look behind or ahead at.
        inner = r"[^\"'\s]{8,}" if name == "secret" else pattern
        rule = surface.rlike(f"^(?:{inner})$")
        if name == "secret":
            continue
        if name == "card":
            rule = rule & luhn(surface)
        whole = F.when(rule, name) if whole is None else whole.when(rule, name)
    digits = surface.rlike(f"^(?:{PATTERNS['card']})$")
    return whole.when(digits, F.lit(None).cast("string")).otherwise("secret")


def _digits(surface: Column) -> Column:
    return F.regexp_replace(surface, r"\D", "")


def _luhn_sum(digits: Column) -> Column:
    """Check-sum over all digits, the last one counting once."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def luhn(surface: Column) -> Column:
    return F.when(_digits(surface).rlike(r"^\d{13,19}$"), _luhn_sum(_digits(surface)) % 10 == 0).otherwise(F.lit(False))


def _phone(surface: Column) -> tuple[Column, Column]:
    """A telephone number with its country code where that is known, and how many digits follow that code."""
    digits = _digits(F.regexp_replace(surface, r"\(0\)", ""))
    code = F.length(F.regexp_extract(digits, COUNTRY, 1))
    french = surface.rlike(r"^0\d(?:[ .-]\d{2}){4}$")
    national = surface.startswith("0")
    number = F.when(surface.startswith("+"), digits).when(french, F.concat(F.lit("33"), F.substring(digits, 2, 99))).when(national, digits).otherwise(F.concat(F.lit("1"), digits))
    own = F.when(surface.startswith("+"), F.length(digits) - code).when(national, F.length(digits) - 1).otherwise(F.length(digits))
    return number, own


def canonical(surface: Column, kind: Column) -> Column:
    """How an entity is recognised again: without case and separators, names without their title."""
    name = F.lower(F.regexp_replace(surface, _TITLE, ""))
    plain = F.lower(F.regexp_replace(surface, r"[^\p{L}\p{N}]", ""))
    return F.when(kind == "name", name).when(kind == "email", F.lower(surface)).when(kind.isin("secret", "ipv4"), surface).when(kind == "ipv6", F.lower(surface)).when(kind == "phone", _phone(surface)[0]).otherwise(plain)


#: First letter and number of letters that stand for a script's letters.
_SCRIPTS = [(r"[\p{IsCyrillic}&&\p{Lu}]", 0x410, 32), (r"\p{IsCyrillic}", 0x430, 32), (r"[\p{IsGreek}&&\p{Lu}]", 0x391, 16), (r"\p{IsGreek}", 0x3B1, 16), (r"[\p{IsArmenian}&&\p{Lu}]", 0x531, 38), (r"\p{IsArmenian}", 0x561, 38), (r"\p{IsHebrew}", 0x5D0, 27), (r"\p{IsArabic}", 0x628, 19), (r"\p{IsHan}", 0x4E00, 256), (r"\p{IsHiragana}", 0x3042, 64), (r"\p{IsKatakana}", 0x30A2, 64), (r"\p{IsHangul}", 0xAC00, 256)]


def _replaced(surface: Column, kind: Column, digest: Column) -> Column:
    """Character by character: a keyed one of the same kind, counted over letters and digits only."""
    hexa = (kind == "ipv6") | ((kind == "secret") & surface.rlike("^[0-9a-fA-F]+$"))
    phone = kind == "phone"
    keep = F.when(kind == "access_key", F.lit(4)).when(kind == "iban", F.lit(2)).when(kind == "card", F.lit(1)).when(phone, F.length(_digits(surface)) - _phone(surface)[1]).otherwise(F.lit(0))
    letters = lambda base, k, n: F.chr(F.lit(base) + _at(digest, k, n))
    other = lambda first, k, n: F.substring(F.lit("".join(chr(first + i) for i in range(n))), _at(digest, k, n) + 1, F.lit(1))

    def one(c: Column, at: Column) -> Column:
        k = at - keep
        out = F.when(at < keep, c).when(phone & (k == 0) & c.rlike("[0-9]"), (_at(digest, k, 8) + 2).cast("string")).when(c.rlike("[0-9]"), _at(digest, k, 10).cast("string"))
        out = out.when(hexa & c.rlike("[a-f]"), letters(97, k, 6)).when(hexa & c.rlike("[A-F]"), letters(65, k, 6)).when(c.rlike("[a-z]"), letters(97, k, 26)).when(c.rlike("[A-Z]"), letters(65, k, 26))
        for script, first, n in _SCRIPTS:
            out = out.when(c.rlike(script), other(first, k, n))
        return out.when(c.rlike(r"\p{Lu}"), letters(65, k, 26)).when(c.rlike(r"\p{L}"), letters(97, k, 26)).otherwise(c)

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))
    step = lambda a, c: F.struct(F.concat(a["out"], one(c, a["k"])).alias("out"), (a["k"] + F.when(c.rlike(r"[\p{L}\p{N}]"), 1).otherwise(0)).alias("k"))
    return F.aggregate(F.split(surface, ""), start, step)["out"]


def _mod97(letters: Column) -> Column:
    """Remainder of an account number as its standard reads it, A to Z as 10 to 35."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(letters, ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + value(c)) % 97).when(c == "", a).otherwise((a * 100 + value(c)) % 97))


def digest_of(kind: Column, value: Column, attempt: Column, secret: str) -> Column:
    """What a surrogate is drawn from; ``attempt`` moves it on after a collision."""
    return F.sha2(F.concat_ws("\u0001", F.lit(secret), kind, value, attempt.cast("string")), 512)


def surrogate(surface: Column, kind: Column, digest: Column, wide: Column | None = None) -> Column:
    """The surrogate of an entity as it is written here; a ``wide`` one comes from a larger space."""
    wide = F.lit(False) if wide is None else wide
    more = lambda *k: F.when(wide, F.concat(*(_at(digest, F.lit(i), 10).cast("string") for i in k))).otherwise(F.lit(""))
    extra = more(23, 24, 25, 26, 27, 28)
    plain = _replaced(surface, kind, digest)
    local, domain = F.substring_index(surface, "@", 1), F.substring_index(surface, "@", -1)
    tail = F.regexp_extract(domain, SUFFIX, 1)
    mail = F.concat(_replaced(local, kind, digest), extra, F.lit("@"), _replaced(F.left(domain, F.length(domain) - F.length(tail)), kind, F.reverse(digest)), tail)
    octets = F.transform(F.split(surface, r"\."), lambda o, i: F.when(wide, _at(digest, i, 256)).when(F.length(o) == 1, _at(digest, i, 10)).when(F.length(o) == 2, _at(digest, i, 90) + 10).otherwise(_at(digest, i, 156) + 100).cast("string"))
    # A card's last digit is set so that the check-sum holds, an account's two digits behind its country too.
    body = F.concat(F.left(plain, F.length(plain) - 1), extra)
    last = F.pmod(-_luhn_sum(F.concat(_digits(body), F.lit("0"))), F.lit(10)).cast("string")
    country, account = F.left(plain, F.lit(2)), F.concat(F.substring(plain, 5, 99), extra)
    check = F.lpad((98 - _mod97(F.concat(F.regexp_replace(account, " ", ""), country, F.lit("00")))).cast("string"), 2, "0")
    title = F.regexp_extract(surface, _TITLE, 0)
    bare = F.regexp_replace(surface, _TITLE, "")
    female = F.rtrim(F.regexp_replace(title, r"(Mrs|Mr|Ms|Miss|Herr|Frau|Mme|Mlle|Señora|Señor|г-н|г-жа)\. $", "$1")).isin(FEMALE)
    part = lambda s, k: F.element_at(F.array(*map(F.lit, SYLLABLES[s])), _at(digest, F.lit(k), 16) + 1)
    given = lambda g, s: F.element_at(F.array(*map(F.lit, GIVEN[g, s])), _at(digest, F.lit(0), len(GIVEN[g, s])) + 1)

    def person(script: str) -> Column:
        first = F.when(female, given("f", script)).otherwise(given("m", script))
        longer = F.when(wide, F.concat(*(part(script, k) for k in (5, 6, 7, 8)))).otherwise(F.lit(""))
        family = F.initcap(F.concat(*(part(script, k) for k in (1, 2, 3, 4)), longer))
        return F.when(bare.contains(" "), F.concat_ws(" ", first, family)).otherwise(family)

    name = F.when(bare.rlike(r"\p{IsCyrillic}"), person("cyrillic")).when(bare.rlike(r"\p{IsGreek}"), person("greek")).when(bare.rlike(r"\p{IsLatin}"), person("latin")).otherwise(_replaced(bare, kind, digest))
    kinds = F.when(kind == "email", mail).when(kind == "ipv4", F.array_join(octets, ".")).when(kind == "card", F.concat(body, last)).when(kind == "iban", F.concat(country, check, account))
    return kinds.when(kind == "name", F.concat(title, name)).when(kind == "ipv6", plain).otherwise(F.concat(plain, extra))


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct ``(kind, value, surface)``: the entities of all texts, with one way of writing each (the least)."""
    some = docs.where(F.col(text).rlike(GATE))
    found = some.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(ALL), F.lit(0)))).alias("surface"))
    typed = found.distinct().withColumn("kind", kind_of(F.col("surface"))).where("kind is not null")
    return typed.withColumn("value", canonical(F.col("surface"), F.col("kind"))).groupBy("kind", "value").agg(F.min("surface").alias("surface"))


def retries(known: DataFrame, secret: str, max_rounds: int = 64) -> DataFrame:
    """The entities whose first surrogates collide, with the attempt at which they no longer do.

    Of entities that share a surrogate the one with the least value keeps it; the others try again, and so does
    an entity whose surrogate is the true value of an entity; of names the last word counts. Only those that collide are carried on, from the
    attempt ``WIDE`` on in a format with a million times more values, in which hardly any collide again.
    """
    attempts = None
    # Persons are told by their last names, by which a text may call them.
    told = lambda kind, value: F.when(kind == "name", F.substring_index(value, " ", -1)).otherwise(value)
    true = known.select("kind", told(F.col("kind"), F.col("value")).alias("taken"))
    for _ in range(max_rounds):
        if attempts is None:
            now = known.withColumn("attempt", F.lit(0))
        else:
            now = known.join(attempts, ["kind", "value"], "left").withColumn("attempt", F.coalesce("attempt", F.lit(0)))
        now = now.withColumn("digest", digest_of(F.col("kind"), F.col("value"), F.col("attempt"), secret))
        now = written(now.withColumn("made", surrogate(F.col("surface"), F.col("kind"), F.col("digest"), F.col("attempt") >= WIDE)), "made")
        made = now.select("kind", "value", "attempt", told(F.col("kind"), canonical(F.col("made"), F.col("kind"))).alias("taken"))
        keeper = made.groupBy("kind", "taken").agg(F.count("*").alias("n"), F.min("value").alias("keeper")).where("n > 1")
        shared = made.join(keeper, ["kind", "taken"]).where("value <> keeper").select("kind", "value", "attempt")
        stolen = made.join(true, ["kind", "taken"], "left_semi").select("kind", "value", "attempt")
        losers = written(shared.unionByName(stolen).distinct().select("kind", "value", (F.col("attempt") + 1).alias("next")), "losers")
        drop_written(now)
        if losers.isEmpty():
            return attempts if attempts is not None else losers.withColumnRenamed("next", "attempt")
        if attempts is None:
            moved = losers.withColumnRenamed("next", "attempt")
        else:
            moved = attempts.join(losers, ["kind", "value"], "full").select("kind", "value", F.coalesce("next", "attempt").alias("attempt"))
        moved = written(moved, "attempts")
        drop_written(losers)
        attempts = moved
    raise RuntimeError(f"surrogates still collide after {max_rounds} rounds")


def pseudonymised(docs: DataFrame, secret: str, text: str = "text", small: int = 20_000) -> DataFrame:
    """``docs`` with ``text`` rewritten and ``n_entities`` (long) added; all other columns and rows stay.

    Null texts stay null with 0 entities, texts without entities are returned unchanged, and equal texts are
    rewritten alike wherever they are. A person counts where a title stands before the name; what the text says of
    the same person without a title is replaced but not counted. ``secret`` keys the surrogates: another one gives others. A column named
    ``n_entities`` is replaced.
    """
    known = written(entities(docs, text), "entities")
    again = retries(known, secret)
    docs = docs.drop("n_entities")
    col = F.col(text)
    parts = F.split(col, ALL, -1)
    found = F.regexp_extract_all(col, F.lit(ALL), F.lit(0))
    moved = again.count()
    mapped = docs
    if moved:
        # Which texts hold an entity that was moved on: few, and joined by a hash of the text.
        held = docs.where(col.rlike(GATE)).select(F.xxhash64(col).alias("pii_text"), F.explode(F.array_distinct(found)).alias("surface")).distinct()
        held = held.withColumn("kind", kind_of(F.col("surface"))).where("kind is not null").withColumn("value", canonical(F.col("surface"), F.col("kind")))
        hit = held.join(F.broadcast(again) if moved <= small else again, ["kind", "value"]).groupBy("pii_text").agg(F.map_from_entries(F.collect_set(F.struct("surface", "attempt"))).alias("pii_again"))
        hit = written(hit, "moved")
        if hit.count() <= small:
            hit = F.broadcast(hit)
        mapped = docs.withColumn("pii_text", F.xxhash64(col)).join(hit, "pii_text", "left").drop("pii_text")
    attempt = (lambda s: F.coalesce(F.try_element_at("pii_again", s), F.lit(0))) if moved else (lambda s: F.lit(0))

    # In steps, so that type and digest of an entity are worked out once.
    typed = F.transform(found, lambda s: F.struct(s.alias("s"), kind_of(s).alias("kind"), attempt(s).alias("attempt")))
    keyed = F.transform(typed, lambda e: F.struct(e["s"].alias("s"), e["kind"].alias("kind"), e["attempt"].alias("attempt"), digest_of(e["kind"], canonical(e["s"], e["kind"]), e["attempt"], secret).alias("digest")))
    put = F.transform(keyed, lambda e: F.struct(F.when(e["kind"].isNull(), e["s"]).otherwise(surrogate(e["s"], e["kind"], e["digest"], e["attempt"] >= WIDE)).alias("to"), e["s"].alias("s"), e["kind"].alias("kind")))
    joined = F.array_join(F.flatten(F.zip_with(parts, F.concat(F.transform("pii_put", lambda e: e["to"]), F.array(F.lit(""))), lambda p, s: F.array(p, s))), "")
    # Persons named with a title: their full names first, then their last names, wherever else the text has them. Entities
    # and mentions are found in one pass over the text as it was, so nothing that was put in is ever replaced again.
    bare = lambda c: F.regexp_replace(c, _TITLE, "")
    full = F.transform(F.filter("pii_put", lambda e: e["kind"] == "name"), lambda e: F.struct(bare(e["s"]).alias("was"), bare(e["to"]).alias("now")))
    last = F.transform(full, lambda e: F.struct(F.substring_index(e["was"], " ", -1).alias("was"), F.substring_index(e["now"], " ", -1).alias("now")))
    named = F.transform("pii_people", lambda e: e["was"])
    first = lambda pairs, key: F.filter(pairs, lambda e, i: F.array_position(key, e["was"]) == i + 1)  # noqa: E731  one that two persons share is the first one's
    either = F.concat(F.lit(ALL + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(named, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    put_pairs = F.transform("pii_put", lambda e: F.struct(e["s"].alias("was"), e["to"].alias("now")))
    known_as = F.map_from_entries(first(put_pairs, F.transform("pii_put", lambda e: e["s"])))
    called = F.map_from_entries(first(F.col("pii_people"), named))
    replaced = F.transform(F.regexp_extract_all(col, F.col("pii_either"), F.lit(0)), lambda s: F.coalesce(F.try_element_at("pii_known", s), F.try_element_at("pii_called", s), s))
    mentions = F.array_join(F.flatten(F.zip_with(F.split(col, F.col("pii_either"), -1), F.concat(replaced, F.array(F.lit(""))), lambda p, s: F.array(p, s))), "")
    n = F.size(F.filter(typed, lambda e: e["kind"].isNotNull())).cast("long")
    has = col.rlike(GATE) & col.rlike(ALL)
    out = mapped.withColumn("n_entities", F.when(has, n).otherwise(F.lit(0).cast("long"))).withColumn("pii_put", F.when(has, put))
    person = F.exists("pii_put", lambda e: e["kind"] == "name")
    out = out.withColumn("pii_people", F.when(person, F.concat(full, last)))
    out = out.withColumns({"pii_either": F.when(F.col("pii_people").isNotNull(), either), "pii_known": F.when(F.col("pii_people").isNotNull(), known_as), "pii_called": F.when(F.col("pii_people").isNotNull(), called)})
    out = out.withColumn(text, F.when(F.col("pii_people").isNotNull(), mentions).when(has, joined).otherwise(col))
    return out.select(*docs.columns, "n_entities")
