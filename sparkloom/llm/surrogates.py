"""Surrogates for personal data: every detected entity is replaced by a keyed one of its own kind.

A surrogate keeps the entity's type, script, case, length and separators.  It is made by a small
Feistel network that shifts characters inside their own class of letters or digits, so it is a
permutation of the strings of one shape: distinct entities stay distinct, the same entity is the
same everywhere in the corpus, and nobody without the key can go back.  Card numbers, which are
told from others by their check digit, and IBANs get right ones again, addresses stay addresses, first names come from a list of their
gender and script, and a surname is the same with every first name and title.  A person who has a
title somewhere in a text is also replaced there without it.

The surrogate of each distinct entity is made once.  A check over all of them finds the ones that
equal their own entity, another entity of the corpus or another's surrogate; these get further
attempts, from domains that grow, until all are distinct.  Then occurrences are joined with their
surrogates and only texts that hold an entity are put together anew.

DataFrame expressions only.
"""

from __future__ import annotations

import secrets
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import Workspace, shared_dir, table

#: Setting of the session that holds the key.  Without it a key is drawn and kept in the shared folder, so that
#: reruns and other sessions over that folder agree; who may read the folder may undo the surrogates.
KEY_SETTING = "spark.sparkloom.surrogates.key"
#: Attempts that keep an entity's shape; later ones are longer by a character each.
SAME_SHAPE = 4
ROUNDS = 4

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_FEMALE = "Mrs|Ms|Miss|Lady|Frau|Señora|Señorita|Sra|Srta|Madame|Mme|Mademoiselle|Mlle"
_TITLE = rf"(?:{_FEMALE}|Mr|Sir|Herr|Señor|Sr|Monsieur|M(?=\.)|Dr|Prof|Professor|Rev)"
#: What may stand between a title and a name, and between names.
_BLANK = r"[\x20\t\u00A0]{1,4}"
_AFTER = rf"\.?(?:{_BLANK}|[\x20\t]{{0,4}}\r?\n[\x20\t]{{0,4}})"
#: Calling codes of one and two digits; all others have three.
_CODES = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
#: Entity patterns in the order in which they are tried at a place of a text.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}",
    "secret": r"(?<![A-Za-z])(?i:api[_-]?key|access[_-]?key|token|secret|password|passwd)[\"']?\x20{0,3}[:=]\x20{0,3}[\"']?[A-Za-z0-9+/_=.~-]{8,256}|(?<![A-Za-z])(?i:password|passwd|pwd)[\"']?\x20{0,3}[:=]\x20{0,3}[\"']?(?=[^\s\"']{0,6}[0-9])[A-Za-z0-9+/_=.~!#$%*-]{4,7}(?![A-Za-z0-9])|(?<![A-Za-z])[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{1,64}:[^\s/@]{1,64}@|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{32,64})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])|(?<![A-Za-z0-9])[a-z]{2}[0-9]{2}(?:(?:[a-z]{4})?[0-9]{7,26}|(?:\x20[0-9]{4}){3,7}(?:\x20[0-9]{1,3})?)(?![A-Za-z0-9@.])",
    "ipv4": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])",
    "ipv6": r"(?<![\p{L}\p{N}:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){2,6}|[0-9A-Fa-f]{4}:)(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)[\x20.-]?)?[0-9]{2,4}(?:[\x20.-]?[0-9]{2,4}){1,4}|\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|0[1-9](?:[\x20.-][0-9]{2}){4}|0[0-9]{1,4}[\x20/-][0-9]{5,9})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{4}(?:[\x20-]?[0-9]{4}){2}[\x20-]?[0-9]{1,7}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9])",
    "name": rf"(?<!\p{{L}}){_TITLE}{_AFTER}\p{{Lu}}[\p{{L}}'-]{{1,40}}(?:{_BLANK}\p{{Lu}}[\p{{L}}'-]{{1,40}})?",
}
#: Every entity has a part of this; texts without one are not searched.
MAYBE = rf"[0-9@:=]|AKIA|ghp_|sk-|{_TITLE}{_AFTER}\p{{Lu}}"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


_HEX = ["0123456789abcdef", "0123456789ABCDEF"]
#: Ranges in which every code point is a letter of one script; too large to be listed.
_RANGES = [(0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0x3400, 0x4DB5), (0xA000, 0xA48C), (0x20000, 0x2A6D6)]
#: Letters in today's use, which are classes of their own beside the rest of their scripts.
_MODERN = [(0x61, 0x7A), (0xDF, 0xFF), (0x100, 0x17F), (0x3B1, 0x3C9), (0x3AC, 0x3CE), (0x430, 0x44F), (0x450, 0x45F), (0x5D0, 0x5EA), (0x620, 0x64A)]


def _classes() -> list[str]:
    """The letters and digits of the basic plane by script, case and use, upper case parallel to lower case.

    Compatibility forms and scripts of the ranges are left out.
    """
    found: dict[tuple, list[str]] = {}
    for point in range(0x3130):
        c, kind = chr(point), unicodedata.category(chr(point))
        if kind[0] not in "LN" or unicodedata.normalize("NFKC", c) != c or (c.lower() != c and len(c.lower()) == 1 and c.lower().upper() == c):
            continue
        script = unicodedata.name(c).split()[0] if point > 0x7F else "ASCII"
        paired = c.upper() != c and len(c.upper()) == 1 and c.upper().lower() == c
        modern = next((i for i, (a, b) in enumerate(_MODERN) if a <= point <= b), len(_MODERN))
        found.setdefault((point > 0x7F, modern, script, kind[0], paired), []).append(c)
    classes = [x for (_, _, _, _, paired), letters in sorted(found.items()) for x in (["".join(letters), "".join(letters).upper()] if paired else ["".join(letters)])]
    return [x for x in classes if len(x) > 1] + ["".join(x for x in classes if len(x) == 1)]


_VOWELS = set("aeiouyαεηιουωаеёиоуыэюяіїє")


def _spoken() -> list[str]:
    """The classes with the vowels of the plain alphabets apart, so that a name stays one that can be said."""
    out = []
    for x in _CLASSES:
        vowels = "".join(c for c in x if c.lower() in _VOWELS)
        out += [vowels, "".join(c for c in x if c not in vowels)] if len(vowels) > 2 else [x]
    return out


_CLASSES = _classes()
_SPOKEN = _spoken()
_DIGITS = ["0123456789"]
#: First names by gender and script.
_NAMES = {
    ("f", "latin"): "Anna Clara Emma Eva Greta Hanna Ida Julia Karin Laura Lena Lucia Maria Marta Mia Nina Nora Olivia Paula Rosa Sara Sofia Teresa Vera".split(),
    ("m", "latin"): "Adam Alex Anton Bruno David Emil Erik Felix Hugo Ivan Jonas Karl Leo Luis Marco Martin Max Noah Oscar Paul Pedro Peter Simon Victor".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Иван Максим Олег Павел Сергей".split(),
    ("f", "greek"): "Άννα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Σοφία Χριστίνα".split(),
    ("m", "greek"): "Ανδρέας Γιάννης Δημήτρης Ηλίας Κώστας Νίκος Παύλος Στέφανος".split(),
}


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where inner lambdas use it."""
    return F.transform(F.array(value), body)[0]


def _digest(*parts: Column | str | int) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 256)


def _byte(digest: Column, place: Column) -> Column:
    """The byte of a hexadecimal digest at a place, around and around."""
    return F.conv(F.substring(digest, (place % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _move(c: Column, k: Column, letters: list[str]) -> Column:
    """The character ``k`` places on in its class, around; what is in no class stays."""
    joined = "".join(letters)
    places = [1]
    for x in letters:
        places.append(places[-1] + len(x))
    starts = F.split(F.lit(",".join(map(str, places))), ",").cast("array<int>")  # one literal; the last is the end

    def moved(at: Column) -> Column:
        first, after = F.array_max(F.filter(starts, lambda s: s <= at)), F.array_min(F.filter(starts, lambda s: s > at))
        return _let(F.struct(first.alias("a"), (after - first).alias("n")), lambda x: F.substring(F.lit(joined), x["a"] + F.pmod(at - x["a"] + k, x["n"]), F.lit(1)))

    found = _let(F.call_function("instr", F.lit(joined), c), lambda at: F.when(at > 0, moved(at)))
    if letters is not _CLASSES and letters is not _SPOKEN:
        return F.when(c == "", c).otherwise(F.coalesce(found, c))
    point = F.ascii(c)
    out = F.when((c == "") | ~c.rlike(r"[\p{L}\p{N}]"), c)
    for a, b in _RANGES:
        moved = F.pmod(point - a + k * 251, F.lit(b - a + 1)) + a
        out = out.when(point.between(a, b), F.decode(F.unhex(F.lpad(F.hex(moved), 8, "0")), "UTF-32"))
    return out.otherwise(F.coalesce(found, F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(point + k, F.lit(26)) + 1, F.lit(1))))


def permute(s: Column, key: str, tweak: Column, alphabets: list[str]) -> Column:
    """A keyed permutation of the strings that have the separators and the classes of letters of ``s``.

    Each round shifts one half's characters by a digest of the other half, case aside, so strings
    that differ in case only stay so.  A letter that is in no class, nor in a range, becomes a Latin
    one, which only the check for collisions keeps apart.
    """
    half = (F.length(s) / 2).cast("int")
    shift = lambda x, d: _let(d, lambda e: F.array_join(F.transform(F.split(x, ""), lambda c, j: _move(c, _byte(e, j), alphabets)), ""))

    def turn(a: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, shift(a["l"], _digest(key, tweak, i.cast("string"), F.lower(a["r"])))).otherwise(a["l"])
        right = F.when(i % 2 == 1, shift(a["r"], _digest(key, tweak, i.cast("string"), F.lower(a["l"])))).otherwise(a["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    start = F.struct(F.substring(s, F.lit(1), half).alias("l"), F.substring(s, half + 1, F.length(s)).alias("r"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, turn, lambda a: F.concat(a["l"], a["r"]))


def _luhn(digits: Column) -> Column:
    """The check digit that Luhn's rule asks for after ``digits``."""
    twice = lambda d, i: F.when(i % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
    values = F.transform(F.reverse(F.split(digits, "")), lambda c, i: twice(c.cast("int"), i))
    return F.pmod(F.lit(10) - F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10, F.lit(10)).cast("int")


def _no_card(e: Column) -> Column:
    """Whether digits that look like a card's number fail its check: they are another number, and stay."""
    digits = F.regexp_replace(e, "[^0-9]", "")
    return F.right(digits, F.lit(1)).cast("int") != _luhn(F.substring(digits, F.lit(1), F.length(digits) - 1))


def _card(e: Column, key: str, tweak: Column) -> Column:
    """All digits but the last are permuted; the last is the check digit again."""
    front = permute(F.substring(e, F.lit(1), F.length(e) - 1), key, tweak, _DIGITS)
    return _let(front, lambda p: F.concat(p, _luhn(F.regexp_replace(p, "[^0-9]", "")).cast("string")))


def _ipv4(e: Column, key: str, tweak: Column, wide: Column) -> Column:
    """Numbers of one, two and three digits are shifted among 0-9, 10-99 and 100-255; if ``wide``, all among 0-255."""
    low = lambda n: F.when(wide | (n < 10), 0).when(n < 100, 10).otherwise(100)
    count = lambda n: F.when(wide, 256).when(n < 10, 10).when(n < 100, 90).otherwise(156)

    def turn(a: Column, i: Column) -> Column:
        other = F.array_join(F.transform(F.filter(a, lambda n, j: (j < 2) == (i % 2 == 1)), lambda n: n.cast("string")), ".")
        step = lambda d, j: F.conv(F.substring(d, j * 8 + 1, F.lit(6)), 16, 10).cast("int")
        return _let(_digest(key, tweak, i.cast("string"), other), lambda d: F.transform(a, lambda n, j: F.when((j < 2) == (i % 2 == 0), low(n) + F.pmod(n - low(n) + step(d, j), count(n))).otherwise(n)))

    numbers = F.transform(F.split(e, r"\."), lambda x: x.cast("int"))
    done = F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), numbers, turn)
    return F.array_join(F.transform(done, lambda n: n.cast("string")), ".")


def _mod97(s: Column) -> Column:
    """The remainder of an IBAN's letters and digits by 97, its first four moved to the end."""
    plain = F.replace(s, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))
    value = lambda c: F.conv(c, 36, 10).cast("int")
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(F.pmod(a * F.when(value(c) > 9, 100).otherwise(10) + value(c), F.lit(97))))


def _iban(e: Column, key: str, tweak: Column) -> Column:
    """The country stays, the account is permuted; check digits that were right are right again."""
    country = F.substring(e, F.lit(1), F.lit(2))
    account = permute(F.substring(e, F.lit(5), F.length(e)), key, F.concat(tweak, country), _CLASSES)
    right = _let(account, lambda p: F.concat(country, F.lpad((F.lit(98) - _mod97(F.concat(country, F.lit("00"), p))).cast("string"), 2, "0"), p))
    return F.when(_mod97(e) == 1, right).otherwise(F.concat(country, permute(F.substring(e, F.lit(3), F.length(e)), key, F.concat(tweak, country), _CLASSES)))


def _email(e: Column, key: str, tweak: Column) -> Column:
    local, domain = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    top = F.regexp_extract(domain, r"\.[^.]+$", 0)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
    return F.concat(permute(local, key, F.concat(tweak, F.lit("/local/"), F.lower(domain)), _CLASSES), F.lit("@"), permute(host, key, F.concat(tweak, F.lit("/host/"), F.lower(top)), _CLASSES), top)


def _script(first: Column) -> Column:
    """The script of a first name that has a list, or null."""
    out = F
    for script in sorted({s for _, s in _NAMES}):
        out = out.when(first.rlike(rf"^\p{{Is{script.capitalize()}}}"), script)
    return out.otherwise(None)


def _first_name(unit: Column, key: str, attempt: Column) -> Column:
    """Of a person "gender|first last": a first name of the list of gender and script.

    Each further attempt takes one name more and joins them with hyphens.  A script without a list
    has its letters permuted, which keeps the script but can't show a gender.
    """
    gender = F.substring(unit, F.lit(1), F.lit(1))
    first = F.substring_index(F.substring(unit, F.lit(3), F.length(unit)), " ", 1)
    names = F
    for (g, s), listed in _NAMES.items():
        names = names.when((gender == g) & (_script(first) == s), F.split(F.lit(" ".join(listed)), " "))
    names = names.otherwise(None)
    pick = lambda i: F.element_at(names, F.pmod(F.conv(F.substring(_digest(key, "first", gender, F.lower(first), attempt.cast("string"), i.cast("string")), F.lit(1), F.lit(8)), 16, 10).cast("long"), F.size(names).cast("long")).cast("int") + 1)
    longer = F.concat(first, F.repeat(F.right(first, F.lit(1)), F.greatest(attempt - SAME_SHAPE + 1, F.lit(0))))
    return F.when(names.isNotNull(), F.array_join(F.transform(F.sequence(F.lit(0), attempt), pick), "-")).otherwise(permute(longer, key, F.concat(F.lit("first"), attempt.cast("string")), _CLASSES))


def _secret(e: Column, key: str, tweak: Column) -> Column:
    head = F.regexp_extract(e, r"^(?:(?i:api[_-]?key|access[_-]?key|token|secret|password|passwd|pwd)[\"']?\x20{0,3}[:=]\x20{0,3}[\"']?|[a-z][a-z0-9+.-]{1,15}://|AKIA|ghp_|sk-)", 0)
    value = F.substring(e, F.length(head) + 1, F.length(e))
    return F.concat(head, F.when(value.rlike("^([0-9a-f]+|[0-9A-F]+)$"), permute(value, key, tweak, _HEX)).otherwise(permute(value, key, tweak, _CLASSES)))


def _phone(e: Column, key: str, tweak: Column) -> Column:
    code = F.regexp_extract(e, rf"^\+(?:[0-9]{{1,3}}(?=[\x20.(-])|{_CODES}|[0-9]{{3}})", 0)
    return F.concat(code, permute(F.substring(e, F.length(code) + 1, F.length(e)), key, F.concat(tweak, code), _DIGITS))


def kind(e: Column) -> Column:
    """The type of an entity: the first pattern that is the whole of it."""
    out = F.when(F.contains(e, F.lit("://")), "secret").when(F.contains(e, F.lit("@")), "email")
    for name, p in list(PATTERNS.items())[1:]:
        out = out.when(e.rlike(f"^(?:{p})$"), name)
    return out.otherwise("other")


def surrogate(unit: Column, type_: Column, key: str, attempt: Column) -> Column:
    """The surrogate of a unit of a type at an attempt (from 0)."""
    tweak = F.when(attempt == 0, type_).otherwise(F.concat_ws("#", type_, attempt.cast("string")))
    more = F.greatest(attempt - SAME_SHAPE + 1, F.lit(0))
    tail = F.right(unit, F.lit(1))
    longer = F.when(more == 0, unit).when(type_ == "email", F.concat(F.repeat(F.lit("x"), more), unit)).otherwise(F.concat(unit, F.repeat(F.when(tail.rlike(r"[\p{L}\p{N}]"), tail).otherwise(F.lit("x")), more)))
    special = {
        "email": _email(longer, key, tweak), "ipv4": _ipv4(unit, key, tweak, attempt > 0), "ipv6": permute(unit, key, tweak, _HEX), "card": _card(longer, key, tweak), "iban": _iban(longer, key, tweak),
        "person": _first_name(unit, key, attempt), "secret": _secret(longer, key, tweak), "phone": _phone(longer, key, tweak), "surname": permute(longer, key, tweak, _SPOKEN),
    }
    out = F
    for name, made in special.items():
        out = out.when(type_ == name, made)
    return out.otherwise(permute(longer, key, tweak, _CLASSES))


def entities(text: Column, pattern: Column | None = None) -> Column:
    """The entities of a text in order; an empty array for null."""
    found = F.regexp_extract_all(text, F.lit(ANY) if pattern is None else pattern, F.lit(0))
    return F.coalesce(F.when(text.rlike(MAYBE), found), F.array().cast("array<string>"))


#: The type of what only looks like an entity.
NONE = "none"
_TITLED = rf"^{_TITLE}{_AFTER}"


def _title(e: Column) -> Column:
    return F.regexp_extract(e, rf"{_TITLED}", 0)


def _untitled(e: Column) -> Column:
    return F.regexp_replace(e, _TITLED, "")


def _even(e: Column) -> Column:
    """With one blank between words, whatever was there."""
    return F.regexp_replace(e, r"[\x20\t\u00A0\r\n]+", " ")


def _gender(titled: Column) -> Column:
    """By the title; where that tells nothing, by the first name's ending."""
    female = F.array_contains(F.split(F.lit(" ".join(n for (g, _), ns in _NAMES.items() if g == "f" for n in ns)), " "), F.substring_index(_untitled(titled), " ", 1))
    return F.when(titled.rlike(rf"^(?:{_FEMALE})(?!\p{{L}})"), "f").when(titled.rlike("^(Dr|Prof|Rev)") & (female | F.substring_index(_untitled(titled), " ", 1).rlike("[aáàâαάηήая]$")), "f").otherwise("m")


def _pieces(found: Column, names: Column) -> Column:
    """What is to be put at each entity: (pos, sub, lead, type, unit), the surrogate of the unit after the lead."""

    def piece(pos: Column, sub: int, lead: Column, type_: Column, unit: Column) -> Column:
        return F.struct(pos.alias("pos"), F.lit(sub).alias("sub"), lead.alias("lead"), type_.alias("type"), unit.alias("unit"))

    def of(e: Column, i: Column) -> Column:
        name, rest = _title(e), _even(_untitled(e))
        last = F.substring_index(rest, " ", -1)
        titled = F.when(name != "", _even(e)).otherwise(F.filter(F.transform(names, _even), lambda n: F.endswith(n, F.concat(F.lit(" "), _even(e))))[0])
        no_iban = (kind(e) == "iban") & e.rlike("^[a-z]") & (_mod97(e) != 1)
        return (
            F.when((kind(e) == "card") & _no_card(e) | no_iban, F.array(piece(i, 0, e, F.lit(NONE), F.lit(""))))
            .when((kind(e) != "name") & (kind(e) != "other"), F.array(piece(i, 0, F.lit(""), kind(e), e)))
            .when(F.contains(rest, F.lit(" ")), F.array(piece(i, 0, name, F.lit("person"), F.concat(_gender(titled), F.lit("|"), rest)), piece(i, 1, F.regexp_extract(_untitled(e), _BLANK, 0), F.lit("surname"), last)))
            .otherwise(F.array(piece(i, 0, name, F.lit("surname"), rest)))
        )

    return F.flatten(F.transform(found, of))


def surrogates_of(spark: SparkSession, work: Workspace, units: DataFrame, key: str) -> DataFrame:
    """(type, unit, s) of the distinct units (type, unit): surrogates that are all different.

    A surrogate won't do if it is the unit itself, or another's of an earlier attempt or a smaller
    unit; and, while attempts keep the shape, if it is a unit of the corpus.  Persons are told apart
    among those with the same surname, whose own surrogates are different from all others.
    """
    person = F.col("type") == "person"
    scope = F.when(person, F.substring_index("unit", " ", -1)).otherwise("")
    own = F.when(person, F.substring_index(F.expr("substring(unit, 3)"), " ", 1)).otherwise(F.col("unit"))
    make = lambda rows: rows.withColumn("s", surrogate(F.col("unit"), F.col("type"), key, F.col("attempt")))
    made = work.save(make(units.withColumns({"scope": scope, "own": own, "attempt": F.lit(0)})), "made")
    while True:
        holder = made.groupBy("scope", "s").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("attempt", "type", "unit")).alias("one")).filter("n > 1").select("scope", "s", "one")
        real = units.filter(F.col("type") != "person").select(F.col("unit").alias("s"), F.lit("").alias("scope")).distinct().withColumn("real", F.lit(True))
        judged = made.join(holder, ["scope", "s"], "left").join(real, ["scope", "s"], "left")
        bad = (F.col("s") == F.col("own")) | (F.col("one").isNotNull() & (F.col("one") != F.struct("attempt", "type", "unit"))) | (F.col("real").isNotNull() & (F.col("attempt") < SAME_SHAPE))
        judged = judged.withColumn("bad", F.coalesce(bad, F.lit(False))).select("type", "unit", "scope", "own", "attempt", "s", "bad")
        if judged.filter("bad").isEmpty():
            return made.select("type", "unit", "s")
        judged = work.save(judged, "judged")
        work.drop(made)
        again = make(judged.filter("bad").select("type", "unit", "scope", "own", (F.col("attempt") + 1).alias("attempt")))
        made = work.save(judged.filter("NOT bad").drop("bad").unionByName(again), "made")
        work.drop(judged)


def session_key(spark: SparkSession) -> str:
    """The key of the session's setting, or one that is drawn once and kept in the shared folder."""
    found = spark.conf.get(KEY_SETTING, None)
    if not found:
        path = f"{shared_dir(spark)}/surrogates-key"
        spark.createDataFrame([(secrets.token_hex(16),)], "value string").coalesce(1).write.mode("ignore").text(path)
        found = min(r[0] for r in spark.read.text(path).collect())  # of two that wrote at once
    return found


def replace(spark: SparkSession, docs: DataFrame, key: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with the text rewritten, ``n_entities`` and ``entity_types`` (sorted, distinct).

    Null texts stay null with 0 entities; empty texts and texts without entities stay as they are.
    Repeated rows are rewritten alike.  Very long texts are searched and rewritten whole.  Columns
    named n_entities or entity_types are replaced; names that begin with __pii are reserved.
    """
    key = key or session_key(spark)
    work = Workspace(spark, "surrogates")
    docs = docs.drop("n_entities", "entity_types")
    plain = docs.withColumn("__pii_found", entities(F.col(text)))
    plain = plain.withColumn("__pii_names", F.filter("__pii_found", lambda e: e.rlike(_TITLED) & (kind(e) == "name")))
    untitled = F.transform("__pii_names", lambda n: _even(_untitled(n)))
    parts = F.array_distinct(F.concat(F.filter(untitled, lambda n: F.contains(n, F.lit(" "))), F.transform(untitled, lambda n: F.substring_index(n, " ", -1))))
    parts = F.transform(parts, lambda n: F.replace(n, F.lit(" "), F.lit(_BLANK)))
    plain = plain.withColumn("__pii_pattern", F.when(F.size("__pii_names") > 0, F.concat(F.lit(ANY + r"|(?<!\p{L})(?:"), F.array_join(parts, "|"), F.lit(r")(?![\p{L}'-])"))))
    found = F.when(F.col("__pii_pattern").isNotNull(), F.regexp_extract_all(F.col(text), F.col("__pii_pattern"), F.lit(0))).otherwise(F.col("__pii_found"))
    marked = plain.withColumn("__pii_pieces", _pieces(found, F.col("__pii_names"))).withColumn("__pii_hit", F.exists("__pii_pieces", lambda p: p["type"] != NONE))
    marked = marked.select(*docs.columns, "__pii_pattern", "__pii_pieces", "__pii_hit", F.monotonically_increasing_id().alias("__pii_row"))
    marked = work.save(marked, "marked")
    hit = marked.filter("__pii_hit")
    spread = hit.select("__pii_row", F.explode("__pii_pieces").alias("p")).select("__pii_row", "p.*")
    made = surrogates_of(spark, work, spread.filter(F.col("type") != NONE).select("type", "unit").distinct(), key)
    joined = spread.join(made, ["type", "unit"], "left")
    placed = joined.groupBy("__pii_row").agg(F.sort_array(F.collect_list(F.struct("pos", "sub", F.concat("lead", F.when(F.col("type") == NONE, "").otherwise(F.col("s"))).alias("put"), "type"))).alias("__pii_put"))
    split = F.when(F.col("__pii_pattern").isNull(), F.split(F.col(text), ANY, -1)).otherwise(F.split(F.col(text), F.col("__pii_pattern"), F.lit(-1)))
    new = F.concat(F.array_join(F.transform("__pii_put", lambda p: F.concat(F.when(p["sub"] == 0, F.element_at("__pii_gaps", p["pos"] + 1)).otherwise(""), p["put"])), ""), F.element_at("__pii_gaps", -1))
    real = F.filter("__pii_put", lambda p: p["type"] != NONE)
    types = F.array_sort(F.array_distinct(F.transform(real, lambda p: F.when(p["type"].isin("person", "surname"), "name").otherwise(p["type"]))))
    put = hit.join(placed, "__pii_row").withColumn("__pii_gaps", split)
    put = put.select(*[new.alias(c) if c == text else F.col(c) for c in docs.columns], F.size(F.filter(real, lambda p: p["sub"] == 0)).cast("long").alias("n_entities"), types.alias("entity_types"))
    rest = marked.filter("NOT __pii_hit").select(*docs.columns, F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("entity_types"))
    return rest.unionByName(put)


def op2_surrogate_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` with surrogates, by the session's key; see ``replace``."""
    return replace(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
