"""Replacement of personal data by surrogates. DataFrame operations only.

Entities are found by one pattern. Each gets a surrogate of its own type, made of itself and a key by a Feistel network
on its characters: a digit stays a digit, a vowel a vowel of its case and script, marks stay, and so on by type; card
numbers and accounts keep their check digits true, addresses of hosts stay in range, given names that are known are exchanged
within their gender. For a key this maps the strings of a format one to one, so one entity has the same surrogate
everywhere (coreference; spellings of one telephone, card or account number differ in their marks and spaces only, which
stay where they were) and different entities have different ones (distinctness), without a table of all entities.
The network is run forth, one character is moved on, and the network is run back: so nothing that has a character that
can move stays what it was. Letters of every script have an alphabet or a run of code points.
That is checked: if two entities still share a surrogate, or one stays what it was though a character of it can move,
the whole is made again with the next key.

Nulls: a null text stays null and has no entities. Repeated rows are replaced alike. Empty tables give empty results.
All columns are carried; one that is named like a result (n_entities, entities, surrogates) is replaced.
"""

from __future__ import annotations

import random
import sys
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import bound, stored, table

# Titles and given names by gender.
TITLES_MALE = "Mr Sir Herr Monsieur Señor"
TITLES_FEMALE = "Mrs Ms Miss Frau Madame Mme Señora"
TITLES_ANY = "Dr Prof"
MALE = "James John Robert Michael William David Richard Thomas Daniel Paul Hans Karl Pierre Louis Carlos Juan"
FEMALE = "Mary Anna Maria Susan Linda Karen Laura Emma Julia Sarah Greta Ingrid Claire Sophie Carmen Lucia"

TITLE = "(?:" + "|".join(sorted(f"{TITLES_MALE} {TITLES_FEMALE} {TITLES_ANY}".split(), key=len, reverse=True)) + ")"
EMAIL = r"[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,}"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"
PHONE = r"(?<![\d])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\d])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
ACCESS = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
SECRET = r'(?i:password|passwd|pwd|secret|token|api_?key)\s{0,3}[=:]\s{0,3}["\x27]?(?=[+/_.-]*[A-Za-z0-9])[A-Za-z0-9+/_.-]{6,}'
PERSON = rf"(?<!\p{{L}}){TITLE}\.? \p{{Lu}}\p{{L}}++(?: \p{{Lu}}\p{{L}}++)?"
ANY = "|".join((EMAIL, SECRET, ACCESS, IP, PHONE, SSN, CARD, IBAN, PERSON))
#: What every entity has somewhere; texts without it aren't searched further.
QUICK = rf"[@=:0-9]|AKIA|(?<!\p{{L}}){TITLE}\.? \p{{Lu}}"

DIGITS = ("0123456789",)
PLAIN = (*DIGITS, "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "áàâäãåéèêëíìîïóòôöõúùûü", "ÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ")
# More of those that names are written in; capitals are at the places of their small letters.
MODERN = ("ñçčćďđğłńňřśšşťźžż", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ", "աեէըիոօ", "բգդզթժլխծկհձղճմյնշչպջռսվտրցփքֆ")
HEX = ("0123456789abcdef",)
CAPITAL = ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",)
ROUNDS = 6
KEY = "surrogates"


def _letters() -> tuple[tuple[str, ...], list[tuple[int, int]], dict[str, str]]:
    """Alphabets of all cased letters by script, runs (first, size) of code points of the others, and letters that are
    spelled as another one first, since both have the same small letter."""
    known = {c for a in PLAIN for c in a}
    signs = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c)[0] == "L"]
    script = lambda c: unicodedata.name(c, "OTHER").split()[0]
    capitals: dict[str, list[str]] = {}
    for c in signs:
        if len(c.lower()) == 1 and c.lower() != c:
            capitals.setdefault(c.lower(), []).append(c)
    pairs, same = {}, {"ς": "σ"}
    for small, some in capitals.items():
        pairs[small] = small.upper() if small.upper() in some or small.isascii() else some[0]
        same |= {c: pairs[small] for c in some if c != pairs[small]}
    alphabets = [*PLAIN, *(x for a in MODERN for x in (a, "".join(pairs[c] for c in a)))]
    known |= {c for a in alphabets for c in a} | same.keys()
    groups: dict[tuple, str] = {}
    large = set(pairs.values())
    for c in signs:
        if c not in known and c not in large and (c in pairs or unicodedata.category(c) in ("Lu", "Ll")) and len(c.lower()) == 1:
            key = (script(c), " WITH " in unicodedata.name(c, ""), c in pairs, unicodedata.category(c))
            groups[key] = groups.get(key, "") + c
    for paired in (True, False):  # letters that are alone in their group share one
        alone = [k for k, a in groups.items() if len(a) == 1 and k[2] == paired]
        for kind in {k[3] for k in alone}:
            some = [k for k in alone if k[3] == kind]
            groups["alone", paired, paired, kind] = "".join(groups.pop(k) for k in some)
    for key, a in groups.items():
        if len(a) > 1:
            alphabets += [a, "".join(pairs[c] for c in a)] if key[2] else [a]
    runs: list[list] = []
    for c in signs:
        if unicodedata.category(c) in ("Lo", "Lm") and c not in pairs and c not in known:
            if runs and runs[-1][0] + runs[-1][1] == ord(c) and runs[-1][2] == script(c):
                runs[-1][1] += 1
            else:
                runs.append([ord(c), 1, script(c)])
    return tuple(alphabets), [(a, n) for a, n, _ in runs if n > 1], same


LETTERS, RUNS, SAME = _letters()
# The same as strings: all letters, where the alphabet of each starts and how wide it is, as code points; likewise the runs.
ALL = "".join(LETTERS)
STARTS = "".join(chr(ALL.index(a[0]) + 1) * len(a) for a in LETTERS)
WIDTHS = "".join(chr(len(a)) * len(a) for a in LETTERS)
FIRSTS, SIZES = "".join(chr(a) for a, _ in RUNS), "".join(chr(n) for _, n in RUNS)
#: What can move in an entity, after what stays before it.
STAYS = rf"(?i)^(?:(?:password|passwd|pwd|secret|token|api_?key)\s{{0,3}}[=:]\s{{0,3}}[\x22\x27]?|{TITLE}\.? |AKIA)"
MOVES = "[" + ALL + "".join(f"{chr(a)}-{chr(a + n - 1)}" for a, n in RUNS) + "]"


def _byte(digest: Column, i: Column) -> Column:
    return F.conv(F.substring(digest, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _moved(c: Column, by: Column, alphabets: tuple[str, ...]) -> Column:
    """A character moved on in its alphabet; others stay."""
    out = None
    for letters in PLAIN if alphabets is LETTERS else alphabets:
        at = F.instr(F.lit(letters), c)
        new = F.substring(F.lit(letters), F.pmod(at - 1 + by, F.lit(len(letters))) + 1, F.lit(1))
        out = F.when(at > 0, new) if out is None else out.when(at > 0, new)
    if alphabets is not LETTERS:
        return out.otherwise(c)
    other = lambda at: F.when(at > 0, _turned(at, by)).otherwise(bound(F.size(F.filter(_chars(F.lit(FIRSTS)), lambda f: f <= c)), lambda run: _run(c, run, by)))
    return out.when(F.ascii(c) < 128, c).otherwise(bound(F.instr(F.lit(ALL), c), other))


def _number(numbers: str, at: Column) -> Column:
    return F.ascii(F.substring(F.lit(numbers), at, F.lit(1)))


def _turned(at: Column, by: Column) -> Column:
    start = _number(STARTS, at)
    return F.substring(F.lit(ALL), start + F.pmod(at - start + by, _number(WIDTHS, at)), F.lit(1))


def _run(c: Column, run: Column, by: Column) -> Column:
    """What a letter of a run of code points becomes; letters outside of runs stay."""
    first, size = _number(FIRSTS, run), _number(SIZES, run)
    code = first + F.pmod(F.ascii(c) - first + by, size)
    new = F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")
    return F.when((run > 0) & (F.ascii(c) < first + size), new).otherwise(c)


def _chars(text: Column) -> Column:
    return F.array_remove(F.split(text, ""), "")


def _shifted(text: Column, digest: Column, alphabets: tuple[str, ...], sign: int) -> Column:
    """Each character moved on (or back) in its alphabet by a byte of the digest; others stay."""
    return bound(digest, lambda d: F.array_join(F.transform(_chars(text), lambda c, i: _moved(c, _byte(d, i) * sign, alphabets)), ""))


def _next(text: Column, alphabets: tuple[str, ...]) -> Column:
    """The first character that can move moved on by one."""
    begun = F.struct(F.lit("").alias("out"), F.lit(False).alias("done"))
    step = lambda s, c: bound(F.when(s["done"], c).otherwise(_moved(c, F.lit(1), alphabets)), lambda n: F.struct(F.concat(s["out"], n).alias("out"), (s["done"] | (n != c)).alias("done")))
    return F.aggregate(_chars(text), begun, step, lambda s: s["out"])


def _folded(text: Column) -> Column:
    """In small letters, of which one has two forms."""
    return F.translate(F.lower(text), "ς", "σ")


def permuted(text: Column, key: str, kind: str, alphabets: tuple[str, ...]) -> Column:
    """A keyed one-to-one map of the strings of a format: halves change places, one moved by a digest of the other; then
    one character moves on, and the halves go all the way back. So no string that has a character that can move stays."""
    low = _folded if alphabets is LETTERS else F.lower
    halved = lambda t: bound(F.floor(F.length(t) / 2).cast("int"), lambda h: F.struct(F.substring(t, F.lit(1), h).alias("a"), F.substring(t, h + 1, F.length(t)).alias("b")))
    digest = lambda r, half: F.sha2(F.concat(F.lit(f"{key} {kind} "), r.cast("string"), F.lit(" "), low(half)), 512)
    forth = lambda s, r: F.struct(s["b"].alias("a"), _shifted(s["a"], digest(r, s["b"]), alphabets, 1).alias("b"))
    back = lambda s, r: F.struct(_shifted(s["b"], digest(r, s["a"]), alphabets, -1).alias("a"), s["a"].alias("b"))
    run = lambda t, rounds, turn: F.aggregate(F.array(*[F.lit(r) for r in rounds]), halved(t), turn, lambda s: F.concat(s["a"], s["b"]))
    return bound(bound(run(text, range(ROUNDS), forth), lambda t: _next(t, alphabets)), lambda t: run(t, reversed(range(ROUNDS)), back))


def _kept(x: Column, prefix: str, use) -> Column:
    """What the prefix pattern matches stays; the rest goes through ``use``."""
    head = F.regexp_extract(x, prefix, 0)
    return bound(F.struct(head.alias("h"), F.substring(x, F.length(head) + 1, F.length(x)).alias("t")), lambda s: F.concat(s["h"], use(s["t"])))


def _luhn(digits: Column) -> Column:
    """The check digit that completes a string of digits."""

    def add(total: Column, c: Column, i: Column, n: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    def summed(chars: Column) -> Column:
        pairs = F.transform(chars, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
        return F.aggregate(pairs, F.lit(0), lambda t, p: add(t, p["c"], p["i"], F.size(chars)))

    return F.pmod(10 - bound(F.array_remove(F.split(digits, ""), ""), summed) % 10, F.lit(10))


def _card(x: Column, key: str) -> Column:
    """Digits are permuted but the last, which is as far off the check digit as it was; spaces and dashes stay."""

    def made(digits: Column) -> Column:
        body = F.substring(digits, F.lit(1), F.length(digits) - 1)
        new = permuted(body, key, "card", DIGITS)
        off = F.pmod(F.right(digits, F.lit(1)).cast("int") - _luhn(body), F.lit(10))
        return bound(new, lambda n: F.concat(n, F.pmod(_luhn(n) + off, F.lit(10)).cast("string")))

    return bound(made(F.regexp_replace(x, "[^0-9]", "")), lambda d: _spread(x, d, "[0-9]"))


def _spread(x: Column, new: Column, sign: str) -> Column:
    """The characters of ``new`` put back where characters like ``sign`` stood in x."""
    begun = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))

    def step(s: Column, c: Column) -> Column:
        own = c.rlike(f"^{sign}$")
        return F.struct(F.concat(s["out"], F.when(own, F.substring(new, s["next"], F.lit(1))).otherwise(c)).alias("out"), (s["next"] + own.cast("int")).alias("next"))

    return F.aggregate(_chars(x), begun, step, lambda s: s["out"])


def _phone(x: Column, key: str) -> Column:
    """The digits after a country's prefix are permuted, whatever stands between them."""
    changed = lambda t: bound(permuted(F.regexp_replace(t, "[^0-9]", ""), key, "phone", DIGITS), lambda d: _spread(t, d, "[0-9]"))
    return _kept(x, r"^(?:\+\d{1,3}(?=[ .(-]))?", changed)


def _iban_check(country: Column, body: Column) -> Column:
    """The two check digits that an account number asks for: 98 less the rest by 97, letters as 10 to 35."""
    value = lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55)
    return 98 - F.aggregate(_chars(F.concat(body, country, F.lit("00"))), F.lit(0), lambda a, c: F.pmod(value(a, c), F.lit(97)).cast("int"))


def _iban(x: Column, key: str) -> Column:
    """The country stays, the account is permuted, and the check digits are as far off the true ones as they were."""

    def made(parts: Column) -> Column:
        country, check, body = parts["country"], parts["check"], parts["body"]
        digits = lambda n: F.lpad(F.pmod(check + _iban_check(country, n) - _iban_check(country, body), F.lit(100)).cast("string"), 2, "0")
        return bound(permuted(body, key, "iban", PLAIN), lambda n: F.concat(country, digits(n), n))

    plain = F.replace(x, F.lit(" "), F.lit(""))
    parts = F.struct(F.substring(plain, 1, 2).alias("country"), F.substring(plain, 3, 2).cast("int").alias("check"), F.substring(plain, F.lit(5), F.length(x)).alias("body"))
    return bound(bound(parts, made), lambda n: _spread(x, n, "[A-Z0-9]"))


def _host(x: Column, key: str) -> Column:
    """An address as 32 bits through a Feistel network of two halves of 16, forth and back as in ``permuted``. A zero
    before a part stays, since spellings of one address are different entities."""
    part = lambda i: F.split(x, r"\.")[i].cast("int")
    begun = F.struct((part(0) * 256 + part(1)).alias("a"), (part(2) * 256 + part(3)).alias("b"))

    def changed(r: Column, half: Column, other: Column) -> Column:
        digest = F.sha2(F.concat(F.lit(f"{key} host "), r.cast("string"), F.lit(" "), half.cast("string")), 256)
        return other.bitwiseXOR(F.conv(F.substring(digest, 1, 4), 16, 10).cast("int"))

    forth = lambda s, r: F.struct(s["b"].alias("a"), changed(r, s["b"], s["a"]).alias("b"))
    back = lambda s, r: F.struct(changed(r, s["a"], s["b"]).alias("a"), s["a"].alias("b"))
    zero = lambda i: F.when(F.split(x, r"\.")[i].rlike("^0."), "0").otherwise("")
    octets = lambda v, i: F.concat(zero(i), F.shiftright(v, 8).cast("string"), F.lit("."), zero(i + 1), v.bitwiseAND(255).cast("string"))
    there = F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), begun, forth, lambda s: F.struct(s["a"].alias("a"), s["b"].bitwiseXOR(F.lit(1)).alias("b")))
    return F.aggregate(F.array(*[F.lit(r) for r in reversed(range(ROUNDS))]), there, back, lambda s: F.concat(octets(s["a"], 0), F.lit("."), octets(s["b"], 2)))


def _names(key: str) -> Column:
    """Known given names and those that they become: a permutation within the gender."""
    pairs = []
    for names in (MALE.split(), FEMALE.split()):
        order = names[:]
        random.Random(f"{key} {names[0]}").shuffle(order)
        # Each name takes the next one in a shuffled circle, so none stays.
        pairs += [(a, b) for a, b in zip(order, order[1:] + order[:1], strict=True)]
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def _person(x: Column, key: str) -> Column:
    def word(w: Column) -> Column:
        return F.coalesce(F.try_element_at(_names(key), w), permuted(F.translate(w, "".join(SAME), "".join(SAME.values())), key, "name", LETTERS))

    return _kept(x, rf"^{TITLE}\.? ", lambda t: F.array_join(F.transform(F.split(t, " "), word), " "))


def surrogate(x: Column, key: str) -> Column:
    plain = lambda kind, prefix="^", alphabets=PLAIN: _kept(x, prefix, lambda t: permuted(t, key, kind, alphabets))
    secret = r"^(?i:password|passwd|pwd|secret|token|api_?key)\s{0,3}[=:]\s{0,3}[\x22\x27]?"
    tail = F.regexp_extract(x, r"\.[A-Za-z]{2,}$", 0)
    mail = F.concat(permuted(F.substring(x, F.lit(1), F.length(x) - F.length(tail)), key, "mail", PLAIN), tail)
    return (
        F.when(x.rlike(f"^(?:{EMAIL})$"), mail)
        .when(x.rlike(secret + "[0-9a-f]+$"), plain("secret", secret, HEX))
        .when(x.rlike(secret), plain("secret", secret))
        .when(x.rlike(f"^(?:{ACCESS})$"), plain("access", "^AKIA", CAPITAL))
        .when(x.rlike(f"^(?:{IP})$"), _host(x, key))
        .when(x.rlike(f"^(?:{PHONE})$"), _phone(x, key))
        .when(x.rlike(f"^(?:{SSN})$"), plain("ssn", "^", DIGITS))
        .when(x.rlike(f"^(?:{CARD})$"), _card(x, key))
        .when(x.rlike(f"^(?:{IBAN})$"), _iban(x, key))
        .otherwise(_person(x, key))
    )


def replaced(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with the text's entities replaced, and n_entities, entities, surrogates."""
    names = ("n_entities", "entities", "surrogates")
    own = [c for c in docs.columns if c not in names]
    body = F.col(text)
    found = docs.select(*own, F.when(body.rlike(QUICK), F.regexp_extract_all(body, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")).alias("entities"))
    made = found.withColumn("surrogates", F.transform("entities", lambda x: surrogate(x, key)))
    gaps = F.zip_with(F.split(body, ANY, -1), F.concat(F.col("surrogates"), F.array(F.lit(""))), lambda g, s: F.concat(g, s))
    new = F.when(F.size("entities") > 0, F.array_join(gaps, "")).otherwise(body)
    return made.select(*[new.alias(c) if c == text else F.col(c) for c in own], F.size(F.coalesce("entities", F.array())).alias("n_entities"), "entities", "surrogates")


def collisions(made: DataFrame) -> int:
    """Entities that share their surrogate with another, or that are their own surrogate though a character can move."""
    pairs = made.filter("n_entities > 0").select(F.explode(F.arrays_zip("entities", "surrogates")).alias("p")).select(_folded(F.col("p.entities")).alias("e"), _folded(F.col("p.surrogates")).alias("s")).distinct()
    same = F.when(F.col("e") == F.col("s"), F.regexp_replace("e", STAYS, "").rlike(MOVES)).otherwise(False)
    shared = pairs.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.max(same).alias("same"))
    return shared.filter("n > 1 or same").count()


def with_surrogates(docs: DataFrame, text: str = "text", key: str = KEY, tries: int = 4) -> DataFrame:
    """``replaced`` by the first of several keys that passes the check; stored."""
    for n in range(tries):
        made = stored(replaced(docs, text, key if n == 0 else f"{key} {n}"), "surrogates")
        if not collisions(made):
            return made
    raise ValueError(f"surrogates collide under each of {tries} keys")


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "text", F.col("n_entities").cast("long").alias("n_entities"))


QUERIES = {"op4_surrogates": op4_surrogates}
ORACLE: dict[str, str] = {}
