"""Personal data replaced by surrogates of the same kind.

Entities are found by patterns. A surrogate comes from a keyed hash of the entity, so the same
entity has the same surrogate in all documents; it keeps length, case, script and signs, a name
its gender, a card number its check digit. Two entities that would get one surrogate, or a
surrogate that is itself an entity of the corpus, are told apart: one of them draws again, until
all differ. These few redrawn entities are joined to their documents; every other surrogate is
computed where it is needed. Documents without digits of any script, @ or names pass straight through.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritlake.llm.frames import remember_only, with_fields, written

# Forms of address and their gender (f, m, or n for either).
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "n", "Prof": "n", "Herr": "m", "Frau": "f",
          "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f", "Srta": "f",
          "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f"}
# Common given names by gender; a name on this list before a capitalised word starts a person's name.
GIVEN = {
    "f": "Mary Anna Anne Maria Elizabeth Linda Susan Jennifer Patricia Sarah Karen Emma Olivia Sophie Julia Laura "
         "Claire Camille Chloé Marie Isabelle Lucía Carmen Sofía Ursula Sabine Petra Monika Heike Katharina "
         "Анна Мария Елена Ольга Наталья Μαρία Ελένη Αικατερίνη".split(),
    "m": "John James Robert Michael William David Richard Thomas Charles Daniel Matthew Peter Paul George Andrew "
         "Pierre Jean Jacques François Hans Klaus Jürgen Wolfgang Stefan Carlos José Juan Miguel Antonio Javier "
         "Иван Сергей Александр Дмитрий Николай Γιώργος Κώστας Νίκος".split()}
_GENDER = {name: gender for gender, names in GIVEN.items() for name in names}
# Syllables for names and the endings that tell a gender, by script.
SYLLABLES = {
    "latin": ("ba be bo da de do fa fe fi ga ge ka ke ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se "
              "si so ta te ti to va ve vi vo wa we za ze").split(),
    "cyrillic": "ба бе бо ва ве да де до за зе ка ко ла ле ли ло ма ме ми мо на не ни но па ра ре ри ро са се та те ти".split(),
    "greek": "βα βε γα γε δα δε κα κο λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε τα τε τι".split()}
ENDINGS = {"latin": {"f": "na", "m": "rd", "n": "n"}, "cyrillic": {"f": "на", "m": "н", "n": "н"},
           "greek": {"f": "να", "m": "νος", "n": "ν"}}
# Endings of surnames that tell a gender; a surrogate keeps them.
SURNAME_ENDINGS = ("ская", "ский", "ова", "ева", "ина", "ов", "ев", "ин", "ová", "ska", "ski", "πούλου", "πουλος")

_NAME = r"[^\W\d_a-zß-öø-ÿа-яёα-ωά-ώ][^\W\d_]*(?:['’-][^\W\d_]+)*"
_GROUP = "[0-9A-Fa-f]{1,4}"
PATTERNS = [
    ("email", re.compile(r"(?<![\w.%+-])[\w%+-][\w.%+-]*@(?:[^\W_][\w-]*\.)+[^\W\d_]{2,}", re.U)),
    ("secret", re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}\b|\bsk-[A-Za-z0-9-]{20,}\b|\bxox[abp]-[\w-]{10,}")),
    ("secret", re.compile(r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b[\"']?\s*[:=]\s*[\"']?)(?=[^\s\"',;<>]*\d)([^\s\"',;<>]{6,})")),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("ip6", re.compile(rf"(?<![\w:.])(?:(?=[0-9A-Fa-f:]*[0-9])(?:{_GROUP}(?::{_GROUP}){{0,6}})?::(?:{_GROUP}(?::{_GROUP}){{0,6}})?"
                       rf"|{_GROUP}(?::{_GROUP}){{7}})(?![\w:]|\.\d)")),
    ("ip", re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)")),
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\w)"
                         r"|(?<![\w.+-])(?:\(\d{2,4}\) ?|\d{3}[.-])\d{3}[ .-]\d{4}(?![\w.-]*\d)"
                         r"|(?<![\w.+-])(?<!\d )0\d([ .-])\d\d(?:\1\d\d){3}(?![ .-]?\d|\w)")),
    # a date after words that say it is one of birth
    ("birth", re.compile(
        r"(?i:\b(?:born(?: on)?|date of birth|birth ?date|dob|geboren(?: am)?|geburtsdatum|née? le|date de naissance|nacid[oa] el|"
        r"fecha de nacimiento|syntynyt|syntymäaika|родил(?:ся|ась)|дата рождения))[\s:,(]{1,4}"
        r"(\d{1,2}[./-]\d{1,2}[./-]\d{4}|\d{4}-\d{1,2}-\d{1,2})(?!\d)")),
    ("card", re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])")),
    ("national", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    # street and house number, as written in English, German, French, Spanish, Finnish and Russian
    ("address", re.compile(rf"(?<![\w.,-])\d{{1,5}}[A-Za-z]? (?:{_NAME} ){{1,4}}(?:Street|Avenue|Road|Lane|Drive|Boulevard|Court|Square|"
                           r"Terrace|Highway|Parkway|(?:St|Ave|Rd|Ln|Dr|Blvd)\b\.?)(?!\w)")),
    ("address", re.compile(r"(?<!\w)[^\W\d_a-zäöüß][^\W\d_]*?(?:straße|strasse|str\.|weg|platz|allee|gasse|katu|kuja) \d{1,4}[a-zA-Z]?(?!\w)")),
    ("address", re.compile(rf"(?<![\w.,-])\d{{1,4}}(?: bis| ter)?,? (?i:rue|avenue|boulevard|place|chemin|impasse|quai|allée) "
                           rf"(?:(?:de la|de l['’]|du|des|de|d['’]) ?)?{_NAME}(?:[ -]{_NAME}){{0,3}}")),
    ("address", re.compile(rf"(?<!\w)(?:Calle|Avenida|Plaza|Paseo|Carrera) (?:(?:de la|de los|de las|del|de) )?{_NAME}(?: {_NAME}){{0,3}},? "
                           r"(?:n\.?º ?)?\d{1,4}(?!\w)")),
    ("address", re.compile(rf"(?<!\w)(?:ул\.|улица|просп\.|проспект|пер\.|переулок) ?{_NAME}(?: {_NAME}){{0,3}},? (?:д\. ?|дом )?\d{{1,4}}(?!\w)")),
]
# Words of an address that say what kind of place it is; a surrogate keeps them.
_PLACE_WORDS = re.compile(
    r"(?<!\w)(?:Street|Avenue|Road|Lane|Drive|Boulevard|Court|Square|Terrace|Highway|Parkway|St|Ave|Rd|Ln|Dr|Blvd|(?i:rue|place|chemin|"
    r"impasse|quai|allée|bis|ter)|avenue|boulevard|Calle|Avenida|Plaza|Paseo|Carrera|de|la|los|las|del|du|des|d|l|n|ул|улица|просп|"
    r"проспект|пер|переулок|д|дом)(?!\w)|(?:straße|strasse|str|weg|platz|allee|gasse|katu|kuja)(?!\w)")
_TITLED = re.compile(r"(?<!\w)(" + "|".join(TITLES) + r")\.?[ \u00a0]+(" + _NAME + r")(?:[ \u00a0]+(" + _NAME + r"))?")
_LISTED = re.compile(r"(?<!\w)(" + "|".join(_GENDER) + r")[ \u00a0]+(" + _NAME + r")(?!\w)")
# What a document must hold for any of the above, for Spark: a sign or digit, the start of a key, a name.
# Digits are Python's: Java's \p{Nd} may know an earlier Unicode. Those beyond ASCII are looked for in texts
# beyond ASCII only, and there among the characters from the first of them on.
_ZEROS = [c for c in range(sys.maxunicode + 1) if unicodedata.decimal(chr(c), -1) == 0 and c > 127]
_OTHER_DIGITS = f"[\\x{{{_ZEROS[0]:x}}}-\\x{{10ffff}}&&[" + "".join(f"\\x{{{c:x}}}-\\x{{{c + 9:x}}}" for c in _ZEROS) + "]]"
_GROUPS = "(?:[0-9A-Fa-f]{1,4}:){7}"
_KEYS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox")
_NAMES = r"[A-ZÀ-ÞΑ-ΩА-Я](?<=" + "|".join(sorted({n[0] for n in [*TITLES, *_GENDER]})) + ")(?:" + "|".join(
    f"(?<={first})(?:" + "|".join(n[1:] for n in [*TITLES, *_GENDER] if n[0] == first) + ")"
    for first in sorted({n[0] for n in [*TITLES, *_GENDER]})) + r")[. \u00a0]"


def may_hold_entities(text: Column) -> Column:
    """False only for texts without any entity."""
    found = text.rlike("[@0-9]") | ((F.octet_length(text) != F.length(text)) & text.rlike(_OTHER_DIGITS)) | (
        text.contains(":") & text.rlike(_GROUPS))
    for key in _KEYS:
        found = found | text.contains(key)
    return F.coalesce(found | text.rlike(_NAMES), F.lit(False))


class Entity(NamedTuple):
    start: int
    end: int
    kind: str
    value: str  # the same for all ways to write the entity


def _plain_digits(text: str) -> str:
    """Decimal digits of any script as 0 to 9."""
    return "".join(c if c.isascii() or not c.isdecimal() else str(unicodedata.decimal(c)) for c in text)


def _digit_like(original: str, number: int | str) -> str:
    """A digit in the script of another."""
    return chr(ord(original) - unicodedata.decimal(original, ord(original) - ord("0")) + int(number))


def _digits(text: str) -> str:
    return "".join(c for c in _plain_digits(text) if c.isdigit())


def _luhn(digits: str) -> bool:
    double = [int(d) * 2 if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in double) % 10 == 0


def _check_digits(iban: str) -> str:
    """The two digits that an account number of this country and body has."""
    rest = "".join(str(int(c, 36)) for c in iban[4:] + iban[:2])
    return f"{98 - int(rest + '00') % 97:02d}"


def _day(text: str) -> tuple[int, int, int]:
    """Year, month and day of a date written with the year last or first."""
    first, second, third = map(int, re.split(r"[./-]", text))
    year, month, day = (first, second, third) if first > 31 else (third, second, first)
    return (year, day, month) if month > 12 else (year, month, day)


def _is_ip(text: str) -> bool:
    try:
        return bool(ipaddress.ip_address(_plain_digits(text)))
    except ValueError:
        return False


def _script(text: str) -> str:
    name = unicodedata.name(next((c for c in text if c.isalpha()), "A"), "")
    return "cyrillic" if name.startswith("CYRILLIC") else "greek" if name.startswith("GREEK") else "latin"


def _value(kind: str, text: str) -> str:
    if kind == "phone":
        text = _plain_digits(text)
        country = re.match(r"\+(\d{1,3})(?=[ .(-])", text)
        return f"+{country[1]}|{_digits(text[country.end():])}" if country else f"|{_digits(text)}"
    if kind == "card":
        return _digits(text)
    if kind == "iban":
        return text.replace(" ", "")
    if kind in ("ip", "national"):
        return _plain_digits(text)
    if kind == "birth":
        return "{:04d}-{:02d}-{:02d}".format(*_day(text))
    return text.lower() if kind in ("email", "ip6") else text


def find_entities(text: str) -> list[Entity]:
    """Entities in order, without overlaps; an earlier kind of the list above wins.

    A part of a person's name that was found once is also found where it stands alone.
    """
    taken: list[Entity] = []
    busy = bytearray(len(text))

    def take(start: int, end: int, kind: str, value: str) -> None:
        if end > start and not any(busy[start:end]):
            busy[start:end] = b"\1" * (end - start)
            taken.append(Entity(start, end, kind, value))

    for kind, pattern in PATTERNS:
        for found in pattern.finditer(text):
            start, end = found.span(1 if kind in ("secret", "birth") and found.lastindex else 0)
            if kind == "card":
                digits = _digits(found[0])
                if not (_luhn(digits) or len(digits) in (15, 16) and digits[0] in "3456"):
                    continue
            if kind in ("ip", "ip6") and not _is_ip(found[0]):
                continue
            take(start, end, kind, _value(kind, text[start:end]))
    parts: dict[str, str] = {}
    for found in _TITLED.finditer(text):
        gender = TITLES[found[1]]
        if found[3]:
            parts.setdefault(found[2], f"given-{_GENDER.get(found[2], gender)}")
            parts.setdefault(found[3], "surname")
        else:
            parts.setdefault(found[2], "surname")
    for found in _LISTED.finditer(text):
        parts.setdefault(found[1], f"given-{_GENDER[found[1]]}")
        parts.setdefault(found[2], "surname")
    if parts:
        # a surname in capitals is the same one, and so is a given name in capitals before it
        capitals = {p.upper(): kind for p, kind in parts.items() if len(p) > 1}
        surnames = [p for p, kind in capitals.items() if kind == "surname"]
        if surnames:
            both = "|".join(map(re.escape, sorted({*capitals, *(n.upper() for n in _GENDER)}, key=len, reverse=True)))
            last = "|".join(map(re.escape, sorted(surnames, key=len, reverse=True)))
            for found in re.finditer(rf"(?<!\w)(?:({both})[ \u00a0]+)?({last})(?!\w)", text):
                if found[1]:
                    given = capitals.get(found[1]) or f"given-{_GENDER[found[1].capitalize()]}"
                    take(*found.span(1), given, found[1].casefold())
                take(*found.span(2), "surname", found[2].casefold())
        for found in re.finditer(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(parts, key=len, reverse=True))) + r")(?!\w)", text):
            take(*found.span(), parts[found[0]], found[0].casefold())
    return sorted(taken)


class _Draw:
    """Numbers below a limit from a keyed hash."""

    def __init__(self, secret: bytes, *parts: object):
        self.state = hmac.new(secret, "\0".join(map(str, parts)).encode(), hashlib.sha256).digest()
        self.pool, self.turn = int.from_bytes(self.state, "big"), 0

    def below(self, limit: int) -> int:
        if self.pool < limit << 32:
            self.turn += 1
            self.pool = int.from_bytes(hashlib.sha256(self.state + self.turn.to_bytes(4, "big")).digest(), "big")
        self.pool, found = divmod(self.pool, limit)
        return found

    def like(self, character: str, hexadecimal: bool = False) -> str:
        if character.isdigit():
            number = self.below(10)
            return _digit_like(character, number) if character.isdecimal() else str(number)
        if hexadecimal and character in "abcdefABCDEF":
            made = "abcdef"[self.below(6)]
            return made.upper() if character.isupper() else made
        if not character.isalpha():
            return character
        made = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя",
                "greek": "αβγδεζηθικλμνξοπρστυφχψω"}[_script(character)]
        made = made[self.below(len(made))]
        return made.upper() if character.isupper() else made


def surrogate_value(secret: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The surrogate of a value; another one for every attempt. Never the value itself.

    After 40 attempts in a space that is too full, surrogates grow longer.
    """
    longer = max(0, attempt - 40)
    for turn in range(100):
        draw = _Draw(secret, kind, value, attempt, turn)
        if kind == "email":
            local, _, domain = value.rpartition("@")
            host, dot, top = domain.rpartition(".")
            at = _Draw(secret, "domain", domain)
            made = ("".join(map(draw.like, local)) + "".join(draw.like("a") for _ in range(longer)) + "@"
                    + "".join(map(at.like, host)) + dot + top)
        elif kind == "ip":
            made = ".".join(str(1 + draw.below(254)) for _ in range(4))
        elif kind == "ip6":
            # the same groups; where these leave too little choice, eight of four
            made = "".join(draw.like(c, True) for c in value) if not longer else ":".join(
                f"{draw.below(1 << 16):04x}" for _ in range(8))
        elif kind == "address":
            kept, place = [], 0
            for word in _PLACE_WORDS.finditer(value):
                kept += [*map(draw.like, value[place:word.start()]), word[0]]
                place = word.end()
            made = "".join([*kept, *map(draw.like, value[place:])]) + "".join(draw.like("0") for _ in range(longer))
        elif kind in ("phone", "card", "national"):
            head, bar, body = value.rpartition("|")
            first = body[0] if kind == "card" or kind == "phone" and body[0] == "0" else str(2 + draw.below(8))
            digits = first + "".join(str(draw.below(10)) for _ in range(len(body) - 1 + longer if kind != "national" else len(body) - 1))
            if kind == "national":
                digits = "".join(d if c.isdigit() else c for c, d in zip(body, digits))
            if kind == "card" and _luhn(body):
                digits = next(digits[:-1] + d for d in "0123456789" if _luhn(digits[:-1] + d))
            made = head + bar + digits
        elif kind == "iban":
            made = value[:2] + "".join(map(draw.like, value[2:])) + "0" * longer
            if value.isascii() and _check_digits(value) == value[2:4]:
                made = made[:2] + _check_digits(made) + made[4:]
        elif kind == "birth":
            year = int(value[:4]) - 5 - longer + draw.below(11 + 2 * longer)
            made = f"{max(1000, year):04d}-{1 + draw.below(12):02d}-{1 + draw.below(28):02d}"
        elif kind == "secret":
            fixed = re.match(r"AKIA|ASIA|gh[pousr]_|sk-|xox[abp]-", value)
            start = fixed.end() if fixed else 0
            body = value[start:]
            hexadecimal = re.fullmatch(r"[0-9a-fA-F]+", body) is not None
            made = value[:start] + "".join(draw.like(c, hexadecimal) for c in body) + "0" * longer
        else:
            script = _script(value)
            syllables = SYLLABLES[script]
            count = max(2, (len(value) + 1) // 2 - 1) + attempt // 4
            made = "".join(syllables[draw.below(len(syllables))] for _ in range(count))
            if kind == "surname":
                made += next((e for e in SURNAME_ENDINGS if value.endswith(e)), "")
            else:
                made += ENDINGS[script][kind[-1]]
        if made != value:
            return made
    raise ValueError(f"no surrogate for {kind}")


def written_like(kind: str, original: str, made: str) -> str:
    """A surrogate value in the way its entity was written: signs, spaces and case."""
    if kind in ("phone", "card"):
        digits = made.partition("|")[2] or made
        skip = len(re.match(r"\+\d{1,3}(?=[ .(-])", original)[0]) if made.startswith("+") and "|" in made else 0
        out, place = list(original[:skip]), 0
        for c in original[skip:]:
            out.append(_digit_like(c, digits[place]) if c.isdigit() else c)
            place += c.isdigit()
        last = next(c for c in reversed(original) if c.isdigit())
        return "".join(out) + "".join(_digit_like(last, d) for d in digits[place:])
    if kind in ("ip", "national"):
        first = next(c for c in original if c.isdecimal())
        return "".join(_digit_like(first, c) if c.isdigit() else c for c in made)
    if kind == "birth":
        year, month, day = made.split("-")
        fields = re.findall(r"\d+", original)
        order = [year, month, day] if len(fields[0]) == 4 else [day, month, year]
        if len(fields[0]) < 4 and int(fields[1]) > 12:  # the month stands first
            order[:2] = order[1::-1]
        given = iter([str(int(new)).zfill(len(old)) for old, new in zip(fields, order)])
        return re.sub(r"\d+", lambda _: next(given), original)
    if kind == "ip6":
        return made.upper() if original.isupper() else made
    if kind == "iban":
        out, rest = [], iter(made)
        for c in original:
            out.append(c if c == " " else next(rest))
        return "".join(out) + "".join(rest)
    if kind in ("email", "surname") or kind.startswith("given"):
        if original.isupper() and len(original) > 1:
            return made.upper()
        if kind == "email":
            return "".join(m.upper() if i < len(original) and original[i].isupper() else m for i, m in enumerate(made))
        return made[0].upper() + made[1:] if original[0].isupper() else made
    return made


def replace_entities(text: str, entities: list[Entity], secret: bytes, drawn: dict[tuple[str, str], int]) -> str:
    """The text with surrogates; ``drawn`` has the attempt of the entities that drew again."""
    out, at = [], 0
    for entity in entities:
        made = surrogate_value(secret, entity.kind, entity.value, drawn.get((entity.kind, entity.value), 0))
        out += [text[at:entity.start], written_like(entity.kind, text[entity.start:entity.end], made)]
        at = entity.end
    return "".join(out) + text[at:]


ENTITIES = "array<struct<start:int,end:int,kind:string,value:string>>"


def _drawn_again(values: DataFrame, secret: bytes) -> DataFrame:
    """kind, value, attempt of the entities whose first surrogate is taken; all surrogates then differ."""
    def draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            made = [surrogate_value(secret, kind, value, attempt) for kind, value, attempt in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())],
                                             names=["kind", "value", "attempt", "made"])

    schema = "kind string, value string, attempt int, made string"
    # given names of either gender share one space
    space = F.split("kind", "-")[0].alias("space")
    originals = values.select(space, F.col("value").alias("made")).distinct()
    drawn = written(values.withColumn("attempt", F.lit(0)).mapInArrow(draw, schema), "surrogates")
    while True:
        # settled first: fewer attempts, then the smaller value
        best = drawn.groupBy(space, "made").agg(F.min(F.struct("attempt", "value", "kind")).alias("best"), F.count("*").alias("n"))
        clash = best.join(originals.withColumn("own", F.lit(True)), ["space", "made"], "left").filter("n > 1 OR own")
        losers = (drawn.withColumn("space", F.split("kind", "-")[0]).join(clash, ["space", "made"])
                  .filter(F.coalesce("own", F.lit(False)) | (F.struct("attempt", "value", "kind") != F.col("best")))
                  .select("kind", "value", "attempt"))
        losers = written(losers, "clashes")
        if not losers.limit(1).count():
            return drawn.filter("attempt > 0").select("kind", "value", "attempt")
        again = losers.withColumn("attempt", (F.col("attempt") + 1).cast("int")).mapInArrow(draw, schema)
        drawn = written(drawn.join(losers, ["kind", "value"], "left_anti").unionByName(again), "surrogates")


def replace_personal_data(docs: DataFrame, secret: bytes, text: str = "text") -> DataFrame:
    """All columns, with surrogates in ``text``, and n_replaced, the number of places that changed.

    Null texts stay null and texts without entities stay as they are, with 0. Rows need no key
    and may repeat; whole texts are read, however long. An input column named n_replaced is
    replaced. An empty table gives an empty table.
    """
    columns = [c for c in docs.columns if c != "n_replaced"]
    maybe = may_hold_entities(docs[text])
    clear = docs.filter(~maybe).select(*columns, F.lit(0).alias("n_replaced"))
    given = docs.filter(maybe).select(F.struct(*[docs[c] for c in columns]).alias("row"), docs[text].alias("text"))

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember_only("surrogates")
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))
        for batch in batches:
            found = [[e._asdict() for e in find_entities(value.as_py())] for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=["row", "text", "entities"])

    found = written(given.mapInArrow(find, with_fields(given.schema, f"entities {ENTITIES}"))
                     .withColumn("place", F.monotonically_increasing_id()), "entities")
    named = found.select("place", F.explode("entities").alias("e")).select("place", "e.kind", "e.value")
    again = _drawn_again(named.select("kind", "value").distinct(), secret)
    # a document's redrawn entities, no more than the document has
    drawn = named.distinct().join(again, ["kind", "value"]).groupBy("place").agg(
        F.collect_list(F.struct("kind", "value", "attempt")).alias("drawn"))

    def replace(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember_only("surrogates")
        for batch in batches:
            texts, counts = [], []
            for value, entities, redrawn in zip(*(batch.column(i).to_pylist() for i in range(1, 4))):
                attempts = {(d["kind"], d["value"]): d["attempt"] for d in redrawn or []}
                texts.append(replace_entities(value, [Entity(**e) for e in entities], secret, attempts))
                counts.append(len(entities))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())],
                names=["row", "changed", "n_replaced"])

    changed = found.join(drawn, "place", "left").select("row", "text", "entities", "drawn").mapInArrow(
        replace, with_fields(given.schema, "changed string, n_replaced int", drop_last=True))
    changed = changed.select(
        *[F.col("changed").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in columns], "n_replaced")
    return clear.unionByName(changed)
