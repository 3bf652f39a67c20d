"""Personal data replaced by keyed surrogates of the same type, format, script and gender.

Detection finds entities in whole texts, once; each has a canonical form (what makes two mentions the same entity). A
person is the words of a name: they follow an honorific or hold a known given name before a surname, and stand alone
elsewhere in the same text. A surrogate is made from a keyed digest of type, canonical form and attempt: digits become
digits and letters become letters of the same script and case, card numbers stay valid, addresses keep their ranges,
given names keep the gender that their honorific, the list of names or their ending shows, and so do Cyrillic surnames.
Every mention of an entity, in any document, gets the same surrogate (coreference), and so do the parts of a name.

Distinctness is checked in Spark over the table of distinct entities: surrogates that two entities share, or that are
an entity of the corpus themselves, are given up by all but the first of them, and those try again with the next
attempt, until none is left. Only entities whose surrogate is not that of the first attempt, or whose mentions differ in
gender, are sent back to the rows that hold them, by a row number; all other surrogates are made where the text is.
Texts are never shuffled unless such rows are many.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starflow.llm.common import cut, grown, split_join, stored, without

# Honorifics that a name follows, by the gender they show.
MALE = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Don", "господин", "κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Lady", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Doña", "госпожа", "κυρία")
NEUTRAL = ("Dr", "Prof")
# Common given names, by gender; names of both genders stand in neither list but in the third.
GIVEN_MALE = (
    "Adam", "Ahmed", "Alejandro", "Alexander", "Ali", "Andrew", "Antoine", "Antonio", "Arthur", "Benjamin", "Bernd", "Carlos", "Charles", "Christian",
    "Daniel", "David", "Diego", "Dmitri", "Edward", "Eric", "Fernando", "Frank", "François", "Friedrich", "Georg", "George", "Günter", "Hans", "Heinrich",
    "Henry", "Ivan", "Jack", "Jacques", "James", "Javier", "Jean", "Johann", "John", "José", "Joseph", "Juan", "Karl", "Klaus", "Louis", "Luis", "Mark",
    "Martin", "Matthew", "Michael", "Michel", "Miguel", "Mohammed", "Oliver", "Otto", "Paul", "Pedro", "Peter", "Philippe", "Pierre", "Richard", "Robert",
    "Samuel", "Stefan", "Thomas", "Walter", "William", "Wolfgang", "Александр", "Дмитрий", "Иван", "Николай", "Сергей", "Γιώργος", "Νίκος",
)
GIVEN_FEMALE = (
    "Alice", "Amelia", "Ana", "Anna", "Anne", "Barbara", "Brigitte", "Carmen", "Carolyn", "Catherine", "Charlotte", "Claire", "Clara", "Daniela", "Elena",
    "Elisabeth", "Elizabeth", "Emily", "Emma", "Erika", "Fatima", "Françoise", "Gisela", "Hannah", "Heike", "Helen", "Helga", "Ingrid", "Irene", "Isabel",
    "Jane", "Jennifer", "Jessica", "Julia", "Karin", "Katharina", "Laura", "Linda", "Lisa", "Lucia", "Lucy", "Margaret", "María", "Maria", "Marie", "Marta",
    "Martina", "Mary", "Monika", "Nathalie", "Nicole", "Olga", "Olivia", "Patricia", "Petra", "Pilar", "Rosa", "Sabine", "Sandra", "Sarah", "Sofia",
    "Sophie", "Susan", "Teresa", "Ursula", "Victoria", "Анна", "Елена", "Мария", "Ольга", "Ελένη", "Μαρία",
)
GIVEN_BOTH = ("Alex", "Andrea", "Camille", "Chris", "Dominique", "Kim", "Robin", "Sam", "Sasha")

GIVEN = {n.casefold(): g for names, g in ((GIVEN_MALE, "m"), (GIVEN_FEMALE, "f"), (GIVEN_BOTH, "n")) for n in names}
_HONORIFIC = "|".join(sorted((*MALE, *FEMALE, *NEUTRAL), key=len, reverse=True))
_NAME = r"\p{Lu}\p{L}++(?:[-'’]\p{L}++)*+"
_INITIALS = r"(?:\p{Lu}\.[ \t]*+)*+"
DETECTORS = {
    "email": re.compile(r"(?<![\w%+-])(?<![\w%+-]\.)[\w%+-]++(?:\.[\w%+-]++)*+@[^\W_]+(?:-[^\W_]+)*(?:\.[^\W_]+(?:-[^\W_]+)*)+"),
    "secret": re.compile(r"(?i:\b(?:token|secret|password|passwd|api[_-]?key)\b)\s*[=:]\s*[\"']?([\w+/-]{16,})"),
    "iban": re.compile(r"(?<![\w])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w])"),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "phone": re.compile(
        r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w+])\(\d{3}\) ?\d{3}-\d{4}(?!\w)"
        r"|(?<![\w.,+-])\d{3}([-.])\d{3}\1\d{4}(?![\w-]|[.,]\d)|(?<![\w.,+-])0\d{2,4}[ /-]?\d{6,8}(?![\w-]|[.,]\d)"
    ),
    "ip": re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)"),
    "card": re.compile(r"(?<![\w.+-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?![\w]|[.-]\d)"),
}
TITLED = regex.compile(rf"\b({_HONORIFIC})\b\.?[ \t]+({_INITIALS}{_NAME}(?: {_INITIALS}{_NAME}){{0,2}})")
CAPITALS = regex.compile(rf"\b{_NAME}(?:[ \t]{_INITIALS}{_NAME}){{1,3}}")
ALONE = regex.compile(rf"\b{_NAME}")
PART = regex.compile(rf"\p{{Lu}}\.|{_NAME}")
SYLLABLES = {"LATIN": ("la", "mi", "ro", "te", "sa", "nu", "ve", "do", "ka", "ri", "be", "lo", "fi", "gu", "ze", "pa"),
             "CYRILLIC": ("ла", "ми", "ро", "те", "са", "ну", "ве", "до", "ка", "ри", "бе", "ло", "фи", "гу", "зе", "па"),
             "GREEK": ("λα", "μι", "ρο", "τε", "σα", "νυ", "βε", "δο", "κα", "ρι", "μπε", "λο", "φι", "γου", "ζε", "πα")}
ENDINGS = {"LATIN": {"m": ("lan", "ron", "dus"), "f": ("lina", "ria", "della"), "n": ("len", "ris", "mor")},
           "CYRILLIC": {"m": ("лан", "рон", "дим"), "f": ("лина", "рия", "делла"), "n": ("лен", "рис", "мор")},
           "GREEK": {"m": ("λος", "ρης", "νος"), "f": ("λινα", "ρια", "δη"), "n": ("λεν", "ρις", "μορ")}}
SURNAMES = {"m": ("ов", "ин", "ев"), "f": ("ова", "ина", "ева"), "n": ("енко", "их", "ко")}  # endings of Cyrillic surnames
ALPHABETS = {"LATIN": "abcdefghijklmnopqrstuvwxyz", "CYRILLIC": "абвгдежзиклмнопрстуфхцчшэюя", "GREEK": "αβγδεζηθικλμνξοπρστυφχψω"}
SPANS = "array<struct<start:int,stop:int,kind:string,form:string,gender:string,lead:boolean>>"
KEPT = 200_000  # surrogates a worker remembers


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def _iban_ok(value: str) -> bool:
    moved = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def canonical(kind: str, value: str) -> str | None:
    """What mentions of one entity have in common; None if the value isn't of this kind after all."""
    if kind in ("phone", "card", "ssn"):
        digits = "".join(str(unicodedata.digit(c)) for c in value if c.isdigit())
        if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
            return None
        return None if kind == "phone" and not 9 <= len(digits) <= 15 else digits
    if kind == "ip":
        parts = [int(p) for p in value.split(".")]
        return ".".join(map(str, parts)) if max(parts) <= 255 else None
    if kind == "iban":
        plain = value.replace(" ", "")
        return plain if 15 <= len(plain) <= 34 and plain.isascii() and _iban_ok(plain) else None
    return value.lower() if kind == "email" else value


def _gender(word: str, title: str, surname: bool) -> str:
    """The gender that an honorific, the lists of names or an ending shows."""
    if title:
        return "m" if title in MALE else "f" if title in FEMALE else "n"
    if surname:
        return "f" if word.endswith(("ова", "ева", "ина", "ая")) else "m" if word.endswith(("ов", "ев", "ин", "ий")) else "n"
    return GIVEN.get(word) or ("f" if word.endswith(("a", "а", "α")) else "n")


def _parts(name: str, at: int, title: str) -> Iterator[tuple[int, int, str, str, str, bool]]:
    """The words of a name as entities: the last is the surname."""
    words = list(PART.finditer(name))
    for k, word in enumerate(words):
        form, surname = word[0].casefold(), k == len(words) - 1
        kind = "initial" if form.endswith(".") else "name" if surname else "given"
        yield at + word.start(), at + word.end(), kind, form, _gender(form, title, surname), k == 0


def find(text: str) -> list[tuple[int, int, str, str, str, bool]]:
    """``(start, stop, kind, canonical form, gender, lead)`` of the entities of a text, apart and in order; kinds that
    come first in ``DETECTORS`` win where two overlap, names come last. The words of a name are entities of their own,
    the first of them with ``lead``."""
    found: list[tuple[int, int, str, str, str, bool]] = []
    taken = bytearray(len(text))

    def take(start: int, stop: int) -> bool:
        if any(taken[start:stop]):
            return False
        taken[start:stop] = b"\1" * (stop - start)
        return True

    for kind, pattern in DETECTORS.items():
        if kind == "email" and "@" not in text:
            continue
        for match in pattern.finditer(text):
            start, stop = match.span(1 if kind == "secret" else 0)
            if (form := canonical(kind, text[start:stop])) is not None and take(start, stop):
                found.append((start, stop, kind, form, "n", True))
    people: dict[str, tuple[str, str]] = {}
    for match in TITLED.finditer(text):
        if take(*match.span(2)):
            found += _parts(match[2], match.start(2), match[1])
    for match in CAPITALS.finditer(text):
        words = list(PART.finditer(match[0]))
        first = next((k for k, word in enumerate(words[:-1]) if word[0].casefold() in GIVEN), None)
        if first is not None:
            start = match.start() + words[first].start()
            if take(start, match.end()):
                found += _parts(text[start : match.end()], start, "")
    for _, _, kind, form, gender, _ in found:
        if kind in ("given", "name"):
            people.setdefault(form, (kind, gender))
    if people:
        for match in ALONE.finditer(text):
            form = match[0].casefold()
            if form in people and take(*match.span()):
                found.append((*match.span(), people[form][0], form, people[form][1], True))
    return sorted(found)


class Stream:
    """Numbers drawn from a keyed digest."""

    def __init__(self, key: bytes, *parts: object):
        self.key, self.label, self.count, self.pool = key, "\x1f".join(map(str, parts)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool += hashlib.blake2b(self.label + self.count.to_bytes(4, "big"), key=self.key, digest_size=64).digest()
            self.count += 1
        value, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return value % n


def script(text: str) -> str:
    """The script of the first letter, of those that surrogates can be written in."""
    for c in text:
        if c.isalpha():
            return next((s for s in ALPHABETS if unicodedata.name(c, "").startswith(s)), "LATIN")
    return "LATIN"


def _letter(c: str, s: Stream) -> str:
    alphabet = ALPHABETS[script(c)]
    out = alphabet[s.below(len(alphabet))]
    return out.upper() if c.isupper() else out


def _name(kind: str, form: str, gender: str, attempt: int, s: Stream) -> str:
    """A word of a name: syllables for each of its parts, and an ending that shows the gender."""
    tongue, out = script(form), []
    pieces = re.split("([-'’])", form)
    for k, piece in enumerate(pieces):
        last = k == len(pieces) - 1
        if k % 2:
            out.append(piece)
            continue
        body = "".join(SYLLABLES[tongue][s.below(16)] for _ in range(1 + s.below(2) + (attempt // 4 if last else 0)))
        ends = SURNAMES[gender] if kind == "name" and tongue == "CYRILLIC" else ENDINGS[tongue]["n" if kind == "name" else gender]
        out.append(body + ends[s.below(3)] if last else body)
    return "".join(out)


def _shifted(letter: str, key: bytes) -> str:
    """An initial's surrogate: a keyed shift of the alphabet, so that different initials stay different."""
    alphabet = ALPHABETS[script(letter)]
    by = 1 + Stream(key, "initial", alphabet).below(len(alphabet) - 1)
    return alphabet[(alphabet.find(letter) + by) % len(alphabet)] if letter in alphabet else letter


def surrogate(kind: str, form: str, gender: str, attempt: int, key: bytes) -> str:
    """The canonical form of an entity's surrogate. From the fourth attempt a number's first digit is free too; when
    32 attempts found nothing unused, the form is too short for so many entities and grows by a character."""
    s = Stream(key, kind, form, attempt)
    if kind in ("given", "name"):
        return _name(kind, form, gender, attempt, s)
    if kind == "initial":
        return _shifted(form[0], key) + form[1:]
    if kind not in ("ip", "card", "iban"):
        form = form[:1] + form[-1:] * (attempt // 32) + form[1:] if kind == "email" else form + form[-1:] * (attempt // 32)
    if kind == "ip":
        return ".".join(str(1 + s.below(254)) for _ in range(4))
    if kind == "card":
        body = (form[0] if attempt < 4 else str(s.below(10))) + "".join(str(s.below(10)) for _ in form[1:-1])
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))
    if kind == "iban":
        body = "".join(str(s.below(10)) if c.isdigit() else _letter(c, s) for c in form[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{form[:2]}00")) % 97
        return f"{form[:2]}{check:02d}{body}"
    if kind in ("phone", "ssn"):
        return (form[0] if attempt < 4 else str(s.below(10))) + "".join(str(s.below(10)) for _ in form[1:])
    if kind == "email":
        name, _, host = form.partition("@")
        host, dot, top = host.rpartition(".")
        return "".join(str(s.below(10)) if c.isdigit() else _letter(c, s) if c.isalpha() else c for c in f"{name}@{host}") + dot + top
    if re.fullmatch("[0-9a-f]+", form):
        return "".join("0123456789abcdef"[s.below(16)] for _ in form)
    return "".join(str(s.below(10)) if c.isdigit() else _letter(c, s) if c.isalpha() else c for c in form)


def dress(kind: str, original: str, form: str) -> str:
    """A surrogate's canonical form in the writing of the mention it replaces; what is longer follows at the end."""
    if kind in ("phone", "card", "ssn", "iban"):
        rest, out = iter(form), []
        for c in original:
            new = next(rest, "") if c.isalnum() else c
            if c.isdigit() and new.isdigit():
                new = chr(ord(c) - unicodedata.digit(c) + int(new))  # of the mention's own digits
            out.append(new)
        return "".join([*out, *rest])
    if kind == "email":
        return "".join(n.upper() if o.isupper() else n for o, n in zip(original, form, strict=False)) + form[len(original) :]
    if kind in ("given", "name", "initial"):
        return form.upper() if original.isupper() else form.title()
    return form


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``row_``, its own number, and ``spans_``, its entities. Stored."""
    at = docs.columns.index(text)
    kind = T._parse_datatype_string(SPANS)
    shape = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("form", pa.string()), ("gender", pa.string()), ("lead", pa.bool_())]))
    fields = shape.value_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            spans = [find(body) if body else [] for body in batch.column(at).to_pylist()]
            rows = pa.array(range(number, number + batch.num_rows), pa.int64())
            number += batch.num_rows
            found = pa.array([[dict(zip((f.name for f in fields), span, strict=True)) for span in own] for own in spans], shape)
            yield pa.RecordBatch.from_arrays([*batch.columns, rows, found], names=[*batch.schema.names, "row_", "spans_"])

    return stored(docs.mapInArrow(run, grown(docs, ("row_", T.LongType()), ("spans_", kind))))


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """``(kind, form, surrogate, attempt)`` for distinct ``entities(kind, form, gender)``, each surrogate given once and
    to no entity of the table; initials are told apart by their shift."""

    def make(attempt: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([surrogate(k, f, g, attempt, key) for k, f, g in rows], pa.string())], names=[*batch.schema.names, "surrogate"])

        return run

    known = stored(entities.where("kind <> 'initial'").select("kind", "form", "gender"))
    taken = known.select("kind", F.col("form").alias("surrogate"))
    open_, done, attempt = known, [], 0
    while True:
        tried = stored(open_.mapInArrow(make(attempt), grown(open_, ("surrogate", T.StringType()))))
        free = tried.join(taken, ["kind", "surrogate"], "left_anti")
        won = free.groupBy("kind", "surrogate").agg(F.min(F.struct("form", "gender")).alias("w"))
        won = stored(won.select("kind", "w.form", "surrogate", F.lit(attempt).alias("attempt")))
        done.append(won)
        open_ = cut(tried.select("kind", "form", "gender").join(won, ["kind", "form"], "left_anti"))
        taken = taken.union(won.select("kind", "surrogate"))
        attempt += 1
        if open_.isEmpty():
            break
    out = done[0]
    for won in done[1:]:
        out = out.union(won)
    return out


def pseudonymise(docs: DataFrame, secret: bytes, text: str = "text", count: str = "n_entities") -> DataFrame:
    """Every row of ``docs`` with its entities replaced in ``text``, and the number of their mentions in ``n_entities``.

    ``secret`` is the key of the surrogates: who has it can make them again. The same entity has the same surrogate in
    all rows; different entities of a kind have different ones, none of which is an entity of the table. Where mentions
    of a name differ in gender, the first of m, f, n that was seen counts for all. Null texts stay null with 0 entities,
    texts without entities stay as they are. Repeated rows and rows with a null key are treated alike. A column named
    like the count is replaced. An empty table stays empty.
    """
    if not secret or len(secret) > 64:
        raise ValueError("the key of the surrogates must have 1 to 64 bytes")
    docs = without(docs, (count, "row_", "spans_", "swap_row_", "swaps_"))
    held = detect(docs, text)
    spans = held.select("row_", F.explode("spans_").alias("s")).select("row_", "s.kind", "s.form", "s.gender")
    order = F.when(F.col("gender") == "m", "0m").when(F.col("gender") == "f", "1f").otherwise("2n")
    entities = stored(
        spans.groupBy("kind", "form")
        .agg(F.min(order).alias("least"), F.max(order).alias("most"), F.count(F.lit(1)).alias("n"))
        .select("kind", "form", F.substring("least", 2, 1).alias("gender"), (F.col("least") != F.col("most")).alias("mixed"), "n")
    )
    given = entities.join(assign(entities, secret), ["kind", "form"]).where("mixed OR attempt > 0")
    given = stored(given.select("kind", "form", "surrogate", "n"))
    swaps = split_join(spans.select("row_", "kind", "form").distinct(), given, ("kind", "form"), entities.agg(F.sum("n")).first()[0] or 0)
    swaps = stored(swaps.groupBy(F.col("row_").alias("swap_row_")).agg(F.collect_list(F.struct("kind", "form", "surrogate")).alias("swaps_")))
    joined = held.join(swaps, F.col("row_") == F.col("swap_row_"), "left").select(*[F.col(f"`{c}`") for c in docs.columns], "spans_", "swaps_")
    names = docs.columns
    width, at = len(names), names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple[str, str, str], str] = {}
        for batch in batches:
            swapped, sizes = [], []
            for body, spans, swaps in zip(*(batch.column(k).to_pylist() for k in (at, width, width + 1)), strict=True):
                own = {(s["kind"], s["form"]): s["surrogate"] for s in swaps or []}
                parts, last = [], 0
                for s in spans:
                    what = (s["kind"], s["form"], s["gender"])
                    if (new := own.get(what[:2]) or made.get(what)) is None:
                        made = made if len(made) < KEPT else {}
                        new = made[what] = surrogate(*what, 0, secret)
                    parts += [body[last : s["start"]], dress(s["kind"], body[s["start"] : s["stop"]], new)]
                    last = s["stop"]
                swapped.append("".join([*parts, body[last:]]) if spans else body)
                sizes.append(sum(s["lead"] for s in spans))
            columns = [pa.array(swapped, pa.string()) if k == at else batch.column(k) for k in range(width)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64())], names=[*names, count])

    return joined.mapInArrow(run, grown(docs, (count, T.LongType())))
