"""Keyed surrogates for personal data: type-consistent, distinct, and the same for every mention.

Entities are found in each text and brought to a canonical form, so that spellings of one entity
agree. Its surrogate is a keyed permutation of the canonical form within the values of the same
form: digits stay digits, an upper-case name stays one, a valid card number stays valid. Names
are made of syllables of the name's script, and given names are of the same gender. The
surrogates of all entities of the corpus are then checked: one that two entities share, or that
is itself an entity of the corpus, is drawn again. Where a form is so full of entities that this
cannot end, its surrogates are a permutation of the form that leaves no value in place: distinct
and the same for every mention, though they may be other entities.
"""

from __future__ import annotations

import hmac
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconcile.llm.batches import written
from reconcile.llm.bytes_of import made_once
from reconcile.session import write_through

# Entities drawn again that may be sent to every task; more are joined to their documents.
MOST_SHARED = 100_000

# Rounds of the collision check. Each draws all colliding entities again. Forms that still
# collide after them count as full.
MOST_ROUNDS = 50

# The draw of an entity whose form is full.
FULL = -1

# Common given names by script and gender.
GIVEN = {
    ("latin", "f"): "Mary Anna Maria Emma Laura Sarah Julia Elena Sofia Alice Marie Claire Camille Lucía Carmen Isabel "
    "Ingrid Ursula Katharina Petra Jennifer Linda Susan Karen Nancy Helen",
    ("latin", "m"): "James John Robert Michael William David Thomas Daniel Pierre Jacques Antoine Luis Carlos Miguel "
    "José Pablo Hans Karl Stefan Jürgen Wolfgang Peter Paul Andrew George Edward",
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Юлия Екатерина",
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Андрей Михаил Николай Владимир Павел",
    ("greek", "f"): "Μαρία Ελένη Αικατερίνη Βασιλική Σοφία Άννα",
    ("greek", "m"): "Γιώργος Δημήτρης Κώστας Νίκος Παναγιώτης Γιάννης",
}

# Titles before a name, with the gender that they tell.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "", "Prof": "", "Herr": "m", "Frau": "f", "Señor": "m",
          "Señora": "f", "Monsieur": "m", "Madame": "f"}

# Syllables from which surnames of each script are made.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha ka ke la le lo ma me mo na ne no pa po ra re ro sa se so ta te to va ve za",
    "cyrillic": "ба бе бо ва ве го да де до за зе ка ке ко ла ле ло ма ме мо на не но па по ра ре ро са се со та те то",
    "greek": "βα βε γα γο δα δε θα κα κε κο λα λε λο μα με μο να νε νο πα πο ρα ρε ρο σα σε σο τα τε το",
}

_WORD = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
_NAMES = {name: kind for kind, names in GIVEN.items() for name in names.split()}
_ANY_CASE = sorted({form for name in _NAMES for form in (name, name.upper())}, key=len, reverse=True)

_EMAIL = r"(?<![A-Za-z0-9._%+-])(?P<email>[A-Za-z0-9_%+-][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"
_SECRET = r"\b(?i:token|secret|password|passwd|api[_-]?key)\b\s*[=:]\s*[\"']?(?P<secret>[A-Za-z0-9+/_-]{8,})"
_IP = r"(?<![\w.])(?P<ip>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?!\w|\.\d)"
_IBAN = r"\b(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)\b"
_SSN = r"(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
_CARD = r"(?<![\w.-])(?P<card>\d(?:[ -]?\d){12,18})(?![\w-]|\.\d)"
_PHONE = (
    r"(?<![\w.-])(?P<phone>(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}"
    r"|\+(?=(?:[ .-]?\d){7})\d{1,3}(?:[ .-]?\d{2,4}){2,5}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\w-])"
)
# White space without an empty line, and what may stand between the parts of a name.
_GAP = r"(?:[^\S\n]+(?:\n[^\S\n]*)?|\n[^\S\n]*)"
_BETWEEN = rf"{_GAP}(?:(?:van|von|der|den|de|del|della|di|da|dos|la|le|zu|ten|ter|[A-Z]\.){_GAP}){{0,3}}"
_UPPER = r"(?=[^\W\d_a-zа-я])"
_PERSON = (
    rf"(?<!\w)(?:(?P<title>{'|'.join(TITLES)})\.?{_GAP})?(?P<given>{'|'.join(map(re.escape, _ANY_CASE))}){_BETWEEN}"
    rf"(?P<surname>{_UPPER}{_WORD})(?!\w)"
)
_TITLED = rf"(?<!\w)(?P<only_title>{'|'.join(TITLES)})\.?{_BETWEEN}(?P<only_surname>{_UPPER}{_WORD})(?!\w)"

_NUMBERS = re.compile("|".join((_IP, _SSN, _CARD, _PHONE, _IBAN)))
_WITH_AT, _WITH_KEY = re.compile(_EMAIL), re.compile(_SECRET)
_PEOPLE = re.compile("|".join((_PERSON, _TITLED)))
_MORE_NAME = re.compile(rf"{_BETWEEN}(?P<word>{_UPPER}{_WORD})(?!\w)")
_OWNER = re.compile("['’][sS]$")

# Words after the first of a name, or other mentions of it, are looked for up to so many.
_MORE_WORDS, _MORE_UPPER_WORDS = 2, 1

# Words that begin sentences. They are no name after a line break or as a further word.
_NO_NAMES = frozenset(
    "the a an and or but if in on at to of for from with by as is was are were be has had have he she it they we you i "
    "his her its their our my your this that these those there then when while where who what which how why not no yes "
    "so after before later during der die das ein eine und oder aber wenn im am zu von mit bei als ist war er sie es "
    "wir ihr ich nicht dann nach vor le la les un une et ou mais si dans sur avec par est il elle nous vous je ne ce "
    "cette ces puis après avant el los las uno una y o pero en con por es era él ella nosotros yo este esta luego "
    "и в на с по он она они мы вы я не но это как что когда ο η το και σε με για".split()
)

# The first digits of payment cards.
_ISSUERS = "23456"

# What a text must have for each of these to be looked for: most texts have none of it.
_KEYS = (b"token", b"secret", b"passw", b"key")
_NO_DIGITS, _FEWEST_DIGITS = bytes(set(range(256)) - set(b"0123456789")), 4
_APART = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_NAMING = {part.encode() for name in (*_ANY_CASE, *TITLES) for part in name.split("-")}


@dataclass(frozen=True)
class Mention:
    """A place in a text, and the entity there: its type and canonical form."""

    start: int
    end: int
    kind: str
    entity: str


def find(text: str) -> list[Mention]:
    """The mentions of a text in order, without overlaps; an earlier or longer one wins."""
    found, raw = [], text.encode()
    if b"@" in raw:
        found += [Mention(*m.span(), "email", m[0].lower()) for m in _WITH_AT.finditer(text)]
    low = raw.lower()
    if any(key in low for key in _KEYS):
        found += [Mention(*m.span("secret"), "secret", m["secret"].lower()) for m in _WITH_KEY.finditer(text)]
    numbers = _NUMBERS.finditer(text) if len(raw.translate(None, _NO_DIGITS)) >= _FEWEST_DIGITS else ()
    people = () if _NAMING.isdisjoint(raw.translate(_APART).split()) else _PEOPLE.finditer(text)
    for m in numbers:
        kind = m.lastgroup
        entity = m[0] if kind == "ip" else re.sub(r"[\W_]", "", m[0])
        if kind == "card" and not (entity[0] in _ISSUERS and luhn(entity)):
            continue  # a long number that no card can have
        if kind == "phone" and m[0][0] == "+":
            entity = f"+{entity}"
        found.append(Mention(*m.span(), kind, entity))
    named = [mention for m in people for mention in _person(text, m)]
    found += named + _other_mentions(text, named)
    found.sort(key=lambda m: (m.start, -m.end))
    kept, at = [], 0
    for m in found:
        if m.start >= at:
            kept.append(m)
            at = m.end
    return kept


def _person(text: str, m: re.Match[str]) -> Iterator[Mention]:
    """The given name and all further words of a name, each an entity of its own."""
    part = "surname" if m["given"] else "only_surname"
    start, end = m.span(part)
    before = text[m.end("given") : start] if m["given"] else text[m.end("only_title") : start]
    if "\n" in before and m[part].lower() in _NO_NAMES:
        return
    if m["given"]:
        script, gender = _named(m["given"])
        yield Mention(*m.span("given"), f"given {script} {gender}", m["given"].title())
    upper = _is_upper(m[part])
    for more in range(1 + (_MORE_UPPER_WORDS if upper else _MORE_WORDS)):
        if more:
            further = _MORE_NAME.match(text, end)
            word = further["word"] if further else ""
            if not word[:1].isupper() or _is_upper(word) != upper or word.lower() in _NO_NAMES:
                return
            if word in _NAMES or word.title() in _NAMES or word in TITLES:
                return
            start, end = further.span("word")
        word = _OWNER.sub("", text[start:end])
        yield Mention(start, start + len(word), f"surname {script_of(word)}", word.title())
        if start + len(word) < end:
            return


def _is_upper(word: str) -> bool:
    return len(word) > 1 and word.isupper()


def _other_mentions(text: str, named: list[Mention]) -> list[Mention]:
    """Where else in the text the words of the names found there stand, in these cases or upper case."""
    forms = {}
    for m in named:
        own = text[m.start : m.end]
        if len(own) > 1 and own[0].isupper() and own.lower() not in _NO_NAMES:
            for form in (own, own.title(), own.upper()):
                forms.setdefault(form, (m.kind, m.entity))
    found = []
    for form, entity in forms.items():
        at = text.find(form)
        while at >= 0:
            end = at + len(form)
            if not (at and _in_word(text[at - 1])) and not (end < len(text) and _in_word(text[end])):
                found.append(Mention(at, end, *entity))
            at = text.find(form, end)
    return found


def _in_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _named(given: str) -> tuple[str, str]:
    return _NAMES.get(given) or _NAMES[given.title()]


def script_of(word: str) -> str:
    c = word[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" else "latin"


class Surrogates:
    """Surrogates of canonical forms under one key.

    ``attempt`` numbers the draws of an entity; ``FULL`` is that of a form full of entities.
    """

    def __init__(self, key: bytes):
        self.key = key
        self.of = lru_cache(50_000)(self._of)

    def _of(self, kind: str, entity: str, attempt: int = 0) -> str:
        name, *form = kind.split()
        if name == "given":
            return self._given(tuple(form), entity, attempt)
        if name == "surname":
            return self._surname(form[0], entity, attempt)
        if name == "ip":
            return self._ip(entity, attempt)
        if name == "email":
            local, _, domain = entity.rpartition("@")
            host, _, top = domain.rpartition(".")
            if not _has_values(local + host):
                return f"{self._letters(name, local, attempt)}@{domain}"
            return f"{self._same_form('email', local, attempt)}@{self._same_form('host', host, attempt)}.{top}"
        if name == "card":
            return self._card(entity, attempt)
        if name == "phone" and entity[0] == "+":
            # The digits after the country code's first one.
            return entity[:2] + self._same_form(name, entity[2:], attempt)
        if name == "iban":
            return entity[:2] + self._same_form(name, entity[2:], attempt)
        if not _has_values(entity):
            return self._letters(name, entity, attempt)
        return self._same_form(name, entity, attempt)

    def _draw(self, size: int, *what: object) -> int:
        data = "\0".join(map(str, what)).encode()
        return int.from_bytes(hmac.digest(self.key, data, "sha256"), "big") % size

    def _drawn(self, value: int, size: int, *what: object) -> int:
        """A keyed permutation of 0..size-1 for each draw; that of a full form is a single cycle."""
        if what[-1] != FULL:
            return self._permuted(value, size, *what)
        return self._unpermuted((self._permuted(value, size, *what) + 1) % size, size, *what)

    def _unpermuted(self, value: int, size: int, *what: object) -> int:
        """The value that ``_permuted`` brings to this one."""
        half = _half(size)
        mask = (1 << half) - 1
        while True:
            left, right = value >> half, value & mask
            for turn in reversed(range(6)):
                left, right = right ^ self._draw(1 << half, *what, size, turn, left), left
            value = left << half | right
            if value < size:
                return value

    def _permuted(self, value: int, size: int, *what: object) -> int:
        """A keyed permutation of 0..size-1: a balanced Feistel network, walked until in range."""
        half = _half(size)
        mask = (1 << half) - 1
        while True:
            left, right = value >> half, value & mask
            for turn in range(6):
                left, right = right, left ^ self._draw(1 << half, *what, size, turn, right)
            value = left << half | right
            if value < size:
                return value

    def _same_form(self, name: str, text: str, attempt: int) -> str:
        """Every digit a digit, every hexadecimal or other letter one of its kind; the rest stays."""
        kinds, form = _form(name, text)
        size, value = 1, 0
        for c, k in zip(text, kinds, strict=True):
            if k:
                size, value = size * len(k), value * len(k) + k.index(c)
        if size == 1:
            return text
        value = self._drawn(value, size, name, form, attempt)
        out = []
        for c, k in zip(reversed(text), reversed(kinds), strict=True):
            if k:
                value, digit = divmod(value, len(k))
                out.append(k[digit])
            else:
                out.append(c)
        return "".join(reversed(out))

    def _letters(self, name: str, marks: str, attempt: int) -> str:
        """Letters for a value that has neither letters nor digits, more of them as a draw's number grows."""
        size, value = 26 ** (len(marks) + attempt // 4), 0
        for c in marks:
            value = value * len(_MARKS) + _MARKS.index(c)
        value, out = self._permuted(value, size, name, "marks", len(marks), attempt), ""
        while size > 1:
            value, letter = divmod(value, 26)
            out, size = out + chr(97 + letter), size // 26
        return out

    def _card(self, digits: str, attempt: int) -> str:
        """A number of the same length that passes the check digit test if the entity does."""
        valid, out = luhn(digits), digits
        while True:
            out = self._same_form("card", out, attempt)
            if luhn(out) == valid:
                return out

    def _ip(self, address: str, attempt: int) -> str:
        """An address of the same kind, private or public."""
        value = 0
        for part in address.split("."):
            value = value * 256 + int(part)
        private = _private(value)
        while True:
            value = self._drawn(value, 1 << 32, "ip", attempt)
            if _private(value) == private:
                return ".".join(str(value >> shift & 255) for shift in (24, 16, 8, 0))

    def _given(self, form: tuple[str, str], entity: str, attempt: int) -> str:
        """Another given name of the gender, with a second part as a draw's number grows."""
        names = GIVEN[form].split()
        place = names.index(entity) if entity in names else self._draw(len(names), "given", entity)
        shift = 1 + self._draw(len(names) - 1, "shift", *form)
        return names[(place + shift) % len(names)]

    def _surname(self, script: str, entity: str, attempt: int) -> str:
        """Three or four syllables, more of them as a draw's number grows, so names never run out."""
        parts, more = SYLLABLES[script].split(), attempt // 4
        drawn = self._draw(len(parts) ** (4 + more) * 4, "surname", script, entity, attempt)
        count, out = 3 + drawn % 4 // 2 + more, ""
        for _ in range(count):
            drawn, i = divmod(drawn, len(parts))
            out += parts[i]
        return out.title()


def _half(size: int) -> int:
    return max(1, ((size - 1).bit_length() + 1) // 2)


# What an e-mail's name or a secret may have besides letters and digits.
_MARKS = "._%+-/"


def _has_values(text: str) -> bool:
    return any(map(_alphabet, text))


def _form(name: str, text: str) -> tuple[list[str], str]:
    """The characters that may stand at each place of a text, and the form that they make."""
    hexadecimal = name == "secret" and re.fullmatch("[0-9a-f]+", text)
    kinds = ["0123456789abcdef" if hexadecimal else _alphabet(c) for c in text]
    form = "".join("x" if hexadecimal else "9" if c.isdigit() else "a" if k else c for c, k in zip(text, kinds, strict=True))
    return kinds, form


def form_of(kind: str, entity: str) -> tuple[str | None, float]:
    """What an entity shares with its possible surrogates, and how many values that has.

    None for those that are not permuted within a form.
    """
    if kind == "ip":
        value = int.from_bytes(bytes(map(int, entity.split("."))), "big")
        private = 2 * 2**24 + 2**20 + 2**16
        return ("private", private) if _private(value) else ("public", 2.0**32 - private)
    if kind not in ("email", "secret", "card", "phone", "iban", "ssn"):
        return None, 0.0
    fixed, text, top = "", entity, ""
    if kind == "iban" or (kind == "phone" and entity[0] == "+"):
        fixed, text = entity[:2], entity[2:]
    elif kind == "email":
        text, _, top = entity.rpartition(".")
    if not _has_values(text):
        return None, 0.0
    kinds, form = _form(kind, text)
    size = 1.0
    for k in kinds:
        size = min(size * (len(k) or 1), 1e300)
    if kind == "card":
        valid = luhn(entity)
        fixed, size = str(valid), size * (0.1 if valid else 0.9)
    return f"{fixed} {form} {top}", size


def _alphabet(c: str) -> str:
    if "0" <= c <= "9":
        return "0123456789"
    return "abcdefghijklmnopqrstuvwxyz" if "a" <= c <= "z" else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if "A" <= c <= "Z" else ""


def _private(value: int) -> bool:
    return value >> 24 in (10, 127) or value >> 20 == 0xAC1 or value >> 16 == 0xC0A8


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def in_format(surrogate: str, mention: str, kind: str) -> str:
    """A surrogate written as the mention was: its separators and its case."""
    name = kind.split()[0]
    if name in ("phone", "card", "ssn", "iban"):
        rest = iter(surrogate.lstrip("+"))
        return "".join(next(rest) if c.isalnum() else c for c in mention)
    if mention.isupper():
        return surrogate.upper()
    if name in ("email", "secret") and not mention.islower() and len(surrogate) == len(mention):
        return "".join(s.upper() if c.isupper() else s for s, c in zip(surrogate, mention, strict=True))
    return surrogate


def replace(text: str, surrogates: Surrogates, attempts: dict[tuple[str, str], int]) -> tuple[str, list[Mention]]:
    """The text with all mentions replaced, and the mentions at their places in the new text."""
    out, at, found, size = [], 0, [], 0
    for m in find(text):
        own = text[m.start : m.end]
        new = in_format(surrogates.of(m.kind, m.entity, attempts.get((m.kind, m.entity), 0)), own, m.kind)
        out += [text[at : m.start], new]
        size += m.start - at
        found.append(Mention(size, size + len(new), m.kind, m.entity))
        size += len(new)
        at = m.end
    return "".join([*out, text[at:]]), found


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = {}
        for row, text in zip(batch.column("row_key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for m in find(text or ""):
                seen[row, m.kind, m.entity] = None
        rows = list(zip(*seen, strict=True)) or [(), (), ()]
        types = [pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["row_key", "kind", "entity"])


def _free(taken: list[str], name: str) -> str:
    low = {c.lower() for c in taken}
    while name in low:
        name += "_"
    return name


def redrawn(entities: DataFrame, key: bytes) -> DataFrame:
    """``kind, entity, attempt`` of the entities whose first surrogates collide.

    A surrogate collides if another entity of its kind has it as well, or if it is an entity of
    the corpus itself. Of a form that has more entities than half its values, or still collides
    after all rounds, every entity has the draw ``FULL`` and may be another's surrogate. Given names are a fixed list, so they are permuted and may be each
    other's surrogates; they are told apart by their surnames, and are not checked.
    """
    spark = entities.sparkSession
    shared = spark.sparkContext.broadcast(key)
    name = uuid.uuid4().hex

    def draw(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        surrogates = made_once(name, lambda: Surrogates(shared.value))
        for kinds, entity, attempt in parts:
            rows = zip(kinds.to_pylist(), entity.to_pylist(), attempt.to_pylist(), strict=True)
            yield pa.array([surrogates.of(*row) for row in rows], pa.string())

    def formed(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for kinds, entity in parts:
            forms = [form_of(*row) for row in zip(kinds.to_pylist(), entity.to_pylist(), strict=True)]
            yield pa.array([{"form": form, "size": size} for form, size in forms], _FORMED)

    drawn = F.arrow_udf(draw, "string")("kind", "entity", "attempt")
    form = F.arrow_udf(formed, "form string, size double")("kind", "entity")
    # Drawing takes time, not room: rows are dealt out by number, however few bytes they have.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    checked = entities.filter("kind NOT LIKE 'given %'").repartition(tasks, F.xxhash64("kind", "entity")).withColumn("attempt", F.lit(0)).withColumn("formed", form)
    checked = checked.withColumn("surrogate", drawn).select("kind", "entity", "attempt", "surrogate", "formed.*")
    checked = write_through(checked, "surrogates")

    def filled(checked: DataFrame, forms: DataFrame) -> DataFrame:
        """All entities of these forms drawn as those of a full form are."""
        forms = write_through(forms.select("kind", "form"), "full_forms")
        if forms.isEmpty():
            return checked
        moved = checked.join(forms, ["kind", "form"], "left_semi").withColumn("attempt", F.lit(FULL))
        kept = checked.join(forms, ["kind", "form"], "left_anti")
        return write_through(kept.unionByName(moved.withColumn("surrogate", drawn)), "surrogates")

    sizes = checked.filter("form IS NOT NULL").groupBy("kind", "form").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    checked = filled(checked, sizes.filter("n * 2 > size"))
    for turn in range(2 * MOST_ROUNDS):
        # The holder of a surrogate is the entity that is first to have it, so it stays.
        order = F.struct("attempt", "entity")
        holders = checked.groupBy("kind", "surrogate").agg(F.min(order)["entity"].alias("holder"), F.count("*").alias("n"))
        real = checked.select("kind", F.col("entity").alias("surrogate"), F.lit(True).alias("real"))
        odd = holders.filter("n > 1").join(real, ["kind", "surrogate"], "full").filter("real OR n > 1")
        state = checked.join(odd, ["kind", "surrogate"], "left")
        taken = F.coalesce("real", F.lit(False)) & (F.col("attempt") != FULL)
        again = taken | F.coalesce(F.col("holder") != F.col("entity"), F.lit(False))
        state = write_through(state.select(*checked.columns, again.alias("again")), "surrogates")
        if state.filter("again").isEmpty():
            return checked.filter(F.col("attempt") != 0).select("kind", "entity", "attempt")
        if turn == MOST_ROUNDS - 1:
            checked = filled(checked, state.filter("again AND form IS NOT NULL").select("kind", "form").distinct())
            continue
        moved = state.filter("again").withColumn("attempt", F.col("attempt") + 1).withColumn("surrogate", drawn)
        checked = state.filter("NOT again").unionByName(moved).drop("again")
    raise ValueError("surrogates still collide")


def pseudonymize(
    docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text", most_shared: int = MOST_SHARED,
    entities: str | None = "entities",
) -> DataFrame:
    """Replace all entities in ``text`` by surrogates; other columns are kept.

    Adds ``entities``, the places and kinds in the new text, unless that name is None. Every
    mention of one entity has the same surrogate, in all documents. A null text stays null and
    an empty one empty; a text without entities is returned as it is. Repeated rows are replaced
    alike. Few redrawn entities are broadcast, checked against ``most_shared``; more are joined
    to the documents that mention them.
    """
    spark = docs.sparkSession
    row_key = F.xxhash64(F.col(doc_id).cast("string"), F.col(text).cast("string"))
    rows = docs.select(row_key.alias("row_key"), F.col(text).cast("string").alias("text"))
    mentions = rows.mapInArrow(_entities, "row_key long, kind string, entity string")
    mentions = written(mentions, "mentions")
    again = write_through(redrawn(mentions.select("kind", "entity").distinct(), key), "redrawn")
    shared = spark.sparkContext.broadcast(key)
    name = uuid.uuid4().hex

    def rewrite(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        surrogates = made_once(name, lambda: Surrogates(shared.value))
        for texts, attempts in parts:
            out = []
            for value, own in zip(texts, attempts, strict=True):
                value, own = value.as_py(), own.as_py()
                drawn = few.value if few else {(a["kind"], a["entity"]): a["attempt"] for a in own or []}
                new, found = (None, []) if value is None else replace(value, surrogates, drawn)
                spans = [{"start": m.start, "end": m.end, "kind": m.kind.split()[0]} for m in found]
                out.append({"text": new, "entities": spans})
            yield pa.array(out, _REWRITTEN)

    held, attempts = _free(docs.columns, "rewritten_text"), _free(docs.columns, "entity_attempts")
    few = None
    if again.count() <= most_shared:
        few = spark.sparkContext.broadcast({(r["kind"], r["entity"]): r["attempt"] for r in again.collect()})
        found = docs.withColumn(attempts, F.lit(None).cast(_ATTEMPTS))
    else:
        named = F.collect_list(F.struct("kind", "entity", "attempt")).alias(attempts)
        own = _free(docs.columns, "mention_row")
        by_row = mentions.distinct().join(again, ["kind", "entity"]).groupBy(F.col("row_key").alias(own)).agg(named)
        found = docs.withColumn(own, row_key).join(by_row, own, "left").drop(own)
    rewritten = F.arrow_udf(rewrite, _SCHEMA)(F.col(text).cast("string"), F.col(attempts))
    found = found.withColumn(held, rewritten)
    columns = [F.col(f"{held}.text").alias(text) if c == text else F.col(c) for c in docs.columns if c != entities]
    if entities:
        columns.append(F.col(f"{held}.entities").alias(entities))
    return found.select(*columns)


_FORMED = pa.struct([("form", pa.string()), ("size", pa.float64())])
_ATTEMPTS = "array<struct<kind: string, entity: string, attempt: int>>"
_SCHEMA = "text string, entities array<struct<start: int, end: int, kind: string>>"
_REWRITTEN = pa.struct(
    [
        ("text", pa.string()),
        ("entities", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))),
    ]
)
