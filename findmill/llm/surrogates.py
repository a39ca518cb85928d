"""PII surrogates: every detected entity gets a keyed replacement of its own type, script and format.

A replacement is a keyed permutation of the entity, never a draw from a pool: digits and letters go
through a Feistel network over exactly the words of their length, with rounds from HMAC-SHA256. Different
entities of a type therefore cannot get the same replacement, and the same entity gets the same one in
every document and task, without a table of the corpus. What is permuted is the entity's ``identity``, one
form for all ways to write it: '+1 555 123 4567', '001 555 123-4567' and '+15551234567' are one number. What must hold
for the type is kept: separators, letter case, country codes, card issuer digit and check digit, octet
ranges, titles, gender and script.

``collisions`` checks over a corpus that no two entities share a replacement and that no replacement is
itself an entity of the corpus; the latter can happen by chance, where numbers of a type are dense, and is
reported, not mended.

Names are recognised by a title or by a listed given name before a capitalised word; later bare mentions of
either part are replaced too. Surname and given names are replaced one by one, so 'Mrs. Ann Lee', 'Dr. Ann
Lee', 'Ms. Lee' and a bare 'Ann' stay one person. A given name has one gender in a document: that of a
gendered title with it, else that of the list, else by its last letter. Made given names end as names of
their gender do. A number without its country code is another entity than the one with it.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import string
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findmill.llm.common import arrow_map, read_table, utf8

KINDS = ("email", "ip", "iban", "ssn", "card", "phone", "name")
ROUNDS = 8
_EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,}(?![\w-])", re.ASCII)
_IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d)", re.ASCII)
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.ASCII)
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.ASCII)
_CARD = re.compile(r"(?<![\w+-])[1-9](?:[ -]?\d){12,18}(?!\w|-\d)", re.ASCII)
_PHONE = re.compile(
    r"(?<![\w.+])\+\d{1,3}(?:[ .-]?(?:\(\d{1,5}\)|\d{1,12})){1,6}+(?!\w|[.-]\d)"
    r"|(?<![\w.+])(?:00\d{1,3}[ .-])?(?:\(\d{1,5}\)[ .-]?|\d{2,5}[ ./-])\d{2,4}(?:[ .-]\d{2,4}){1,3}(?!\w|[.-]\d)",
    re.ASCII,
)
#: Titles that come before a name, by gender.
TITLES = {
    "m": ("Mr", "Sir", "Herr", "M", "Monsieur", "Sr", "Señor", "Don", "г-н", "κ"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Mme", "Mlle", "Madame", "Sra", "Srta", "Señora", "Doña", "г-жа", "κα"),
    "n": ("Dr", "Prof"),
}
_GENDER = {t: g for g, titles in TITLES.items() for t in titles}
#: Common given names that are no common words, by gender.
GIVEN = {
    "m": (
        "John", "James", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Daniel", "Matthew", "Anthony",
        "Steven", "Paul", "Andrew", "Kenneth", "George", "Edward", "Brian", "Ronald", "Kevin", "Peter", "Henry", "Hans", "Klaus", "Jürgen",
        "Wolfgang", "Stefan", "Andreas", "Jean", "Pierre", "Jacques", "François", "Michel", "Philippe", "José", "Juan", "Carlos", "Luis",
        "Miguel", "Antonio", "Pedro", "Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Γιώργος", "Νίκος", "Κώστας",
    ),
    "f": (
        "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Nancy", "Lisa", "Margaret",
        "Sandra", "Ashley", "Emily", "Donna", "Michelle", "Carol", "Amanda", "Melissa", "Deborah", "Stephanie", "Ann", "Anna", "Helen",
        "Laura", "Ursula", "Monika", "Petra", "Sabine", "Claudia", "Marie", "Nathalie", "Isabelle", "Sylvie", "Catherine", "María", "Carmen",
        "Ana", "Lucía", "Elena", "Анна", "Мария", "Ольга", "Елена", "Наталья", "Μαρία", "Ελένη", "Κατερίνα",
    ),
}
_LISTED = {name.casefold(): g for g, names in GIVEN.items() for name in names}
#: International country codes of one and of two digits; all others have three.
SHORT_CODES = {
    "1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54",
    "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
}
_WORD = r"[^\W\d_a-zß-öø-ÿа-яα-ω][^\W\d_]*(?:[-'’][^\W\d_]+)*"
_NAME = re.compile(rf"(?<!\w)({'|'.join(sorted(map(re.escape, _GENDER), key=len, reverse=True))})(\.? )({_WORD}(?: {_WORD}){{0,2}})(?!\w)")
_FULL = re.compile(rf"(?<!\w)((?:{'|'.join(n for names in GIVEN.values() for n in names)})(?: {_WORD}){{1,2}})(?!\w)")
#: Syllable parts of made names, and endings by gender, for each script.
SYLLABLES = {
    "latin": ("bcdfghjklmnpqrstvwxz", "aeiouy", {"m": "o", "f": "a", "n": "is"}),
    "cyrillic": ("бвгджзклмнпрстфхцчшщ", "аеиоуыэюя", {"m": "ий", "f": "ая", "n": "ен"}),
    "greek": ("βγδζθκλμνξπρστφχψ", "αεηιουω", {"m": "ος", "f": "α", "n": "ις"}),
}
#: The letters of most names of a script.
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "wide": "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýœšž", "cyrillic": "абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψωςάέήίόύώ"}


@lru_cache(maxsize=1 << 14)
def permute(key: bytes, tweak: str, value: int, size: int) -> int:
    """A keyed permutation of range(size), by a Feistel network and cycle walking."""
    if size < 2:
        return value
    half = max(1, (size - 1).bit_length() + 1 >> 1)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for i in range(ROUNDS):
            said = hmac.digest(key, f"{tweak}|{size}|{i}|{right}".encode(), "sha256")
            left, right = right, left ^ (int.from_bytes(said, "big") & mask)
        value = left << half | right
        if value < size:
            return value


def permute_word(key: bytes, tweak: str, word: str, alphabet: str) -> str:
    """A word of the same length over the alphabet."""
    n, base = 0, len(alphabet)
    for c in word:
        n = n * base + alphabet.index(c)
    n = permute(key, f"{tweak}|{len(word)}", n, base ** len(word))
    out = []
    for _ in word:
        n, digit = divmod(n, base)
        out.append(alphabet[digit])
    return "".join(reversed(out))


def _same_classes(key: bytes, tweak: str, text: str) -> str:
    """Letters and digits permuted as two words, all other characters and places kept; lower-case text."""
    made = {}
    for alphabet in (string.ascii_lowercase, string.digits):
        word = "".join(c for c in text if c in alphabet)
        shape = "".join("x" if c in alphabet else c for c in text)
        made[alphabet] = iter(permute_word(key, f"{tweak}|{_shape(shape)}", word, alphabet))
    return "".join(
        next(made[string.ascii_lowercase]) if c in string.ascii_lowercase else next(made[string.digits]) if c in string.digits else c
        for c in text
    )


def _shape(text: str) -> str:
    return re.sub(r"\d", "9", re.sub(r"[a-z]", "x", text))


def _cased(made: str, like: str) -> str:
    if len(made) == len(like):
        return "".join(a.upper() if b.isupper() else a for a, b in zip(made, like))
    return made.upper() if like.isupper() and len(like) > 1 else made[:1].upper() + made[1:]


def _digits_in(text: str, digits: str) -> str:
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in text)


def luhn(digits: str) -> int:
    """The check digit that belongs after these digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 - i % 2)
        total += n - 9 * (n > 9)
    return -total % 10


def _email(key: bytes, text: str) -> str:
    local, _, domain = text.lower().partition("@")
    host, _, top = domain.rpartition(".")
    made = f"{_same_classes(key, 'local', local)}@{_same_classes(key, 'domain', host)}"
    return _cased(made, text[: len(made)]) + f".{top}.example"


def _ip(key: bytes, text: str) -> str:
    a, b, c, d = map(int, text.split("."))
    # 1.0.0.0 to 223.255.255.255 stay among themselves, and so does the rest.
    first, last = (1, 224) if 1 <= a < 224 else (0, 1) if a == 0 else (224, 256)
    n = permute(key, f"ip{first}", ((a - first) << 24) | b << 16 | c << 8 | d, (last - first) << 24)
    return f"{(n >> 24) + first}.{n >> 16 & 255}.{n >> 8 & 255}.{n & 255}"


def _card(key: bytes, text: str) -> str:
    digits = re.sub(r"\D", "", text)
    body = digits[0] + permute_word(key, f"card{digits[0]}", digits[1:-1], string.digits)
    # A valid number stays valid, another stays as far from valid as it was.
    check = (luhn(body) + int(digits[-1]) - luhn(digits[:-1])) % 10
    return _digits_in(text, body + str(check))


def _phone_parts(text: str) -> tuple[str, list[int]]:
    """The country code ('' if none is written) and the places of the digits after it, a trunk (0) left out."""
    places = [i for i, c in enumerate(text) if c.isdigit()]
    code = ""
    if text.startswith("+") or re.match("00[1-9]", text) and not text.startswith("000"):
        skip = 0 if text[0] == "+" else 2
        digits = "".join(text[i] for i in places[skip:])
        size = next((n for n in (1, 2) if digits[:n] in SHORT_CODES), 3)
        code, places = digits[:size], places[skip + size :]
        trunk = re.compile(r"[ .-]?\(0\)").match(text, places[0] - 1 if places else 0)
        places = places[1:] if trunk and text[places[0]] == "0" else places
    return code, places


def _phone(key: bytes, text: str) -> str:
    code, places = _phone_parts(text)
    digits = "".join(text[i] for i in places)
    if not digits:
        return text
    # The first digit permutes among 1-9 or stays 0; the rest among all words of its length.
    first = digits[0] if digits[0] == "0" else str(1 + permute(key, f"phone{code}|{digits[1:]}", int(digits[0]) - 1, 9))
    made = iter(first + permute_word(key, f"phone{code}|{first}", digits[1:], string.digits))
    out = list(text)
    for i in places:
        out[i] = next(made)
    return "".join(out)


def _iban(key: bytes, text: str) -> str:
    body = re.sub(" ", "", text)[4:]
    made = _same_classes(key, f"iban{text[:2]}", body.lower()).upper()
    number = int("".join(str(int(c, 36)) for c in made + text[:2]) + "00")
    left = iter(f"{98 - number % 97:02d}{made}")
    return text[:2] + "".join(c if c == " " else next(left) for c in text[2:])


def _ssn(key: bytes, text: str) -> str:
    return _digits_in(text, permute_word(key, "ssn", text.replace("-", ""), string.digits))


def _script(word: str) -> str:
    if re.search("[а-яёА-ЯЁ]", word):
        return "cyrillic"
    return "greek" if re.search("[α-ωΑ-Ωά-ώ]", word) else "latin"


def made_name(key: bytes, word: str, gender: str | None) -> str:
    """A pronounceable word for a name: its letters permuted as a number, then written in syllables.

    Every word of n letters has a number of its own and every number its own syllables, so two names never
    share one; it takes about 1.4 letters for one. Words with rarer characters are numbered by their UTF-8.
    ``gender`` None makes a surname, without a gendered ending.
    """
    low, script = word.lower(), _script(word)
    consonants, vowels, endings = SYLLABLES[script]
    kinds = [x for x in (script, "wide") if set(low) <= set(LETTERS[x])]
    letters = LETTERS[kinds[0]] if kinds else ""
    base, raw = (len(letters), [letters.index(c) for c in low]) if kinds else (256, low.encode())
    n = 0
    for digit in raw:
        n = n * base + digit
    n = permute(key, f"name|{script}|{gender}|{base}|{len(raw)}", n, base ** len(raw))
    # Numbers for shorter words come first, so that lengths do not meet; nor do the three kinds of words.
    n = 3 * (n + sum(base**k for k in range(1, len(raw)))) + (2 if not kinds else kinds[0] != script)
    out, base = [], len(consonants) * len(vowels)
    while True:
        n, digit = divmod(n, base)
        out.append(consonants[digit // len(vowels)] + vowels[digit % len(vowels)])
        if not n:
            break
        n -= 1
    return _cased("".join(out) + ("" if gender is None else endings[gender]), word)


_MAKERS = {"email": _email, "ip": _ip, "iban": _iban, "ssn": _ssn, "card": _card, "phone": _phone}
_RULES = (("email", _EMAIL), ("ip", _IP), ("iban", _IBAN), ("ssn", _SSN), ("card", _CARD), ("phone", _PHONE))


def detect(text: str) -> list[tuple[int, int, str, str | None]]:
    """Sorted spans (start, end, kind, gender of a given name) that don't overlap; earlier kinds win."""
    taken: list[tuple[int, int, str, str | None]] = []
    used = set()

    def take(start: int, end: int, kind: str, gender: str | None = None) -> None:
        if used.isdisjoint(range(start, end)):
            used.update(range(start, end))
            taken.append((start, end, kind, gender))

    for kind, rule in _RULES:
        if kind == "email" and "@" not in text:
            continue
        for m in rule.finditer(text):
            digits = sum(c.isdigit() for c in m[0])
            if kind == "phone" and not 7 <= digits <= 15:
                continue
            take(m.start(), m.end(), kind)
    surnames: set[str] = set()
    titled: dict[str, set[str]] = {}
    found = [(m.start(3), m[3], _GENDER[m[1]]) for m in _NAME.finditer(text)] + [(m.start(1), m[1], "n") for m in _FULL.finditer(text)]
    for start, words, gender in found:
        *given, surname = words.split()
        surnames.add(surname)
        for name in given:
            titled.setdefault(name, set()).update({gender} - {"n"})
    if found:
        genders = {name.casefold(): _gender_of(name, g) for name, g in titled.items()}
        known = surnames | titled.keys()
        either = {x for name in known for x in (name, name.upper())}
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(sorted(map(re.escape, either), key=len, reverse=True))})(?!\w)", text):
            take(m.start(), m.end(), "name", genders.get(m[0].casefold()))
    return sorted(taken, key=lambda x: x[:2])


def _gender_of(name: str, titled: set[str]) -> str:
    if len(titled) == 1:
        return next(iter(titled))
    return _LISTED.get(name.casefold()) or ("f" if name.casefold()[-1] in "aeаяηα" else "m")


def surrogate(key: bytes, kind: str, text: str, gender: str | None = None) -> str:
    return made_name(key, text, gender) if kind == "name" else _MAKERS[kind](key, text)


def identity(kind: str, text: str) -> str:
    """What makes two mentions the same entity: digits of numbers, letters without case."""
    if kind == "phone":
        code, places = _phone_parts(text)
        return f"{'+' if code else ''}{code}{''.join(text[i] for i in places)}"
    return re.sub(r"\D", "", text) if kind in ("card", "ssn") else text.replace(" ", "").casefold()


#: What every detection holds: an e-mail its @, numbers an ASCII digit, a name its title or a listed given name.
#: \b would know ASCII letters only.
_MAYBE = re.compile(rb"@|[0-9]|(?:" + "|".join(sorted(map(re.escape, _GENDER), key=len, reverse=True)).encode() + rb")\.? |(?:" + "|".join(n for x in GIVEN.values() for n in x).encode() + rb") ")


def replace(key: bytes, raw: bytes) -> tuple[str, list[tuple[int, int, str, str, str]]]:
    """The text with surrogates, and (start, end, kind, identity, surrogate) in places of the old text."""
    text = raw.decode("utf-8", "replace")
    if not _MAYBE.search(raw):
        return text, []
    out, found, at = [], [], 0
    for start, end, kind, gender in detect(text):
        made = surrogate(key, kind, text[start:end], gender)
        out += [text[at:start], made]
        found.append((start, end, kind, identity(kind, text[start:end]), made))
        at = end
    return "".join([*out, text[at:]]), found


ENTITIES = "array<struct<start:bigint,end:bigint,kind:string,identity:string,surrogate:string,made:string>>"


FIELDS = ("start", "end", "kind", "identity", "surrogate", "made")


def pseudonymise(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``df`` with surrogates in ``text_col`` and ``entities``, their spans in the old text; ``made`` is the surrogate's identity.

    A null text stays null; it and an empty text have no entities. ``entities`` replaces a column of that
    name; other columns and repeated rows stay. One narrow pass without a shuffle.
    """
    secret = hashlib.sha256(key.encode()).digest()
    keep = [c for c in df.columns if c not in ("entities", text_col)]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), *((x, pa.string()) for x in FIELDS[2:])]))

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, found = [], []
        for value, null in zip(batch.column(len(keep)), batch.column(len(keep) + 1)):
            text, spans = replace(secret, value.as_py())
            texts.append(None if null.as_py() else text)
            found.append([dict(zip(FIELDS, (*x, identity(x[2], x[4])))) for x in spans])
        made = [pa.array(texts, pa.string()), pa.array(found, kind)]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], [*keep, text_col, "entities"])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep]
    given = df.select(*keep, utf8(F.col(text_col)).alias("_raw"), F.col(text_col).isNull().alias("_null"))
    return arrow_map(given, ", ".join([*schema, f"`{text_col}` string", f"entities {ENTITIES}"]), per_batch)


def collisions(found: DataFrame) -> DataFrame:
    """(kind, made, identities, real): surrogates that several entities share, or that are entities of the corpus.

    ``found`` has the ``entities`` of a corpus. Pairs are made distinct before they are counted, so a frequent
    entity is one row a task.
    """
    one = found.select(F.explode("entities").alias("e")).select("e.kind", "e.identity", "e.made").distinct()
    both = one.select("kind", "made", F.lit(0).alias("real")).union(one.select("kind", "identity", F.lit(1)).distinct())
    counted = both.groupBy("kind", "made").agg(F.sum(1 - F.col("real")).alias("identities"), F.max("real").alias("real"))
    # An e-mail's surrogate and a name's are made for no one else; a real one means the same in all kinds.
    return counted.where("identities > 1 OR (identities > 0 AND real = 1)").withColumn("real", F.col("real") == 1)


def op5_surrogates(spark, sf_dir: str) -> DataFrame:
    """Every document with surrogates; ``n_unchanged`` counts those of its entities whose surrogate is themselves."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pseudonymise(documents, key="findmill")
    counts = [F.size(F.filter("entities", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    same = F.size(F.filter("entities", lambda x: x["identity"] == x["made"])).cast("long").alias("n_unchanged")
    return found.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), *counts, same)


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind
