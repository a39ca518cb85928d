import hashlib
import re
import string

import pytest

from findmill.llm import surrogates as R

SF = "/root/testdata/sf0.001"
KEY = hashlib.sha256(b"test").digest()


@pytest.mark.parametrize("size", [2, 3, 10, 97, 256])
def test_permutations_are_permutations(size):
    assert sorted(R.permute(KEY, "t", i, size) for i in range(size)) == list(range(size))


def test_words_of_one_length_stay_distinct():
    made = {R.permute_word(KEY, "w", f"{i:03d}", string.digits) for i in range(1000)}
    assert len(made) == 1000 and all(len(w) == 3 for w in made)


@pytest.mark.parametrize(
    "kind,text,shape",
    [
        ("email", "Ann.Lee_7@mail.example.org", r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}_\d@[a-z]{4}\.[a-z]{7}\.org\.example"),
        ("ip", "192.168.0.1", r"\d+\.\d+\.\d+\.\d+"),
        ("ssn", "123-45-6789", r"\d{3}-\d{2}-\d{4}"),
        ("phone", "+49 (30) 1234-567", r"\+49 \(\d\d\) \d{4}-\d{3}"),
        ("card", "4111 1111 1111 1111", r"4\d{3} \d{4} \d{4} \d{4}"),
        ("iban", "DE89 3704 0044 0532 0130 00", r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d"),
    ],
)
def test_formats_stay(kind, text, shape):
    made = R.surrogate(KEY, kind, text)
    assert re.fullmatch(shape, made) and made != text
    assert made == R.surrogate(KEY, kind, text) != R.surrogate(b"other", kind, text)


def test_check_digits_stay_valid():
    card = re.sub(r"\D", "", R.surrogate(KEY, "card", "4111 1111 1111 1111"))
    assert R.luhn(card[:-1]) == int(card[-1])
    iban = R.surrogate(KEY, "iban", "DE89370400440532013000")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def test_octets_stay_in_their_range():
    for text in ("10.0.0.1", "223.255.255.255", "0.0.0.0", "255.255.255.255", "8.8.8.8"):
        parts = [int(x) for x in R.surrogate(KEY, "ip", text).split(".")]
        assert all(0 <= x < 256 for x in parts)
        first = int(text.split(".")[0])
        assert (1 <= parts[0] < 224) == (1 <= first < 224)


def test_names_keep_gender_script_and_coreference():
    text, found = R.replace(KEY, "Mrs. Ann Lee met Dr. Lee. LEE and Lee; г-жа Анна Петрова".encode())
    made = {(k, i): s for _, _, k, i, s in found}
    assert made["name", "ann"].endswith("a")
    lee = next(s for _, _, k, i, s in found if i == "lee")
    assert text.count(lee) == 3 and "Mrs. " in text and f" {lee.upper()} " in text and "LEE" not in text
    assert re.fullmatch("[А-Я][а-я]+ая", made["name", "анна"])
    assert re.fullmatch("[А-Я][а-я]+", made["name", "петрова"])


def test_made_names_are_distinct():
    words = [a + b + c for a in "ABCDE" for b in "aeiou" for c in string.ascii_lowercase]
    assert len({R.made_name(KEY, w, None) for w in words}) == len(words)


def test_spans_point_into_the_old_text():
    old = "é call +1 555 123 4567 or mail a@b.org, SSN 078-05-1120."
    text, found = R.replace(KEY, old.encode())
    assert [k for _, _, k, _, _ in found] == ["phone", "email", "ssn"]
    for a, b, k, i, s in found:
        assert R.identity(k, old[a:b]) == i and s in text
    assert "078-05-1120" not in text and "a@b.org" not in text


def test_query_covers_every_document_without_collisions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = R.op5_surrogates(spark, SF)
    assert found.count() == docs.count()
    changed = found.where("n_entities > 0").count()
    assert 0 < changed < docs.count()
    made = R.pseudonymise(docs, "findmill")
    assert R.collisions(made).count() == 0
    again = R.pseudonymise(docs, "another key").join(found.select("doc_id", found.text.alias("t")), "doc_id")
    assert again.where("size(entities) = 0 AND text <> t").count() == 0


def test_collisions_are_reported(spark):
    rows = [([(0, 1, "ssn", "111", "9-9", "99"), (2, 3, "ssn", "222", "99", "99"), (4, 5, "ip", "1", "2", "2"), (6, 7, "ip", "2", "3", "3")],)]
    found = R.collisions(spark.createDataFrame(rows, f"entities {R.ENTITIES}")).collect()
    assert sorted(tuple(r) for r in found) == [("ip", "2", 1, True), ("ssn", "99", 2, False)]


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, 3), (2, "", 3), (2, "", 3)], "doc_id long, text string, entities int")
    found = R.pseudonymise(df, "k")
    assert sorted(found.columns) == ["doc_id", "entities", "text"]
    assert sorted((r.doc_id, r.text, len(r.entities)) for r in found.collect()) == [(1, None, 0), (2, "", 0), (2, "", 0)]
    assert R.pseudonymise(df.limit(0), "k").count() == 0


@pytest.mark.parametrize(
    "text, kind",
    [
        ("write to a@b.org", "email"), ("ask 8.8.8.8 first", "ip"), ("at 1.1.1.1", "ip"), ("DE89 3704 0044 0532 0130 00", "iban"),
        ("my 078-05-1120", "ssn"), ("4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "card"), ("call +1 2 3 4 5 6 7", "phone"),
        *((f"{before}{title}{dot} {name}", "name") for titles in R.TITLES.values() for title in titles for dot in (".", "") for before in ("", "– ", "ο ")
          for name in ("Lee", "Иванов", "Παπαδόπουλος")),
    ],
)
def test_texts_with_a_single_entity_are_not_passed_over(text, kind):
    made, found = R.replace(KEY, text.encode())
    assert [x[2] for x in found] == [kind] and made != text


@pytest.mark.parametrize(
    "mentions",
    [
        ("+1 555 123 4567", "+15551234567", "001 555 123 4567", "001-555-123-4567", "+1 (555) 123-4567"),
        ("+49 30 1234567", "+49 (0)30 1234567", "0049 30 1234 567", "+49301234567"),
        ("+351 21 123 4567", "+351211234567", "00351 21 123 4567"),
    ],
)
def test_one_number_has_one_surrogate_in_all_formats(mentions):
    for text in mentions:
        made, found = R.replace(KEY, f"call {text}, please".encode())
        assert [x[2] for x in found] == ["phone"], text
    assert len({R.identity("phone", x) for x in mentions}) == 1
    assert len({R.identity("phone", R.surrogate(KEY, "phone", x)) for x in mentions}) == 1


def test_numbers_of_all_formats_stay_distinct():
    real = [f"{code}{n}" for code in ("+1 ", "+49", "+351 ", "0", "0049 ") for n in range(2_000_000, 2_000_400)]
    real = sorted({R.identity("phone", x): x for x in real}.values())
    assert len({R.identity("phone", R.surrogate(KEY, "phone", x)) for x in real}) == len(real)


def test_one_person_over_titles_and_bare_mentions():
    text, found = R.replace(KEY, b"Mrs. Ann Lee wrote. Dr. Ann Lee agreed, and Ann left with LEE.")
    given, surname = {s for *_, i, s in found if i == "ann"}, {s.casefold() for *_, i, s in found if i == "lee"}
    assert len(given) == len(surname) == 1 and len(found) == 6 and "Ann" not in text and "Lee" not in text


def test_untitled_names_are_found():
    text, found = R.replace(KEY, "John Smith called Mary Jones. Петра видела Анна Петрова".encode())
    assert [x[3] for x in found] == ["john", "smith", "mary", "jones", "анна", "петрова"]
    assert found[0][4].endswith("o") and found[2][4].endswith("a")


def test_made_names_are_little_longer():
    for name in ("Lee", "Smith", "Papadopoulos", "Müller", "Петрова", "Παπαδόπουλος", "Wolfeschlegelstein"):
        assert len(R.made_name(KEY, name, None)) <= 1.6 * len(name) + 3


def brute(text: str) -> str:
    """The text with every e-mail, number and IP of a fixed grammar replaced one by one, by the makers."""
    def made(m):
        kind = "email" if "@" in m[0] else "ssn" if re.fullmatch(r"\d{3}-\d\d-\d{4}", m[0]) else "ip" if "." in m[0] else "phone"
        return R.surrogate(KEY, kind, m[0])

    return re.sub(r"[a-z]+@[a-z]+\.org|\d{3}-\d\d-\d{4}|\d+\.\d+\.\d+\.\d+|\+1 \d{3} \d{3} \d{4}", made, text)


def test_whole_texts_equal_brute_force():
    parts = ["ann@mail.org", "078-05-1120", "10.20.30.40", "+1 555 123 4567", "word,", "é", "x y z.", "(see", "below)"]
    for i in range(300):
        text = " ; ".join(parts[(i * k + k * k) % len(parts)] for k in range(1, 2 + i % 9))
        assert R.replace(KEY, text.encode())[0] == brute(text)


def test_long_texts(spark):
    text = "Mrs. Ann Lee, ann@mail.org and +1 555 123 4567. " * 20_000
    row = R.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").first()
    assert len(row.entities) == 80_000 and "Ann" not in row.text and len({e.surrogate for e in row.entities}) == 4
