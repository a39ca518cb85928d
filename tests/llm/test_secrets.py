import base64
import bz2
import gzip
import hashlib
import io
import lzma
import re
import tarfile
import time
import tracemalloc
import zlib
from urllib.parse import quote

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from findmill.llm import secret_worklist as X

SF = "/root/testdata/sf0.001"
SECRET = "password = hunter2hunter2"


def brute_base(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) by the base rules alone."""
    assign = re.compile("(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(a, X.KINDS[k], b) for a, k, b in sorted(found)]


def test_query_equals_brute_force_and_keeps_base_spans(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = X.op10_secrets(spark, SF).collect()
    assert len(found) == len(docs)
    for row in found:
        base = brute_base(docs[row.doc_id])
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(k == kind for _, k, _ in base) for kind in X.KINDS]
        labels = [f"{k}:{a}:{b}" for a, k, b in base]
        assert row.base_sha256 == hashlib.sha256(",".join(labels).encode()).hexdigest()
        assert set(labels) <= set(filter(None, row.spans.split(",")))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="tokensecrpiay_ =:\"'AKI0f9é%5\\u&#;-", max_size=120))
def test_base_spans_of_any_text(text):
    found, unopened = X.find(text.encode())
    assert [(a, X.KINDS[k], b) for a, b, k, d in found if d == 0] == brute_base(text)
    assert all(0 <= a < b <= len(text) for a, b, _, _ in found)


def b64(data: bytes) -> str:
    return base64.b64encode(data).decode()


def escaped(text: str) -> str:
    return "".join(f"\\u{ord(c):04x}" for c in text)


WRAPPED = {
    "url": "".join(f"%{b:02X}" for b in SECRET.encode()),
    "unicode": escaped(SECRET),
    "entities": "".join(f"&#{ord(c)};" for c in SECRET),
    "base64": b64(SECRET.encode()),
    "urlsafe base64": base64.urlsafe_b64encode(f"{SECRET}???>>>".encode()).decode().rstrip("="),
    "gzip": b64(gzip.compress(SECRET.encode() * 3)),
    "zlib": b64(zlib.compress(SECRET.encode() * 3)),
    "bz2": b64(bz2.compress(SECRET.encode() * 3)),
    "xz": b64(lzma.compress(SECRET.encode() * 3)),
    "base64 twice": b64(b64(SECRET.encode()).encode()),
    "url in base64": b64(quote(SECRET, safe="").replace("p", "%70").encode()),
    "base64 in unicode": escaped(b64(SECRET.encode())),
    "gzip in base64 in gzip": b64(gzip.compress(b64(gzip.compress(SECRET.encode() * 3)).encode())),
}


@pytest.mark.parametrize("name", WRAPPED)
def test_wrapped_secrets_are_found_inside_their_wrapping(name):
    before, after = "é intro: ", " . tail"
    text = before + WRAPPED[name] + after
    found, _ = X.find(text.encode())
    inner = [(a, b) for a, b, k, d in found if k == 0 and d > 0]
    assert inner, name
    for a, b in inner:
        assert len(before) <= a < b <= len(text) - len(after)


def test_zstandard():
    zstandard = pytest.importorskip("zstandard")
    text = b64(zstandard.ZstdCompressor().compress(SECRET.encode() * 3))
    assert any(d > 0 for *_, d in X.find(text.encode())[0])


def test_spans_of_plain_escapes_are_exact():
    text = "x %70assword=hunter2hunter2 y"
    found = X.find(text.encode())[0]
    assert [(a, b) for a, b, k, d in found if d == 1] == [(2, 27)]


def test_clean_words_are_not_secrets():
    text = "A plain paragraph with internationalization, 100%25 effort, and caf%C3%A9. " * 50
    assert X.find(text.encode()) == ([], 0)


def test_layers_that_grow_nothing_end():
    assert X.find(("%25" * 200).encode())[0] == []
    assert X.find(("%" + "25" * 14).encode())[0] == []


def test_long_compressed_layers_map_to_their_wrapping():
    inner = "\\u0020 filler " * 20_000 + SECRET
    text = "x " + b64(gzip.compress(inner.encode())) + " y"
    found = X.find(text.encode())[0]
    assert {(a, b) for a, b, k, d in found if k == 0} == {(2, len(text) - 2)}


def test_a_layer_above_the_limit_stays_closed_and_is_counted():
    bomb = b64(gzip.compress(b"a" * 100_000))
    assert X.find(bomb.encode(), most=1000) == ([], 1)


def test_redaction_covers_whole_spans(spark):
    rows = [(1, f"a {SECRET} b", 1), (2, f"é {b64(SECRET.encode())} z", 1), (3, None, 1), (4, "", 1), (5, "clean", 1), (5, "clean", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, secrets int")
    found = [(r.doc_id, r.text) for r in X.redact(df.drop("secrets")).collect()]
    by_id = dict(found)
    assert by_id[1] == "a [SECRET] b" and by_id[3] is None and by_id[4] == "" and by_id[5] == "clean"
    assert "hunter2" not in X.find(by_id[2].encode()).__repr__() and "[SECRET]" in by_id[2]
    assert len(found) == 6
    assert X.find_secrets(df).columns == ["doc_id", "text", "secrets"]
    assert X.find_secrets(df.limit(0)).count() == 0


def test_redaction_of_many_secrets_and_a_clashing_column(spark):
    many = f"é {SECRET} " * 3000
    out = X.redact(spark.createDataFrame([(1, many, 7)], "doc_id long, text string, secrets int")).first()
    assert (out.text, out.secrets) == ("é [SECRET] " * 3000, 7)
    assert X.cover("aébcdef".encode(), [(1, 3), (2, 4), (4, 5)], "*").decode() == "a**ef"
    assert X.redact(spark.createDataFrame([], "text string")).count() == 0


def test_layers_of_any_size_are_scanned_in_windows(spark):
    filler = b"a plain line, and more of it.\n" * (5 << 20)  # 150 MB, beyond the former limit of 64 MiB
    bomb = b64(gzip.compress(filler + SECRET.encode() + b"\n" + filler[:3000], 1))
    found, unopened = X.find(bomb.encode())
    assert [(a, b, k) for a, b, k, _ in found] == [(0, len(bomb), 0)] and unopened == 0


@pytest.mark.parametrize("inner", [SECRET, b64(SECRET.encode()), b64(gzip.compress(SECRET.encode() * 9))])
def test_matches_across_windows_are_found(inner, monkeypatch):
    monkeypatch.setattr(X, "WINDOW", 50)
    for before in range(30, 60):
        text = b64(gzip.compress(b"x" * before + b", " + inner.encode() + b", end " * 30))
        assert any(k == 0 for _, _, k, _ in X.find(text.encode())[0]), before


def test_what_stays_unopened_is_shown(spark, monkeypatch):
    bomb = b64(gzip.compress(b"z" * 100_000))
    df = spark.createDataFrame([(1, f"a {bomb} b"), (2, "clean")], "doc_id long, text string")
    found = X.find_secrets(df, max_layer=1000, unopened_col="n").collect()
    assert sorted((r.doc_id, r.n) for r in found) == [(1, 1), (2, 0)]
    assert {r.text for r in X.redact(df, max_layer=1000).collect()} == {"a [SECRET] b", "clean"}
    nested = SECRET.encode()
    for _ in range(X.MAX_NESTED + 2):
        nested = gzip.compress(nested)
    assert X.find(b64(nested).encode())[1] == 1
    assert "n_unopened" in X.op10_secrets(spark, SF).columns


def _tar(data: bytes) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        head = tarfile.TarInfo("settings.ini")
        head.size = len(data)
        tar.addfile(head, io.BytesIO(data))
    return out.getvalue()


BINARY = {
    "tar": _tar(SECRET.encode()),
    "escape": gzip.compress(b"\x1b[31m" + SECRET.encode() + b"\x1b[0m"),
    "latin-1": gzip.compress("café ".encode("latin-1") + SECRET.encode()),
    "utf-16": gzip.compress(f"é {SECRET}".encode("utf-16")),
    "utf-16 big-endian": gzip.compress(f"é {SECRET}".encode("utf-16-be")),
    "plain latin-1": "café ".encode("latin-1") + SECRET.encode(),
    "plain utf-16": SECRET.encode("utf-16-le"),
    "nested in binary": gzip.compress(b"\xff\x00" + b64(gzip.compress(SECRET.encode())).encode() + b"\x00\x01"),
}


@pytest.mark.parametrize("name", BINARY)
def test_layers_that_are_not_clean_text_are_scanned(name):
    text = f"see {b64(BINARY[name])} end"
    spans = [(a, b) for a, b, k, d in X.find(text.encode())[0] if k == 0 and d > 0]
    assert spans and all(4 <= a < b <= len(text) - 4 for a, b in spans)


def lines(data: bytes, width: int, end: str, before: str = "") -> str:
    word = b64(data)
    return before + end.join(word[i : i + width] for i in range(0, len(word), width))


@pytest.mark.parametrize("end", ["\n", "\r\n", "\n  ", "\\n", "\n> "])
@pytest.mark.parametrize("width", [64, 70, 76])
def test_wrapped_base64_is_joined(width, end):
    noise = hashlib.sha512(b"1").hexdigest().encode().upper() * 3  # does not shrink to a line
    for data in (b"x" * 39 + b" " + SECRET.encode() + b" " + b"y" * 90, gzip.compress(noise + b"\n" + SECRET.encode()), bz2.compress(noise + b"\n" + SECRET.encode())):
        for before in ("", "-----BEGIN DATA-----\n", "see https://example.org/" + "longpath" * 15 + "\n", "internationalization\n", "key: "):
            text = lines(data, width, end, before) + "\n-----END DATA-----\n"
            found = [(a, b) for a, b, k, d in X.find(text.encode())[0] if k == 0 and d > 0]
            assert found and max(b for _, b in found) <= len(text) - 1, (before, data[:4])
            if data[:1] != b"x":
                assert max(b for _, b in found) >= len(lines(data, width, end, before))
            else:  # the whole secret, not what one line holds of it
                assert max(b - a for a, b in found) >= len(b64(SECRET.encode())) - 3


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress, zlib.compress])
def test_all_members_are_scanned(pack):
    for padding in (b"", b"\0" * 8):
        text = b64(pack(b"first member, " * 9) + padding + pack(b"second ") + pack(SECRET.encode()))
        assert [(a, b) for a, b, k, _ in X.find(text.encode())[0] if k == 0] == [(0, len(text))]


@pytest.mark.parametrize("before", ["id/", "x/y/z/", "a", "ab", "abc", "data+", "0123456789_", "path-to/"])
@pytest.mark.parametrize("data", [SECRET.encode(), gzip.compress(b"first, " * 9 + SECRET.encode()), bz2.compress(b"first, " * 9 + SECRET.encode())])
def test_encoded_parts_inside_longer_words_are_found(before, data):
    text = f"see {before}{b64(data)} end"
    assert any(k == 0 and d > 0 for _, _, k, d in X.find(text.encode())[0])


def test_escapes_that_are_escaped_very_many_times_take_time_in_proportion():
    text = "token" + "%" + "25" * 200_000 + "3dhunter2hunter2"
    began = time.process_time()
    found = X.find(text.encode())[0]
    assert (0, len(text), 0) in [(a, b, k) for a, b, k, _ in found]
    assert time.process_time() - began < 30


def test_mixed_escapes_are_decoded_to_the_end():
    text = SECRET
    for i in range(14):
        text = (f"%{ord(text[0]):02x}" if i % 2 else f"\\u{ord(text[0]):04x}") + text[1:]
    found = X.find(f"é {text} z".encode())[0]
    assert [(a, b) for a, b, k, _ in found if k == 0][-1] == (2, 2 + len(text))


def test_long_texts_with_few_escapes_take_little_memory():
    text = "lorem ipsum dolor, " * 100_000 + "%70assword=hunter2hunter2" + " end" * 100_000
    tracemalloc.start()
    found = X.find(text.encode())[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(a, b, k) for a, b, k, _ in found] == [(1_900_000, 1_900_025, 0)] and most < 8 * len(text)


def brute_once(text: str) -> tuple[str, list[tuple[int, int]]]:
    """One step of decoding, character by character, and the stretch each character came from."""
    out, places, at = "", [], 0
    while at < len(text):
        if m := re.compile("%([0-7][0-9A-Fa-f])").match(text, at) or re.compile("&#x([0-7]?[0-9a-f]);").match(text, at):
            out, at = out + chr(int(m[1], 16)), m.end()
            places.append(m.span())
        else:
            out, at = out + text[at], at + 1
            places.append((at - 1, at))
    return out, places


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "=", "%3D", "%74", "&#x74;", "oken", "AKIA", "%41", "ABCDEFGH", "&#x41;", "12345678", " ", "é", "%253D", "%2541", "&#x25;41", "%26#x41;", "0123456789abcdef"]), max_size=14))
def test_decoded_spans_equal_brute_force(parts):
    text = "".join(parts)
    want, layer, places = set(), text, [(i, i + 1) for i in range(len(text))]
    for _ in range(6):
        for a, k, b in brute_base(layer):
            want.add((places[a][0], places[b - 1][1], X.KINDS.index(k)))
        layer, made = brute_once(layer)
        places = [(places[a][0], places[b - 1][1]) for a, b in made]
    assert {(a, b, k) for a, b, k, _ in X.find(text.encode())[0]} == want
