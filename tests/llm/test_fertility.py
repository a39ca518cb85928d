import base64
import math
import random
import re
import tracemalloc
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from findmill.llm import fertility as Q

SF = "/root/testdata/sf0.001"
MODEL = P.path("piece_bpe_32k.model")


def brute_base(text: str) -> tuple[int, int, int, int, int]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é\n\t\x0b\x1c　#|", max_size=120))
def test_base_measures_equal_brute_force(text):
    assert Q.base_measures(text.encode(), len(text)) == brute_base(text)


RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def brute_measures(ids: list[int], single: set[int], chars: int) -> tuple[int, float, float, float]:
    counts = Counter(ids)
    entropy = sum(-n / len(ids) * math.log2(n / len(ids)) for n in counts.values())
    return len(ids), chars / len(ids), sum(i in single for i in ids) / len(ids), entropy


def whole(token: bytes) -> bool:
    try:
        return bool(token.decode())
    except UnicodeDecodeError:
        return False


def brute_verdicts(docs: list[tuple]) -> dict:
    """doc_id to (base failed, kept, measures under both vocabularies), by the libraries on whole texts."""
    pieces = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    raw = {i for i in range(pieces.get_piece_size()) if pieces.is_byte(i)}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    codec = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bytes_ = {i for token, i in ranks.items() if not whole(token)}
    out = {}
    for doc_id, text, lang in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = Counter(zip(words, words[1:], words[2:]))
        again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        failed = len(words) < 50 or 2 * len(again) > len(words)
        if failed:
            out[doc_id] = (True, False, None, None)
            continue
        chars = sum(map(len, words))
        both = brute_measures(pieces.encode(text), raw, chars), brute_measures(codec.encode_ordinary(text), bytes_, chars)
        bands = Q.LANGUAGE_BANDS[lang] if lang in Q.LANGUAGE_BANDS else Q.SCRIPT_BANDS["LATIN"]
        kept = all(b.chars_low <= m[1] <= b.chars_high and m[2] <= b.bytes_high and m[3] >= b.entropy_low for m, b in zip(both, bands))
        out[doc_id] = (False, kept, *both)
    return out


def test_query_over_the_table(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = Q.op3_fertility(spark, SF).collect()
    assert len(found) == len(docs)
    want = brute_verdicts([(r.doc_id, r.text, r.lang) for r in docs.values()])
    for row in found:
        text = docs[row.doc_id].text or ""
        if len(text) < 20_000:
            base = brute_base(text)
            assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == base
        failed, kept, *both = want[row.doc_id]
        assert (row.base_failed, row.kept) == (failed, kept)
        for names, measures in zip(([*Q.TOKENS], [f"bytes_{x}" for x in Q.TOKENS]), both):
            assert [row[x] for x in names] == ([None] * 4 if measures is None else pytest.approx(list(measures)))
    assert 0 < sum(not r.base_failed and not r.kept for r in found) < len(found) / 4


def test_measures_of_long_texts_are_those_of_the_whole_text():
    rng = random.Random(5)
    text = "".join(rng.choice(["word", " ", "  ", "\n", "été ", "x1 ", "漢字", ". ", " 'tis ", "\u00a0", "y "]) for _ in range(30_000))
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for size in (50, 1000, 1 << 16):
        found = Q.piece_fertility(MODEL, text, 1, size)
        assert found.tokens == len(model.encode(text))
        assert found == pytest.approx(Q.piece_fertility(MODEL, text, 1, 1 << 30))


def test_a_text_costs_its_own_tokens_not_the_vocabulary():
    """A short text beside vocabularies of 32,000 and 50,000 tokens."""
    text, ranks = prose("one two three four five six seven eight nine ten"), P.path("byte_bpe_multi_50k.tiktoken")
    measures = (lambda: Q.piece_fertility(MODEL, text, len(text))), (lambda: Q.byte_fertility(ranks, P.PATTERN, text, len(text)))
    for measure in measures:
        measure()
        tracemalloc.start()
        measure()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 64_000


def prose(words: str, n: int = 90) -> str:
    """Words in an order without repeated windows."""
    w = words.split()
    return " ".join(w[(i * i + i // 7) % len(w)] for i in range(n))


ENGLISH = "the river was high and we could not cross before evening so our guide made a fire under some old trees while others looked for water"


def test_bands_reject_junk_and_keep_prose(spark):
    keyboard = " ".join(chr(0x4E00 + 37 * i % 9000) * 6 for i in range(80))
    repeated = "buy this now " * 60
    rows = [
        (1, prose(ENGLISH), "en"), (2, prose(ENGLISH), None), (3, keyboard, "en"), (4, repeated, "en"),
        (5, " ".join(f"xq{i}zv{i * i}kk" for i in range(80)), "de"), (6, "too short", "en"), (7, "", "en"), (8, None, None),
    ]
    found = Q.measure(spark.createDataFrame(rows, "doc_id long, text string, lang string"), MODEL, RANKS, P.PATTERN)
    kept = {r.doc_id: (r.base_failed, r.kept) for r in found.collect()}
    assert kept[3] == (False, False)
    assert kept[5] == (False, False)
    for i in (4, 6, 7, 8):
        assert kept[i] == (True, False)
    assert kept[1][0] == kept[2][0]


def test_bytes_are_parts_of_characters_not_short_tokens():
    assert Q.byte_fertility(RANKS, P.PATTERN, "a , b ; c . d", 7).byte_share == 0
    rare = Q.byte_fertility(RANKS, P.PATTERN, "\U00012000\U00012001\U00012002", 3)
    assert rare.byte_share == 1 and rare.tokens > 3
    assert Q.byte_fertility(RANKS, P.PATTERN, "one two \U00012000", 7).byte_share < 1


def test_bands_hold_on_the_half_of_the_labels_they_were_not_set_on(spark):
    """Bands come from the good texts with an even id; of those with an odd one none goes, of the bad ones most do."""
    big = SF.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{big}/labels.parquet").where("doc_id % 2 = 1")
    found = Q.op3_fertility(spark, big).where("NOT base_failed").join(labels, "doc_id").select("quality", "kept").collect()
    good, bad = ([r.kept for r in found if r.quality == q] for q in (1, 0))
    assert len(good) > 50 and all(good)
    assert bad and sum(bad) <= len(bad) / 2


def test_script_decides_where_the_language_is_unknown():
    assert Q.bands_of("xx", "Привет, мир") is Q.SCRIPT_BANDS["CYRILLIC"]
    assert Q.bands_of(None, "hello") is Q.SCRIPT_BANDS["LATIN"]
    assert Q.bands_of(None, "漢字") is Q.OTHER_BAND
    assert Q.bands_of(None, "12 34") is Q.OTHER_BAND
    assert Q.bands_of("en", "Привет") is Q.LANGUAGE_BANDS["en"]


def test_extra_columns_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b", "en", 7), (1, "a b", "en", 7)], "doc_id long, text string, lang string, kept int")
    found = Q.measure(df, MODEL)
    assert found.columns == ["doc_id", "text", "lang", *Q.MEASURES]
    assert [r.kept for r in found.collect()] == [False, False]
    assert Q.measure(df.limit(0), MODEL).count() == 0
    assert Q.measure(df.drop("lang"), MODEL, lang_col=None).count() == 2
