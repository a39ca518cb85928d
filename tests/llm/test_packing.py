import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from findmill.llm import spfhp as K

SF = "/root/testdata/sf0.001"
VOCABULARY = P.path("word_bpe_49k.json")


LIBRARY = Tokenizer.from_file(VOCABULARY)


def library_ids(text: str) -> list[int]:
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aBz é'ß.9\n\x00\x1c\x85\xa0İſk漢́<|>!", max_size=40))
def test_word_ids_equal_the_library(text):
    found = np.frombuffer(K._words(VOCABULARY).encode(text.encode()), "<u4").tolist()
    assert found == library_ids(text)


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "A<|endoftext|>É", "<|EndOfText|> <|endoftext |>", "<|endoftext|>" * 3])
def test_special_tokens_in_a_text_are_as_the_library_has_them(text):
    assert np.frombuffer(K._words(VOCABULARY).encode(text.encode()), "<u4").tolist() == library_ids(text)


def test_a_vocabulary_that_splits_in_another_way_is_refused():
    with pytest.raises(ValueError):
        K.WordIds(P.path("byte_bpe_50k.json"))


def test_a_new_word_takes_few_steps():
    """A search for special tokens is one call, however many there are."""
    words, calls = K.WordIds(VOCABULARY), Counter()
    text = " ".join("".join(chr(97 + (i * k) % 26) for k in (1, 3, 7, 11)) + "q" * (i // 26) for i in range(300)).encode()
    new = len(set(text.split()))
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        words.encode(text)
    finally:
        sys.setprofile(None)
    assert calls["call"] <= 3 * new + 10


def test_small_caches_give_the_same_ids():
    words = K.WordIds(VOCABULARY, most=3)
    text = "one two three four five one two six seven one"
    assert np.frombuffer(words.encode(text.encode()), "<u4").tolist() == library_ids(text)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 50), max_size=12))
def test_patterns_use_every_piece_once(histogram):
    patterns = K.pack_histogram(histogram, 32)
    used = Counter()
    for contents, copies in patterns:
        assert copies > 0 and sum(contents) <= 32
        for length in contents:
            used[length] += copies
    assert used == Counter(histogram)


def test_padding_is_small():
    rng = np.random.default_rng(1)
    histogram = Counter(np.clip(rng.lognormal(6, 1, 20000), 1, 4096).astype(int).tolist())
    patterns = K.pack_histogram(histogram, 4096)
    tokens = sum(k * n for k, n in histogram.items())
    assert sum(n for _, n in patterns) <= 1.01 * -(-tokens // 4096) + 1


def check(rows, docs: dict[int, list[list[int]]], size: int = 4096) -> None:
    """Pieces cover every document once; sequences have no gaps and no overlaps."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(docs)
    for doc, found in pieces.items():
        want = []
        for ids in docs[doc]:
            for at in range(0, len(ids), size):
                part = np.array(ids[at : at + size], "<u4")
                want.append((at, len(part), zlib.crc32(part.tobytes()), len(ids)))
        assert sorted(found) == sorted(want)
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= size


def test_query_equals_the_library(spark):
    docs = {r.doc_id: [library_ids(r.text or "") + [2]] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = K.op8_spfhp(spark, SF).collect()
    check(rows, docs)
    tokens = sum(len(x) for ids in docs.values() for x in ids)
    assert len({r.sequence_id for r in rows}) <= -(-tokens // 4096) * 1.05 + 1


def test_nulls_repeats_and_empty_tables(spark):
    text = "word " * 5000
    rows = [(1, None, 0), (2, "", 0), (3, text, 0), (3, text, 0), (4, "same", 0), (5, "same", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    cut = K.pieces(df, VOCABULARY).withColumn("ids_crc32", K.F.crc32("ids")).drop("ids")
    docs = defaultdict(list)
    for i, t, _ in rows:
        docs[i].append(library_ids(t or "") + [2])
    check(K.pack(cut).collect(), docs)
    assert K.pack(K.pieces(df.limit(0), VOCABULARY)).count() == 0


def test_one_common_length_is_spread_and_ranked_without_gaps(spark):
    df = spark.range(5000).select(K.F.col("id").alias("doc_id"), K.F.lit(0).cast("long").alias("start"), K.F.lit(1000).cast("long").alias("length"))
    rows = K.pack(df, bucket_rows=50).collect()
    count = Counter(r.sequence_id for r in rows)
    assert set(count.values()) == {4} and len(count) == 1250
    assert len({(r.sequence_id, r.offset) for r in rows}) == 5000


@pytest.mark.parametrize("packed", [K.op8_spfhp, lambda spark, _: corpus_pipeline.packing(spark, K.read_table(spark, "", "documents"), "")])
def test_texts_come_to_python_in_small_batches(spark, monkeypatch, packed):
    """Forty texts of a megabyte: a task is given a few of them at a time."""

    def rows_of_batches(df, vocabulary):
        def run(batches):
            for b in batches:
                one = [pa.array(x, pa.int64()) for x in ([0] * b.num_rows, [1] * b.num_rows)]
                yield pa.RecordBatch.from_arrays([b.column(0), *one, pa.array([b""] * b.num_rows), pa.array([b.num_rows] * b.num_rows)], names)

        names = ["doc_id", "start", "length", "ids", "doc_tokens"]
        return df.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long")

    texts = spark.range(0, 40, 1, 1).select(K.F.col("id").alias("doc_id"), K.F.repeat(K.F.lit("x"), K.F.lit(1 << 20)).alias("text"))
    monkeypatch.setattr(K, "read_table", lambda *_: texts)
    monkeypatch.setattr(K, "pieces", rows_of_batches)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    found = [r.doc_tokens for r in packed(spark, "").collect()]
    assert len(found) == 40 and max(found) <= 8
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
