import hashlib

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from findmill.llm import bpe_codec as B

SF = "/root/testdata/sf0.001"
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab 1\n\t\x0b\x85　é'.!漢👍", max_size=200), st.integers(1, 30))
def test_slices_give_the_ids_of_the_whole_text(text, size):
    codec = B.encoding(RANKS, P.PATTERN)
    assert B.encode_text(codec, text, size) == codec.encode_ordinary(text)


@pytest.mark.parametrize("run", [" " * 9000, "\n" * 5000 + " " * 5000, "　" * 6000])
@pytest.mark.parametrize("after", ["b", "", "."])
def test_long_runs_of_white_space(run, after):
    codec = B.encoding(RANKS, P.PATTERN)
    text = "a" * 20 + run + after + " end" * 3
    assert B.encode_text(codec, text, 100) == codec.encode_ordinary(text)


def test_query_equals_the_library(spark):
    codec = B.encoding(RANKS, P.PATTERN)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = B.op1_bpe(spark, SF).collect()
    assert len(found) == len(docs)
    for row in found:
        ids = codec.encode_ordinary(docs[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(docs[row.doc_id].encode()).hexdigest()


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, "x"), (1, None, "x"), (2, "", None), (None, "👍 naïve", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = B.decode(B.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert coded.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted(bytes(r.decoded) for r in coded.collect()) == [b"", b"", b"", "👍 naïve".encode()]


def test_tokens_that_split_characters_decode_as_bytes(spark):
    codec = B.encoding(RANKS, P.PATTERN)
    first = codec.encode_single_token("漢".encode()[:1])
    df = spark.createDataFrame([([first],), (None,), ([],)], "ids array<int>")
    found = [bytes(r.decoded) for r in B.decode(df, RANKS, P.PATTERN).collect()]
    assert sorted(found) == [b"", b"", "漢".encode()[:1]]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert B.encode(df, RANKS, P.PATTERN).count() == 0
