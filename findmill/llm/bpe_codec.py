"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

A text is split by the pattern, and the bytes of each match are merged by rank. Very long texts are cut
before they reach the library, so that no single call holds more than about ``SLICE`` characters and the
matcher never runs over a huge stretch of white space. Cuts fall only where every match ends anyway:

* between a character that is not white space and one that is: no match spans that place, and no match
  looks back across it;
* before the last character of a run of white space that a visible character follows: the pattern gives
  all but that character to one match (the run up to there is then encoded as one piece by itself).

Decoding joins the raw bytes of the tokens, so a document whose tokens split characters comes back whole.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findmill.llm.common import arrow_map, read_table

SLICE = 1 << 16
#: The characters that \s means in the library's regular expressions.
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_BOUNDARY = re.compile(f"(?<=[^{SPACES}])(?=[{SPACES}])")
_SPACE_RUN = re.compile(f"[{SPACES}]{{{SLICE // 16},}}")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file (a base64 token and its rank a line), without special tokens."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(rank_file, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _slices(text: str, size: int):
    """Cut at safe boundaries, at most one slice longer than ``size`` for each stretch without any."""
    start = 0
    while len(text) - start > size:
        cut = _BOUNDARY.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(codec: tiktoken.Encoding, text: str, size: int = SLICE) -> list[int]:
    """The ids of ``encode_ordinary`` over the whole text, made from slices cut at safe boundaries."""
    if len(text) <= size:
        return codec.encode_ordinary(text)
    ids: list[int] = []
    for part in _slices(text, size):
        at = 0
        for run in _SPACE_RUN.finditer(part):
            # A run at the end of the text is one match; else its last character belongs to what follows.
            end = run.end() if run.end() == len(part) else run.end() - 1
            ids += codec.encode_ordinary(part[at : run.start()])
            ids += codec._encode_single_piece(part[run.start() : end])
            at = end
        ids += codec.encode_ordinary(part[at:])
    return ids


def _column_of_ids(found: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(found) + 1, np.int64)
    np.cumsum([len(x) for x in found], out=offsets[1:])
    flat = np.concatenate(found) if found else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))


def encode(df: DataFrame, rank_file: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with ``ids_col``, the token ids of each whole text (null text: no ids).

    ``ids_col`` replaces a column of that name; all other columns and repeated rows stay as they are.
    One narrow pass: no shuffle, and a task holds one Arrow batch.
    """
    keep = [c for c in df.columns if c != ids_col]
    given = df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_bpe_text"))

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = encoding(rank_file, pattern)
        ids = _column_of_ids([np.array(encode_text(codec, t.as_py()), np.int32) for t in batch.column(len(keep))])
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], ids], [*keep, ids_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep)
    return arrow_map(given, f"{schema}, `{ids_col}` array<int>", per_batch)


def decode(df: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with ``bytes_col``, the raw bytes of the ids (null ids: no bytes; an unknown id is an error)."""
    keep = [c for c in df.columns if c != bytes_col]
    at = keep.index(ids_col)

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = encoding(rank_file, pattern)
        ids = batch.column(at)
        flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
        raw = [codec.decode_bytes(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], [*keep, bytes_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep)
    return arrow_map(df.select(*keep), f"{schema}, `{bytes_col}` binary", per_batch)


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    rank_file = P.path("byte_bpe_multi_50k.tiktoken")
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = encode(documents, rank_file, P.PATTERN).select("doc_id", "ids")
    both = decode(ids, rank_file, P.PATTERN)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
