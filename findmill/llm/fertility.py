"""Quality rules from tokeniser fertility.

Public vocabularies are run over every whole text: a SentencePiece vocabulary with byte fallback, and a
byte-level one for many languages. Text that is far from the language it claims to be falls into short
tokens, raw bytes (of the byte-level vocabulary: tokens that are parts of characters), or very few different tokens. Each
language has a band for characters a token, byte share and token entropy under each vocabulary; a text
outside any band is rejected. A language without bands of its own is judged by the bands of the script that
most of its letters have.

A base rule comes first: too few words, or most of the text inside 3-word windows that repeat. What fails it
is not tokenised, and its measures are null.

Bands are fixed parameters, so a document's verdict depends on that document alone and nothing has to be
gathered from the corpus: one narrow pass without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findmill.llm.bpe_codec import encode_text, encoding
from findmill.llm.common import arrow_map, read_table, utf8

MIN_WORDS = 50
#: Characters that go to the SentencePiece library at a time: its time for a whole text is a quarter more.
SLICE = 1 << 10
SYMBOLS = b"#*$%&|<>"


class Band(NamedTuple):
    """What a text may have under one vocabulary: characters a token, byte share, bits of entropy."""

    chars_low: float
    chars_high: float
    bytes_high: float
    entropy_low: float


#: For each language the bands of the vocabulary with byte fallback and of the byte-level one: what the good labelled
#: texts with an even id have, with 5 % fewer characters a token, a share of bytes 0.05 higher and 0.2 bits less.
LANGUAGE_BANDS = {
    "en": (Band(1.76, 8.0, 0.085, 5.36), Band(1.89, 9.0, 0.05, 5.35)),
    "de": (Band(1.94, 9.0, 0.077, 5.60), Band(2.05, 10.0, 0.083, 5.65)),
    "fr": (Band(1.62, 8.0, 0.094, 5.54), Band(1.74, 9.0, 0.063, 5.54)),
    "es": (Band(1.71, 8.0, 0.074, 5.65), Band(1.80, 9.0, 0.071, 5.56)),
}
SCRIPT_BANDS = {
    "LATIN": (Band(1.40, 9.0, 0.15, 5.0), Band(1.50, 10.0, 0.50, 5.0)),
    "CYRILLIC": (Band(1.20, 8.0, 0.15, 5.0), Band(0.80, 10.0, 0.60, 5.0)),
    "GREEK": (Band(0.80, 8.0, 0.30, 4.5), Band(0.60, 10.0, 0.80, 4.5)),
}
#: Scripts without spaces between words, or mostly outside the vocabularies: only a floor under entropy.
OTHER_BAND = (Band(0.20, 9.0, 1.0, 3.5), Band(0.20, 12.0, 1.0, 3.5))


@lru_cache(maxsize=2)
def _vocabulary(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, np.fromiter(map(model.is_byte, range(model.get_piece_size())), bool)


def _script(text: str) -> str:
    """The script of most letters, by the first word of their names; '' without letters."""
    letters = Counter(filter(str.isalpha, text))
    scripts: Counter = Counter()
    for letter, n in letters.items():
        scripts[unicodedata.name(letter, "").partition(" ")[0]] += n
    return min(scripts, key=lambda s: (-scripts[s], s), default="")


def bands_of(lang: str | None, text: str) -> tuple[Band, Band]:
    if lang in LANGUAGE_BANDS:
        return LANGUAGE_BANDS[lang]
    return SCRIPT_BANDS.get(_script(text), OTHER_BAND)


def _repeated(ids: np.ndarray) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(ids) - 2
    if n < 2:
        return 0
    size = int(ids.max()) + 1
    pair = ids[:-1] * size + ids[1:]
    if size >= 1 << 21:  # three words do not fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    windows = pair[:-1] * size + ids[2:]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(windows, twice))
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[starts + k] = True
    return int(covered.sum())


def base_measures(raw: bytes, n_chars: int) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; bytes.split() knows ASCII space only."""
    words = raw.split()
    white = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), n_chars - white, symbols, len(lines) - len(set(lines)), _repeated(ids)


#: A space between ASCII words: the model starts every text as if a space came before it, so what follows can go alone.
_CUT = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


def _parts(text: str, size: int) -> Iterator[str]:
    start = 0
    while len(text) - start > size and (cut := _CUT.search(text, start + size)):
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:]


class Measured(NamedTuple):
    tokens: int
    chars_per_token: float
    byte_share: float
    entropy: float

    def within(self, band: Band) -> bool:
        return band.chars_low <= self.chars_per_token <= band.chars_high and self.byte_share <= band.bytes_high and self.entropy >= band.entropy_low


def _measured(ids: np.ndarray, is_byte: np.ndarray, chars: int) -> Measured:
    n = len(ids)
    if not n:
        return Measured(0, 0.0, 0.0, 0.0)
    # By sorting: a text has few tokens beside the vocabulary, whose size counting by place would cost each text.
    ids = np.sort(ids)
    share = np.diff(np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]]))) / n
    return Measured(n, chars / n, float(np.count_nonzero(is_byte[ids]) / n), float(-(share * np.log2(share)).sum()))


def piece_fertility(path: str, text: str, chars: int, size: int = SLICE) -> Measured:
    """By the SentencePiece vocabulary at ``path``; long texts are cut where the ids stay those of the whole text."""
    model, is_byte = _vocabulary(path)
    found = [np.array(model.encode(part, num_threads=1), np.int32) for part in _parts(text, size)]
    return _measured(np.concatenate(found), is_byte, chars)


def byte_fertility(rank_file: str, pattern: str, text: str, chars: int) -> Measured:
    """By the byte-level ranks in ``rank_file``; bytes are tokens that are not whole characters."""
    codec = encoding(rank_file, pattern)
    return _measured(np.array(encode_text(codec, text), np.int32), _parts_of_characters(rank_file, pattern), chars)


@lru_cache(maxsize=2)
def _parts_of_characters(rank_file: str, pattern: str) -> np.ndarray:
    """Of each token whether its bytes are not characters by themselves."""
    codec = encoding(rank_file, pattern)
    parts = np.zeros(codec.n_vocab, bool)
    for token in codec.token_byte_values():
        parts[codec.encode_single_token(token)] = token.decode("utf-8", "ignore").encode() != token
    return parts


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
TOKENS = ("n_tokens", "chars_per_token", "byte_share", "token_entropy")
MEASURES = {
    **dict.fromkeys(BASE, "long"), **dict(zip(TOKENS, ("long", "double", "double", "double"))),
    **{f"bytes_{name}": kind for name, kind in zip(TOKENS, ("long", "double", "double", "double"))},
    "base_failed": "boolean", "kept": "boolean",
}


def measure(
    df: DataFrame, vocabulary: str, ranks: str | None = None, pattern: str | None = None, text_col: str = "text", lang_col: str | None = "lang"
) -> DataFrame:
    """``df`` with the columns of ``MEASURES``, which replace columns of those names.

    ``vocabulary`` is a SentencePiece model with byte fallback, ``ranks`` a file of byte-level ranks that goes
    with ``pattern``; without it the columns ``bytes_*`` are null and its bands do not count. Null and empty
    texts have no words and fail the base rule. Repeated rows stay, each with the same verdict. A null or
    unknown language is judged by script.
    """
    keep = [c for c in df.columns if c not in MEASURES]
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    given = df.select(*keep, utf8(F.col(text_col)).alias("_raw"), lang.alias("_lang"))

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for value, lang in zip(batch.column(len(keep)), batch.column(len(keep) + 1)):
            raw = value.as_py()
            text = raw.decode("utf-8", "replace")
            words, chars, *rest = base_measures(raw, len(text))
            failed = words < MIN_WORDS or 100 * rest[-1] > 50 * words
            none = (None,) * len(TOKENS)
            pieces, single, kept = none, none, False
            if not failed:
                bands = bands_of(lang.as_py(), text)
                pieces = piece_fertility(vocabulary, text, chars)
                kept = pieces.within(bands[0])
                if ranks is not None:
                    single = byte_fertility(ranks, pattern, text, chars)
                    kept = kept and single.within(bands[1])
            rows.append((words, chars, *rest, *pieces, *single, failed, kept))
        kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
        made = [pa.array(x, kinds[k]) for x, k in zip(zip(*rows), MEASURES.values())]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], [*keep, *MEASURES])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep]
    return arrow_map(given, ", ".join([*schema, *(f"{n} {k}" for n, k in MEASURES.items())]), per_batch)


def op3_fertility(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = measure(documents, P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    return found.select("doc_id", *MEASURES)
