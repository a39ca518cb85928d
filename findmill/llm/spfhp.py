"""Sequence packing: shortest-pack-first over the length histogram.

1. Tokenise every document once; cut documents longer than a sequence into full sequences and a rest.
2. Count pieces per length: the histogram has at most ``size`` bins however large the corpus.
3. On the driver, from that histogram alone, place lengths longest first, each into the pack with the most
   room left (the shortest pack), counting packs with equal contents as one pattern.
4. Rank the pieces of each length and look up pattern, copy and slot of each rank in a table of the
   patterns, which is bounded by ``size`` as well.

Ranks come from counts per (length, bucket) and a window inside each bucket, so that one very common
length is spread over many tasks. The number of buckets grows with the pieces; their first ranks are
summed and joined in Spark, and only the totals per length reach the driver.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findmill.llm.common import arrow_map, read_table, written
from findmill.sources.store import small_batches

SEQUENCE = 4096
END_ID = 2
BUCKETS = 64
BUCKET_ROWS = 1_000_000
CACHE_WORDS = 200_000


#: The vocabulary's split pattern, written out for Latin words (white space there can only be
#: U+0085 and U+00A0) and for words of lower-case ASCII.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\x85\xa0\p{L}\p{N}]+")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPLIT_ASCII = re.compile(rb"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^a-z0-9]+")
#: Below this character every text is in composed form already and lower-cased character by character.
_LATIN_END = "\u0250"


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Recent(dict):
    """A bounded cache: when it is full it becomes the old generation, from which hits are taken over."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordIds:
    """Ids of texts, as little-endian unsigned 32-bit bytes, from a bounded cache of words.

    The vocabulary normalises character by character, and no match of its pattern spans white space; so
    the ids of a text are the ids of its words (maximal runs without ASCII white space) in their order.
    A new word of Latin letters is split here into its parts, which are words of the cache themselves;
    only a word that is its own single part goes to the library's merges. Any other new word goes
    through the whole library, and so does one that may hold a special token. What a special token's string
    becomes is the library's choice: its id, as by default. A vocabulary with other steps is refused.
    """

    def __init__(self, path: str, most: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        steps = json.loads(self.tokenizer.to_str())
        split, letters = (steps["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}])[:2]
        made = (
            [x.get("type") for x in (steps["normalizer"] or {}).get("normalizers", [])], split.get("pattern", {}).get("Regex"), split.get("invert"),
            split.get("behavior"), letters.get("type"), letters.get("add_prefix_space"), steps["model"].get("end_of_word_suffix"),
        )
        if made != (["NFC", "Replace", "Lowercase"], _PATTERN, True, "Removed", "ByteLevel", False, "</w>"):
            raise ValueError(f"{path} normalises or splits texts in another way")
        special = [re.escape(x["content"].encode()) for x in steps["added_tokens"]]
        self.special = re.compile(b"|".join(special) or rb"(?!)").search
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.words = Recent(self._word, most)

    def _part(self, part: bytes) -> bytes:
        text = part.decode()
        if not (text.isascii() and text.isprintable()):
            text = part.decode("latin-1").translate(self.letters)
        # The machine's own order, which is little-endian wherever Spark runs here.
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def _whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _word(self, word: bytes) -> bytes:
        if self.special(word):
            return self._whole(word.decode("utf-8", "replace"))
        if word.isascii():
            lower = word.lower()
            if lower.isalpha():
                return self._part(word) if lower == word else self.words[lower]
            split = _SPLIT_ASCII.findall(lower)
        else:
            given = word.decode("utf-8", "replace")
            lower = given.lower()
            if max(lower) >= _LATIN_END:
                return self._whole(given)
            split = [x.encode() for x in _SPLIT.findall(lower)]
        if split == [word]:
            return self._part(word)
        return b"".join([self.words[x] for x in split])

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, text.split()))


@lru_cache(maxsize=2)
def _words(path: str) -> WordIds:
    return WordIds(path)


def pieces(
    df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, end_id: int = END_ID
) -> DataFrame:
    """(``id_col``, start, length, ids, doc_tokens): the pieces of each document's ids and the end id.

    ``ids`` is binary, little-endian unsigned 32-bit. A null or empty text is the end id alone. Every
    piece but a document's last has ``size`` ids.
    """

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        end = np.array([end_id], "<u4").tobytes()
        row, start, length, ids, total = [], [], [], [], []
        for i, value in enumerate(batch.column(1)):
            found = _words(vocabulary).encode(value.as_py()) + end
            n = len(found) // 4
            for at in range(0, n, size):
                row.append(i)
                start.append(at)
                length.append(min(size, n - at))
                ids.append(found[4 * at : 4 * (at + size)])
                total.append(n)
        columns = [pa.array(x, pa.int64()) for x in (start, length)] + [pa.array(ids, pa.binary()), pa.array(total, pa.int64())]
        names = [id_col, "start", "length", "ids", "doc_tokens"]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int32())), *columns], names)

    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("raw")
    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(id_col, text), f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long", per_batch)


def stored_pieces(df: DataFrame, vocabulary: str) -> DataFrame:
    """The pieces of ``documents``, a checksum in place of their ids, as a stored table; texts come to tasks 4 MB at a time."""
    cut = pieces(df, vocabulary)
    with small_batches(df.sparkSession):
        return written(cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"), "pieces")


class Pattern(NamedTuple):
    lengths: tuple[int, ...]
    copies: int


def pack_histogram(histogram: dict[int, int], size: int) -> list[Pattern]:
    """Shortest-pack-first: patterns and their counts for {length: pieces}.

    Lengths go longest first into the packs with the most room; equal packs are one entry, so a length
    costs as many steps as it meets different packs. A pack that the length no longer fits is final for
    it, but stays open for the shorter lengths that follow.
    """
    open_by_room: dict[int, list[list]] = {}  # room -> [lengths, copies]
    done: list[Pattern] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            room = max(open_by_room, default=-1)
            if room < length:
                fresh = size // length
                if left >= fresh:
                    contents, copies = (length,) * fresh, left // fresh
                else:
                    contents, copies = (length,) * left, 1
                left -= len(contents) * copies
                _add(open_by_room, done, size - length * len(contents), contents, copies)
                continue
            entries = open_by_room[room]
            contents, copies = entries.pop()
            if not entries:
                del open_by_room[room]
            use = min(copies, left)
            if copies > use:
                _add(open_by_room, done, room, contents, copies - use)
            _add(open_by_room, done, room - length, (*contents, length), use)
            left -= use
    done += [Pattern(c, n) for entries in open_by_room.values() for c, n in entries]
    return done


def _add(open_by_room: dict, done: list[Pattern], room: int, contents: tuple[int, ...], copies: int) -> None:
    if room == 0:
        done.append(Pattern(contents, copies))
    else:
        open_by_room.setdefault(room, []).append([contents, copies])


def _places(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, pieces a sequence, first sequence, first offset), ranks rising."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for contents, copies in patterns:
        offset = 0
        at = 0
        while at < len(contents):
            length = contents[at]
            times = 1
            while at + times < len(contents) and contents[at + times] == length:
                times += 1
            rank = ranks.get(length, 0)
            rows.setdefault(length, []).append((rank, times, sequence, offset))
            ranks[length] = rank + times * copies
            offset += times * length
            at += times
        sequence += copies
    return {length: np.array(x, np.int64) for length, x in rows.items()}


def pack(
    df: DataFrame, length_col: str = "length", key_cols: tuple[str, ...] = ("doc_id", "start"), size: int = SEQUENCE,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``df`` with ``sequence_id`` and ``offset``; ``df`` should be a stored table, as it is read more than once.

    Lengths lie in 1..size. Rows are told apart by ``key_cols``; equal rows get different places in an
    order that is not fixed. A length has a bucket for each ``bucket_rows`` rows of ``df`` (at least
    ``BUCKETS``). An empty table gives an empty result.
    """
    buckets = max(BUCKETS, -(-df.count() // bucket_rows))
    given = df.withColumn("_bucket", F.pmod(F.xxhash64(*key_cols), F.lit(buckets)).cast("int"))
    counts = written(given.groupBy(length_col, "_bucket").agg(F.count("*").alias("_n")), "piece-counts")
    # At most one row for each length, whatever the number of pieces.
    histogram = dict(counts.groupBy(length_col).agg(F.sum("_n")).collect())
    if any(length is None or not 1 <= length <= size for length in histogram):
        raise ValueError(f"lengths must lie in 1..{size}")
    places = _places(pack_histogram(histogram, size))
    before = F.sum("_n").over(Window.partitionBy(length_col).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select(length_col, "_bucket", F.coalesce(before, F.lit(0)).cast("long").alias("_first"))
    rank = F.row_number().over(Window.partitionBy(length_col, "_bucket").orderBy(*key_cols)) - 1
    names = df.columns
    at_length = names.index(length_col)

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths, ranks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (at_length, len(names)))
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for length in np.unique(lengths):
            mine = np.flatnonzero(lengths == length)
            r = ranks[mine]
            table = places[int(length)]
            first, times, seq, off = table[np.searchsorted(table[:, 0], r, side="right") - 1].T
            sequence[mine] = seq + (r - first) // times
            offset[mine] = off + (r - first) % times * length
        return pa.RecordBatch.from_arrays(
            [*batch.columns[: len(names)], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]
        )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    ranked = given.join(firsts, [length_col, "_bucket"]).select(*names, (rank + F.col("_first")).alias("_rank"))
    return arrow_map(ranked, f"{schema}, sequence_id long, offset long", per_batch)


def op8_spfhp(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    stored = stored_pieces(read_table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"))
    return pack(stored).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
