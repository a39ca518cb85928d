"""Line dedup: range-partitioned hashes, streamed first occurrences, keep bitmaps instead of texts.

Every line that is long enough becomes one small row: the 128-bit hash of its key, its document and its
place. The rows are dealt by ranges of (hash, document, place), largest document first, and sorted inside
their range; so a line that very many documents share spreads over as many ranges as it needs. One pass
streams each range: the first document of a hash keeps its lines, all others lose theirs once a third
document is seen. A task holds one Arrow batch and the places of one document.

A hash can go on over the end of a range. What a range cannot decide alone (the rows of its first hash, and
those of a second document at its end) is put aside with witnesses of its last hash. There are at most two
such hashes a range, so their summary has no more than twice as many rows as there are ranges: it is
broadcast, and it settles the rows put aside.

What comes out is one bitmap for each text that loses lines. ``apply_bitmaps`` brings it to the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findmill.llm.common import arrow_map, fresh, read_table, utf8, written

MIN_CHARS, MIN_DOCS = 20, 3
#: A null id is one document, before all others.
_NO_ID = -(1 << 63)
_BLANK = b" \t\n\x0b\x0c\r"
_TAIL = re.compile(rb"[\x80-\xbf]")
_MARK, _ASIDE, _WITNESS = 0, 1, 2
_ROWS = "hi long, lo long, doc long, fp long, pos int"


def text_key(id_col: str, text_col: str) -> list[Column]:
    """What tells the texts of one id apart: rows with equal id and text share a bitmap."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64(utf8(F.col(text_col))).alias("fp")]


def line_keys(raw: bytes, min_chars: int = MIN_CHARS) -> Iterator[tuple[int, bytes]]:
    """(place, key) of the lines whose key has ``min_chars`` code points: stripped, A-Z lower-cased."""
    for pos, line in enumerate(raw.lower().split(b"\n")):
        if len(line) >= min_chars:
            key = line.strip(_BLANK)
            if len(key) >= min_chars and (key.isascii() or len(key) - len(_TAIL.findall(key)) >= min_chars):
                yield pos, key


def _lines(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    given = df.select(*text_key(id_col, text_col), utf8(F.col(text_col)).alias("raw"))

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        digests, places, counts = [], [], []
        digest = xxhash.xxh3_128_digest
        for value in batch.column(2):
            before = len(places)
            for pos, key in line_keys(value.as_py(), min_chars):
                digests.append(digest(key))
                places.append(pos)
            counts.append(len(places) - before)
        lanes = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        made = [np.ascontiguousarray(lanes[:, 0]), np.ascontiguousarray(lanes[:, 1]), np.repeat(docs, counts), np.repeat(fps, counts), np.array(places, np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["hi", "lo", "doc", "fp", "pos"])

    return arrow_map(given, _ROWS, per_batch)


class _Stream:
    """One range, batch by batch: ``take`` gives what a batch decides, ``end`` what is left."""

    def __init__(self, min_docs: int):
        self.min_docs = min_docs
        self.key: tuple | None = None  # the open hash
        self.doc = None  # its last document
        self.rank = -1  # and that document's rank among those of the hash, largest first
        self.first = True  # whether the open hash is the range's first
        self.held: list[list[np.ndarray]] = []  # rows of the documents that are too few as yet
        self.seen: list[tuple] = []  # witnesses of the open hash: its first documents

    def take(self, cols: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
        hi, lo, doc, *_ = cols
        new_key = np.append((hi[0], lo[0]) != self.key, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))
        new_doc = new_key | np.append(doc[0] != self.doc, doc[1:] != doc[:-1])
        run, docs = np.cumsum(new_key), np.cumsum(new_doc)  # run 0 goes on from the batch before
        rank = docs - np.append(-self.rank, docs[new_key])[run]
        top = np.zeros(run[-1] + 1, np.int64)
        top[run] = rank  # ranks rise within a run, and the last one written stays
        first = 1 if self.key is None else 0 if self.first else -1
        aside, full = run == first, top[run] >= self.min_docs - 1
        if run[0] == 0 and top[0] >= self.min_docs - 1:
            for part in self.held:
                yield _MARK, part
            self.held = []
        if aside.any():
            yield _ASIDE, [c[aside] for c in cols]
        marks = ~aside & full & (rank > 0)
        if marks.any():
            yield _MARK, [c[marks] for c in cols]
        last = run == run[-1]
        if run[-1]:
            self.held, self.seen = [], []
        wait = last & ~aside & ~full & (rank > 0)
        if wait.any():
            self.held.append([c[wait] for c in cols])
        for i in np.flatnonzero(last & new_doc)[: self.min_docs - len(self.seen)]:
            self.seen.append(tuple(c[i] for c in cols))
        self.first = bool(run[-1] == first)
        self.key, self.doc, self.rank = (hi[-1], lo[-1]), doc[-1], int(rank[-1])

    def end(self) -> Iterator[tuple[int, list[np.ndarray]]]:
        if self.first:
            return  # all rows of the open hash are put aside and are their own witnesses
        for part in self.held:
            yield _ASIDE, part
        if self.seen:
            yield _WITNESS, [np.array(x, y) for x, y in zip(zip(*self.seen), (np.int64, np.int64, np.int64, np.int64, np.int32))]


def drop_marks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, fp, pos): the lines that go, each once or more."""
    order = ["hi", "lo", F.desc("doc"), "fp", "pos"]
    dealt = _lines(df, id_col, text_col, min_chars).repartitionByRange(*order).sortWithinPartitions(*order)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Stream(min_docs)

        def out(kind: int, cols: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), kind, np.int32)), *map(pa.array, cols)], ["kind", "hi", "lo", "doc", "fp", "pos"])

        for batch in batches:
            if batch.num_rows:
                for kind, cols in state.take([c.to_numpy(zero_copy_only=False) for c in batch.columns]):
                    yield out(kind, cols)
        for kind, cols in state.end():
            yield out(kind, cols)

    found = written(dealt.mapInArrow(stream, f"kind int, {_ROWS}"), "line-marks")
    edges = found.where(f"kind <> {_MARK}")
    # First the documents of a hash, which spread, then the hashes: two a range at most.
    docs = edges.groupBy("hi", "lo", "doc").agg(F.lit(1).alias("one"))
    known = docs.groupBy("hi", "lo").agg(F.count("*").alias("docs"), F.max("doc").alias("largest"))
    aside = edges.where(f"kind = {_ASIDE}").join(F.broadcast(known.where(F.col("docs") >= min_docs)), ["hi", "lo"])
    return found.where(f"kind = {_MARK}").select("doc", "fp", "pos").unionAll(aside.where("doc <> largest").select("doc", "fp", "pos"))


def bitmap(dropped: np.ndarray) -> bytes:
    """Bit i is 0 if line i goes; lines beyond the last bit stay. Compressed."""
    bits = np.ones(int(dropped.max()) + 1, bool)
    bits[dropped] = False
    return pa.compress(np.packbits(bits).tobytes(), "zstd", asbytes=True) + int(len(bits)).to_bytes(8, "little")


def kept_lines(packed: bytes | None, n_lines: int) -> np.ndarray:
    bits = np.ones(n_lines, bool)
    if packed:
        n = int.from_bytes(packed[-8:], "little")
        raw = pa.decompress(packed[:-8], -(-n // 8), "zstd", asbytes=True)
        bits[:n] = np.unpackbits(np.frombuffer(raw, np.uint8), count=n)
    return bits


def keep_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, fp, keep): a compressed bitmap of the lines that stay, for each text that loses any.

    ``doc`` is the id (a null id is -2^63: one document, smaller than all others), ``fp`` the hash of the text. Rows
    that share an id are one document. A key that ``min_docs`` documents hold stays only in the largest
    of them, there as often as it stands. Null and empty texts have one empty line and lose nothing.
    """
    marks = drop_marks(df, id_col, text_col, min_chars, min_docs)
    places = marks.groupBy("doc", "fp").agg(F.collect_set("pos").alias("places"))

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, ends = batch.column(2).values.to_numpy(), batch.column(2).offsets.to_numpy()
        made = pa.array([bitmap(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns[:2], made], ["doc", "fp", "keep"])

    return arrow_map(places, "doc long, fp long, keep binary", per_batch)


LINES = {"n_lines": "long", "n_dropped": "long", "kept": "string"}


def apply_bitmaps(df: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with ``n_lines`` (before dropping), ``n_dropped`` and ``kept``, the text of the lines that stay.

    The three replace columns of those names; all other columns and repeated rows stay. A text with no line left is
    ''. Texts meet their bitmaps by id and text, so a frequent id spreads.
    """
    keep = [c for c in df.columns if c.lower() not in LINES]
    doc, fp, raw, bits = fresh(df.columns, "_doc", "_fp", "_raw", "_bits")
    own = text_key(id_col, text_col)
    given = df.select(*keep, own[0].alias(doc), own[1].alias(fp), utf8(F.col(text_col)).alias(raw))
    maps = bitmaps.select(F.col("doc").alias(doc), F.col("fp").alias(fp), F.col("keep").alias(bits))
    both = given.join(maps, [doc, fp], "left").select(*keep, raw, bits)

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        totals, dropped, texts = [], [], []
        for raw, packed in zip(batch.column(len(keep)), batch.column(len(keep) + 1)):
            raw, packed = raw.as_py(), packed.as_py()
            total, gone = raw.count(b"\n") + 1, 0
            if packed:
                stay = kept_lines(packed, total)
                gone = total - int(stay.sum())
                raw = b"\n".join(compress(raw.split(b"\n"), stay))
            totals.append(total)
            dropped.append(gone)
            texts.append(raw.decode())
        made = [pa.array(totals, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], [*keep, *LINES])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep]
    return arrow_map(both, ", ".join([*schema, *(f"{n} {k}" for n, k in LINES.items())]), per_batch)


def op13_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    made = apply_bitmaps(docs, keep_bitmaps(docs))
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_STRIP = "trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(doc_id, CAST(-9223372036854775808 AS BIGINT)) AS doc, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
 x AS (SELECT r, doc_id, doc, unnest(l) AS line, unnest(range(len(l))) AS pos FROM d),
 k AS (SELECT *, {_LOWER.format(_STRIP.format('line'))} AS key FROM x),
 f AS (SELECT key, max(doc) AS largest FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc) >= 3),
 g AS (SELECT k.*, f.key IS NOT NULL AND doc <> largest AS gone FROM k LEFT JOIN f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY r"""
