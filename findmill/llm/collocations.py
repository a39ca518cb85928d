"""Phrase collocations by counting quotient filters.

Tasks count the phrases of a few million words at a time: words get local ids, an n-gram packs into one
64-bit number, and sorting gives the counts. For the world outside a word's id is a hash of language and word of ``id_bytes`` bytes,
and an n-gram is that many bytes a word. Its lanes are permuted by an invertible map, so that the leading bits are
even whatever words are frequent. These bits are the quotient, which says where an entry stands; everything
else, the whole remainder, is stored beside the count. So a filter is sorted, compact, and loses nothing: the
map backwards gives the word ids again.

A shard's filter is cut into slices by leading bits of the quotient, and slices meet by shuffle; every shard has
an n-gram once at most, so a frequent one makes no hot key. A slice's filters, each sorted, are merged,
and what occurs often enough leaves the merge. The number of slices grows with the bytes of the table, so a slice stays
at about ``SLICE_ENTRIES`` entries.

Words travel the same way with their texts, so two words that share an id are seen: then the count is
made again with ids of their own for them (for V words about V² / 2^(8 * id_bytes + 1) pairs are expected).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findmill.llm.common import discard, read_table, utf8, written

ID_BYTES, SHARD_WORDS, FILTER_ENTRIES, SLICE_ENTRIES = 6, 2_500_000, 500_000, 1_000_000
BATCH_BYTES = 4 << 20
LONGEST, MIN_COUNT, COVER_PERCENT, TOP, SALTS = 3, 10, 50, 2000, 64
#: Bytes of a text that are split at a time, words known before the local ids begin anew, and bits of a local id.
PART, MOST_WORDS, LOCAL_BITS = 1 << 20, 250_000, 21
#: 0xFE and 0xFF are in no UTF-8 text: the one between pieces, the other between keys.
_BREAK, _JOIN = b"\xff", b"\xfe"
_TABLE = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", _BREAK * 10 + b" ")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray, turn: int) -> np.ndarray:
    x = (x + np.uint64(turn + 1)) * _MIX
    return (x ^ (x >> np.uint64(29))) * _MIX


def permuted(lanes: list[np.ndarray], bits: int, back: bool = False) -> list[np.ndarray]:
    """Lanes of ``bits`` bits, each shifted by a mix of the next, twice around; with ``back`` the other way."""
    out, n, mask = list(lanes), len(lanes), np.uint64((1 << bits) - 1)
    steps = [(turn, i) for turn in range(2) for i in reversed(range(n))]
    for turn, i in reversed(steps) if back else steps:
        shift = _mixed(out[(i + 1) % n], turn) >> np.uint64(64 - bits) if n > 1 else np.uint64(turn)
        out[i] = (out[i] - shift if back else out[i] + shift) & mask
    return out


def _low_bytes(x: np.ndarray, n: int) -> np.ndarray:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]


def _number(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, : raw.shape[1]] = raw
    return wide.reshape(-1).view("<u8")


def pack_counts(counts: np.ndarray) -> bytes:
    """A byte each; 255 stands for a larger number, which follows behind."""
    large = counts >= 255
    return np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype("<u8").tobytes()


def unpack_counts(raw: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, "<u8", offset=n)
    return counts


class Filter:
    """The layout of quotient filters: ``slice_bits`` name the slice, the quotient has ``quotient`` bits in all."""

    def __init__(self, id_bytes: int, slice_bits: int):
        self.id_bytes, self.bits, self.slice_bits = id_bytes, 8 * id_bytes, slice_bits
        self.quotient = min(self.bits, 8 * -(-(slice_bits + 4) // 8))
        self.buckets = 1 << (self.quotient - slice_bits)

    def cut(self, lanes: list[np.ndarray], counts: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
        """(slice, entries, counts) of different n-grams, given as lanes of word ids."""
        lanes = permuted(lanes, self.bits)
        order = np.argsort(lanes[0])
        lanes, counts = [x[order] for x in lanes], counts[order]
        del order
        place = (lanes[0] >> np.uint64(self.bits - self.quotient)).astype(np.int64)
        rest = np.concatenate([_low_bytes(lanes[0], self.id_bytes - self.quotient // 8), *(_low_bytes(x, self.id_bytes) for x in lanes[1:])], axis=1)
        del lanes
        own = place // self.buckets
        ends = np.flatnonzero(np.append(own[1:] != own[:-1], True)) + 1 if len(own) else []
        at = 0
        for end in ends:
            runs = np.bincount(place[at:end] - own[at] * self.buckets, minlength=self.buckets)
            yield int(own[at]), pack_counts(runs) + rest[at:end].tobytes(), pack_counts(counts[at:end])
            at = end

    def read(self, slice_no: int, words: int, entries: bytes, counts: bytes) -> tuple[list[np.ndarray], np.ndarray]:
        """Permuted lanes and counts of one filter, sorted by the first lane."""
        large = entries[: self.buckets].count(255)
        runs = unpack_counts(entries[: self.buckets + 8 * large], self.buckets)
        n = int(runs.sum())
        first, width = self.id_bytes - self.quotient // 8, self.id_bytes * words - self.quotient // 8
        rest = np.frombuffer(entries, np.uint8, offset=self.buckets + 8 * large).reshape(n, width)
        place = np.repeat(np.arange(self.buckets) + slice_no * self.buckets, runs).astype(np.uint64)
        lanes = [(place << np.uint64(self.bits - self.quotient)) | _number(rest[:, :first])]
        lanes += [_number(rest[:, a : a + self.id_bytes]) for a in range(first, width, self.id_bytes)]
        return lanes, unpack_counts(counts, n)

    def merge(self, parts: list[tuple[list[np.ndarray], np.ndarray]], least: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Word ids and summed counts of all that occur ``least`` times or more."""
        lanes = [np.concatenate(x) for x in zip(*(p[0] for p in parts))]
        counts = np.concatenate([p[1] for p in parts])
        # A stable sort merges runs that are sorted. Free bits of the key hold the beginning of the second lane.
        free = 64 - self.bits
        key = lanes[0]
        if free and len(lanes) > 1:
            more = lanes[1] << np.uint64(free - self.bits) if free >= self.bits else lanes[1] >> np.uint64(self.bits - free)
            key = (lanes[0] << np.uint64(free)) | more
        order = np.argsort(key, kind="stable")
        same = np.ones(len(order) - 1, bool)
        for x in lanes:
            same &= x[order][1:] == x[order][:-1]
        if (~same & (key[order][1:] == key[order][:-1])).any():  # the key is alike and the whole is not
            order = np.lexsort(lanes[::-1])
            same = np.ones(len(order) - 1, bool)
            for x in lanes:
                same &= x[order][1:] == x[order][:-1]
        starts = np.flatnonzero(np.append(True, ~same))
        sums = np.add.reduceat(counts[order], starts)
        often = sums >= least
        found = [x[order][starts][often] for x in lanes]
        return permuted(found, self.bits, back=True), sums[often]


class _Words(dict):
    """Local ids of one language's words; the shard's list of names gives them out."""

    def __init__(self, lang: bytes, names: list[bytes]):
        super().__init__({_BREAK: 0})
        self.lang, self.names = lang + _BREAK, names

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self.names)
        self.names.append(self.lang + word)
        return at


def word_id(key: bytes, id_bytes: int) -> int:
    """Of language, 0xFF and word."""
    return xxhash.xxh3_64_intdigest(key) >> (64 - 8 * id_bytes)


class Shard:
    """Counts the phrases of a task, ``SHARD_WORDS`` words at a time."""

    def __init__(self, layout: Filter, longest: int, own_ids: dict[bytes, int]):
        self.layout, self.longest, self.own_ids = layout, longest, own_ids
        self.parts: list[np.ndarray] = []
        self.size = self.carried = 0
        self._begin()

    def _begin(self) -> None:
        self.names: list[bytes] = [b""]
        self.langs: dict[str, _Words] = {}
        self.ids = np.zeros(1, np.uint64)

    def _global(self) -> np.ndarray:
        new = [self.own_ids.get(x) or word_id(x, self.layout.id_bytes) for x in self.names[len(self.ids) :]]
        self.ids = np.concatenate([self.ids, np.array(new, np.uint64)])
        return self.ids

    def add(self, lang: str, raw: bytes) -> Iterator[tuple]:
        """Rows that this text completes: a text is taken in parts, so its length does not matter."""
        text = raw.lower().translate(_TABLE)
        at = 0
        while at < len(text):
            end = at + PART
            if end < len(text):
                found = [x for x in (text.find(b" ", end), text.find(_BREAK, end)) if x >= 0]
                end = min(found, default=len(text))
            words = self.langs.get(lang)
            if words is None:
                words = self.langs[lang] = _Words(lang.encode(), self.names)
            tokens = text[at:end].replace(_BREAK, b" \xff ").split()
            self._put(np.fromiter(map(words.__getitem__, tokens), np.int32, len(tokens)))
            at = end
            if self.size >= SHARD_WORDS or len(self.names) >= MOST_WORDS:
                yield from self.flush()
        self._put(np.zeros(1, np.int32))

    def _put(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.size += len(ids)

    def flush(self) -> Iterator[tuple]:
        """(slice, words, entries, counts); the last words stay, for phrases that go on."""
        if self.size <= self.carried:
            return
        flat = np.concatenate(self.parts)
        self.parts = []
        ids = self._global()
        yield from self._words(np.bincount(flat[self.carried :], minlength=len(ids)))
        for n in range(2, self.longest + 1):
            # By first word in parts of about a filter, as lanes and entries take many times the memory of keys.
            most = FILTER_ENTRIES * 3 // 2
            parts = len(flat) // most + 1
            for at in range(parts):
                keys = self._keys(flat, n, at, parts)
                starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else keys
                for low in range(0, len(starts), most):
                    own = starts[low : low + most + 1]
                    counts = np.diff(own if len(own) > most else np.append(own, len(keys)))
                    part = keys[own[: len(counts)]]
                    lanes = [ids[(part >> (LOCAL_BITS * (n - 1 - i))) & ((1 << LOCAL_BITS) - 1)] for i in range(n)]
                    for row in self.layout.cut(lanes, counts):
                        yield row[0], n, *row[1:]
        last = flat[-(self.longest - 1) :] if self.longest > 1 else flat[:0]
        if len(self.names) >= MOST_WORDS:
            kept = [self.names[i] for i in last]
            self._begin()
            again = []
            for key in kept:
                lang, _, word = key.partition(_BREAK)
                own = self.langs.setdefault(lang.decode(), _Words(lang, self.names))
                again.append(own[word] if key else 0)
            last = np.array(again, np.int32)
        self.parts, self.size, self.carried = [last], len(last), len(last)

    def _keys(self, flat: np.ndarray, n: int, at: int, parts: int) -> np.ndarray:
        """Of all stretches of n words without a break whose first word is in part ``at``, sorted."""
        size = max(0, len(flat) - n + 1)
        whole = flat[:size] % parts == at
        for i in range(n):
            whole &= flat[i : size + i] > 0
        whole[: max(0, self.carried - n + 1)] = False  # these were counted with the words before
        first = np.flatnonzero(whole)
        keys = np.zeros(len(first), np.int64)
        for i in range(n):
            keys <<= LOCAL_BITS
            keys |= flat[first + i]
        keys.sort()
        return keys

    def _words(self, single: np.ndarray) -> Iterator[tuple]:
        used = np.flatnonzero(single[1:]) + 1
        own = (self.ids[used] >> np.uint64(self.layout.bits - self.layout.slice_bits)).astype(np.int64)
        order = np.argsort(own, kind="stable")
        used, own = used[order], own[order]
        ends = np.flatnonzero(np.append(own[1:] != own[:-1], True)) + 1 if len(own) else []
        at = 0
        for end in ends:
            yield int(own[at]), 1, _JOIN.join(self.names[i] for i in used[at:end]), pack_counts(single[used[at:end]])
            at = end


_COUNTED = "words int, lang string, word string, ids array<long>, count long"
#: Rows that are not phrases: the occurrences of all words of a language, and words that share their id.
_TOTAL, _CLASH = 0, -1


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _counted(docs: DataFrame, lang_col: str, text_col: str, layout: Filter, longest: int, least: int, own_ids: dict[bytes, int]) -> DataFrame:
    given = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), utf8(F.col(text_col)).alias("raw"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(layout, longest, own_ids)

        def out(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            for row in rows:
                held.append(row)
                if len(held) == 256:
                    yield packed(held)
                    held = []
            if held:
                yield packed(held)

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["slice", "words", "entries", "counts"])

        for batch in batches:
            for lang, raw in zip(*batch.columns):
                yield from out(shard.add(lang.as_py(), raw.as_py()))
        yield from out(shard.flush())

    def merge(table: pa.Table) -> pa.Table:
        slice_no = table.column("slice")[0].as_py()
        made: dict[str, list] = {"words": [], "lang": [], "word": [], "ids": [], "count": []}

        def put(*row) -> None:
            for column, value in zip(made.values(), row):
                column.append(value)

        known: Counter[bytes] = Counter()
        parts: dict[int, list] = {}
        for words, entries, counts in zip(*(table.column(c) for c in ("words", "entries", "counts"))):
            words, entries, counts = words.as_py(), entries.as_py(), counts.as_py()
            if words == 1:
                keys = entries.split(_JOIN)
                for key, n in zip(keys, unpack_counts(counts, len(keys)).tolist()):
                    known[key] += n
            else:
                parts.setdefault(words, []).append(layout.read(slice_no, words, entries, counts))
        totals: Counter[str] = Counter()
        by_id: dict[int, bytes] = {}
        for key, n in sorted(known.items()):
            lang, word = (x.decode() for x in key.split(_BREAK))
            totals[lang] += n
            own = own_ids.get(key) or word_id(key, layout.id_bytes)
            if by_id.setdefault(own, key) != key:
                put(_CLASH, lang, word, [_long(own)], n)
            if n >= least:
                put(1, lang, word, [_long(own)], n)
        for lang, n in totals.items():
            put(_TOTAL, lang, None, None, n)
        for words, found in parts.items():
            lanes, sums = layout.merge(found, least)
            for *ids, n in zip(*(_signed(x).tolist() for x in lanes), sums.tolist()):
                put(words, None, None, ids, n)
        kinds = (pa.int32(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64())
        return pa.table([pa.array(x, k) for x, k in zip(made.values(), kinds)], names=list(made))

    shards = given.mapInArrow(count, "slice int, words int, entries binary, counts binary")
    return shards.groupBy("slice").applyInArrow(merge, _COUNTED)


def counted(
    docs: DataFrame, longest: int = LONGEST, least: int = MIN_COUNT, lang_col: str = "lang", text_col: str = "text", id_bytes: int = ID_BYTES
) -> DataFrame:
    """(words, lang, word, ids, count), stored: words (``words`` 1), phrases of 2 to ``longest`` words by word ids, all that occur
    ``least`` times or more, and the number of all words of each language (``words`` 0).
    """
    if longest not in (2, 3):
        raise ValueError("phrases have 2 or 3 words")
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    # A word and the space behind it have six bytes or so, and each begins a phrase of either length.
    slices = max(size // 6 * (longest - 1) // SLICE_ENTRIES, int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    own_ids: dict[bytes, int] = {}
    while True:
        layout = Filter(id_bytes, min(8 * id_bytes - 4, (slices - 1).bit_length()))
        counting = _counted(docs, lang_col, text_col, layout, longest, least, own_ids)
        with _small_batches(spark):
            made = written(counting, "phrases")
        # Few by the size of the ids: each clash is a pair of words among V² / 2 whose hashes agree.
        clashes = made.where(F.col("words") == _CLASH).select("lang", "word").distinct().collect()
        if not clashes:
            return made
        discard(made)
        for lang, word in sorted(clashes):
            key = lang.encode() + _BREAK + word.encode()
            own_ids[key] = word_id(key + _JOIN * (1 + len(own_ids)), id_bytes) or 1


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Texts go to Python ``BATCH_BYTES`` at a time: 10,000 rows at once take many times their size, in the JVM and in Python."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _windows(ids: Column, n: int) -> Column:
    """All stretches of two to n - 1 of the n word ids."""
    return F.array(*(F.slice(ids, at + 1, size) for size in range(2, n) for at in range(n - size + 1)))


def collocations(
    docs: DataFrame, top: int = TOP, longest: int = LONGEST, least: int = MIN_COUNT, cover_percent: int = COVER_PERCENT,
    lang_col: str = "lang", text_col: str = "text", id_bytes: int = ID_BYTES,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases.

    A null language is ``und``; null and empty texts have no words; equal rows count each. Other columns are not looked at. A phrase is scored at its
    worst cut by floor(10^6 a² / (l r)), and goes if a longer one that holds it occurs in ``cover_percent`` per cent of its
    places. Ties fall to the more frequent phrase, then by bytes. Numbers are exact up to counts of 10^13.
    """
    made = counted(docs, longest, least, lang_col, text_col, id_bytes)
    counts = made.where("words >= 1").select("ids", "count")
    phrases = made.where("words >= 2").select("words", "ids", F.col("count").alias("a"))
    cuts = phrases.select("ids", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("ids", F.lit(1), F.col("k")).alias("head"), F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("tail"))
    heads, tails = (counts.select(F.col("ids").alias(c), F.col("count").alias(x)) for c, x in (("head", "l"), ("tail", "r")))
    a, l, r = (F.col(x).cast("decimal(13,0)") for x in "alr")  # noqa: E741
    parts = cuts.join(heads, "head").join(tails, "tail").select("ids", "a", "k", "l", "r", (F.lit(1_000_000) * a * a).alias("above"), (l * r).alias("below"))
    scored = parts.select("ids", "a", F.struct(F.expr("above div below").alias("score"), "k", "l", "r").alias("cut"))
    best = scored.groupBy("ids").agg(F.first("a").alias("a"), F.min("cut").alias("cut"))
    if longest > 2:
        inside = phrases.where("words > 2").select(F.explode(_windows(F.col("ids"), longest)).alias("ids"), F.col("a").alias("longer"))
        covered = inside.groupBy("ids").agg(F.max("longer").alias("longer"))
        open_ = F.coalesce(100 * F.col("longer") < cover_percent * F.col("a"), F.lit(True))
        best = best.join(covered, "ids", "left").where(open_)
    names = made.where("words = 1").select(F.col("ids")[0].alias("id"), "lang", "word")
    spelled = best.select("ids", F.posexplode("ids").alias("at", "id")).join(names, "id").groupBy("ids").agg(
        F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")
    )
    totals = made.where("words = 0").groupBy("lang").agg(F.sum("count").alias("n"))
    rows = best.select("ids", "a", "cut.l", "cut.r", "cut.score").join(spelled, "ids")
    # The best of each of SALTS parts first: what meets in one task does not grow with the number of tasks.
    order = (F.desc("score"), F.desc("a"), "phrase")
    few = rows.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(SALTS)))
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents").select("lang", "text"))


ORACLE_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
 p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?
-
]')) AS piece FROM d),
 w AS (SELECT lang, list_filter(string_split_regex(piece, '[ 	]+'), lambda x: x <> '') AS ws FROM p),
 x AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
 g AS (SELECT lang, unnest(CASE WHEN i + 2 <= len(ws) THEN [ws[i:i], ws[i:i + 1], ws[i:i + 2]] WHEN i + 1 <= len(ws) THEN [ws[i:i], ws[i:i + 1]] ELSE [ws[i:i]] END) AS ids FROM x),
 c AS (SELECT lang, ids, len(ids) AS words, count(*) AS f FROM g GROUP BY lang, ids),
 t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE words = 1 GROUP BY lang),
 k AS (SELECT lang, ids, f AS a, unnest(range(1, words)) AS k FROM c WHERE words > 1 AND f >= 10),
 s AS (SELECT k.lang, k.ids, a, k, h.f AS l, e.f AS r, (CAST(1000000 AS HUGEINT) * a * a) // (CAST(h.f AS HUGEINT) * e.f) AS score
  FROM k JOIN c h ON h.lang = k.lang AND h.ids = k.ids[1:k] JOIN c e ON e.lang = k.lang AND e.ids = k.ids[k + 1:]),
 b AS (SELECT *, row_number() OVER (PARTITION BY lang, ids ORDER BY score, k) AS worst FROM s),
 v AS (SELECT lang, ids, max(f) AS longer FROM (SELECT lang, unnest([ids[1:2], ids[2:3]]) AS ids, f FROM c WHERE words = 3 AND f >= 10) GROUP BY lang, ids),
 o AS (SELECT b.lang, array_to_string(b.ids, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN v ON v.lang = b.lang AND v.ids = b.ids
  WHERE worst = 1 AND (len(b.ids) > 2 OR longer IS NULL OR 100 * longer < 50 * a)),
 q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT q.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM q JOIN t USING (lang) WHERE rank <= 2000"""
