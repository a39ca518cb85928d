"""SimHash near-duplicates at a similarity of 0.8 or more: the anchors of a covering code for wider fingerprints.

``anchor_simhash`` links fingerprints of 64 bits at 3 or fewer differing bits. Texts whose sets of 5-word
shingles have a Jaccard similarity of 0.8 differ in about 10 of 64 bits, so no such radius links them. Here
the fingerprint has 512 bits, and each of ``TABLES`` blocks of 23 of them is searched with a threshold of
one: the anchors are the words of the perfect [23, 12] Golay code, whose covering radius is 3, and a text is
copied to every anchor within 3 + 1 = 4 of its block (1 or 6 of them). A block counts only together with
the least shingle of the text under the block's own hash, so unrelated texts do not meet, however many.
Where a key (least shingle, anchor) is shared, fingerprints are compared. Beside each stands a parity sketch
of 512 bits: two differ in no more bits than the sets do in shingles, so it rules out pairs without losing
one. Pairs within ``FAR`` bits are verified by the exact similarity of their whole sets, so no link is false.

Recall: a pair with similarity exactly 0.8 has the least shingle of a table in common with probability 0.8,
and an anchor with 0.60, so one of nine tables shows it with 0.997; at 0.85 it is 0.9997. Equal sets are
merged before and never missed. ``FAR`` lies 4.6 standard deviations above what 0.8 gives.

Two passes. First each text of a key meets the text in the middle of those it is near to; keys with very many
texts are dealt into parts, other ones for every table. Of the middles a text met it is compared with the
one that most texts met. Then, in keys whose texts are not all connected yet, all texts are compared that are
not connected. So a large group of near copies costs about one pair a text, and connectivity is that of all
links found.

Joins by node are dealt at every size: what Spark would broadcast on a small input is held by the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findmill.llm.anchor_simhash import SEED, _with_end, components
from findmill.llm.common import arrow_map, beside, buffers, discard, fresh, utf8, written

WORDS = 5
BITS = 512
TABLES = 9
FIRST_TABLES = 3
FAR = 115
PART_ROWS = 1024
#: Most bits of the filter that tells which texts are to be cut again: 32 MB.
FILTER_BITS = 1 << 28
_SLICE = 1 << 14
_ROUNDS = np.random.default_rng(SEED)
#: Odd factors: of the eight words of a shingle's 512 bits, and of the hash of each table.
_WIDEN = _ROUNDS.integers(0, 2**63, BITS // 64, np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE = _ROUNDS.integers(0, 2**63, TABLES, np.uint64) * np.uint64(2) + np.uint64(1)
#: The bits of each block.
_BLOCKS = np.stack([_ROUNDS.choice(BITS, 23, replace=False) for _ in range(TABLES)])


def shingles(raw: bytes) -> np.ndarray:
    """The sorted hashes of the shingles of a text in UTF-8; a shorter text is one, a text without words has none."""
    words = raw.lower().split()
    joined = b" ".join(words)
    if len(words) <= WORDS:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    first, last = (ends - sizes)[: 1 - WORDS].tolist(), ends[WORDS - 1 :].tolist()
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first, last)], np.uint64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * shared >= 4 * (len(a) + len(b))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def wide_fingerprint(found: np.ndarray) -> np.ndarray:
    """SimHash of 512 bits (as bits) of a set of shingles; no shingles give zeros."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(found), _SLICE):
        part = _mixed(found[at : at + _SLICE, None] * _WIDEN)
        bits = np.unpackbits(part.view(np.uint8), axis=1)
        for i in range(0, len(bits), 255):  # sums of 255 bits fit in a byte
            ones += np.add.reduce(bits[i : i + 255], axis=0, dtype=np.uint8)
    return (2 * ones > len(found)).astype(np.uint8)


def parity(found: np.ndarray) -> np.ndarray:
    """512 bits: whether an odd number of the shingles falls on each."""
    return (np.bincount((found & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)


def may_be_similar(n: np.ndarray, prints: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows a and b (arrays of places) may be similar, by fingerprints with sketches and by sizes."""
    near = np.bitwise_count(prints[a] ^ prints[b]).reshape(-1, 2, BITS // 64).sum(axis=2, dtype=np.int64)
    return (near[:, 0] <= FAR) & (9 * near[:, 1] <= n[a] + n[b])


def least_shingles(found: np.ndarray) -> np.ndarray:
    """The least hash of a set of shingles for each table."""
    least = np.full(TABLES, np.uint64(2**64 - 1))
    for at in range(0, len(found), _SLICE):
        least = np.minimum(least, _mixed(found[at : at + _SLICE, None] * _TABLE).min(axis=0))
    return least


def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the [23, 12] Golay code: syndromes of the bits; per syndrome the error of up to 3 bits, and those of 4."""
    generator = 0b101011100011

    def rest(word: int) -> int:
        for i in range(22, 10, -1):
            if word >> i & 1:
                word ^= generator << (i - 11)
        return word

    single = [rest(1 << i) for i in range(23)]
    nearest, further = np.zeros(2048, np.uint32), [[] for _ in range(2048)]
    for n in range(1, 5):
        for places in combinations(range(23), n):
            syndrome = 0
            for i in places:
                syndrome ^= single[i]
            error = sum(1 << i for i in places)
            if n < 4:
                nearest[syndrome] = error
            else:
                further[syndrome].append(error)
    return np.array(single, np.uint32), nearest, np.array([x if x else [0] * 5 for x in further], np.uint32)


_SINGLE, _NEAREST, _FURTHER = _golay()


def golay_anchors(words: np.ndarray) -> np.ndarray:
    """The anchors within 4 of each word of 23 bits, six a row; where there is one only, it is repeated."""
    syndrome = np.zeros(len(words), np.uint32)
    for i in range(23):
        syndrome ^= ((words >> np.uint32(i)) & np.uint32(1)) * _SINGLE[i]
    nearest = (words ^ _NEAREST[syndrome])[:, None]
    far = _FURTHER[syndrome]
    return np.concatenate([nearest, np.where(far > 0, words[:, None] ^ far, nearest)], axis=1)


def keys(least: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """For each text a row of keys, one for every (table, least shingle, anchor); the lowest four bits are the table."""
    blocks = np.zeros((len(bits), TABLES), np.uint32)
    for i in range(23):
        blocks |= bits[:, _BLOCKS[:, i]].astype(np.uint32) << np.uint32(i)
    anchors = golay_anchors(blocks.ravel()).reshape(len(bits), TABLES, 6).astype(np.uint64)
    both = _mixed(least[:, :, None] ^ (anchors * np.uint64(0x9E3779B97F4A7C15)))
    return ((both & ~np.uint64(15)) | np.arange(TABLES, dtype=np.uint64)[:, None]).reshape(len(bits), TABLES * 6)


def _rows(given: DataFrame, kind: str) -> DataFrame:
    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        sigs, sizes, prints, sketches, least = [], [], [], [], []
        for raw in buffers(batch.column(1)):
            found = shingles(raw)
            sigs.append(xxhash.xxh3_128_digest(found.tobytes()))
            sizes.append(len(found))
            prints.append(wide_fingerprint(found))
            sketches.append(parity(found))
            least.append(least_shingles(found))
        fps = [x.tobytes() for x in np.packbits(np.concatenate([np.stack(prints), np.stack(sketches)], axis=1), axis=1)]
        columns = [pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64()), pa.array(fps, pa.binary()), pa.array([x.tobytes() for x in least], pa.binary())]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(2)], ["_id", "sig", "n", "fp", "least", "text_hash"])

    return arrow_map(given, f"_id {kind}, sig binary, n long, fp binary, least binary, text_hash long", per_batch)


def _each_key(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(key, node) for every key of rows (node, fp, least): keys are made where they are dealt, not stored."""
    fp, least = (np.frombuffer(b"".join(batch.column(i).to_pylist()), kind).reshape(batch.num_rows, -1) for i, kind in ((1, np.uint8), (2, np.uint64)))
    found = np.sort(keys(least, np.unpackbits(fp[:, : BITS // 8], axis=1)).view(np.int64), axis=1)
    keep = np.append(np.ones((len(found), 1), bool), found[:, 1:] != found[:, :-1], axis=1)
    node = np.repeat(batch.column(0).to_numpy(), keep.sum(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(found[keep]), pa.array(node)], ["key", "node"])


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Four bits of the filter for each hash."""
    mixed = hashes.view(np.uint64)[:, None] * _WIDEN[:4]
    return ((mixed ^ (mixed >> np.uint64(32))) & np.uint64(bits - 1)).astype(np.int64)


def _may_be(wanted: DataFrame) -> Callable[[str], Column]:
    """A test of a column of hashes: true for all that are a ``text_hash`` of ``wanted``, false for most others.

    It is a Bloom filter of 16 bits a hash, ``FILTER_BITS`` at most, so what is broadcast has a fixed bound; with very
    many hashes it tells fewer apart, and the join behind it does the rest.
    """
    spark = wanted.sparkSession
    bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * wanted.count() - 1).bit_length()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, bool)
        for batch in batches:
            own[_places(batch.column(0).to_numpy(zero_copy_only=False), bits).ravel()] = True
        packed = np.packbits(own).reshape(-1, 1 << 13)
        some = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([packed[i].tobytes() for i in some], pa.binary())], ["at", "bits"])

    def either(table: pa.Table) -> pa.Table:
        parts = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        return pa.table({"at": table.column("at")[:1], "bits": [np.bitwise_or.reduce(parts, axis=0).tobytes()]})

    whole = np.zeros((bits >> 16, 1 << 13), np.uint8)
    for at, part in wanted.select("text_hash").mapInArrow(fill, "at int, bits binary").groupBy("at").applyInArrow(either, "at int, bits binary").collect():
        whole[at] = np.frombuffer(part, np.uint8)
    shared = spark.sparkContext.broadcast(whole.tobytes())

    @F.pandas_udf("boolean")
    def told(hashes: pd.Series) -> pd.Series:
        at = _places(hashes.to_numpy(), bits)
        have = np.frombuffer(shared.value, np.uint8)[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
        return pd.Series(have.all(axis=1))

    return told


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of whole runs of rows with one value in the first column, some runs at a time."""
    held: list[np.ndarray] | None = None
    for batch in _with_end(batches):
        if batch is not None:
            new = [
                np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(-1, 2 * BITS // 64) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False)
                for c in batch.columns
            ]
            held = [np.concatenate(x) for x in zip(held, new)] if held else new
        if not held or not len(held[0]):
            continue
        first = held[0]
        end = len(first) if batch is None else int(np.searchsorted(first, first[-1]))
        if end:
            yield [x[:end] for x in held]
        held = [x[end:] for x in held]


def _bounds(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs."""
    starts = np.concatenate([[0], np.flatnonzero(first[1:] != first[:-1]) + 1])
    return starts, np.diff(np.append(starts, len(first)))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key those whose key is not alone, and the rows of their key."""
    for key, node in _runs(batches):
        _, sizes = _bounds(key)
        sizes = np.repeat(sizes, sizes)
        keep = sizes > 1
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, node, sizes)], ["key", "node", "size"])


def _mixed_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, node, root) sorted by key those whose key has several roots."""
    for key, node, root in _runs(batches):
        starts, sizes = _bounds(key)
        keep = np.repeat(np.minimum.reduceat(root, starts) < np.maximum.reduceat(root, starts), sizes)
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, node, root)], ["key", "node", "root"])


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    two = np.unique(np.sort(np.stack([a, b]), axis=0), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(side) for side in two], ["a", "b"])


def _to_middle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, node, n, fp) sorted by part: each row with the middle one of those near to it."""
    for part, node, n, fp in _runs(batches):
        starts, sizes = _bounds(part)
        for at, size in zip(starts.tolist(), sizes.tolist()):
            left = np.arange(at, at + size)
            while len(left) > 1:
                some = fp[left, : BITS // 64]
                bits = np.unpackbits(some.view(np.uint8), axis=1)
                usual = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(left)).view(np.uint64)
                middle = left[np.bitwise_count(some ^ usual).sum(axis=1, dtype=np.int64).argmin()]
                near = may_be_similar(n, fp, left, np.full(len(left), middle))
                mine = left[near & (left != middle)]
                if len(mine):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[mine], np.full(len(mine), node[middle]))], ["a", "b"])
                left = left[~near]


def _all_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, root, n, fp) sorted by key and n: all pairs that are near and have different roots."""
    for key, node, root, n, fp in _runs(batches):
        at, k = np.flatnonzero(key[1:] == key[:-1]), 1
        while len(at):
            to = at + k
            ask = root[at] != root[to]
            a, b = at[ask], to[ask]
            for i in range(0, len(a), 1 << 16):
                x, y = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
                near = may_be_similar(n, fp, x, y)
                if near.any():
                    yield _pairs(node[x[near]], node[y[near]])
            k += 1
            at = at[at + k < len(n)]
            # Sizes grow along a key, so the first one too large ends a row's comparisons.
            at = at[(key[at] == key[at + k]) & (5 * n[at] >= 4 * n[at + k])]


def _most_met(met: DataFrame, kept: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Of the middles (b) each text (a) met the one that most texts met, so that groups become stars."""
    met = kept(met, "near-middles")
    texts = met.groupBy("b").agg(F.count("*").alias("degree")).withColumn("texts", F.col("degree"))
    best = beside(met, texts, "b", met.count()).groupBy("a").agg(F.max_by("b", F.struct("texts", "b")).alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _verified(pairs: DataFrame, firsts: DataFrame, given: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar. Only texts of pairs are cut into shingles again."""
    pairs = written(pairs.distinct(), "near-pairs")
    if pairs.isEmpty():
        return pairs
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    need = written(firsts.select("node", "sig", "text_hash", "first_id").join(nodes.hint("merge"), "node", "left_semi"), "near-needed")

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(x) for x in buffers(batch.column(0))]
        made = [pa.array([f(x.tobytes()) for x in found], pa.binary()) for f in (xxhash.xxh3_128_digest, bytes)]
        return pa.RecordBatch.from_arrays(made, ["sig", "hashes"])

    # A text of each set, that of its first id: exact copies are not cut.
    one = need.select(F.col("text_hash").alias("wanted"), "first_id").hint("merge")
    texts = given.where(_may_be(need)("text_hash")).join(one, (F.col("text_hash") == F.col("wanted")) & F.col("_id").eqNullSafe(F.col("first_id")), "left_semi").select("raw")
    made = arrow_map(texts, "sig binary, hashes binary", sets).join(need.select("sig", "node").hint("merge"), "sig").select("node", "hashes")
    kept = written(made.dropDuplicates(["node"]), "near-sets")
    both = pairs.join(kept.select(F.col("node").alias("a"), F.col("hashes").alias("x")).hint("merge"), "a").join(
        kept.select(F.col("node").alias("b"), F.col("hashes").alias("y")).hint("merge"), "b"
    )

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = ([np.frombuffer(v, np.uint64) for v in buffers(batch.column(i))] for i in (2, 3))
        return batch.select(["a", "b"]).filter(pa.array(map(similar, x, y), pa.bool_()))

    found = written(arrow_map(both.select("a", "b", "x", "y"), "a long, b long", check), "near-links")
    for done in (pairs, need, kept):
        discard(done)
    return found


def _connected(df: DataFrame, id_col: str, text_col: str, part_rows: int) -> tuple[DataFrame, list[DataFrame]]:
    """(_id, text_hash, root) for every row of ``df``: rows with one root are near copies. And the tables that are done with after that."""
    made: list[DataFrame] = []

    def kept(table: DataFrame, name: str) -> DataFrame:
        made.append(written(table, name))
        return made[-1]

    given = df.select(F.col(id_col).alias("_id"), utf8(F.col(text_col)).alias("raw")).withColumn("text_hash", F.xxhash64("raw"))
    rows = kept(_rows(given, df.schema[id_col].dataType.simpleString()), "near-rows")
    grouped = rows.groupBy("sig").agg(
        F.min("_id").alias("first_id"), F.count("*").alias("degree"), *(F.first(c).alias(c) for c in ("n", "fp", "least")),
        F.coalesce(F.min_by("text_hash", "_id"), F.first("text_hash")).alias("text_hash"),
    )
    firsts = kept(grouped.withColumn("node", F.monotonically_increasing_id()), "near-firsts")
    # Most keys belong to one set; they go before anything else is copied beside them.
    each = arrow_map(firsts.select("node", "fp", "least"), "key long, node long", _each_key).repartition("key").sortWithinPartitions("key")
    shared = kept(each.mapInArrow(_shared, "key long, node long, size long"), "near-keys")

    few = shared.where(F.col("key").bitwiseAND(15) < FIRST_TABLES)
    dealt = F.xxhash64("key", F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("size") / part_rows)))
    part = F.when(F.col("size") > part_rows, dealt).otherwise(F.col("key"))
    wide = few.withColumn("part", part).join(firsts.select("node", "n", "fp").hint("merge"), "node").select("part", "node", "n", "fp")
    middle = wide.repartition("part").sortWithinPartitions("part").mapInArrow(_to_middle, "a long, b long")
    links = _verified(_most_met(middle, kept), firsts, given)
    made.append(links)

    roots = kept(components(links), "near-roots")
    lean = shared.join(roots.hint("merge"), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    several = lean.repartition("key").sortWithinPartitions("key").mapInArrow(_mixed_keys, "key long, node long, root long")
    wide = several.join(firsts.select("node", "n", "fp").hint("merge"), "node").select("key", "node", "root", "n", "fp")
    rest = wide.repartition("key").sortWithinPartitions("key", "n", "node").mapInArrow(_all_pairs, "a long, b long")
    more = _verified(rest, firsts, given)
    made.append(more)
    if not more.isEmpty():
        roots = components(links.union(more))
    by_sig = firsts.join(roots.hint("merge"), "node", "left").select("sig", F.coalesce("root", "node").alias("root"), "degree")
    return beside(rows.select("_id", "sig", "text_hash"), by_sig, "sig", rows.count()).select("_id", "text_hash", "root"), made


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_rows: int = PART_ROWS) -> DataFrame:
    """(``id_col``, ``component_id``) for every row of ``df``.

    ``component_id`` is the smallest id reachable over links, the row's own included. Texts without words are
    equal. Rows whose id is null take part; they get the smallest id that is not null, or null if there is
    none. Repeated rows stay, an empty table gives an empty result, other columns of ``df`` are not read.
    """
    found, made = _connected(df, id_col, text_col, part_rows)
    rows = written(found.drop("text_hash"), "near-roots")
    for done in made:
        discard(done)
    lowest = rows.groupBy("root").agg(F.min("_id").alias("component_id"), F.count("*").alias("degree"))
    return beside(rows, lowest, "root", rows.count()).select(F.col("_id").alias(id_col), "component_id")


def without_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_rows: int = PART_ROWS) -> DataFrame:
    """One row of each group of near copies, with all columns of ``df``.

    The row with the smallest id stays (null ids last), of rows that share it the one whose text has the
    smallest hash, of rows equal in both any one. Ids need not be unique: rows, not ids, are kept or dropped.
    """
    found, made = _connected(df, id_col, text_col, part_rows)
    rows = found.groupBy("root", "_id", "text_hash").agg(F.count("*").alias("rows"))
    rows = written(rows.withColumn("rank", F.struct(F.col("_id").isNull().alias("none"), "_id", "text_hash")), "near-roots")
    for done in made:
        discard(done)
    first = rows.groupBy("root").agg(F.min("rank").alias("first"), F.count("*").alias("degree"))
    own, hashed, gone, named_hash = fresh(df.columns, "_id", "_hash", "_gone", "_text_hash")
    marks = beside(rows, first, "root", rows.count()).select(
        F.col("_id").alias(own), F.col("text_hash").alias(hashed), (F.col("rank") != F.col("first")).alias(gone), "rows"
    )
    # Only what goes or is there more than once meets the texts: its size is known, and Spark picks the join.
    marks = written(marks.where(F.col(gone) | (F.col("rows") > 1)).select(own, hashed, gone), "near-marks")
    named = df.withColumn(named_hash, F.xxhash64(utf8(F.col(text_col))))
    both = F.col(id_col).eqNullSafe(F.col(own)) & (F.col(named_hash) == F.col(hashed))
    # Texts that no mark can mean stay where they are; the others, few as a rule, are dealt to meet the marks.
    met = _may_be(marks.select(F.col(hashed).alias("text_hash")))(named_hash)
    asked = named.where(met)
    single = named.where(~met).union(asked.join(marks, both, "left_anti")).select(*df.columns)
    repeated = marks.where(~F.col(gone))
    if repeated.isEmpty():
        return single
    return single.union(asked.join(repeated, both, "left_semi").dropDuplicates([id_col, named_hash]).select(*df.columns))
