"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits; two link when at most ``THRESHOLD`` = 3 bits differ. Then at most one bit
differs in the upper or in the lower 32 bits, so each half is searched with a threshold of one.

The anchors of a half are the words of a covering code: the perfect [31, 26] Hamming code on the upper
31 bits and both values of the last bit. Every 32-bit word is within covering radius 1 of an anchor. A
fingerprint is copied to every anchor within radius plus threshold = 2 of its half (2 or 17 of them);
if x and y differ in at most one bit of the half, the anchor nearest to x is within 2 of y, so the two
meet there. Fingerprints are compared per anchor, over the full 64 bits.

Equal fingerprints are merged before anything is copied, so exact copies cost one row. A bucket hands on
a spanning forest of its links, never all its pairs. Buckets above ``bucket_rows`` are not compared as
they are: their rows go to a second level of anchors (the [15, 11] Hamming code and one free bit, on each
quarter of the other half, where again one quarter differs in at most one bit), and buckets that are too
large there to a third (each byte of the quarter left, with all bytes one bit away). Both are exact too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findmill.llm.common import arrow_map, beside, buffers, discard, utf8, written

THRESHOLD = 3
SEED = 42
SHINGLE_WORDS = 3
BUCKET_ROWS = 4096
_SLICE = 1 << 16


def _fingerprint(raw: bytes) -> int:
    """SimHash of a text given as UTF-8; bytes.lower() and bytes.split() know ASCII only, as wanted."""
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    first, last = (ends - sizes)[: 1 - SHINGLE_WORDS].tolist(), ends[SHINGLE_WORDS - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first, last)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _SLICE):
        part = hashes[at : at + _SLICE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, ``fp``): the SimHash of each whole text, as a signed long.

    Null and empty texts and texts of white space have fingerprint 0. Repeated rows stay.
    """

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.fromiter(map(_fingerprint, buffers(batch.column(1))), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], [id_col, "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(id_col, utf8(F.col(text_col)).alias("raw")), f"`{id_col}` {kind}, fp long", per_batch)


def _syndrome(words: np.ndarray, bits: int) -> np.ndarray:
    """The XOR of the positions (from 1) of the set bits: 0 for a word of the Hamming code."""
    out = np.zeros(len(words), dtype=np.uint64)
    for i in range(1, bits + 1):
        out ^= ((words >> np.uint64(i - 1)) & np.uint64(1)) * np.uint64(i)
    return out


def covering_anchors(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Every anchor within distance 2 of each word of ``bits`` + 1 bits (``bits`` = 2**m - 1).

    Bit 0 of a word is the free bit, the others belong to the Hamming code. Returns (row, anchor).
    """
    one = np.uint64(1)
    words = words.astype(np.uint64)
    code, free = words >> one, words & one
    syndrome = _syndrome(code, bits)

    def flip(where: np.ndarray) -> np.ndarray:
        return np.where(where > 0, one << (np.maximum(where, one) - one), np.uint64(0))

    rows = np.arange(len(words))
    nearest = code ^ flip(syndrome)
    out = [(rows, (nearest << one) | free), (rows, (nearest << one) | (free ^ one))]
    for i in range(1, bits + 1):
        other = syndrome ^ np.uint64(i)
        keep = np.flatnonzero((syndrome > 0) & (other > i))
        if len(keep):
            far = code[keep] ^ (one << np.uint64(i - 1)) ^ flip(other[keep])
            out.append((keep, (far << one) | free[keep]))
    return np.concatenate([r for r, _ in out]), np.concatenate([a for _, a in out])


def _to_anchors(batch: pa.RecordBatch) -> pa.RecordBatch:
    fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
    keys, copies = [], []
    for half in (0, 1):
        rows, anchors = covering_anchors((fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF), 31)
        keys.append(anchors | np.uint64(half << 32))
        copies.append(fps[rows])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(x).view(np.int64)) for x in (keys, copies)], ["anchor", "fp"]
    )


def _to_second_anchors(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Second level: within one first-level bucket, anchors of the two quarters of the other half."""
    keys, fps = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
    other = np.uint64(32) * (np.uint64(1) - (keys >> np.uint64(32)))
    first, second, copies = [], [], []
    for quarter in (0, 16):
        rows, anchors = covering_anchors((fps >> (other + np.uint64(quarter))) & np.uint64(0xFFFF), 15)
        first.append(keys[rows])
        second.append(anchors | np.uint64(quarter << 16))
        copies.append(fps[rows])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(x).view(np.int64)) for x in (first, second, copies)], ["bucket", "anchor", "fp"]
    )


def _to_third_anchors(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Third level: within one second-level bucket, the words within one bit of each byte of the quarter left.

    At most three bits differ in two bytes, so at most one does in one of them.
    """
    keys, quarters, fps = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3))
    other = np.uint64(32) * (np.uint64(1) - (keys >> np.uint64(32))) + (np.uint64(16) - (quarters >> np.uint64(16)))
    near = np.array([0, *(1 << i for i in range(8))], np.uint64)
    out: list[list[np.ndarray]] = [[], [], [], []]
    for byte in (0, 8):
        words = ((fps >> (other + np.uint64(byte))) & np.uint64(255))[:, None] ^ near
        third = (words | np.uint64(byte << 8)).ravel()
        for to, x in zip(out, (np.repeat(keys, 9), np.repeat(quarters, 9), third, np.repeat(fps, 9))):
            to.append(x)
    made = [pa.array(np.concatenate(x).view(np.int64)) for x in out]
    return pa.RecordBatch.from_arrays(made, ["bucket", "quarter", "anchor", "fp"])


def _root(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    up = parent[at]
    while (up != at).any():
        at, up = up, parent[up]
    return at


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of each pair; every round hooks larger roots below smaller ones."""
    while len(a):
        a, b = _root(parent, a), _root(parent, b)
        keep = a != b
        a, b = np.minimum(a[keep], b[keep]), np.maximum(a[keep], b[keep])
        np.minimum.at(parent, b, a)


def _forest(group: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) that connect what is within the threshold inside each run of ``group``.

    Rows i and i + k of a run are compared for k = 1, 2, ... so memory stays in proportion to the rows.
    """
    parent = np.arange(len(fps))
    at, k = np.flatnonzero(group[1:] == group[:-1]), 1
    while len(at):
        near = np.bitwise_count(fps[at] ^ fps[at + k]) <= THRESHOLD
        _unite(parent, at[near], at[near] + k)
        k += 1
        at = at[at + k < len(fps)]
        at = at[group[at] == group[at + k]]
    root = _root(parent, np.arange(len(fps)))
    own = np.flatnonzero(root != np.arange(len(fps)))
    return fps[own], fps[root[own]]


def _links(bucket_rows: int | None, key_columns: int):
    """Task over rows sorted by anchor: links (kind 0), and the rows of large buckets passed on (kind 1)."""

    def out(kind: int, a: np.ndarray, b: np.ndarray, quarter: np.ndarray) -> pa.RecordBatch:
        columns = [a, b, quarter][: 2 + (key_columns > 1)]
        made = [pa.array(np.full(len(a), kind, np.int32)), *(pa.array(x.view(np.int64)) for x in columns)]
        return pa.RecordBatch.from_arrays(made, ["kind", "a", "b", "quarter"][: len(made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.uint64) for _ in range(key_columns + 1)]
        large: np.ndarray | None = None  # the key of a bucket being passed on
        for batch in _with_end(batches):
            if batch is not None:
                new = [c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns]
                held = [np.concatenate(x) for x in zip(held, new)]
            rows = held[-1]
            if not len(rows):
                continue
            keys = np.stack(held[:-1])
            change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            starts = np.concatenate([[0], change])
            sizes = np.diff(np.append(starts, len(rows)))
            group = np.repeat(np.arange(len(starts)), sizes)
            ready = np.ones(len(starts), bool)
            ready[-1] = batch is None
            heavy = np.zeros(len(starts), bool)
            if bucket_rows is not None:
                heavy = sizes > bucket_rows
                heavy[0] |= large is not None and (keys[:, 0] == large).all()
                large = keys[:, -1].copy() if heavy[-1] else None
            ready |= heavy
            if heavy.any():
                mine = heavy[group]
                yield out(1, held[0][mine], rows[mine], held[-2][mine])
            do = (ready & ~heavy & (sizes > 1))[group]
            if do.any():
                a, b = _forest(group[do], rows[do])
                yield out(0, a, b, np.zeros_like(a))
            stay = ~ready[group]
            held = [x[stay] for x in held]

    return run


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def links(distinct: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): links among distinct fingerprints (column ``fp``) with the connectivity of all links."""
    anchors = arrow_map(distinct.select("fp"), "anchor long, fp long", _to_anchors)
    found = written(
        anchors.repartition("anchor")
        .sortWithinPartitions("anchor", "fp")
        .mapInArrow(_links(bucket_rows, 1), "kind int, a long, b long"),
        "simhash-links",
    )
    large = found.where("kind = 1").select(F.col("a").alias("bucket"), F.col("b").alias("fp"))
    second = written(
        arrow_map(large, "bucket long, anchor long, fp long", _to_second_anchors)
        .repartition("bucket", "anchor")
        .sortWithinPartitions("bucket", "anchor", "fp")
        .mapInArrow(_links(bucket_rows, 2), "kind int, a long, b long, quarter long"),
        "simhash-links",
    )
    larger = second.where("kind = 1").select(F.col("a").alias("bucket"), "quarter", F.col("b").alias("fp"))
    third = (
        arrow_map(larger, "bucket long, quarter long, anchor long, fp long", _to_third_anchors)
        .repartition("bucket", "quarter", "anchor")
        .sortWithinPartitions("bucket", "quarter", "anchor", "fp")
        .mapInArrow(_links(None, 3), "kind int, a long, b long, quarter long")
    )
    return found.where("kind = 0").union(second.where("kind = 0").drop("quarter")).union(third.drop("quarter")).select("a", "b").distinct()


def _beside_lowest(edges: DataFrame, count: int) -> DataFrame:
    """``edges`` (u, v) with ``low``, the smallest v of u."""
    found = edges.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("degree"))
    return beside(edges, found, "u", count)


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root): the smallest node each node of ``edges`` (a, b) is connected with.

    Large-star and small-star steps alternate until a round changes no edge. Each step is a table in the
    shared folder, so that its plan does not hold that of the step before many times over (the driver keeps
    every plan); the one before is removed. Minima are aggregated before the shuffle, and the edges of
    nodes with very many neighbours are not dealt by the node.
    """

    def each(found: DataFrame, names: tuple[str, str], *pairs: tuple[str, str]) -> DataFrame:
        """A row for each pair of columns of every row; unlike a union, it reads ``found`` once."""
        return found.select(F.inline(F.array(*(F.struct(*(F.col(c).alias(n) for c, n in zip(pair, names))) for pair in pairs))))

    now = written(edges.where("a <> b").distinct(), "edges")
    count = now.count()
    for _ in range(max_rounds):
        both = each(now, ("u", "v"), ("a", "b"), ("b", "a"))
        large = _beside_lowest(both, 2 * count).where("v > u").withColumn("low", F.least("u", "low"))
        down = written(large.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct(), "edges")
        small = _beside_lowest(down, 2 * count)
        stars = each(small, ("a", "b"), ("v", "low"), ("u", "low"))
        after = written(stars.where("a <> b").distinct(), "edges")
        discard(down)
        before, count = count, after.count()
        # Both tables hold distinct rows, so they are equal if as many and none is new.
        settled = count == before and after.join(now, ["a", "b"], "left_anti").isEmpty()
        discard(now)
        now = after
        if settled:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError("components did not settle")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """(``id_col``, ``fp``, ``component_id``) for every row of ``df``.

    ``component_id`` is the smallest id reachable over links, the row's own included. Rows whose id is
    null take part; they get the smallest id that is not null, or null if there is none. An empty table
    gives an empty result. Other columns of ``df`` are not read.
    """
    rows = written(fingerprints(df, id_col, text_col).withColumnRenamed(id_col, "_id"), "fingerprints")
    firsts = rows.groupBy("fp").agg(F.min("_id").alias("first_id"), F.count("*").alias("degree"))
    stars = components(links(firsts, bucket_rows))
    rooted = written(firsts.join(stars.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("degree"))
    by_fp = beside(rooted, lowest, "root", rooted.count()).select("fp", "component_id", "degree")
    return beside(rows, by_fp, "fp", rows.count()).select(F.col("_id").alias(id_col), "fp", "component_id")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    from findmill.llm.common import read_table

    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
