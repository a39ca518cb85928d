"""Cross-tokenizer alignment: two tokenizations of the same bytes, merged in lockstep.

Vocabulary A is byte-level BPE (a tokenizers JSON), B a SentencePiece model with byte fallback; A sees the text
behind a space, which B adds by itself. Both are encoded by stretches that begin at a space behind a visible character: no match
of A's pattern spans such a place, and no piece of B has a space behind another character (checked), so a stretch
has the same ids wherever it stands, and the ids of frequent stretches are looked up.

The merge holds one NumPy state vector: for every stretch of every document of a batch a pointer into A's token ends and one into
B's. Each step emits the pair under the pointers as a link, advances the side that ends first, or both, which is a
cut, and compacts away what is finished. Stretches begin at cuts, so long documents do not take more steps.

Corpus-wide counts of id pairs: a task gathers blocks of documents. A block stores its different pairs with their document
counts, and each document's pairs as places in that list. Pairs are cut by a hash of A's id into ``SLICES`` slices,
so no slice has more than |A| |B| / SLICES pairs, however large the corpus. Per slice counts are summed (blocks are dealt over salts
first), the highest of each A id marked, and the answers go back to the blocks. No link is shuffled, only the
different pairs of a block.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findmill.llm.bpe_codec import encode_text
from findmill.llm.common import read_table, written

SLICES, BLOCKS_PER_SALT = 256, 4096
#: Tokens that a stretch of the state vector has at least, tokens that a batch and a block have about, characters split at a time.
STRETCH, BATCH_TOKENS, BLOCK_TOKENS, PART = 1024, 1_000_000, 2_000_000, 1 << 20
MOST_SEGMENTS, LONG_SEGMENT = 300_000, 100
_CUT = re.compile(r"(?<=\S)(?= )")
#: Fixed value: the pattern of byte-level pre-tokenization.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a visible character: itself, or the next one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {**{chr(b): b for b in visible}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


@lru_cache(maxsize=2)
def byte_level(path: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    """A's encoding and the bytes of each id, from a tokenizers JSON.

    Its ids must rise with its merges, as the encoder merges by id; another vocabulary or pre-tokenizer is refused.
    """
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    model, byte = given["model"], _byte_of_char()
    special = {x["content"] for x in given["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    made = [model["vocab"][m] for m in merges]
    pre = given["pre_tokenizer"]
    if made != list(range(256, 256 + len(made))) or given["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
        raise ValueError("a byte-level BPE whose ids follow its merges is needed")
    raw = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        raw[i] = token
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), raw


@lru_cache(maxsize=2)
def pieces(path: str):
    """B's model and the bytes of each id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(re.search("[^▁]▁", x) for x in names):
        raise ValueError("a piece with a space behind another character")
    raw = [bytes([int(x[3:-1], 16)]) if model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
    for i in range(len(raw)):
        if model.is_control(i) or model.is_unknown(i):
            raw[i] = b"\xff"  # never equal to a text's bytes
    return model, raw


class _Common(dict):
    """Segments behind a space, by text; -1 for those that may not stand alone before another space."""

    def __init__(self, owner: Segments):
        self.owner = owner

    def __missing__(self, word: str) -> int:
        if not word or word[-1].isspace():
            return -1
        at = self.owner.encode(word)
        if len(word) < LONG_SEGMENT:
            self[word] = at
        return at


class Segments:
    """Ids of segments under both vocabularies, as they are met; each begins with a space."""

    def __init__(self, path_a: str, path_b: str):
        (self.codec, self.raw_a), (self.model, self.raw_b) = byte_level(path_a), pieces(path_b)
        if max(len(self.raw_a), len(self.raw_b)) > 1 << 16:
            raise ValueError("ids of 16 bits are needed")
        self.prefix = self.model.encode("x", num_threads=1)
        self.bytes_a, self.bytes_b = (np.array([len(x) for x in raw], np.int64) for raw in (self.raw_a, self.raw_b))
        self.clear()

    def clear(self) -> None:
        self.known = _Common(self)
        self.ids_a, self.ids_b = array("H"), array("H")
        self.ends_a, self.ends_b, self.good = array("q", [0]), array("q", [0]), array("b")

    def full(self) -> bool:
        return len(self.known) > MOST_SEGMENTS or len(self.ids_a) > 8 * MOST_SEGMENTS

    def encode(self, word: str) -> int:
        text = " " + word
        a = encode_text(self.codec, text)
        b = self.model.encode("x" + text, num_threads=1)
        good = b[: len(self.prefix)] == self.prefix
        b = b[len(self.prefix) :]
        raw = text.encode()
        good = good and b"".join(map(self.raw_a.__getitem__, a)) == raw == b"".join(map(self.raw_b.__getitem__, b))
        if good:
            self.ids_a.extend(a)
            self.ids_b.extend(b)
        self.ends_a.append(len(self.ids_a))
        self.ends_b.append(len(self.ids_b))
        self.good.append(good)
        return len(self.good) - 1

    def of(self, text: str) -> Iterator[np.ndarray]:
        """Places of the segments of a text, part by part."""
        text, at = " " + text, 0
        while at < len(text):
            cut = _CUT.search(text, at + PART) if len(text) - at > PART else None
            end = cut.start() if cut else len(text)
            *words, last = text[at + 1 : end].split(" ")
            found = list(map(self.known.__getitem__, words))
            if -1 in found:
                yield np.array([self._one(x[1:]) for x in _CUT.split(text[at:end])], np.int64)
            else:
                yield np.array([*found, self._one(last)], np.int64)
            at = end

    def _one(self, word: str) -> int:
        """A segment that ends where it may, whatever it ends with."""
        at = self.known[word]
        return self.encode(word) if at < 0 else at


class Merged(NamedTuple):
    link_a: np.ndarray
    link_b: np.ndarray
    cut: np.ndarray


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, starts_a: np.ndarray, starts_b: np.ndarray, stops_a: np.ndarray) -> Merged:
    """All pairs of tokens that overlap, by step, and which of them end together.

    ``ends_*`` are byte offsets; entry i of the state goes from (starts_a[i], starts_b[i]) until A's pointer is at stops_a[i].
    """
    most = len(ends_a) + len(ends_b)
    link_a, link_b, cut = np.empty(most, np.int64), np.empty(most, np.int64), np.empty(most, bool)
    a, b, stop, at = starts_a, starts_b, stops_a, 0
    while len(a):
        to = at + len(a)
        x, y = ends_a[a], ends_b[b]
        step_a, step_b = x <= y, y <= x
        link_a[at:to], link_b[at:to], cut[at:to] = a, b, step_a & step_b
        a, b, at = a + step_a, b + step_b, to
        live = a < stop
        if not live.all():
            a, b, stop = a[live], b[live], stop[live]
    return Merged(link_a[:at], link_b[:at], cut[:at])


def _gather(flat: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the rows ``at`` of a ragged array, and how many each has."""
    sizes = ends[at + 1] - ends[at]
    shift = np.repeat(ends[at] - np.append(0, np.cumsum(sizes)[:-1]), sizes)
    return flat[shift + np.arange(len(shift))], sizes


@lru_cache(maxsize=1)
def _written_ids() -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids followed by ',', '|' or ';', six bytes each, and their lengths: row 3 * id + kind."""
    rows = [f"{i}{mark}".encode() for i in range(1 << 16) for mark in ",|;"]
    return np.frombuffer(b"".join(r.ljust(6) for r in rows), np.uint8).reshape(-1, 6), np.array([len(r) for r in rows], np.int64)


class Batch:
    """Segments of several documents under both vocabularies, merged."""

    def __init__(self, store: Segments, parts: list[np.ndarray]):
        at = np.concatenate(parts)
        flat = [np.frombuffer(x, np.uint16) for x in (store.ids_a, store.ids_b)]
        ends = [np.frombuffer(x, np.int64) for x in (store.ends_a, store.ends_b)]
        self.ids_a, sizes_a = _gather(flat[0], ends[0], at)
        self.ids_b, sizes_b = _gather(flat[1], ends[1], at)
        # A stretch begins with each part, and with the segment that passes another STRETCH tokens.
        after_a, after_b = np.append(0, np.cumsum(sizes_a)), np.append(0, np.cumsum(sizes_b))
        first = np.append(0, np.cumsum([len(p) for p in parts]))
        begin = np.append(True, np.diff(after_a[:-1] // STRETCH) > 0)
        begin[first[:-1]] = True
        begin = np.flatnonzero(begin)
        starts_a, starts_b = after_a[begin], after_b[begin]
        stops_a = np.append(starts_a[1:], after_a[-1])
        self.ends_a, self.ends_b = np.cumsum(store.bytes_a[self.ids_a]), np.cumsum(store.bytes_b[self.ids_b])
        self.links = lockstep(self.ends_a, self.ends_b, starts_a, starts_b, stops_a)
        #: Tokens before each part, and before its end.
        self.part_a, self.part_b = after_a[first], after_b[first]
        self.cut_a, self.cut_b = (np.sort(x[self.links.cut]) for x in self.links[:2])
        self.part_groups = np.searchsorted(self.cut_a, self.part_a)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The part of each link, and its id pair: A's id in the upper 16 of 32 bits."""
        part = np.searchsorted(self.part_a, self.links.link_a, side="right") - 1
        pair = (self.ids_a[self.links.link_a].astype(np.uint64) << np.uint64(16)) | self.ids_b[self.links.link_b]
        return part, pair

    def groups(self) -> list[bytes]:
        """For each part its groups, ``a1,a2|b1;a3|b2,b3;``."""
        n_a, n_b = len(self.ids_a), len(self.ids_b)
        in_a, in_b = np.searchsorted(self.cut_a, np.arange(n_a)), np.searchsorted(self.cut_b, np.arange(n_b))
        before_b = np.append(0, self.cut_b[:-1] + 1)
        code = np.empty(n_a + n_b, np.int64)
        last_a, last_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
        last_a[self.cut_a], last_b[self.cut_b] = 1, 2
        code[np.arange(n_a) + before_b[in_a]] = self.ids_a.astype(np.int64) * 3 + last_a
        code[np.arange(n_b) + self.cut_a[in_b] + 1] = self.ids_b.astype(np.int64) * 3 + last_b
        chars, sizes = _written_ids()
        size = sizes[code]
        text = chars[code][np.arange(6) < size[:, None]].tobytes()
        ends = np.append(0, np.cumsum(size))[self.part_a + self.part_b]
        return [text[a:b] for a, b in zip(ends[:-1], ends[1:])]


def pack(x: np.ndarray) -> bytes:
    """Numbers of 32 bits as compressed planes of bytes."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4")


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x.astype(np.uint32), prepend=np.uint32(0))


def _sums(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=np.uint32)


def slice_of(pair: np.ndarray) -> np.ndarray:
    """Of a pair, by a hash of A's id."""
    return ((pair >> np.uint32(16)) * np.uint32(2654435761) >> np.uint32(20)) % np.uint32(SLICES)


def by_slice(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slices that pairs are in, the order that puts them together, and where each ends."""
    own = slice_of(pairs)
    order = np.argsort(own, kind="stable")
    own = own[order]
    ends = np.flatnonzero(np.append(own[1:] != own[:-1], True)) + 1 if len(own) else np.empty(0, np.int64)
    return own[ends - 1], order, ends


class Block:
    """Documents of a task, until they have ``BLOCK_TOKENS`` tokens."""

    def __init__(self, store: Segments, digest: bool):
        self.store, self.digest = store, digest
        self._begin()

    def _begin(self) -> None:
        self.keys: list = []
        self.totals: list[list[int]] = []  # of each document: n_a, n_b, n_groups, n_links
        self.texts: list = []  # and its groups, as digest or pieces of text
        self.parts: list[tuple[int, np.ndarray]] = []
        self.waiting = self.tokens = 0
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        if self.store.full():
            self.store.clear()

    def add(self, key, text: str) -> None:
        doc = len(self.keys)
        self.keys.append(key)
        self.totals.append([0, 0, 0, 0])
        self.texts.append(None)
        mine = list(self.store.of(text)) if text else []
        good = np.frombuffer(self.store.good, np.int8)
        if not mine or not all(good[x].all() for x in mine):
            return
        del good  # a view keeps the array from growing
        self.texts[doc] = hashlib.sha256() if self.digest else []
        ends = np.frombuffer(self.store.ends_a, np.int64)
        sizes = [int((ends[x + 1] - ends[x]).sum()) for x in mine]
        del ends
        for part, size in zip(mine, sizes):
            self.parts.append((doc, part))
            self.waiting += 2 * size
            if self.waiting >= BATCH_TOKENS:
                self._merge()

    def _merge(self) -> None:
        if not self.parts:
            return
        docs = np.array([d for d, _ in self.parts])
        batch = Batch(self.store, [p for _, p in self.parts])
        part, pair = batch.pairs()
        links = np.bincount(part, minlength=len(docs))
        sizes = zip(*(x.tolist() for x in (np.diff(batch.part_a), np.diff(batch.part_b), np.diff(batch.part_groups), links)))
        for doc, more, text in zip(docs.tolist(), sizes, batch.groups()):
            begun = self.totals[doc][0] > 0
            self.totals[doc] = [x + y for x, y in zip(self.totals[doc], more)]
            text = (b";" if begun else b"") + text[:-1]
            self.texts[doc].update(text) if self.digest else self.texts[doc].append(text)
        self.found.append(np.unique((docs[part].astype(np.uint64) << np.uint64(32)) | pair, return_counts=True))
        self.tokens += len(batch.ids_a) + len(batch.ids_b)
        self.parts, self.waiting = [], 0

    def full(self) -> bool:
        return self.tokens + self.waiting >= BLOCK_TOKENS or len(self.keys) >= 1 << 20

    def row(self) -> dict:
        """The block as one row; the next one begins."""
        self._merge()
        keys = np.concatenate([np.empty(0, np.uint64), *(k for k, _ in self.found)])
        times = np.concatenate([np.empty(0, np.int64), *(n for _, n in self.found)])
        if len(self.found) > 1:  # a long document's parts may lie in several batches
            keys, inverse = np.unique(keys, return_inverse=True)
            times = np.bincount(inverse, times).astype(np.int64)
        pairs, place, held = np.unique((keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), return_inverse=True, return_counts=True)
        per_doc = np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=len(self.keys))
        texts = ["" if t is None else t.hexdigest() if self.digest else b"".join(t).decode() for t in self.texts]
        made = {
            "key": self.keys, "totals": [x for t in self.totals for x in t], "groups": texts, "per_doc": per_doc.tolist(), "n_links": len(keys), "n_pairs": len(pairs),
            "place": pack(_steps(place)), "times": pack(times), "pairs": pack(_steps(pairs)), "held": pack(held),
        }
        self._begin()
        return made


_BLOCK = "totals array<long>, groups array<string>, per_doc array<int>, n_links int, n_pairs int, place binary, times binary, pairs binary, held binary"
_KINDS = (pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.int32(), pa.int32(), *[pa.binary()] * 4)
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def blocks(df: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    """One row for each block of documents, stored."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, made = Block(Segments(path_a, path_b), digest), 0

        def out(key_type: pa.DataType) -> pa.RecordBatch:
            nonlocal made
            number = (TaskContext.get().partitionId() << 32) + made
            made += 1
            row = block.row()
            kinds = (pa.int64(), pa.list_(key_type), *_KINDS)
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip([number, *row.values()], kinds)], ["block", *row])

        for batch in batches:
            key_type = batch.column(0).type
            for key, text in zip(*batch.columns):
                block.add(key.as_py(), text.as_py())
                if block.full():
                    yield out(key_type)
        if block.keys:
            yield out(key_type)

    found = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(run, f"block long, key array<{kind}>, {_BLOCK}")
    return written(found, "aligned")


def _slices(stored: DataFrame, salts: int) -> DataFrame:
    """(slice, salt, block, n, pairs, held): each block's pairs, cut by slice."""
    names = ["slice", "salt", "block", "n", "pairs", "held"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, n, pairs, held in zip(*(x.to_pylist() for x in batch.columns)):
                pairs, held = _sums(unpack(pairs, n)), unpack(held, n)
                slices, order, ends = by_slice(pairs)
                rows = [(int(s), (number ^ (number >> 32)) % salts, number, len(i), pack(_steps(pairs[i])), pack(held[i])) for s, i in zip(slices, np.split(order, ends[:-1]))]
                if rows:
                    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    return stored.select("block", "n_pairs", "pairs", "held").mapInArrow(run, "slice int, salt int, block long, n int, pairs binary, held binary")


def _summed(table: pa.Table, n: str, counts) -> tuple[np.ndarray, np.ndarray]:
    sizes, pairs = table.column(n).to_pylist(), table.column("pairs").to_pylist()
    pairs, inverse = np.unique(np.concatenate([_sums(unpack(p, k)) for p, k in zip(pairs, sizes)]), return_inverse=True)
    total = np.zeros(len(pairs), np.int64)
    np.add.at(total, inverse, np.concatenate(counts(table, sizes)))
    return pairs, total


def _longs(x: np.ndarray) -> bytes:
    return x.astype("<i8").tobytes()


def pair_counts(cut: DataFrame) -> DataFrame:
    """(slice, n, pairs, counts, best): in how many documents each pair is linked, and whether that is its A id's highest."""

    def by_salt(table: pa.Table) -> pa.Table:
        pairs, total = _summed(table, "n", lambda t, sizes: [unpack(h, k) for h, k in zip(t.column("held").to_pylist(), sizes)])
        return pa.table({"slice": table.column("slice")[:1], "n": pa.array([len(pairs)], pa.int32()), "pairs": [pack(_steps(pairs))], "counts": [_longs(total)]})

    def by_slice_(table: pa.Table) -> pa.Table:
        pairs, total = _summed(table, "n", lambda t, sizes: [np.frombuffer(c, "<i8") for c in t.column("counts").to_pylist()])
        starts = np.flatnonzero(np.append(True, np.diff(pairs >> np.uint32(16)) > 0))
        highest = np.repeat(np.maximum.reduceat(total, starts), np.diff(np.append(starts, len(total))))
        best = (total == highest).astype(np.uint8).tobytes()
        return pa.table({"slice": table.column("slice")[:1], "n": pa.array([len(pairs)], pa.int32()), "pairs": [pack(_steps(pairs))], "counts": [_longs(total)], "best": [best]})

    salted = cut.groupBy("slice", "salt").applyInArrow(by_salt, "slice int, n int, pairs binary, counts binary")
    return salted.groupBy("slice").applyInArrow(by_slice_, "slice int, n int, pairs binary, counts binary, best binary")


def align(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row.

    A row is a document: repeated rows and ids count each. Null and empty texts, and those whose bytes one vocabulary does not give
    back, have no tokens: zeros and ''. ``groups`` is ``a1,a2|b1;a3|b2,b3``, or its SHA-256 with ``digest``. A link's count is the number of documents
    where its id pair is linked; ``n_best`` counts links whose count is the highest of their A id. Other columns are not looked at.
    """
    stored = blocks(df, path_a, path_b, id_col, text_col, digest)
    salts = 1 + stored.count() // BLOCKS_PER_SALT
    known = written(pair_counts(_slices(stored, salts)), "pair-counts")
    kind, key_name = df.schema[id_col].dataType.simpleString(), "key"

    def answer(cut: pa.Table, counts: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if cut.num_rows:
            (row,) = counts.to_pylist()
            pairs, total, best = _sums(unpack(row["pairs"], row["n"])), np.frombuffer(row["counts"], "<i8"), np.frombuffer(row["best"], np.uint8)
            for number, n, own in zip(*(cut.column(c).to_pylist() for c in ("block", "n", "pairs"))):
                at = np.searchsorted(pairs, _sums(unpack(own, n)))
                large = total[at] >= 1 << 32
                rows.append((number, row["slice"], n, pack(np.where(large, 0, total[at])), _longs(total[at][large]), np.packbits(np.append(best[at], large)).tobytes()))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        names = ("block", "slice", "n", "counts", "large", "flags")
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def finish(block: pa.Table, answers: pa.Table) -> pa.Table:
        (row,) = block.drop_columns(["key"]).to_pylist()
        pairs, n = _sums(unpack(row["pairs"], row["n_pairs"])), row["n_links"]
        counts, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        slices, order, ends = by_slice(pairs)
        given = {r["slice"]: r for r in answers.to_pylist()}
        for s, i in zip(slices.tolist(), np.split(order, ends[:-1])):
            r = given[s]
            flags = np.unpackbits(np.frombuffer(r["flags"], np.uint8), count=2 * len(i)).astype(bool)
            total = unpack(r["counts"], len(i)).astype(np.int64)
            total[flags[len(i) :]] = np.frombuffer(r["large"], "<i8")
            counts[i], best[i] = total, flags[: len(i)]
        place, times = _sums(unpack(row["place"], n)), unpack(row["times"], n).astype(np.int64)
        ends_ = np.cumsum(row["per_doc"])
        sums = [np.append(0, np.cumsum(x)) for x in (times * best[place], times * counts[place])]
        n_best, count_sum = (x[ends_] - x[ends_ - np.array(row["per_doc"])] for x in sums)
        totals = np.array(row["totals"], np.int64).reshape(-1, 4)
        columns = {key_name: block.column("key").combine_chunks().flatten(), **{c: totals[:, i] for i, c in enumerate(COUNTS)}, "n_best": n_best, "count_sum": count_sum}
        return pa.table({**columns, "groups": pa.array(row["groups"], pa.string())})

    spread = known.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    answers = _slices(stored, salts).groupBy("slice", "salt").cogroup(spread.groupBy("slice", "salt")).applyInArrow(
        answer, "block long, slice int, n int, counts binary, large binary, flags binary"
    )
    schema = f"{key_name} {kind}, {', '.join(f'{c} long' for c in (*COUNTS, 'n_best', 'count_sum'))}, groups string"
    made = stored.drop("held").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)
    return made.withColumnRenamed(key_name, id_col)


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    made = align(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), digest=True)
    return made.withColumnRenamed("groups", "groups_sha256")
