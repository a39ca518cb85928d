import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from findmill.llm import collocations as C
from findmill.llm.common import read_table

SF = "/root/testdata/sf0.001"


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", x) for x in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, top=2000, longest=3, least=10, percent=50):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for ws in pieces(text):
            totals[lang] += len(ws)
            for n in range(1, longest + 1):
                counts[lang].update(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
    out = []
    for lang, f in counts.items():
        made = []
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                continue
            score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            made.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(made)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 3), st.integers(2, 8), st.integers(0, 12), st.integers(0, 10**6))
def test_filters_lose_nothing(words, id_bytes, slice_bits, seed):
    """Cut into slices, read back, merged with another shard: the ids and sums of plain counting."""
    if words == 1:
        return
    pick = np.random.default_rng(seed)
    layout = C.Filter(id_bytes, min(slice_bits, 8 * id_bytes - 4))
    want, filters = Counter(), defaultdict(list)
    for _ in range(3):
        grams = {tuple(pick.integers(0, min(40, 1 << (8 * id_bytes)), words).tolist()) for _ in range(60)} | {tuple(int(x) for x in pick.integers(0, 1 << (8 * id_bytes), words, dtype=np.uint64)) for _ in range(5)}
        counts = pick.choice([1, 2, 254, 255, 256, 10**12], len(grams))
        want.update(dict(zip(grams, counts.tolist())))
        lanes = [np.array(x, np.uint64) for x in zip(*grams)]
        for at, entries, packed in layout.cut(lanes, counts):
            filters[at].append(layout.read(at, words, entries, packed))
    got = {}
    for parts in filters.values():
        lanes, sums = layout.merge(parts, 3)
        got.update(zip(zip(*(x.tolist() for x in lanes)), sums.tolist()))
    assert got == {k: v for k, v in want.items() if v >= 3}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=20), st.sampled_from([16, 24, 48, 56, 64]), st.integers(2, 3))
def test_the_map_goes_back(values, bits, words):
    lanes = [np.array(values, np.uint64) >> np.uint64(64 - bits)] * words
    there = C.permuted(lanes, bits)
    assert all((x < (1 << bits) if bits < 64 else np.ones(len(x), bool)).all() for x in there)
    assert [x.tolist() for x in C.permuted(there, bits, back=True)] == [x.tolist() for x in lanes]


TEXT = st.text(alphabet="aAbÄ é\t\n.,\x00\x1c\x85　", max_size=80)


def shard_counts(rows, **sizes):
    layout = C.Filter(6, 2)
    shard = C.Shard(layout, 3, {})
    made, lists = [], Counter()
    for lang, text in rows:
        made += shard.add(lang, text.encode())
    made += shard.flush()
    for _, words, entries, counts in made:
        if words == 1:
            keys = entries.split(C._JOIN)
            for key, n in zip(keys, C.unpack_counts(counts, len(keys)).tolist()):
                lists[(key,)] += n
    ids = {C.word_id(k[0], 6): k[0] for k in lists}
    for at, words, entries, counts in made:
        if words > 1:
            lanes, sums = layout.merge([layout.read(at, words, entries, counts)], 1)
            for *gram, n in zip(*(x.tolist() for x in lanes), sums.tolist()):
                lists[tuple(ids[x] for x in gram)] += n
    return {tuple(x.split(b"\xff")[1].decode() for x in k): n for k, n in lists.items()}


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=6), st.sampled_from([3, 7, 1 << 20]), st.sampled_from([4, 11, 10**6]), st.sampled_from([3, 5, 400_000]))
def test_shards_cut_anywhere(texts, part, words, most):
    """Texts in small parts, tiny shards and few local ids: all phrases are counted, each once."""
    want = Counter()
    for text in texts:
        for ws in pieces(text):
            for n in (1, 2, 3):
                want.update(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
    old = C.PART, C.SHARD_WORDS, C.MOST_WORDS, C.FILTER_ENTRIES
    C.PART, C.SHARD_WORDS, C.MOST_WORDS, C.FILTER_ENTRIES = part, words, most, part
    try:
        assert shard_counts([("en", t) for t in texts]) == want
    finally:
        C.PART, C.SHARD_WORDS, C.MOST_WORDS, C.FILTER_ENTRIES = old


def corpus(seed, n=300):
    pick = random.Random(seed)
    words = [*"abcdefgh", "The", "É", "nbsp x"]
    return [(pick.choice(["en", "de", None, "und"]), pick.choice([" ", ". ", "\n", "  "]).join(" ".join(pick.choices(words, range(1, 12), k=pick.randint(1, 9))) for _ in range(5))) for _ in range(n)]


@pytest.mark.parametrize("more", [{}, {"longest": 2}, {"least": 3, "top": 7, "cover_percent": 20}, {"id_bytes": 2}, {"id_bytes": 8}])
def test_collocations_equal_brute_force(spark, more):
    """Null and clashing columns, repeated rows, odd texts, a phrase in all texts; two-byte ids share words' ids."""
    rows = corpus(1) + [(None, None), ("en", ""), ("fr", " \t.\n"), ("en", "in all the texts " * 40), ("es", "x " * 50_000)] + [("en", f"in all the texts w{i} w{i + 1}") for i in range(900)]
    df = spark.createDataFrame([(a, b, 1, "p") for a, b in rows], "lang string, text string, n int, phrase string").repartition(5)
    names = {"cover_percent": "percent"}
    want = brute(rows, **{names.get(k, k): v for k, v in more.items() if k != "id_bytes"})
    assert found(C.collocations(df, **more)) == want and want


def test_empty_and_hot(spark):
    assert C.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    rows = [("en", "Same words here, same words there")] * 500
    assert found(C.collocations(spark.createDataFrame(rows, "lang string, text string"))) == brute(rows)
    with pytest.raises(ValueError):
        C.collocations(spark.createDataFrame(rows, "lang string, text string"), longest=4)


def test_scores_beyond_64_bits_are_exact(spark):
    """The division that the query uses, on counts whose products pass 64 bits."""
    rows = [(10**12 + 7, 10**12 + 9, 3 * 10**12 + 1), (10**13 - 1, 10**13 - 1, 10**13 - 1), (10, 10**12, 10)]
    df = spark.createDataFrame(rows, "a long, l long, r long").selectExpr(*(f"cast({c} as decimal(13,0)) {c}" for c in "alr"))
    made = df.selectExpr("(cast(1000000 as int) * a * a) div (l * r) AS x").collect()
    assert [r.x for r in made] == [10**6 * a * a // (l * r) for a, l, r in rows]


def test_query_equals_brute_force(spark):
    rows = [(r.lang, r.text) for r in read_table(spark, SF, "documents").collect()]
    assert found(C.op12_collocations(spark, SF)) == brute(rows)


def test_a_shard_is_counted_in_little_memory():
    """Two and a half million words, most of them different phrases: what is held besides the words is a few filters."""
    pick = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(200_000)])
    texts = [" ".join(words[pick.integers(0, len(words), 10_000)]).encode() for _ in range(249)]
    shard = C.Shard(C.Filter(6, 8), 3, {})
    for text in texts:
        assert not list(shard.add("en", text))
    tracemalloc.start()
    found = sum(C.unpack_counts(counts, _entries(shard, n, entries)).sum() for _, n, entries, counts in shard.flush() if n == 3)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 249 * 9_998
    assert most < 110e6


def _entries(shard, n, entries):
    buckets = shard.layout.buckets
    return int(C.unpack_counts(entries[: buckets + 8 * entries[:buckets].count(255)], buckets).sum())
