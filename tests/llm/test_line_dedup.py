import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from findmill.llm import line_dedup as L
from findmill.llm.common import read_table

SF = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows, min_chars=20, min_docs=3):
    """For each (id, text): lines, lines that go, and the text of those that stay."""
    holders = defaultdict(set)
    least = float("-inf")
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= min_chars:
                holders[key_of(line)].add(least if doc is None else doc)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if key_of(x) not in gone or gone[key_of(x)] == doc]
        out.append((doc, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abAÄ\n \t\r\x0b\x1c\x85 é", max_size=60), st.integers(1, 5))
def test_keys_equal_brute_force(text, least):
    found = [(i, k.decode()) for i, k in L.line_keys(text.encode(), least)]
    assert found == [(i, key_of(x)) for i, x in enumerate(text.split("\n")) if len(key_of(x)) >= least]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 5), st.integers(0, 2)), max_size=40), st.lists(st.integers(1, 9), min_size=1, max_size=9), st.lists(st.integers(0, 40), max_size=3), st.integers(2, 4))
def test_ranges_and_batches_cut_anywhere(rows, sizes, ranges, least):
    """Sorted rows (hash, document, place) in any ranges and batches: what goes is what the whole would give."""
    rows = sorted(rows, key=lambda r: (r[0], -r[1], r[2]))
    docs = defaultdict(set)
    for h, d, _ in rows:
        docs[h].add(d)
    want = {r for r in rows if len(docs[r[0]]) >= least and r[1] != max(docs[r[0]])}
    marks, aside, edges = set(), set(), defaultdict(set)
    cuts = [0, *sorted(min(c, len(rows)) for c in ranges), len(rows)]
    for a, b in zip(cuts, cuts[1:]):
        state, at, i, made = L._Stream(least), a, 0, []
        while at < b:
            part = rows[at : min(b, at + sizes[i % len(sizes)])]
            h, d, p = (np.array(x, np.int64) for x in zip(*part))
            made += state.take([h, h * 0, d, d * 0, p.astype(np.int32)])
            at, i = at + len(part), i + 1
        for kind, cols in [*made, *state.end()]:
            for h, d, p in zip(cols[0].tolist(), cols[2].tolist(), cols[4].tolist()):
                if kind == L._MARK:
                    marks.add((h, d, p))
                else:
                    edges[h].add(d)
                    if kind == L._ASIDE:
                        aside.add((h, d, p))
    marks |= {r for r in aside if len(edges[r[0]]) >= least and r[1] != max(edges[r[0]])}
    assert marks == want


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 300), min_size=1), st.integers(0, 20))
def test_bitmaps_come_back(dropped, more):
    n = max(dropped) + 1 + more
    bits = L.kept_lines(L.bitmap(np.array(sorted(dropped))), n)
    assert set(np.flatnonzero(~bits).tolist()) == dropped and len(bits) == n
    assert L.kept_lines(None, n).all()


def applied(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    made = L.apply_bitmaps(df, L.keep_bitmaps(df, **more))
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in made.collect()), key=str)


def test_odd_rows_equal_brute_force(spark):
    """Null and equal ids, null, empty and very long texts, repeated rows and lines, lines that most documents share."""
    pick = random.Random(3)
    pool = [f"  Line number {i} of the Pool, éèü  " for i in range(30)]
    hot = "THIS LINE IS IN NEARLY ALL OF THE DOCUMENTS"
    rows = [(i, "\n".join([hot, *pick.choices(pool, k=pick.randint(0, 6)), f"own line of document {i}", "short", "short"])) for i in range(400)]
    rows += [(None, hot), (None, hot + "\nx"), (None, None), (7, hot + "\n" + pool[0]), (7, hot + "\n" + pool[0]), (900, ""), (901, None)]
    rows += [(1000, "\n".join(f"line {i % 700} of a very long document" for i in range(60_000))), (1001, f"{hot.lower()}\n{hot}"), (-5, pool[3])]
    rows += [(i, "line 5 of a very long document") for i in (2000, 2001)]
    assert applied(spark, rows) == brute(rows)
    assert applied(spark, rows[:50], min_chars=3, min_docs=2) == brute(rows[:50], 3, 2)


def test_an_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert L.apply_bitmaps(empty, L.keep_bitmaps(empty)).count() == 0
    rows = [(i, "the same long line in every document", "a", 1, b"x", 5) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, doc int, keep binary, _lines_doc int")
    made = L.apply_bitmaps(df, L.keep_bitmaps(df))
    assert sorted((r.doc_id, r.kept, r.doc, bytes(r.keep), r.text) for r in made.collect()) == [(i, "" if i < 3 else rows[0][1], 1, b"x", rows[0][1]) for i in range(4)]
    assert made.columns == ["doc_id", "text", "doc", "keep", "_lines_doc", *L.LINES]


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_a_frequent_line_spreads_over_ranges(spark, partitions):
    rows = [(i, "one line that is in all of these documents") for i in range(3000)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert applied(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in read_table(spark, SF, "documents").collect()]
    want = [(d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, n, g, t in brute(rows)]
    found = L.op13_line_dedup(spark, SF).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in found), key=str) == sorted(want, key=str)
