import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from findmill.llm import anchor_simhash as S

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text: str | None) -> int:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps: list[int]) -> list[int]:
    """For each fingerprint the position of the smallest one reachable."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(fps))]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aBÉ \n　x", max_size=60))
def test_fingerprints_equal_brute_force(text):
    assert S._fingerprint(text.encode()) == brute_fingerprint(text)


def test_query_equals_brute_force(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    fps = [brute_fingerprint(t) for _, t in docs]
    want = {docs[i][0]: (f"{fps[i]:016x}", docs[r][0]) for i, r in enumerate(brute_components(fps))}
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op7_simhash(spark, SF).collect()}
    assert found == want


def test_anchors_cover_and_meet():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 32, 500, dtype=np.uint64)
    rows, anchors = S.covering_anchors(words, 31)
    assert set(np.bincount(rows).tolist()) <= {2, 17}
    assert (S._syndrome(anchors >> np.uint64(1), 31) == 0).all()
    assert (np.bitwise_count(words[rows] ^ anchors) <= 2).all()
    sets = [set(anchors[rows == i].tolist()) for i in range(len(words))]
    for bit in range(32):
        near, met = S.covering_anchors(words ^ np.uint64(1 << bit), 31)
        assert all(sets[i] & set(met[near == i].tolist()) for i in range(0, len(words), 25))


@pytest.mark.parametrize("bucket_rows", [4, 4096])
def test_links_connect_what_brute_force_connects(spark, bucket_rows):
    """Dense clusters; the small bucket limit sends most rows through the second level of anchors."""
    rng = np.random.default_rng(2)
    fps = {int(x) for x in rng.integers(0, 1 << 64, 60, dtype=np.uint64)} | {0, (1 << 64) - 1}
    for seed in list(fps)[:12]:
        for n in range(25):
            flips = rng.choice(64, int(rng.integers(1, 7)), replace=False)
            fps.add(seed ^ sum(1 << int(b) for b in flips))
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    stars = {r.node: r.root for r in S.components(S.links(df, bucket_rows)).collect()}
    want = brute_components(fps)
    for i in range(len(fps)):
        for j in range(i):
            together = stars.get(signed[i], signed[i]) == stars.get(signed[j], signed[j])
            assert together == (want[i] == want[j])


def test_large_buckets_split_over_batches():
    """One bucket above the limit arrives in several batches: all its rows are passed on."""
    import pyarrow as pa

    keys = np.array([1] * 3 + [2] * 9 + [3] * 2)
    fps = np.arange(len(keys))
    batches = [
        pa.RecordBatch.from_arrays([pa.array(keys[a : a + 4]), pa.array(fps[a : a + 4])], ["anchor", "fp"]) for a in range(0, len(keys), 4)
    ]
    out = [r for b in S._links(5, 1)(iter(batches)) for r in b.to_pylist()]
    assert sorted(r["b"] for r in out if r["kind"] == 1) == list(range(3, 12))


def test_long_chains_settle(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(500, 499)], "a long, b long")
    found = {r.node: r.root for r in S.components(edges).collect()}
    assert all(found[i] == 0 for i in range(1, 201)) and found[500] == 499


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(4, None, 1), (2, "", 1), (9, " \n", 1), (None, "", 1), (7, "alpha beta gamma delta", 1), (7, "alpha beta gamma delta", 1), (None, "lone words here", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    found = sorted(((r.doc_id or -1), r.component_id or -1) for r in S.near_duplicates(df).collect())
    assert found == [(-1, -1), (-1, 2), (2, 2), (4, 2), (7, 7), (7, 7), (9, 2)]
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_no_step_of_components_has_a_plan_that_holds_those_before(spark, monkeypatch):
    """The driver keeps every plan: a step reads the table of edges a few times, not a hundred."""
    reads, kept = [], S.written

    def counted(df, name):
        reads.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return kept(df, name)

    monkeypatch.setattr(S, "written", counted)
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40, 2)] + [(100, i) for i in range(40)], "a long, b long")
    found = {r.node: r.root for r in S.components(edges).collect()}
    assert found == {i: 0 for i in [*range(1, 40), 100]}
    assert max(reads) <= 8
