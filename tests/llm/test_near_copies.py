import corpus_pipeline
import numpy as np
import pytest

from findmill.llm import near_copies as N

SF = "/root/testdata/sf0.001"


def brute(texts: list[str]) -> list[int]:
    def shingles(t):
        words = t.lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return root


@pytest.mark.parametrize("part_rows", [2, 1024])
def test_components_equal_brute_force(spark, part_rows):
    words = [f"w{i * i % 997}" for i in range(300)]
    texts = [" ".join([*words[:at], f"new{at}", *words[at + 1 :]]) for at in range(0, 300, 9)]
    texts += [" ".join(words[:n]) for n in range(60, 300, 7)] + ["", "  ", "a b", "A  b", "a b c"]
    texts += [" ".join(words[:40] + [f"x{i}y{j}" for j in range(60)]) for i in range(20)]
    found = {r.doc_id: r.component_id for r in N.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), part_rows=part_rows).collect()}
    assert found == dict(enumerate(brute(texts)))


def test_the_stage_drops_near_copies_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(texts)
    want = {i for i, r in zip(ids, brute([texts[i] for i in ids])) if i == ids[r]}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()} == want


def test_rows_without_ids_take_part(spark):
    words = [f"w{i}" for i in range(100)]
    first, second, third = (" ".join([*words[:at], "new", *words[at + 1 :]]) for at in (2, 50, 97))
    df = spark.createDataFrame([(None, first), (None, first), (5, second), (None, third), (9, "other")], "doc_id long, text string")
    found = sorted(r.component_id for r in N.near_copies(df).collect())
    assert found == [5, 5, 5, 5, 9]
    assert N.near_copies(df.limit(0)).count() == 0


def test_every_word_has_its_anchors_within_four_bits():
    words = np.random.default_rng(1).integers(0, 1 << 23, 2000, np.uint32)
    anchors = N.golay_anchors(words)
    assert np.bitwise_count(anchors ^ words[:, None]).max() <= 4
    assert (N.golay_anchors(anchors[:, 0])[:, 0] == anchors[:, 0]).all()  # anchors are words of the code
    for i in range(23):  # words that differ in one bit meet
        other = N.golay_anchors(words ^ np.uint32(1 << i))
        assert (anchors[:, :, None] == other[:, None, :]).any(axis=(1, 2)).all()


def test_recall_of_pairs_at_the_threshold():
    rng, met, n = np.random.default_rng(2), 0, 500
    for _ in range(n):
        both, one, other = (rng.integers(0, 2**63, k, np.uint64) for k in (160, 20, 20))
        a, b = (np.unique(np.concatenate([both, x])) for x in (one, other))
        assert N.similar(a, b)
        prints = np.stack([N.wide_fingerprint(a), N.wide_fingerprint(b)])
        x, y = N.keys(np.stack([N.least_shingles(a), N.least_shingles(b)]), prints)
        met += np.count_nonzero(prints[0] != prints[1]) <= N.FAR and len(np.intersect1d(x, y)) > 0
    assert met >= 0.98 * n


def test_rows_and_not_ids_are_kept_or_dropped(spark):
    one, two = (" ".join(f"{w}{i}" for i in range(60)) for w in ("a", "b"))
    rows = [(1, one, "x"), (5, one, "y"), (5, two, "z"), (7, None, "n"), (7, "", "n"), (None, one + " end", "x"), (None, "c d e", "w"), (9, "f", "v"), (9, "f", "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = N.without_copies(df)
    assert found.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in found.collect()) == sorted([(1, one), (5, two), (7, ""), (0, "c d e"), (9, "f")])


def test_clashing_columns_come_back_as_they_are(spark):
    one = " ".join(f"a{i}" for i in range(60))
    rows = [(1, one, 7, "h", 8, 9, 10), (2, one + " end", 17, "i", 18, 19, 20), (3, "other", 27, "j", 28, 29, 30), (3, "other", 27, "j", 28, 29, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int, _text_hash string, _hash int, _gone int, rows int")
    assert sorted(map(tuple, N.without_copies(df).collect())) == [rows[0], rows[2]]


def test_the_filter_holds_back_no_wanted_text(spark):
    hashes = [(int(x),) for x in np.random.default_rng(4).integers(-(2**63), 2**63, 20_000)]
    given, wanted = spark.createDataFrame(hashes, "text_hash long"), spark.createDataFrame(hashes[:2000], "text_hash long")
    left = {r[0] for r in given.where(N._may_be(wanted)("text_hash")).collect()}
    assert {h for (h,) in hashes[:2000]} <= left and len(left) < 2600
    old, N.FILTER_BITS = N.FILTER_BITS, 1 << 16
    try:
        assert {h for (h,) in hashes} == {r[0] for r in given.where(N._may_be(given)("text_hash")).collect()}
        assert given.where(N._may_be(given.where("false"))("text_hash")).count() == 0
    finally:
        N.FILTER_BITS = old
