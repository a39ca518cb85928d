import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from findmill.llm import token_align as T
from findmill.llm.common import read_table

SF = "/root/testdata/sf0.001"
JSON, MODEL = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
A = Tokenizer.from_file(JSON)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def tokens(text):
    """(id, bytes) of both libraries over the whole text."""
    byte = T._byte_of_char()
    a = [(i, bytes(byte[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(B.id_to_piece(i)[3:-1], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()) for i in B.encode(text)]
    raw = (" " + text).encode()
    if not text or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
        return [], []
    return a, b


def spans(found):
    at, out = 0, []
    for i, raw in found:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def one(text):
    """(A ids, B ids, links, groups) by comparing spans."""
    a, b = map(spans, tokens(text or ""))
    links, j = [], 0
    for i, x, y in a:
        while j and b[j - 1][2] > x:
            j -= 1
        while j < len(b) and b[j][1] < y:
            if b[j][2] > x:
                links.append((i, b[j][0]))
            j += 1
    cuts = sorted({y for *_, y in a} & {y for *_, y in b})
    groups, low = [], 0
    by_end = [defaultdict(list), defaultdict(list)]
    for side, found in enumerate((a, b)):
        at = 0
        for i, _, y in found:
            while cuts[at] < y:
                at += 1
            by_end[side][at].append(str(i))
    groups = [f"{','.join(by_end[0][k])}|{','.join(by_end[1][k])}" for k in range(len(cuts))]
    return len(a), len(b), links, groups


def brute(rows):
    made = [(key, *one(text)) for key, text in rows]
    held = Counter(p for *_, links, _ in made for p in set(links))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    out = []
    for key, n_a, n_b, links, groups in made:
        out.append((key, n_a, n_b, len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), ";".join(groups)))
    return sorted(out, key=str)


def found(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return sorted((tuple(r) for r in T.align(df, JSON, MODEL).collect()), key=str)


ODD = st.text(alphabet=st.sampled_from(list("ab  \n\t\r.'\x00\x1c\x85\xa0▁éß漢字😀　<|>0")) | st.characters(codec="utf-8"), max_size=60)


@settings(max_examples=500, deadline=None)
@given(ODD)
def test_segments_have_the_ids_of_whole_texts(text):
    store = T.Segments(JSON, MODEL)
    at = np.concatenate(list(store.of(text)))
    a, b = tokens(text)
    good = all(store.good[i] for i in at)
    assert good == (not text or bool(a))
    if good and text:
        assert [x for i in at for x in store.ids_a[store.ends_a[i] : store.ends_a[i + 1]]] == [i for i, _ in a]
        assert [x for i in at for x in store.ids_b[store.ends_b[i] : store.ends_b[i + 1]]] == [i for i, _ in b]


@settings(max_examples=100, deadline=None)
@given(st.lists(ODD, max_size=4), st.sampled_from([1, 5, 1 << 20]))
def test_parts_cut_only_where_segments_end(texts, part):
    old, T.PART = T.PART, part
    try:
        store, whole = T.Segments(JSON, MODEL), " ".join(texts)
        at = np.concatenate(list(store.of(whole)))
        if all(store.good[i] for i in at) and whole:
            assert [x for i in at for x in store.ids_b[store.ends_b[i] : store.ends_b[i + 1]]] == [i for i, _ in tokens(whole)[1]]
    finally:
        T.PART = old


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 30)), st.sets(st.integers(1, 30)), st.integers(1, 30)), min_size=1, max_size=5))
def test_lockstep_meets_all_overlaps(docs):
    ends, starts, stops, want_links, want_cuts, base = [[], []], [[], []], [], set(), set(), 0
    for a, b, last in docs:
        sides = [sorted({x for x in side if x < last} | {last}) for side in (a, b)]
        for s in (0, 1):
            starts[s].append(len(ends[s]))
        for i, y in enumerate(sides[0]):
            for j, z in enumerate(sides[1]):
                x, w = (sides[0][i - 1] if i else 0), (sides[1][j - 1] if j else 0)
                if max(x, w) < min(y, z):
                    want_links.add((starts[0][-1] + i, starts[1][-1] + j))
                if y == z:
                    want_cuts.add((starts[0][-1] + i, starts[1][-1] + j))
        for s in (0, 1):
            ends[s] += [base + x for x in sides[s]]
        stops.append(len(ends[0]))
        base += last
    made = T.lockstep(*(np.array(x) for x in (*ends, *starts, stops)))
    links = list(zip(made.link_a.tolist(), made.link_b.tolist()))
    assert len(links) == len(set(links)) and set(links) == want_links
    assert {p for p, c in zip(links, made.cut) if c} == want_cuts


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_packed_numbers_come_back(values):
    assert T.unpack(T.pack(np.array(values, np.uint32)), len(values)).tolist() == values
    assert T._sums(T._steps(np.array(values, np.uint32))).tolist() == values


WORDS = ["the", "alignment", "tokenizers", "Größe", "naïve", "漢字", "don't", "x" * 70, "1234", "<|endoftext|>", "</s>", "a\nb", "é😀"]


def test_odd_rows_equal_brute_force(spark):
    pick = random.Random(5)
    rows = [(i, " ".join(pick.choices(WORDS, k=pick.randint(1, 40)))) for i in range(120)]
    rows += [(None, "null id"), (None, "null id"), (3, "same id, other text"), (500, None), (501, ""), (502, " "), (503, "  two  spaces \n  "), (504, "▁lower block"), (505, "tail ")]
    rows += [(600, "\n ".join(WORDS) * 3), (601, "漢字かな" * 3000), (602, " ".join(pick.choices(WORDS, k=30_000)))] + [(700 + i, "a copy that is here often") for i in range(60)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("sizes", [(8, 40, 100, 30), (1, 1, 1, 1)])
def test_batches_blocks_and_salts_cut_anywhere(spark, sizes):
    """Texts over several batches, one document a block, several salts."""
    pick = random.Random(7)
    rows = [(i, " ".join(pick.choices(WORDS, k=50))) for i in range(8)]
    names = ("STRETCH", "BATCH_TOKENS", "BLOCK_TOKENS", "PART")
    want = brute(rows)
    old = {n: getattr(T, n) for n in names} | {"MOST_SEGMENTS": T.MOST_SEGMENTS}
    for n, v in zip(names, sizes):
        setattr(T, n, v)
    T.MOST_SEGMENTS = 3
    try:
        blocks, block, counts = [], T.Block(T.Segments(JSON, MODEL), False), Counter()
        for key, text in rows:
            block.add(key, text)
            if block.full():
                blocks.append(block.row())
        if block.keys:
            blocks.append(block.row())
    finally:
        for n, v in old.items():
            setattr(T, n, v)
    for row in blocks:
        pairs = T._sums(T.unpack(row["pairs"], row["n_pairs"]))
        counts.update(dict(zip(pairs.tolist(), T.unpack(row["held"], row["n_pairs"]).tolist())))
    assert sum(len(b["key"]) for b in blocks) == 8 and len(blocks) > 3
    got = [(k, *b["totals"][4 * i : 4 * i + 4], g) for b in blocks for i, (k, g) in enumerate(zip(b["key"], b["groups"]))]
    assert sorted(got) == [(w[0], *w[1:5], w[7]) for w in want]
    held = Counter(p for _, text in rows for p in set(one(text)[2]))
    assert counts == {(a << 16) | b: n for (a, b), n in held.items()}
    old, T.BLOCKS_PER_SALT = T.BLOCKS_PER_SALT, 2
    try:
        assert found(spark, rows, 8) == want
    finally:
        T.BLOCKS_PER_SALT = old


def test_empty_and_extra_columns(spark):
    assert T.align(spark.createDataFrame([], "doc_id long, text string"), JSON, MODEL).count() == 0
    df = spark.createDataFrame([("a", "some text", 1, 2)], "doc_id string, text string, n_a int, key int")
    assert [tuple(r) for r in T.align(df, JSON, MODEL).collect()] == brute([("a", "some text")])


def test_other_vocabularies_are_refused(tmp_path):
    (tmp_path / "v.json").write_text(open(JSON, encoding="utf-8").read().replace('"add_prefix_space":false', '"add_prefix_space":true').replace('"add_prefix_space": false', '"add_prefix_space": true'))
    with pytest.raises(ValueError):
        T.byte_level(str(tmp_path / "v.json"))


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in read_table(spark, SF, "documents").collect()]
    want = [(*w[:7], hashlib.sha256(w[7].encode()).hexdigest() if w[7] else "") for w in brute(rows)]
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted((tuple(r[n] for n in names) for r in T.op11_alignment(spark, SF).collect()), key=str) == sorted(want, key=str)
