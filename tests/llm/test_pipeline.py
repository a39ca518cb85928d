from collections import defaultdict

import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from findmill.llm import secret_worklist

from test_fertility import brute_verdicts
from test_near_copies import brute

SF = "/root/testdata/sf0.001"


def brute_kept(docs: list[tuple]) -> dict[int, str]:
    """doc_id to text after quality rules, near-duplicates and redaction."""
    verdicts = brute_verdicts(docs)
    good = [(i, text) for i, text, _ in sorted(docs) if verdicts[i][1]]
    roots = brute([t for _, t in good])
    first = [x for i, x in enumerate(good) if roots[i] == i]
    out = {}
    for doc_id, text in first:
        spans = sorted((a, b) for a, b, *_ in secret_worklist.find(text.encode())[0])
        made, at = "", 0
        for a, b in spans:
            if a >= at:
                made += text[at:a] + "[SECRET]"
            at = max(at, b)
        out[doc_id] = made + text[at:]
    return out


def test_stages_keep_the_columns_and_their_decisions_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns and now.schema == docs.schema, name
        counts.append(now.count())
    assert counts[0] > counts[1] > counts[2] == counts[3]
    want = brute_kept([(r.doc_id, r.text, r.lang) for r in docs.collect()])
    assert {r.doc_id: r.text for r in now.collect()} == want
    assert now.where("n_chars <> length(text)").count() == 0


def test_run_packs_what_the_stages_keep(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    kept = brute_kept(docs)
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    found: dict[int, int] = defaultdict(int)
    places = set()
    for r in corpus_pipeline.run(spark, SF).collect():
        found[r.doc_id] += r.length
        places.update((r.sequence_id, r.offset + i) for i in (0, r.length - 1))
    assert found == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept.items()}
    assert all(at < 4096 for _, at in places)


def test_odd_rows(spark):
    table = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    kept = brute_kept(table)
    long = next(text for i, text, lang in sorted(table) if lang == "en" and kept.get(i) == text and len(text) > 800)
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, long, None, "s", len(long)), (3, long, None, "s", len(long)), (None, long + " x", "en", None, None)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    # All three rows with a text are near copies of each other; the one with the smallest id stays.
    assert [(r.doc_id, r.text) for r in docs.collect()] == [(3, long)]
    assert sum(r.length for r in corpus_pipeline.packing(spark, docs, SF).collect()) > 300
    assert corpus_pipeline.packing(spark, docs.limit(0), SF).count() == 0
