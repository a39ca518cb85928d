import math

import numpy as np
import pytest

from findmill.llm import threshold_topk as T

SF = "/root/testdata/sf0.001"


def brute(rows, queries, k=5, scale=256):
    usable = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        e = tuple(math.floor(scale * float(x)) for x in v)
        usable[i] = min(e, usable.get(i, e))
    out = {}
    for q in queries:
        if q in usable:
            scores = [(-sum(a * b for a, b in zip(usable[q], v)), i) for i, v in usable.items() if i != q]
            for rank, (score, i) in enumerate(sorted(scores)[:k], 1):
                out[q, rank] = (i, -score)
    return out


def as_dict(df):
    return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in df.collect()}


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = T.op6_threshold(spark, SF)
    assert as_dict(found) == brute(rows, [i for i, _ in rows if i % 50 == 0])


@pytest.mark.parametrize("block_rows,query_rows", [(7, 3), (1000, 1000)])
def test_blocks_ties_and_bad_vectors(spark, block_rows, query_rows):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, 4) / 256]) for i in range(60)]
    rows += [(100, None), (150, [1.0, None, 0.0, 0.0]), (200, [float("nan")] * 4), (250, [math.inf, 0.0, 0.0, 0.0])]
    rows += [(300, [0.0] * 4), (5, rows[5][1]), (None, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    queries = df.where("vec_id % 50 = 0")
    found = T.top_k(queries, df, block_rows=block_rows, query_rows=query_rows)
    assert as_dict(found) == brute(rows, [0, 50, 100, 150, 200, 250, 300])


def test_fewer_candidates_than_k_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert as_dict(T.top_k(df.where("vec_id = 0"), df)) == {(0, 1): (1, 256 * 512)}
    assert T.top_k(df.limit(0), df).count() == 0
    assert T.top_k(df, df.limit(0)).count() == 0


def test_query_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    made = duckdb.connect()
    made.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = {(q, r): (v, s) for q, r, v, s in made.sql(T.ORACLE_SQL).fetchall()}
    assert as_dict(T.op6_threshold(spark, SF)) == want


def test_search_stops_before_the_end_of_the_lists():
    rng = np.random.default_rng(5)
    rows = rng.normal(0, 1, (4000, 8))
    rows[:, 1:] *= 0.05
    rows = np.floor(rows * 256).astype(np.int64)
    ids = np.arange(len(rows))
    order = np.argsort(rows, axis=0, kind="stable")
    ranked = np.take_along_axis(rows, order, axis=0)
    query = np.array([500, 3, 0, -2, 0, 1, 0, 0])
    best_ids, best, depth, scored = T.threshold_search(query, -1, ids, rows, order, ranked, 5)
    exact = rows @ query
    want = np.lexsort((ids, -exact))[:5]
    assert best_ids.tolist() == ids[want].tolist() and best.tolist() == exact[want].tolist()
    assert depth < len(rows) and scored < len(rows) / 2
    floor = int(best[-1])
    some = np.arange(0, len(rows), 2)  # another block: the floor of all stops it earlier and loses nothing
    part = rows[some]
    order = np.argsort(part, axis=0, kind="stable")
    ranked = np.take_along_axis(part, order, axis=0)
    alone = T.threshold_search(query, -1, ids[some], part, order, ranked, 5)
    known = T.threshold_search(query, -1, ids[some], part, order, ranked, 5, floor)
    assert known[0].tolist() == [i for i in best_ids.tolist() if i % 2 == 0]
    assert known[2] <= alone[2] and known[3] <= alone[3]


def test_products_beyond_64_bits_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e16]), (1, [1e16])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        T.top_k(df, df).collect()
