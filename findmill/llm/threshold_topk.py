"""Exact top-k by inner product with Fagin's threshold algorithm.

Candidates are dealt into blocks of about ``BLOCK_ROWS`` by a hash of their id, queries into blocks of
about ``QUERY_ROWS``; every pair of blocks is one bounded task group. Inside a group the candidates have
one sorted list for each dimension. For a query the lists are read from the end that its weight favours,
to growing depths; every candidate met is scored in full. No candidate that was not met can score more
than the sum of the weights times the next entries of the lists, so the search stops once that bound is
below the k-th best score. (An equal bound does not stop it: an equal score with a smaller id would win.)
The best k of each block are then ranked together.

Blocks share what is known of the k-th score: one block of candidates is searched first, and its k-th score
for a query is a floor under that of all candidates, so in every other block the search also stops once the
bound is below the floor, and only scores that reach it are handed on.

All arithmetic is on integers. The product of queries and candidates is inherent in an exact search of a
query set against all rows; blocks keep memory bounded and spread the work evenly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findmill.llm.common import read_table, written

BLOCK_ROWS = 4096
QUERY_ROWS = 2048
FIRST_DEPTH = 4


def _vectors(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    column = table.column("v").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.int64()))
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return table.column("id").to_numpy(), [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _matrix(ids: np.ndarray, vectors: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows by id, missing components 0; of rows with one id the lexicographically smallest counts."""
    out = np.zeros((len(ids), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    order = np.lexsort((*out.T[::-1], ids))
    ids, out = ids[order], out[order]
    first = np.ones(len(ids), bool)
    first[1:] = ids[1:] != ids[:-1]
    return ids[first], out[first]


def threshold_search(
    query: np.ndarray, own_id: int, ids: np.ndarray, rows: np.ndarray, order: np.ndarray, ranked: np.ndarray, k: int, floor: int | None = None
) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The k best (ids, scores) of one block for one query, the depth that was read, and how many were scored.

    Scores below ``floor`` are of no use. ``order`` holds, for each dimension, the rows by rising component; ``ranked`` the components so sorted.
    """
    n = len(ids)
    up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
    met = np.zeros(n, bool)
    met[ids == own_id] = True
    best_ids, best = np.empty(0, np.int64), np.empty(0, np.int64)
    depth, upto = 0, min(FIRST_DEPTH, n)
    while True:
        new = np.zeros(n, bool)
        new[order[n - upto : n - depth, up]] = True
        new[order[depth:upto, down]] = True
        if not len(up) and not len(down):
            new[:] = True  # every score is 0
        new &= ~met
        found = np.flatnonzero(new)
        met[found] = True
        best_ids = np.concatenate([best_ids, ids[found]])
        best = np.concatenate([best, rows[found] @ query])
        first = np.lexsort((best_ids, -best))[:k]
        best_ids, best = best_ids[first], best[first]
        if upto == n or new.all():
            break
        bound = int(ranked[n - 1 - upto, up] @ query[up] + ranked[upto, down] @ query[down])
        if len(best) == k and bound < best[-1] or floor is not None and bound < floor:
            break
        depth, upto = upto, min(upto + max(FIRST_DEPTH, upto // 2), n)
    scored = int(met.sum()) - int((ids == own_id).sum())
    if floor is not None:
        best_ids, best = best_ids[best >= floor], best[best >= floor]
    return best_ids, best, upto, scored


def _search_block(k: int):
    names = ["query_id", "vec_id", "score"]

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if queries.num_rows and candidates.num_rows:
            query_ids, query_rows = _vectors(queries)
            floors = dict(zip(queries.column("id").to_pylist(), queries.column("floor").to_pylist()))
            ids, rows = _vectors(candidates)
            width = max(map(len, (*query_rows, *rows)))
            query_ids, query_rows = _matrix(query_ids, query_rows, width)
            ids, rows = _matrix(ids, rows, width)
            if width * max(map(abs, (int(query_rows.min()), int(query_rows.max())))) * max(map(abs, (int(rows.min()), int(rows.max())))) >= 2**63:
                raise OverflowError("inner products may not fit in 64 bits")
            order = np.argsort(rows, axis=0, kind="stable")
            ranked = np.take_along_axis(rows, order, axis=0)
            for own, query in zip(query_ids, query_rows):
                best_ids, best, *_ = threshold_search(query, own, ids, rows, order, ranked, k, floors[own])
                found.append((np.full(len(best), own, np.int64), best_ids, best))
        columns = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64)] * 3
        return pa.table([pa.array(c) for c in columns], names)

    return run


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of each component; rows without an id, a vector or a finite number drop out."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda y: y.isNotNull() & (F.abs(y) < F.lit(float("inf"))))
    return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda y: F.floor(y * scale)).alias("v")
    )


def top_k(
    queries: DataFrame,
    candidates: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates, ties to the smaller id.

    A candidate with the query's own id is left out. Vectors that are null or hold null or non-finite
    components take no part. Repeated rows count once; of different vectors with one id the
    lexicographically smallest counts. Where lengths differ, missing components are 0. Fewer than k
    candidates are all returned; empty tables give an empty result. Vectors whose products may not fit in 64
    bits are an error.
    """
    blocks = max(1, -(-candidates.count() // block_rows))
    query_blocks = max(1, -(-queries.count() // query_rows))

    def dealt(df: DataFrame, own: str, n: int) -> DataFrame:
        return integer_vectors(df, id_col, vector_col, scale).withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))

    def copied(df: DataFrame, other: str, first: int, m: int) -> DataFrame:
        return df.withColumn(other, F.explode(F.sequence(F.lit(first), F.lit(m - 1))))

    def searched(asked: DataFrame, first: int, m: int) -> DataFrame:
        """The best of candidate blocks ``first`` to ``m`` - 1."""
        own = right.where(F.col("block").between(first, m - 1))
        pairs = copied(asked, "block", first, m).groupBy("block", "query_block")
        return pairs.cogroup(copied(own, "query_block", 0, query_blocks).groupBy("block", "query_block")).applyInArrow(
            _search_block(k), "query_id long, vec_id long, score long"
        )

    left, right = dealt(queries, "query_block", query_blocks), dealt(candidates, "block", blocks)
    none = left.withColumn("floor", F.lit(None).cast("long"))
    if blocks == 1:
        found = searched(none, 0, 1)
    else:
        seed = written(searched(none, 0, 1), "topk-seed")
        floors = seed.groupBy("query_id").agg(F.count("*").alias("_n"), F.min("score").alias("floor")).where(F.col("_n") == k)
        known = left.join(floors.select(F.col("query_id").alias("id"), "floor"), "id", "left").select(*left.columns, "floor")
        found = seed.union(searched(known, 1, blocks))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op6_threshold(spark, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors.where("vec_id % 50 = 0"), vectors)
