"""Exact top-k by inner product with the threshold algorithm over sorted lists, one per dimension."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from . import arrays as A

SCALE = 256
BLOCK_VECTORS = 4_096
BLOCK_QUERIES = 1_024


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, q, dim): floor(scale * x) of every component; rows that are null or hold null or non-finite values are left out."""
    x = F.col(vector_col).cast("array<double>")
    usable = F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.filter(usable).filter(F.coalesce(finite, F.lit(False)))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale)).alias("q"), F.size(x).alias("dim"))


def _packed(rows: DataFrame, blocks: int, name: str) -> DataFrame:
    """One row per block of vectors of one dimension."""
    schema = pa.schema([("dim", pa.int32()), (name, pa.int64()), ("ids", pa.binary()), ("matrix", pa.binary())])

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        q = A.column(table, "q").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        head = table.slice(0, 1)
        return pa.table([head.column("dim"), head.column(name), [A.column(table, "vec_id").to_numpy().tobytes()], [q.tobytes()]], schema=schema)

    dealt = rows.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    return dealt.groupBy("dim", name).applyInArrow(build, f"dim int, {name} long, ids binary, matrix binary")


class SortedLists:
    """A block of vectors with its components sorted in every dimension, read from either end."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.matrix = ids, matrix
        self.order = np.argsort(matrix, axis=0, kind="stable")
        self.values = np.take_along_axis(matrix, self.order, axis=0)

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best by (score, smaller id), own row left out.

        Lists are read from the end that the query's sign prefers, to a depth that doubles. Each vector met is scored in
        full. What has not been met scores at most the sum over the lists of the query times the value at that depth;
        the search stops when this bound is below the kth score (a tie could still have a smaller id).
        """
        n = len(self.ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen = np.zeros(n, np.bool_)
        if len(up) + len(down) == 0:
            seen[:] = True  # every score is zero
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, done = 8, 0
        while True:
            if len(up) + len(down):
                depth = min(depth, n)
                met = np.concatenate([self.order[n - depth : n - done, up].ravel(), self.order[done:depth, down].ravel()])
                new = np.zeros(n, np.bool_)
                new[met] = True
                new = np.flatnonzero(new & ~seen)
                seen[new] = True
            else:
                new, depth = np.arange(n), n
            new = new[self.ids[new] != own]
            rows = np.concatenate([rows, new])
            scores = np.concatenate([scores, self.matrix[new] @ query])
            if len(rows) > k:
                best = np.lexsort((self.ids[rows], -scores))[:k]
                rows, scores = rows[best], scores[best]
            if depth >= n:
                break
            bound = int(self.values[n - 1 - depth, up] @ query[up]) + int(self.values[depth, down] @ query[down])
            if len(rows) == k and bound < scores.min():
                break
            done, depth = depth, depth * 2
        return rows, scores


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = SCALE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k vectors with the highest integer inner product, its own id left out.

    Scores are of floor(``scale`` * component) and exact while they fit 64 bits. Ties go to the smaller id; fewer than k
    candidates give fewer rows, an empty table none. Rows with a null id or vector, or with a null or non-finite
    component, take no part, and vectors are only compared with those of their own length. A candidate id that occurs in
    several rows counts with each of them; a query id that does is one query for each of its vectors, ranked together.

    Candidates and queries are dealt into blocks of bounded size, and every block of one meets every block of the other.
    """
    base = quantised(vectors, id_col, vector_col, scale)
    ask = quantised(queries, id_col, vector_col, scale)
    blocks = max(1, -(-base.count() // BLOCK_VECTORS))
    asked = max(1, -(-ask.count() // BLOCK_QUERIES))
    left = _packed(base, blocks, "block").withColumn("ask", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(asked - 1).cast("long"))))
    right = _packed(ask, asked, "ask").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(have: pa.Table, want: pa.Table) -> pa.Table:
        if have.num_rows == 0 or want.num_rows == 0:
            return schema.empty_table()
        ids, asking = A.parts(have, "ids", np.int64)[0], A.parts(want, "ids", np.int64)[0]
        lists = SortedLists(ids, A.parts(have, "matrix", np.int64)[0].reshape(len(ids), -1))
        out = []
        for own, query in zip(asking.tolist(), A.parts(want, "matrix", np.int64)[0].reshape(len(asking), -1)):
            rows, scores = lists.top(query, own, k)
            out.append((np.full(len(rows), own), ids[rows], scores))
        return pa.table([np.concatenate(c) for c in zip(*out)], schema=schema)

    key = ["dim", "block", "ask"]
    found = left.groupBy(*key).cogroup(right.select("dim", "block", "ask", "ids", "matrix").groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
