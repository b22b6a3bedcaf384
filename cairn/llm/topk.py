"""Exact top-k by inner product: Fagin's threshold algorithm over sorted per-dimension lists, in blocks.

Candidates are dealt into blocks by hash and every block of queries meets every block of candidates in a task of its own.
A task sorts its candidates once per dimension. A query reads each list from the end its component's sign prefers, scores
every vector it meets in full, and stops when the threshold (the score of a vector that had the last read value
in every dimension) is below its k-th best score; so what it did not meet cannot be among its best. The best of all
blocks are ranked in the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import read_table, written

K, EVERY, SCALE = 20, 20, 64.0
CANDIDATES, QUERIES, FIRST_DEPTH = 8192, 512, 32


class SortedLists:
    """The vectors of a block with, for each dimension, their order by descending value."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[by_id], x[by_id]
        top = int(np.abs(x).max(initial=0))
        self.exact = np.float32 if top * top * x.shape[1] < 2**24 else np.float64 if top < 2**26 // max(x.shape[1], 1) else np.int64
        self.dense = self.x.astype(self.exact)
        self.order = np.argsort(-self.x, axis=0, kind="stable").T.copy()
        self.value = np.take_along_axis(self.x.T, self.order, axis=1)

    def best(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best vectors other than the query's own, ties to the smaller id; and unsorted more of equal rank are left out."""
        m = len(self.ids)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        seen, scored = np.zeros(m, bool), np.zeros(m, bool)
        score = np.zeros(m, np.int64)
        vector = q.astype(self.exact)
        own = np.searchsorted(self.ids, query_id)
        if own < m and self.ids[own] == query_id:
            seen[own] = scored[own] = True
        else:
            own = -1
        depth, read = FIRST_DEPTH, 0
        while True:
            depth = min(depth, m)
            seen[self.order[up, read:depth].ravel()] = True
            seen[self.order[down, m - depth : m - read].ravel()] = True
            if depth == m:
                seen[:] = True
            new = np.flatnonzero(seen & ~scored)
            if len(new) * 2 > m:
                score[new] = (self.dense @ vector)[new]
            elif len(new):
                score[new] = self.dense[new] @ vector
            scored |= seen
            if scored.all():
                break
            read = depth
            have = np.flatnonzero(scored)
            have = have[have != own]
            if len(have) >= k:
                bound = int(q[up] @ self.value[up, depth - 1] + q[down] @ self.value[down, m - depth])
                if np.partition(score[have], len(have) - k)[len(have) - k] > bound:
                    break
            depth *= 2
        have = np.flatnonzero(scored)
        have = have[have != own]
        if len(have) > k:
            kth = np.partition(score[have], len(have) - k)[len(have) - k]
            have = have[score[have] >= kth]
        have = have[np.argsort(-score[have], kind="stable")][:k]
        return self.ids[have], score[have]


def quantised(embeddings: DataFrame, scale: float = SCALE) -> DataFrame:
    """(vec_id, x): floor(scale * component) as longs, of the vectors that have only finite components; an error where one is beyond 2^62."""
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    whole = lambda y: F.when(F.abs(y) < 2.0**62, F.floor(y)).otherwise(F.raise_error(F.lit("a component is too large for a long")).cast("long"))
    x = F.transform("embedding", lambda e: whole(e.cast("double") * scale))
    return embeddings.where(F.col("vec_id").isNotNull() & fine & (F.size("embedding") > 0)).select("vec_id", x.alias("x"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of all vectors by inner product, all if there are fewer.

    Both tables are (vec_id, x array<long>). A vec_id names one vector: of rows that repeat it the greatest x counts, and a
    query never finds its own vec_id. Vectors of another length than the query's are not compared with it. Ties go to
    the smaller vec_id. Empty tables give no rows. Other columns are ignored. Scores are longs: an error is raised where
    vectors are so large that one might not fit.
    """
    one = lambda df: df.groupBy("vec_id", F.size("x").alias("dims")).agg(F.max("x").alias("x"))
    vectors, queries = written(one(vectors), "vectors"), written(one(queries), "queries")
    n_blocks = max(1, -(-vectors.count() // CANDIDATES))
    q_blocks = max(1, -(-queries.count() // QUERIES))
    spread = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cand = vectors.select("dims", spread(n_blocks).alias("cb"), every(q_blocks).alias("qb"), "vec_id", "x")
    asked = queries.select("dims", every(n_blocks).alias("cb"), spread(q_blocks).alias("qb"), "vec_id", "x")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, near, score = [], [], []
        if left.num_rows and right.num_rows:
            matrix = lambda t: t.column("x").combine_chunks().values.to_numpy().reshape(t.num_rows, -1)
            x, asked_ = matrix(left), matrix(right)
            if int(np.abs(x).max()) * int(np.abs(asked_).max()) * x.shape[1] >= 2**63:
                raise OverflowError("scores might exceed 64 bits")
            lists = SortedLists(left.column("vec_id").to_numpy(), x)
            for query, q in zip(right.column("vec_id").to_pylist(), asked_):
                a, b = lists.best(query, q, k)
                ids.append(np.full(len(a), query))
                near.append(a)
                score.append(b)
        flat = lambda x: pa.array(np.concatenate([np.zeros(0, np.int64), *x]))
        return pa.table({"query_id": flat(ids), "vec_id": flat(near), "score": flat(score)})

    found = cand.groupBy("dims", "cb", "qb").cogroup(asked.groupBy("dims", "cb", "qb")).applyInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(read_table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
