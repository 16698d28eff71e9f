"""Exact top-k by inner product with an impact-ordered index, score at a time.

The vectors are cut into blocks, each indexed by impact: the postings of a dimension
are sorted by the size of their component and cut into segments at powers of two.
Queries meet a block segment level by level, largest impacts first, which adds what
these postings give to every score.  What is left of a score is bounded by the norms
of the unread components, so after each level a vector whose upper bound is below the
k-th best lower bound is proven out.  Reading stops when few possible members are
left; they are scored exactly.

One block in turn is searched first; the k-th score that a query has there is a lower
bound of its k-th score in all, and the other blocks start from it: they stop as soon as
nothing can reach it and send on only what does.

Scores are whole numbers.  Sums read so far are exact in float64 where no sum of
products can reach 2^53; larger components are scored in integers without bounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors of a block, at least and at most.  Between them the table is cut into 16 blocks of vectors
#: (each gives up to k rows a query, so few large ones) and 256 of queries.
BLOCK = (2048, 32_768)
#: Components of a block at most, however long its vectors are.
COMPONENTS = 1 << 22
#: Scores held at a time by a task (queries times vectors of a block).
HELD = 1 << 21
#: Reading stops when at most this share of a block's scores is still possible.
FEW = 0.02
#: What rounding can add to a bound: sums of d products and a root are off by less than (d + 8) 2^-52 of themselves.
ROUNDING = 2.0**-52


def quantised(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of every component as long; null if the vector is null or a component is null or not finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~odd, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


class ImpactIndex:
    """Postings of a block of vectors (rows of whole numbers), by descending impact level.

    Level ``b`` holds the components of ``2**(b-1) <= |x| < 2**b``.  A segment is the
    vectors and dimensions that have any at its level, with zeros elsewhere, so all
    queries read it in one product.
    """

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors.astype(np.float64)
        self.level = np.frexp(np.abs(self.vectors))[1].astype(np.int16)
        self.levels = [b for b in range(int(self.level.max(initial=0)), 0, -1) if (self.level == b).any()]
        self.read_levels = 0  # of all searches, to see where they stop

    def possible(self, queries: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) places that hold all members of each query's top ``k``; ``own``: pairs that don't take part.

        ``least``: a score that each query's members have at least (-inf: not known)."""
        queries = queries.astype(np.float64)
        read = np.zeros((len(queries), len(self.vectors)))
        squares = queries**2
        at = max(0, len(self.vectors) - k)
        left = ~own
        safe = 1 + (queries.shape[1] + 8) * ROUNDING
        for b in self.levels:
            here = self.level == b
            rows, dims = np.flatnonzero(here.any(1)), np.flatnonzero(here.any(0))
            segment = np.where(here[np.ix_(rows, dims)], self.vectors[np.ix_(rows, dims)], 0)
            read[:, rows] += queries[:, dims] @ segment.T  # exact: whole numbers below 2^53
            self.read_levels += 1
            # Cauchy-Schwarz over what is unread; sums of non-negative numbers, so no digits cancel
            below = self.level < b
            unread = np.where(below, self.vectors, 0)
            slack = np.sqrt((squares @ below.T.astype(np.float64)) * (unread * unread).sum(1)) * safe
            low, high = read - slack, read + slack
            low[own] = -np.inf
            proven = np.partition(low, at, 1)[:, at] if at else np.full(len(queries), -np.inf)
            # low and high are rounded too, each by half a unit at most below 2^53
            left = (high >= np.maximum(proven, least)[:, None] - 1) & ~own
            if np.count_nonzero(left) <= max(2 * k * len(queries), FEW * left.size):
                break
        return np.nonzero(left)


def search(qid: np.ndarray, queries: np.ndarray, vid: np.ndarray, vectors: np.ndarray, k: int, least: np.ndarray | None = None) -> list[np.ndarray]:
    """[query ids, vector ids, scores]: each query's best ``k`` of a block, ties to the smaller id.

    Scores below ``least`` (one a query) may be left out."""
    if not len(qid) or not len(vid):
        return [np.zeros(0, np.int64)] * 3
    least = np.full(len(qid), -np.inf) if least is None else least
    # of equal vectors only the smallest ids can be members: k of them, and one more as a query's own takes no part
    order = np.lexsort((vid, *vectors.T[::-1])) if vectors.shape[1] else np.argsort(vid)
    vid, vectors = vid[order], vectors[order]
    first = np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(1)])
    start = np.maximum.accumulate(np.where(first, np.arange(len(vid)), 0))
    keep = np.arange(len(vid)) - start <= k
    vid, vectors = vid[keep], vectors[keep]
    most = float(np.abs(queries.astype(np.float64)).max(initial=0)) * float(np.abs(vectors.astype(np.float64)).max(initial=0)) * max(1, vectors.shape[1])
    index, out = ImpactIndex(vectors) if most < 1 << 52 else None, []
    step = max(1, HELD // len(vid))
    for at in range(0, len(qid), step):
        ids, part = qid[at : at + step], queries[at : at + step]
        own = ids[:, None] == vid[None, :]
        q, v = index.possible(part, own, k, least[at : at + step]) if index else np.nonzero(~own)
        scores = np.concatenate([np.einsum("ij,ij->i", part[q[i : i + HELD // 64]], vectors[v[i : i + HELD // 64]]) for i in range(0, len(q), HELD // 64)] or [np.zeros(0, np.int64)])
        best = np.lexsort((vid[v], -scores, q))
        q, v, scores = q[best], v[best], scores[best]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        sent = (rank < k) & (scores >= least[at : at + step][q])
        out.append((ids[q[sent]], vid[v[sent]], scores[sent]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def top_k(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's best ``k`` among all other vectors.

    ``is_query`` is over ``key``.  A null key, a null vector and one with a component
    that is null or not finite take no part; rows that repeat a key are one vector (the
    largest); vectors are compared with those of their own length.  Components may have
    any size as long as scores fit in a long.  Queries and vectors are dealt in blocks,
    so a task holds one block of each whatever the table's size.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), quantised(F.col(vector), scale).alias("v"))
    rows = rows.where("id is not null and v is not null").groupBy("id").agg(F.max("v").alias("v")).checkpoint()
    asked = rows.withColumnRenamed("id", key).withColumn("asked", is_query).select(F.col(key).alias("id"), "v", "asked")
    n, nq, dims = asked.agg(F.count("*"), F.coalesce(F.sum(F.col("asked").cast("int")), F.lit(0)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    largest = max(1, min(BLOCK[1], COMPONENTS // max(1, dims)))
    parts, qparts = (max(1, -(-m // min(largest, max(BLOCK[0], n // cuts)))) for m, cuts in ((n, 16), (nq, 256)))
    place = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    keys = ("dim", "part", "qpart")
    right = rows.select(F.size("v").alias("dim"), place(parts).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(qparts - 1))).alias("qpart"), F.col("id").alias("cid"), F.col("v").alias("cv"))
    queries = asked.where("asked").select(F.size("v").alias("dim"), place(qparts).alias("qpart"), "id", "v")

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        def arrays(t: pa.Table, key: str, vector: str) -> tuple[np.ndarray, np.ndarray]:
            v = t.column(vector).combine_chunks()
            return t.column(key).to_numpy(), v.flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1) if len(t) else np.zeros((0, 0), np.int64)

        least = np.array([-np.inf if x is None else x for x in q.column("least").to_pylist()])
        a, b, s = search(*arrays(q, "id", "v"), *arrays(c, "cid", "cv"), k, least)
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(s.astype(np.int64), pa.int64())})

    def met(left: DataFrame, some: Column) -> DataFrame:
        return left.groupBy(*keys).cogroup(right.where(some).groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score long")

    # the first block of a query is another one for each block of queries, so that all are searched
    started = F.pmod(F.col("qpart"), F.lit(parts)) == F.col("part")
    found = met(queries.select("dim", F.pmod("qpart", F.lit(parts)).cast("int").alias("part"), "qpart", "id", "v", F.lit(None).cast("double").alias("least")), started)
    if parts > 1:
        found = found.checkpoint()
        bound = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= k)
        # a score below 2^53 is exact as a double; a larger one bounds nothing
        exact = F.when(F.abs("s") < 1 << 53, F.col("s").cast("double"))
        known = queries.join(bound.select(F.col("query_id").alias("id"), exact.alias("least")), "id", "left")
        others = known.select("dim", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "qpart", "id", "v", "least").where(~started)
        found = found.union(met(others, ~started))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def oracle(every: int = 20, k: int = 20) -> str:
    """Top ``k`` for the rows whose id is divisible by ``every``, in DuckDB's SQL."""
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % {every} = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {k}"""
