"""Centroid clustering of whole-number vectors with Orchard search.

Each centroid has the list of the others by their distance from it.  A vector walks the
list of the closest centroid it knows; at one that is closer it goes on with that one's
list from its start, and centroids it has met are marked and not measured again.  By the
triangle inequality nothing on the list can be closer, or as close, once its distance
from the current centroid is strictly beyond twice the vector's; there the walk ends.
All comparisons are of exact squared whole numbers.

The vectors never leave their tasks: a round sends a sum and a count for each centroid
and task, and the driver holds the centroids alone (k vectors).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Marks (vectors times centroids) that a task holds at a time.
HELD = 1 << 21


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has ``dims`` components, none null or not finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(vector) == dims) & ~odd, F.lit(False))


def whole(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) exactly: int64 where four squared distances fit in it, else Python's integers."""
    x = np.floor(values.astype(np.float64) * scale)
    most = float(np.abs(x).max(initial=0))
    if 16 * most * most * max(1, x.shape[-1]) < 2.0**62:
        return x.astype(np.int64)
    return np.array([[int(c) for c in row] for row in x], dtype=object).reshape(x.shape)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``a`` and ``b``."""
    d = a - b
    return (d * d).sum(-1)


class Orchard:
    """Centroids, and for each the list of the others by distance (ties: smaller number)."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        k = len(centroids)
        between = [squared(centroids, c) for c in centroids]
        self.lists = np.array([[j for j in sorted(range(k), key=lambda j: (row[j], j)) if j != i] for i, row in enumerate(between)], dtype=np.int64).reshape(k, max(0, k - 1))
        self.gaps = np.array([row[order] for row, order in zip(between, self.lists, strict=True)], dtype=centroids.dtype).reshape(self.lists.shape)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of each vector's nearest centroid, ties to the smaller number, and the distances measured."""
        centroids = self.centroids
        if vectors.dtype != centroids.dtype:
            vectors, centroids = vectors.astype(object), centroids.astype(object)
        n, k = len(vectors), len(centroids)
        at = np.zeros(n, np.int64)
        best = squared(vectors, centroids[at])
        met = np.zeros((n, k), bool)
        met[:, 0] = True
        place = np.zeros(n, np.int64)  # in the list of ``at``
        walking, measured = np.arange(n), n
        while k > 1 and len(walking):
            c = at[walking]
            other, gap = self.lists[c, place[walking]], self.gaps[c, place[walking]]
            on = (gap <= 4 * best[walking]).astype(bool)
            walking, other = walking[on], other[on]
            new = ~met[walking, other]
            rows, to = walking[new], other[new]
            met[rows, to] = True
            measured += len(rows)
            d = squared(vectors[rows], centroids[to])
            closer = ((d < best[rows]) | ((d == best[rows]) & (to < at[rows]))).astype(bool)
            place[walking] += 1
            jump = rows[closer]
            at[jump], best[jump], place[jump] = to[closer], d[closer], 0
            walking = walking[place[walking] < k - 1]
        return at, best, measured


def _pieces(batches: Iterator[pa.RecordBatch], dims: int, scale: float, k: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches cut to ``HELD`` marks, with their vectors as whole numbers."""
    step = max(1, HELD // max(k, dims))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            flat = part.column("vector").flatten().to_numpy(zero_copy_only=False)
            yield part, whole(flat.reshape(part.num_rows, dims), scale)


def _sums(orchard: Orchard, dims: int, scale: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's row a centroid: the vectors nearest to it and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(orchard.centroids)
        count, total = [0] * k, [[0] * dims for _ in range(k)]
        for _, vectors in _pieces(batches, dims, scale, k):
            at, _, _ = orchard.nearest(vectors)
            for c in np.unique(at).tolist():
                mine = vectors[at == c]
                count[c] += len(mine)
                total[c] = [t + int(x) for t, x in zip(total[c], mine.sum(0), strict=True)]
        used = [c for c in range(k) if count[c]]
        if used:
            yield pa.RecordBatch.from_pydict({
                "cluster": pa.array(used, pa.int32()),
                "n": pa.array([count[c] for c in used], pa.int64()),
                "total": pa.array([[str(x) for x in total[c]] for c in used], pa.list_(pa.string())),
            })

    return run


def _assign(orchard: Orchard, dims: int, scale: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, vectors in _pieces(batches, dims, scale, len(orchard.centroids)):
            at, best, _ = orchard.nearest(vectors)
            cells = [part.column("key"), pa.array(at, pa.int32()), pa.array([int(d) for d in best], pa.int64())]
            yield pa.RecordBatch.from_arrays(cells, names=["key", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: float = 1024.0, seed: int = 3, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """``key, cluster, distance`` of each kept vector, and the final centroids.

    Kept are vectors of ``dims`` components, none null or not finite; each component
    counts as floor(``scale`` * x).  The first centroids are the ``k`` kept vectors of the
    smallest sha256 of ``<seed>:<key>`` (a null key counts as the word ``null``; rows that
    share a key, by their vectors), in that order, fewer if fewer are kept.  A round
    assigns every vector and moves each centroid to the floored mean of its vectors; one
    without vectors stays.  Rounds that would move nothing are not run.  Repeated rows
    are as many vectors.  An empty table has no clusters.  Squared distances must fit in
    a long, or the job fails; nothing wraps.
    """
    spark = prepare(vectors.sparkSession)
    kept = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector")).where(usable(F.col("vector"), dims)).checkpoint()
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("null"))), 256)
    first = kept.orderBy(place, "vector").limit(k).collect()  # k rows
    if not first:
        empty = kept.select("key", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return empty.withColumnRenamed("key", key), []
    centroids = whole(np.array([r["vector"] for r in first], dtype=np.float64), scale)
    for _ in range(rounds):
        parts = kept.select("vector").mapInArrow(_sums(Orchard(centroids), dims, scale), "cluster int, n long, total array<string>")
        one = parts.select("cluster", "n", F.posexplode("total").alias("dim", "x"))
        totals = one.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        moved = centroids.astype(object)
        for r in totals.collect():  # k times dims rows
            moved[r["cluster"], r["dim"]] = int(r["x"]) // r["n"]
        if (moved == centroids).all():
            break
        most = max(abs(c) for row in moved for c in row)
        centroids = moved.astype(np.int64) if 16 * most * most * dims < 1 << 62 else moved
    type_of = kept.schema["key"].dataType.simpleString()
    found = kept.mapInArrow(_assign(Orchard(centroids), dims, scale), f"key {type_of}, cluster int, distance long")
    return found.withColumnRenamed("key", key), [[int(c) for c in row] for row in centroids]


def clusters(vectors: DataFrame, key: str = "vec_id", **kw) -> DataFrame:
    """``key, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each kept vector (see :func:`cluster`)."""
    spark = vectors.sparkSession
    found, centroids = cluster(vectors, key=key, **kw)
    if not centroids:
        return found.selectExpr("*", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256")
    found = found.checkpoint()
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"))
    of_all = sums.agg(F.sum("d").cast("long").alias("inertia"))
    # one row a centroid
    by = spark.createDataFrame(digests, "cluster int, centroid_sha256 string").join(sums, "cluster").select("cluster", F.col("d").cast("long").alias("cluster_inertia"), of_all.scalar().alias("inertia"), "centroid_sha256")
    return found.join(F.broadcast(by), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same clusters in DuckDB's SQL, a step a round."""
    distance = "list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2])::HUGEINT * (z[1] - z[2])))"

    def nearest(r: int) -> str:
        return f"a{r} AS MATERIALIZED (SELECT row, arg_min({{'c': c.c, 'd': {distance}}}, ({distance}, c.c)) AS a FROM v, c{r} c GROUP BY row)"

    def moved(r: int) -> str:
        total = f"SELECT a.c AS c, i, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT a, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v JOIN a{r} USING (row)) GROUP BY 1, 2"
        mean = "list(((s - ((s % n) + n) % n) / n)::BIGINT ORDER BY i)"
        return f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, c{r}.v) AS v FROM c{r} LEFT JOIN (SELECT c, {mean} AS v FROM ({total}) GROUP BY c) m USING (c))"

    steps = ",\n".join(f"{nearest(r)},\n{moved(r)}" for r in range(rounds))
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v, embedding AS e
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, e) - 1 AS c, v FROM (SELECT sha256('{seed}:' || coalesce(vec_id::VARCHAR, 'null')) AS h, e, v FROM v ORDER BY h, e LIMIT {k})
),
{steps},
{nearest(rounds)},
told AS (SELECT vec_id, a.c::INT AS cluster, a.d::BIGINT AS distance FROM a{rounds} JOIN v USING (row))
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
       sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM told JOIN c{rounds} c ON c.c = told.cluster"""
