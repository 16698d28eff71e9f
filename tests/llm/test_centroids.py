"""Orchard search and clustering against plain assignment of every vector to every centroid."""

import hashlib
import math
import random

import numpy as np
import pytest

from kindsort.llm import centroids, queries

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k=8, rounds=10, dims=64, scale=1024, seed=3):
    """[(id, cluster, distance)] and the centroids, in Python's integers."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()
    middle = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(middle))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, mine in groups.items():
            middle[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted((str(i), *nearest(v)[::-1]) for i, v in kept), middle


def told(df, **kw):
    found, middle = centroids.cluster(df, **kw)
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in found.collect()), middle


@pytest.mark.parametrize("seed", range(4))
def test_orchard_finds_the_nearest_with_ties(seed):
    rng = np.random.default_rng(seed)
    middle = rng.integers(-3, 4, (40, 2))
    middle[7], middle[30] = middle[3], middle[3]  # centroids that coincide
    vectors = rng.integers(-5, 6, (500, 2))
    at, best, measured = centroids.Orchard(middle).nearest(vectors)
    every = ((vectors[:, None, :] - middle[None]) ** 2).sum(2)
    assert (at == every.argmin(1)).all() and (best == every.min(1)).all()
    assert measured <= 500 * 40


def test_orchard_leaves_far_centroids_unmeasured():
    rng = np.random.default_rng(1)
    middle = rng.integers(-1000, 1000, (200, 3)) * 100
    vectors = middle[rng.integers(0, 200, 2000)] + rng.integers(-50, 50, (2000, 3))
    at, _, measured = centroids.Orchard(middle).nearest(vectors)
    assert (at == ((vectors[:, None, :] - middle[None]) ** 2).sum(2).argmin(1)).all()
    assert measured < 0.5 * 2000 * 200


def test_clusters_equal_plain(make):
    rng = random.Random(5)
    rows = [(i, [rng.choice((-1, 0, 1)) + rng.gauss(0, 0.3) for _ in range(4)]) for i in range(300)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    rows += rows[:40] * 3  # repeated rows
    got, middle = told(make(rows, SCHEMA).repartition(7), k=6, rounds=10, dims=4)
    want, plain_middle = plain(rows, k=6, dims=4)
    assert got == want and middle == plain_middle


def test_query_sums_and_digests(make, folder, spark):
    rng = random.Random(9)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(64)]) for i in range(120)]
    out = queries.op11_centroids(spark, folder(embeddings=make(rows, SCHEMA))).collect()
    want, middle = plain(rows)
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in out) == want
    total = sum(d for _, _, d in want)
    for r in out:
        assert r["inertia"] == total and r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, middle[r["cluster"]])).encode()).hexdigest()


def test_odd_rows_and_clashing_names(make):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (None, [3.0, -4.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 0.0]), (1, [1.0, 2.0]), (7, [])]
    df = make(rows, SCHEMA).selectExpr("*", "1 as cluster", "2 as distance", "3 as key", "4 as vector")
    got, middle = told(df, k=8, dims=2)
    want, plain_middle = plain(rows, k=8, dims=2)
    assert got == want and middle == plain_middle and len(middle) == 3


def test_large_components_stay_exact(make):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([(2.0**20, 1.0), (2.0**20, 2.0), (-(2.0**20), 1.0), (2.0**20 + 1, 1.5), (0.0, 0.0)])]
    got, middle = told(make(rows, "vec_id long, embedding array<double>"), k=2, dims=2)
    want, plain_middle = plain(rows, k=2, dims=2)
    assert got == want and middle == plain_middle


def test_distances_beyond_long_are_refused(make):
    with pytest.raises(Exception, match="(?i)overflow|too large|int64|long|convert"):
        told(make([(1, [1e12, 0.0]), (2, [-1e12, 0.0]), (3, [1e12, 5.0])], "vec_id long, embedding array<double>"), k=1, dims=2)


def test_empty_tables(make):
    assert told(make([], SCHEMA)) == ([], [])
    out = centroids.clusters(make([(1, None)], SCHEMA))
    assert out.collect() == [] and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
