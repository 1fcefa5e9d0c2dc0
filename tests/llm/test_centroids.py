"""op11: the bounded search against all distances, and whole results against plain Python."""

import hashlib

import numpy as np
import pytest

from tenderlake.llm import centroids


def brute(rows, k, rounds, dim, seed="1"):
    """rows (vec_id, vector) -> sorted result rows, in Python integers."""
    kept = [(i, tuple(int(np.floor(float(x) * 64)) for x in v)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [list(p) for _, p in named[:k]]
    far = lambda p, c: sum((x - y) ** 2 for x, y in zip(p, c, strict=True))
    for r in range(rounds + 1):
        own = [min(range(len(centres)), key=lambda c: (far(p, centres[c]), c)) for _, p in kept]  # noqa: B023
        if r < rounds:
            for c in range(len(centres)):
                mine = [p for (_, p), o in zip(kept, own, strict=True) if o == c]
                if mine:
                    centres[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    distance = [far(p, centres[o]) for (_, p), o in zip(kept, own, strict=True)]
    each = [sum(d for d, o in zip(distance, own, strict=True) if o == c) for c in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, o, d, each[o], sum(distance), digest[o]) for (i, _), o, d in zip(kept, own, distance, strict=True)), key=str)


@pytest.mark.parametrize("k", [1, 2, 7, 40])
def test_search_finds_the_nearest_and_keeps_its_bounds(k):
    pick = np.random.default_rng(k)
    # few values, so that many distances tie, and some centroids equal
    points = pick.integers(-3, 4, (600, 5))
    centres = pick.integers(-3, 4, (k, 5))
    cluster, upper, lower = np.zeros(600, np.int32), np.full(600, np.inf), np.zeros(600)
    before = None
    for _ in range(6):
        at = centroids.Geometry.of(centres, before)
        cluster, upper, lower, taken = centroids.nearest(points, cluster, upper, lower, at)
        far = ((points[:, None] - centres) ** 2).sum(axis=2)
        assert cluster.tolist() == far.argmin(axis=1).tolist()
        roots = np.sqrt(far.astype(float))
        assert (upper >= roots[np.arange(600), cluster]).all()
        roots[np.arange(600), cluster] = np.inf
        assert (lower <= roots.min(axis=1)).all()
        before, centres = centres, centres + pick.integers(-1, 2, centres.shape) * (pick.random((k, 1)) < 0.5)


def test_search_looks_at_few_centroids():
    pick = np.random.default_rng(1)
    centres = pick.integers(-10000, 10000, (100, 8))
    points = centres[pick.integers(0, 100, 5000)] + pick.integers(-200, 200, (5000, 8))
    at = centroids.Geometry.of(centres)
    cluster, upper, lower, _ = centroids.nearest(points, np.zeros(5000, np.int32), np.full(5000, np.inf), np.zeros(5000), at)
    again, _, _, taken = centroids.nearest(points, cluster, upper, lower, centroids.Geometry.of(centres + 1, centres))
    assert again.tolist() == cluster.tolist() and taken == 0  # the bounds decide them all
    _, _, _, taken = centroids.nearest(points, cluster, upper + 5000, lower * 0, at)
    assert taken < 5000 * 5  # what isn't decided looks at the ball alone


@pytest.mark.parametrize(("k", "rounds"), [(16, 3), (3, 5), (500, 1)])
def test_clusters_match_plain_python(spark, monkeypatch, k, rounds):
    monkeypatch.setattr(centroids, "BLOCK", 11)
    pick = np.random.default_rng(k)
    rows = [(i, (pick.integers(-4, 5, 6) / 8 + pick.choice([0.0, 0.003], 6)).tolist()) for i in range(150)]
    rows += [(i, rows[i % 5][1]) for i in range(150, 200)] + [rows[0], rows[0], (3, rows[9][1]), (None, rows[1][1]), (None, rows[2][1])]
    rows += [(300, None), (301, []), (302, [1.0] * 5), (303, [None] + [1.0] * 5), (304, [float("nan")] * 6), (305, [float("inf")] * 6), (306, [0.0] * 6), (307, [-0.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, "x", 0.5) for i, v in rows], "vec_id bigint, embedding array<double>, cluster int, point string, distance double").repartition(3)
    got = sorted(map(tuple, centroids.cluster_vectors(df, dimensions=6, k=k, rounds=rounds).collect()), key=str)
    assert got == brute(rows, k, rounds, 6)


def test_huge_components_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [1e300, -1e300]), (2, [0.0, 0.0])], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r.distance for r in centroids.cluster_vectors(df, dimensions=2, k=1, rounds=0).collect()}
    assert sorted(got.values()) == [0, 2 * centroids.LARGEST**2]
    empty = centroids.cluster_vectors(df.where("vec_id > 5"), dimensions=2)
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
