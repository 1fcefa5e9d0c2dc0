"""op10 against brute force over all pairs."""

import random

import numpy as np
import pytest

from tenderlake.llm import vectors


def brute(rows, least=0.98):
    ok = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) and l is not None and i is not None for i, l, v in rows]
    n = [0] * len(rows)
    parent = {i: i for i, _, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p in range(len(rows)):
        for q in range(p + 1, len(rows)):
            (i, l, v), (j, m, w) = rows[p], rows[q]
            if ok[p] and ok[q] and l == m and len(v) == len(w):
                v, w = np.array(v, float), np.array(w, float)
                if v @ w / np.sqrt((v @ v) * (w @ w)) >= least:
                    n[p] += 1
                    n[q] += 1
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
    return sorted([(i, c, None if i is None else root(i), None if i is None else root(i) == i) for (i, _, _), c in zip(rows, n)], key=str)


@pytest.mark.parametrize(("tile", "split", "saving"), [(512, 8192, 0.67), (7, 8192, 0.67), (7, 10, 0.95), (512, 3, 2.0)])
def test_links_match_brute_force(spark, monkeypatch, tile, split, saving):
    monkeypatch.setattr(vectors, "TILE", tile)
    monkeypatch.setattr(vectors, "BLOCK", 5)
    monkeypatch.setattr(vectors, "SPLIT", split)
    monkeypatch.setattr(vectors, "SAVING", saving)
    pick = np.random.default_rng(3)
    rows = []
    for g in range(12):
        center = pick.normal(size=8)
        for _ in range(12):
            rows.append((len(rows), g % 3, (center + pick.normal(size=8) * 0.25).tolist()))
    rows += [(len(rows) + k, 1, rows[0 if k % 2 else 1][2]) for k in range(6)]
    rows += [(500, 1, [2 * x for x in rows[1][2]]), (501, None, rows[1][2]), (502, 1, None), (503, 1, [0.0] * 8), (504, 1, [float("nan")] * 8), (505, 1, [None] + [1.0] * 7), (506, 1, []), (507, 1, [1.0, 0.0]), (508, 1, [1.0, 0.01]), (None, 1, rows[1][2]), (509, 1, [float("inf")] * 8), (510, 1, [1e-200] * 8), (511, 1, [1e200] * 8)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").repartition(3)
    got = sorted(map(tuple, vectors.near_duplicate_vectors(df).collect()), key=str)
    want = brute([(i, l, [x * 1e190 for x in v] if i == 510 else [x * 1e-190 for x in v] if i == 511 else v) for i, l, v in rows])
    assert got == want


def test_rows_that_share_an_id_share_a_component(spark):
    rows = [(3, 1, [1.0, 0.0]), (5, 1, [1.0, 0.0]), (5, 1, [0.0, 1.0]), (9, 1, [0.0, 2.0]), (9, 1, None), (7, 1, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    got = sorted(map(tuple, vectors.near_duplicate_vectors(df).collect()))
    assert got == sorted([(3, 1, 3, True), (5, 1, 3, False), (5, 1, 3, False), (9, 1, 3, False), (9, 0, 3, False), (7, 0, 7, True)])


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id bigint, label int, embedding array<float>")
    assert vectors.near_duplicate_vectors(df).collect() == []
