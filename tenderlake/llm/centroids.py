"""Centroid clustering: Lloyd's rounds in integers, with the Exponion search for the nearest centroid."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import step
from .shared import table, written

DIMENSIONS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, "1"
#: Integer components stop here, so that a squared distance of 64 of them fits a long.
LARGEST = 1 << 27
#: Vectors that are compared at a time.
BLOCK = 4096
#: Room for rounding in bounds; distances that decide are integers.
SLACK = 1e-9


@dataclass
class Geometry:
    """Centroids (integers, a row each), the distances between them (a little too small) with the
    others of each sorted from the nearest, and how far each has moved in the last round."""

    centres: np.ndarray
    order: np.ndarray
    away: np.ndarray
    moved: np.ndarray

    @classmethod
    def of(cls, centres: np.ndarray, before: np.ndarray | None = None) -> Geometry:
        k = len(centres)
        between = np.stack([_lengths(centres - c) for c in centres])
        np.fill_diagonal(between, -1)  # itself first
        order = np.argsort(between, axis=1, kind="stable")[:, 1:]
        away = np.take_along_axis(between, order, 1) * (1 - SLACK)
        moved = np.zeros(k) if before is None else _lengths(centres - before) * (1 + SLACK)
        return cls(centres, order, away, moved)


def _lengths(differences: np.ndarray) -> np.ndarray:
    return np.sqrt((differences * differences).sum(axis=1).astype(float))


def _squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    difference = points - centres
    return (difference * difference).sum(axis=1)


def nearest(points: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, at: Geometry) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Cluster (the nearest centroid, the smaller number of those that tie), upper and lower bounds of
    each vector's distances to its centroid and to the others, and how many distances were taken.

    cluster, upper and lower are those of the round before (0, infinite and 0 in the first). A vector
    stays where its upper bound is below its lower one or below half the way to the centroid nearest
    to its own. Else its distance u is taken, and the nearest and the second nearest centroid lie
    within 2 u plus that way around its own: only those are looked at, a prefix of the sorted list.
    What lies on the rim is looked at too, so no tie is lost."""
    k = len(at.centres)
    top = np.sort(at.moved)[::-1]
    widest = np.where(at.moved == top[0], top[1] if k > 1 and (at.moved == top[0]).sum() == 1 else top[0], top[0])
    cluster, upper, lower = cluster.copy(), upper + at.moved[cluster], lower - widest[cluster]
    way = at.away[:, 0] if k > 1 else np.full(k, np.inf)
    open_ = np.flatnonzero(~(upper < np.maximum(lower, way[cluster] / 2)))
    own = _squares(points[open_], at.centres[cluster[open_]])
    upper[open_] = np.sqrt(own.astype(float)) * (1 + SLACK)
    still = ~(upper[open_] < np.maximum(lower[open_], way[cluster[open_]] / 2))
    taken, open_, own = len(open_), open_[still], own[still]
    if k == 1:
        return cluster, upper, np.full(len(points), np.inf), taken
    held = cluster[open_]
    for a in np.unique(held):
        mine = held == a
        rows, best = open_[mine], own[mine]
        name, second = np.full(len(rows), a), np.full(len(rows), np.iinfo(np.int64).max)
        radius = (2 * upper[rows] + way[a] / (1 - SLACK)) * (1 + SLACK)
        reach = np.searchsorted(at.away[a], radius, side="right")
        for j in range(int(reach.max())):
            c, sub = at.order[a, j], np.flatnonzero(reach > j)
            d = _squares(points[rows[sub]], at.centres[c])
            taken += len(sub)
            better = (d < best[sub]) | ((d == best[sub]) & (c < name[sub]))
            second[sub] = np.where(better, best[sub], np.minimum(second[sub], d))
            best[sub[better]], name[sub[better]] = d[better], c
        cluster[rows], upper[rows], lower[rows] = name, np.sqrt(best.astype(float)) * (1 + SLACK), np.sqrt(second.astype(float)) * (1 - SLACK)
    return cluster, upper, lower, taken


def _assign(frames: Iterator[pa.RecordBatch], at: Geometry, last: bool) -> Iterator[pa.RecordBatch]:
    """vec_id, point, cluster, upper and lower of a round; of the last vec_id, cluster and distance."""
    dim = at.centres.shape[1]
    for whole in frames:
        for first in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(first, BLOCK)
            n = batch.num_rows
            points = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, dim)
            bounds = [batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3, 4)]
            cluster, upper, lower, _ = nearest(points, *bounds, at)
            if last:
                distance = _squares(points, at.centres[cluster])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower)], names=["vec_id", "point", "cluster", "upper", "lower"])


def _round(state: DataFrame, at: Geometry, last: bool = False) -> DataFrame:
    schema = "vec_id bigint, cluster int, distance bigint" if last else "vec_id bigint, point array<int>, cluster int, upper double, lower double"
    return state.mapInArrow(lambda frames: _assign(frames, at, last), schema)


def points(vectors: DataFrame, vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, point) of the vectors with exactly so many components, none null or non-finite: each
    component x becomes the integer floor(scale * x), at most LARGEST either way."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int")
    return vectors.where((F.size(vector) == dimensions) & finite).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, whole).alias("point"))


def cluster_vectors(vectors: DataFrame, vector: str = "embedding", dimensions: int = DIMENSIONS, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 for each usable
    row of vectors (vec_id and the vector).

    The k rows of smallest SHA-256 of "<seed>:<vec_id>" are the first centroids; rows of one hash are
    taken in the order of their components, rows without an id last. Each round assigns every vector
    to its nearest centroid, the smaller number where some tie, and moves each centroid that has
    vectors to the exact floor of their mean. Fewer usable rows than k make as many centroids; none
    make an empty table. Vectors that are null, of other length or hold null or non-finite components
    are left out; repeated rows are vectors of their own; other columns play no part. Distances are
    exact integers. An inertia too large for a long is null.

    A round is one pass over the written vectors with their bounds; of the table before nothing stays.
    What reaches the driver are k rows of sums, combined on the map side, so one cluster may hold
    all vectors.
    """
    spark = vectors.sparkSession
    usable = points(vectors, vector, dimensions, scale)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = usable.select(digest.alias("digest"), "vec_id", "point").orderBy(F.col("digest").asc_nulls_last(), "point").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    at = Geometry.of(np.array([row.point for row in first], np.int64))
    state = usable.select("vec_id", "point", F.lit(0).alias("cluster"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"))
    with step(spark) as keep:
        for _ in range(rounds):
            state = written(_round(state, at), "centroid-round")
            sums = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("point", F.lit(i))).alias(f"s{i}") for i in range(dimensions)]).collect()
            centres = at.centres.copy()
            for row in sums:
                centres[row.cluster] = [row[f"s{i}"] // row.n for i in range(dimensions)]
            at = Geometry.of(centres, at.centres)
        out = keep(_round(state, at, last=True), "centroid-clusters")
    inertia = dict(map(tuple, out.groupBy("cluster").agg(F.try_sum("distance")).collect()))
    total = sum(inertia.values()) if None not in inertia.values() else None
    if total is not None and total >= 1 << 63:
        total = None
    named = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at.centres.tolist()]
    of = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster"))
    return out.select(
        "vec_id", "cluster", "distance", of([inertia.get(c) for c in range(len(named))], "bigint").alias("cluster_inertia"), F.lit(total).cast("bigint").alias("inertia"), of(named, "string").alias("centroid_sha256")
    )


def op11_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


_ROUND_SQL = """, a{r} AS MATERIALIZED (
  SELECT row, any_value(v.p) AS p, arg_min(number, struct_pack(d := d, number := number)) AS number, min(d) AS d
  FROM (SELECT row, v.p, number, list_sum(list_transform(list_zip(v.p, c.p), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d FROM v CROSS JOIN c{r} c) v
  GROUP BY row
)"""
_MOVE_SQL = """, s{r} AS (
  SELECT number, i, sum(x) AS s, count(*) AS n FROM (SELECT number, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM a{r}) GROUP BY number, i
), c{s} AS MATERIALIZED (
  SELECT c.number, coalesce(m.p, c.p) AS p FROM c{r} c
  LEFT JOIN (SELECT number, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS p FROM s{r} GROUP BY number) m USING (number)
)"""

ORACLE = (
    f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id,
         list_transform(embedding, lambda x: floor(greatest(least(x::DOUBLE * {SCALE}, {LARGEST}::DOUBLE), -{LARGEST}::DOUBLE))::BIGINT) AS p
  FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id::VARCHAR) NULLS LAST, p) - 1 AS number, p FROM v ORDER BY number LIMIT {CENTROIDS}
)"""
    + "".join(_ROUND_SQL.format(r=r) + _MOVE_SQL.format(r=r, s=r + 1) for r in range(ROUNDS))
    + _ROUND_SQL.format(r=ROUNDS)
    + f"""
SELECT vec_id, a.number::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a.number))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.p, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (row) JOIN c{ROUNDS} c ON c.number = a.number
"""
)
