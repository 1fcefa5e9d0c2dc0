"""Near-duplicate vectors: tiles in the order of principal components, with bounds on the rest."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import step
from .components import same_document, smallest_ids
from .shared import table, written

MIN_COSINE = 0.98
#: Vectors of a tile, and rows of it that are multiplied at a time.
TILE, BLOCK = 2048, 512
#: A cell of more vectors is split along the next of the leading axes, if that saves at least a third
#: of its comparisons.
SPLIT, SPLIT_AXES, SAVING = 8192, 8, 0.67
#: Vectors from which the principal components are learned; they order the work, not the result.
SAMPLE = 4096
#: Leading components after which the bound on the rest is tried.
STEPS = (8, 24)
#: Room for rounding in bounds; the cosine that decides is computed from the vectors as given.
SLACK = 1e-6


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension in a bounded sample (the SAMPLE rows of smallest hash), an orthogonal
    matrix whose columns are the principal axes, the widest first. The sample is all that is
    collected."""
    rows = vectors.orderBy("h1", "h2").limit(SAMPLE).select("embedding").collect()
    by_dim: dict[int, list] = {}
    for (v,) in rows:
        by_dim.setdefault(len(v), []).append(v)
    axes = {}
    for dim, vs in by_dim.items():
        x = _unit(np.array(vs, float))
        axes[dim] = np.linalg.eigh(np.cov(x.T) if len(x) > 1 and dim > 1 else np.eye(dim))[1][:, ::-1]
    return axes


def _unit(matrix: np.ndarray) -> np.ndarray:
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def tile_links(a: np.ndarray, b: np.ndarray, axes: np.ndarray, min_cosine: float = MIN_COSINE) -> np.ndarray:
    """Which rows of a and b have cosine >= min_cosine. Products of the leading components are
    accumulated; a pair is dropped as soon as the product of the norms of what is left can't lift
    it to the threshold; pairs that reach the end are decided in the components as given."""
    x, y = _unit(a), _unit(b)
    p, q = x @ axes, y @ axes
    suffix = lambda m, k: np.sqrt(np.maximum(0, 1 - (m[:, :k] ** 2).sum(axis=1)))
    dots, done, alive = 0.0, 0, None
    for step in (*STEPS, p.shape[1]):
        if step <= done or step > p.shape[1]:
            continue
        dots = dots + p[:, done:step] @ q[:, done:step].T
        alive = dots + np.outer(suffix(p, step), suffix(q, step)) >= min_cosine - SLACK
        done = step
        n_alive = int(alive.sum())
        if not n_alive or n_alive * 16 < alive.size:
            break
    out = np.zeros((len(x), len(y)), bool)
    i, j = np.nonzero(alive)
    for s in range(0, len(i), 1 << 16):
        u, v = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
        out[u, v] = np.einsum("ij,ij->i", x[u], y[v]) >= min_cosine
    return out


def _forest(links: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[list, list]:
    """A few of the links that join what all of them join: breadth first over the two sides."""
    names, where = np.unique(np.concatenate([ids_a, ids_b]), return_inverse=True)
    n_a = len(ids_a)
    out_a: list = []
    out_b: list = []
    seen_a, seen_b = np.zeros(n_a, bool), np.zeros(len(ids_b), bool)
    for first in range(n_a):
        if seen_a[first]:
            continue
        queue = [first]
        seen_a[first] = True
        while queue:
            i = queue.pop()
            new_b = np.flatnonzero(links[i] & ~seen_b)
            seen_b[new_b] = True
            out_a += [ids_a[i]] * len(new_b)
            out_b += ids_b[new_b].tolist()
            for j in new_b:
                new_a = np.flatnonzero(links[:, j] & ~seen_a)
                seen_a[new_a] = True
                out_a += [ids_b[j]] * len(new_a)
                out_b += ids_a[new_a].tolist()
                queue += new_a.tolist()
    return out_a, out_b


def _stack(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def _split(cells: DataFrame, axis: int, reach: float) -> DataFrame | None:
    """cells (label, dim, path, home, node, lead) with those of more than SPLIT home vectors split into
    slabs of twice the reach of a link along an axis, where that saves comparisons; None if none is.

    A vector is at home in its own slab. It is a guest in the slab before, if it lies within reach of
    it, so that each pair of two slabs meets once, at home in the first. Guests of the cell are guests
    of every slab within reach."""
    cell, width = ["label", "dim", "path"], 2 * reach
    counts = cells.groupBy(*cell).agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("g"))
    full = written(counts.where((F.col("h") > SPLIT) & (F.col("dim") > axis)), "vector-full")
    if full.isEmpty():
        return None
    x = F.get("lead", F.lit(axis))
    slab = F.floor(x / width)
    into = x - slab * width
    place = lambda number, home: F.struct(number.alias("slab"), home.alias("at_home"))
    places = F.array_compact(F.array(
        place(slab, F.col("home")), F.when(into <= reach, place(slab - 1, F.lit(False))), F.when(~F.col("home") & (into >= width - reach), place(slab + 1, F.lit(False)))
    ))
    dealt = cells.join(full.select(*cell), cell).select(*cell, "node", "lead", F.explode(places).alias("place")).select(*cell, "node", "lead", "place.*")
    slabs = dealt.groupBy(*cell, "slab").agg(F.count_if("at_home").alias("sh"), F.count_if(~F.col("at_home")).alias("sg")).where("sh > 0")
    slabs = written(slabs, "vector-slabs")
    cost = slabs.groupBy(*cell).agg(F.sum(F.col("sh") * (F.col("sh") / 2 + F.col("sg"))).alias("cost"))
    better = full.join(cost, cell).where(F.col("cost") <= SAVING * F.col("h") * (F.col("h") / 2 + F.col("g"))).select(*cell)
    better = written(better, "vector-better")
    if better.isEmpty():
        return cells
    parts = dealt.join(better, cell).join(slabs.select(*cell, "slab"), [*cell, "slab"])
    parts = parts.select("label", "dim", F.concat_ws(",", "path", F.concat(F.lit(f"{axis}:"), "slab")).alias("path"), F.col("at_home").alias("home"), "node", "lead")
    return written(cells.join(better, cell, "left_anti").select(*parts.columns).unionByName(parts), "vector-cells")


def _jobs(cells: DataFrame) -> DataFrame:
    """Rows (label, dim, path, tile_a, tile_b, guests, side, node) of comparing tasks: each two home
    tiles of a cell, each tile with itself, and each home tile with each guest tile."""
    cell = ["label", "dim", "path"]
    tiles = lambda home: F.ceil(F.count_if(F.col("home") == home) / TILE).cast("int")
    counts = written(cells.groupBy(*cell).agg(tiles(True).alias("th"), tiles(False).alias("tg")), "vector-tiles")
    dealt = cells.join(counts, cell).withColumn("tile", F.pmod(F.xxhash64("node"), F.when(F.col("home"), F.col("th")).otherwise(F.col("tg"))).cast("int"))
    job = lambda a, b, guests, side: F.struct(a.cast("int").alias("tile_a"), b.cast("int").alias("tile_b"), F.lit(guests).alias("guests"), F.lit(side).alias("side"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    tile = F.col("tile")
    at_home = F.concat(
        F.transform(F.sequence(tile, F.col("th") - 1), lambda j: job(tile, j, False, 0)), F.transform(upto(tile), lambda i: job(i, tile, False, 1)),
        F.transform(upto(F.col("tg")), lambda j: job(tile, j, True, 0)),
    )
    as_guest = F.transform(upto(F.col("th")), lambda i: job(i, tile, True, 1))
    return dealt.select(*cell, "node", F.explode(F.when(F.col("home"), at_home).otherwise(as_guest)).alias("job")).select(*cell, "node", "job.*")


def near_duplicate_vectors(vectors: DataFrame, min_cosine: float = MIN_COSINE, vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors (vec_id, label and the vector).

    Vectors of equal label and dimension are linked if their cosine is at least min_cosine. Rows
    whose label or vector is null, whose vector is empty or zero or holds null or non-finite
    components are linked with nothing. n_links counts rows. A null vec_id takes part in no link and
    gets null component_id and kept. Rows that share a vec_id are one vector given in several forms:
    they share a component, with all that any of them is linked with. An empty table gives an empty table.

    Equal vectors are joined first and only one of each goes on, with its count. The vectors of a
    label are a cell. Linked unit vectors differ by at most sqrt(2 - 2 c) along any axis, so a cell
    that holds more than a few tiles is split into slabs along one leading principal axis after the
    other. A cell is dealt into tiles of about TILE vectors, and each task compares two tiles. A task
    returns a count for each vector and a spanning forest of the links, never the pairs. Of the
    tables written on the way only the result stays.
    """
    with step(vectors.sparkSession) as keep:
        return keep(_linked(vectors, min_cosine, vector), "vector-result")


def _linked(vectors: DataFrame, min_cosine: float, vector: str) -> DataFrame:
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", F.col(vector).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("usable", usable).withColumn("embedding", F.when(F.col("usable"), F.transform("embedding", lambda x: x + F.lit(0.0))))
    keys = {f"h{k}": F.when(F.col("usable"), F.xxhash64(F.lit(k), "label", "embedding")) for k in (1, 2)}  # 128 bits name a vector
    copies = rows.where("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.lit(True).alias("usable"))
    copies = written(copies.withColumns(keys).drop("usable").withColumns({"dim": F.size("embedding"), "node": F.monotonically_increasing_id()}), "vector-copies")
    axes = principal_axes(copies)
    reach = math.sqrt(2 - 2 * min_cosine) + SLACK

    def turned(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            values = batch.column(batch.schema.get_field_index("embedding"))
            dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
            lead: list = [None] * batch.num_rows
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = _unit(_stack(pa.chunked_array([values.take(pa.array(at))])))
                for i, point in zip(at, x @ axes.get(int(dim), np.eye(int(dim)))[:, :SPLIT_AXES], strict=True):
                    lead[i] = point
            kept = [batch.schema.get_field_index(c) for c in ("label", "dim", "node")]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(lead, pa.list_(pa.float64()))], names=["label", "dim", "node", "lead"])

    label_type = dict(copies.dtypes)["label"]
    cells = copies.select("label", "dim", "node", F.lit("").alias("path"), F.lit(True).alias("home"))
    if not copies.groupBy("label", "dim").count().where(F.col("count") > SPLIT).isEmpty():
        cells = copies.select("label", "embedding", "dim", "node").mapInArrow(turned, f"label {label_type}, dim int, node bigint, lead array<double>")
        cells = written(cells.withColumns({"path": F.lit(""), "home": F.lit(True)}), "vector-cells")
        for axis in range(SPLIT_AXES):
            after = _split(cells, axis, reach)
            if after is None:
                break
            cells = after

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        side, node, copies_ = (group.column(c).to_numpy() for c in ("side", "node", "copies"))
        within = bool(group.column("tile_a")[0] == group.column("tile_b")[0] and not group.column("guests")[0].as_py())
        x = _stack(group.column("embedding"))
        a = np.flatnonzero(side == 0)
        b = a if within else np.flatnonzero(side == 1)
        ids, n, u, v = [], [], [], []
        if len(a) and len(b):
            rotation = axes.get(x.shape[1], np.eye(x.shape[1]))
            links = np.concatenate([tile_links(x[a[s : s + BLOCK]], x[b], rotation, min_cosine) for s in range(0, len(a), BLOCK)])
            if within:
                np.fill_diagonal(links, False)
            if links.any():
                per_a, per_b = links @ copies_[b], links.T @ copies_[a]
                sides = [(a, per_a)] if within else [(a, per_a), (b, per_b)]
                for at, per in sides:
                    ids += node[at][per > 0].tolist()
                    n += per[per > 0].tolist()
                u, v = _forest(links, node[a], node[b])
        ids, n, other_ = ids + list(u), n + [0] * len(u), [None] * len(n) + list(v)
        return pa.table({"node": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64()), "other": pa.array(other_, pa.int64())})

    jobs = _jobs(cells).join(copies.select("node", "copies", "embedding"), "node")
    found = written(jobs.groupBy("label", "dim", "path", "tile_a", "tile_b", "guests").applyInArrow(compare, "node bigint, n bigint, other bigint"), "vector-links")
    n_links = found.where("other IS NULL").groupBy("node").agg(F.sum("n").alias("n"))
    edges = found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))
    keyed = written(rows.withColumns(keys).select("vec_id", "h1", "h2"), "vector-rows")
    often = written(keyed.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id"), "vector-several")
    held = written(keyed.join(often, "vec_id", "left_semi").join(copies.select("h1", "h2", "node", "rep"), ["h1", "h2"]).select(F.col("vec_id").alias("id"), "node", "rep"), "vector-held")
    parents = smallest_ids(copies.select("node", F.col("rep").alias("id")), edges.unionByName(same_document(held.select("id", "node"))), "vectors")
    parents = written(parents.select("node", F.col("least").alias("component")), "vector-components")
    per = copies.select("h1", "h2", "node", "rep", "copies").join(n_links, "node", "left").join(parents, "node", "left")
    per = per.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"), "rep")
    per = written(per.where("n_links > 0 OR component != rep").drop("rep"), "vector-result")
    by_id = held.join(parents, "node", "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("by_id")).withColumnRenamed("id", "vec_id")
    out = keyed.join(per, ["h1", "h2"], "left").join(written(by_id, "vector-by-id"), "vec_id", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("by_id", "component", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))


def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
