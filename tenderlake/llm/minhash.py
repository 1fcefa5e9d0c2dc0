"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import step
from .components import components, same_document, smallest_ids
from .shared import fresh, table, written
from .spans import FOLD, ORDER, _BYTE, batches, mix64, span_hashes, text_slices, word_spans

SHINGLE = 5
ROWS = 5
#: A link: JACCARD[1] * shared >= JACCARD[0] * union. JACCARD is op1's; STAGE_JACCARD that of a
#: corpus without near-duplicates.
JACCARD, STAGE_JACCARD = (85, 100), (80, 100)
#: The most probable a pair at exactly the threshold may be missed.
MISS = 1e-6
#: Buckets up to this size give pairs; larger ones are compared in tasks of up to CHUNK documents a side.
SMALL_BUCKET, CHUNK = 16, 512
#: Shingles a side of such a task: buckets of long texts are dealt into more, smaller parts.
CHUNK_SHINGLES = 2_000_000

_FOLDED = _BYTE[FOLD]


def bands_for(jaccard: tuple[int, int]) -> int:
    """The least number of bands that misses a pair at the threshold with probability up to MISS."""
    return math.ceil(math.log(MISS) / math.log1p(-((jaccard[0] / jaccard[1]) ** ROWS)))


BANDS = bands_for(JACCARD)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text its sorted distinct 64-bit shingle hashes: of 5 words, or of all if fewer."""
    starts, ends, bounds = word_spans(data, offsets)
    words = span_hashes(data, starts, ends, _FOLDED)
    n = len(words)
    runs = np.zeros(max(n - SHINGLE + 1, 0), np.uint64)
    for j in range(SHINGLE):
        runs += words[j : n - SHINGLE + 1 + j] * ORDER[j]
    runs = mix64(runs)
    out = []
    for d in range(len(bounds) - 1):
        first, end = int(bounds[d]), int(bounds[d + 1])
        if end - first >= SHINGLE:
            out.append(np.unique(runs[first : end - SHINGLE + 1]))
        elif end > first:
            out.append(mix64((words[first:end] * ORDER[: end - first]).sum(dtype=np.uint64, keepdims=True) + np.uint64(end - first)))
        else:
            out.append(words[:0])
    return out


def _mix32(x: np.ndarray, odd: int) -> np.ndarray:
    """A permutation of the 32-bit universe."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(odd)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], k: int = BANDS * ROWS, block: int = 1 << 15) -> np.ndarray:
    """Circulant MinHash of each set that isn't empty: one permutation first shuffles the universe,
    the other, shifted by 0, 1, ..., k - 1 places round the circle, gives the coordinates."""
    lengths = np.array([len(s) for s in sets])
    flat = _mix32((np.concatenate(sets) >> np.uint64(32)).astype(np.uint32), 0x85EBCA6B) if len(sets) else np.zeros(0, np.uint32)
    out = np.empty((len(sets), k), np.uint32)
    first, done, at = 0, 0, np.cumsum(lengths)
    while first < len(sets):  # blocks of whole sets that stay in the processor's cache
        end = max(first + 1, int(np.searchsorted(at, done + block, side="right")))
        part, begins = flat[done : at[end - 1]], at[first:end] - lengths[first:end] - done
        for shift in range(k):
            out[first:end, shift] = np.minimum.reduceat(_mix32(part + np.uint32(shift), 0x9E3779B1), begins)
        first, done = end, int(at[end - 1])
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    bands = signature.shape[1] // ROWS
    parts = signature.reshape(len(signature), bands, ROWS).astype(np.uint64)
    keys = (parts * ORDER[5 : 5 + ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * ORDER[14]
    return mix64(keys).view(np.int64)


def _sketch(frames: Iterator[pa.RecordBatch], n_bands: int) -> Iterator[pa.RecordBatch]:
    for batch in batches(frames):
        for first, end, data, offsets in text_slices(batch, "text"):
            sets = shingle_sets(data, offsets)
            n = np.array([len(s) for s in sets], np.int64)
            marks = [np.array([mix64(s ^ ORDER[j]).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for j in (6, 7)]
            full = n > 0
            bands = band_keys(signatures([s for s in sets if len(s)], n_bands * ROWS))
            starts = np.concatenate([[0], np.cumsum(full * n_bands)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first), pa.array(n), pa.array(marks[0]), pa.array(marks[1]), pa.ListArray.from_arrays(pa.array(starts), pa.array(bands.ravel()))],
                names=["doc_id", "mark", "n_shingles", "f1", "f2", "bands"],
            )


def _sets(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(frames):
        for first, end, data, offsets in text_slices(batch, "text"):
            sets = [s.tobytes() for s in shingle_sets(data, offsets)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(first, end - first) for c in (0, 1)], pa.array(sets, pa.binary())], names=["node", "again", "shingles"])


def similar(shared: np.ndarray, a: np.ndarray, b: np.ndarray, jaccard: tuple[int, int] = JACCARD) -> np.ndarray:
    return jaccard[1] * shared >= jaccard[0] * (a + b - shared)


def _verify_pairs(frames: Iterator[pa.RecordBatch], jaccard: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches(frames):
        x, y = batch.column(2), batch.column(3)
        keep = []
        for i in range(batch.num_rows):
            s, t = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
            shared = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(bool(similar(shared, len(s), len(t), jaccard)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))


def _chunk_links(group: pa.Table, jaccard: tuple[int, int]) -> pa.Table:
    """Links among one task's documents that join what isn't joined yet: a spanning forest.

    A document of the left side is compared with those of both sides, or, where no side is left,
    all with all. Documents of one known component need no comparison."""
    ids = group.column("node").to_numpy()
    left = group.column("side").to_numpy() == 0
    _, comp = np.unique(group.column("comp").to_numpy(), return_inverse=True)
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles").combine_chunks()]
    lengths = np.array([len(s) for s in sets])
    distinct, flat = np.unique(np.concatenate(sets), return_inverse=True)
    begins = np.cumsum(lengths) - lengths
    label, a, b = comp.copy(), [], []
    present = np.zeros(len(distinct), bool)
    for i in np.flatnonzero(left):
        if (label == label[i]).all():
            continue
        mine = flat[begins[i] : begins[i] + lengths[i]]
        present[mine] = True
        shared = np.add.reduceat(present[flat], begins, dtype=np.int64)
        present[mine] = False
        for j in np.flatnonzero(similar(shared, lengths, lengths[i], jaccard) & (label != label[i])):
            if label[j] != label[i]:
                a.append(ids[i])
                b.append(ids[j])
                label[label == label[j]] = label[i]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _parts(size, shingles) -> Column:
    """Into how many parts of a bucket documents are dealt."""
    return F.ceil(F.greatest(size / CHUNK, shingles / CHUNK_SHINGLES)).cast("int")


def _in_chunks(members: DataFrame, sets: DataFrame, jaccard: tuple[int, int]) -> DataFrame:
    """members: side, node and comp of comparing tasks, which the other columns name."""

    def compare(group: pa.Table) -> pa.Table:
        return _chunk_links(group, jaccard)

    task = [c for c in members.columns if c not in ("side", "node", "comp")]
    return members.join(sets, "node").groupBy(*task).applyInArrow(compare, "a bigint, b bigint")


@dataclass
class Classes:
    """The texts of a table by their shingle sets. rows: doc_id, mark (64-bit hash of id and text),
    n_shingles, f1, f2 (128-bit hash of the set) and row (a number of its own) of each row of the
    table; classes: f1, f2, n_shingles, rep (smallest doc_id), node (the row of one of its texts) and
    copies of each set that has words and an id; links: (a, b) between the nodes of near-duplicates,
    enough of them to join all that belong together."""

    rows: DataFrame
    classes: DataFrame
    links: DataFrame


def find_classes(docs: DataFrame, text: str, jaccard: tuple[int, int]) -> Classes:
    """Candidates share one of the bands of 5 circulant MinHash coordinates (24 at 0.85, 35 at 0.8: a
    pair at exactly the threshold is missed with probability below MISS). Small buckets give pairs, each verified once on full sets;
    large ones are dealt into chunks that one task compares in bounded memory. Then, where a large
    bucket still has several components, the documents outside its largest one are compared with
    all of the bucket, chunk by chunk: every pair of a bucket is either compared or already joined,
    and no group is gathered or expanded into all its pairs. Only one text of a set goes into
    buckets, however often it, or the row itself, is repeated.
    """
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("doc_id", text).alias("mark"), F.col(text).alias("text"))
    n_bands = bands_for(jaccard)
    sketches = source.mapInArrow(lambda frames: _sketch(frames, n_bands), "doc_id bigint, mark bigint, n_shingles bigint, f1 bigint, f2 bigint, bands array<bigint>")
    sketches = written(sketches.withColumn("row", F.monotonically_increasing_id()), "minhash-sketches")
    rows = sketches.drop("bands")
    known = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = known.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min_by("row", "doc_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes, "minhash-classes")
    first = sketches.withColumnRenamed("row", "node").join(classes.select("node"), "node", "left_semi")
    members = written(first.select("node", "n_shingles", F.explode("bands").alias("key")), "minhash-members")
    buckets = written(members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("shingles")).where("size > 1"), "minhash-buckets")
    members = written(members.join(buckets, "key"), "minhash-met")
    small, large = members.where(F.col("size") <= SMALL_BUCKET), members.where(F.col("size") > SMALL_BUCKET)

    one = small.select("key", F.col("node").alias("a"), F.col("n_shingles").alias("na"))
    two = small.select("key", F.col("node").alias("b"), F.col("n_shingles").alias("nb"))
    fits = jaccard[1] * F.least("na", "nb") >= jaccard[0] * F.greatest("na", "nb")
    pairs = one.join(two, "key").where((F.col("a") < F.col("b")) & fits).select("a", "b").distinct()
    pairs = written(pairs, "minhash-pairs")

    wanted = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).unionByName(large.select(F.col("node").alias("row"))).distinct()
    # Ids that several rows hold: their texts may be read more than once below.
    often = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    wanted = rows.join(wanted, "row").join(often, "doc_id", "left").select("doc_id", "mark", F.col("row").alias("node"), F.col("n").isNotNull().alias("again"))
    # Dealt by hash at every size: what is wanted grows with the table.
    texts = source.join(written(wanted, "minhash-wanted").hint("merge"), ["doc_id", "mark"]).select("node", "again", "text")
    sets = written(texts.mapInArrow(_sets, "node bigint, again boolean, shingles binary"), "minhash-sets")
    once = written(sets.where("again").dropDuplicates(["node"]), "minhash-sets-again")
    sets = sets.where("NOT again").unionByName(once).select("node", "shingles")
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    verified = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(lambda frames: _verify_pairs(frames, jaccard), "a bigint, b bigint")

    dealt = large.withColumn("parts", _parts(F.col("size"), F.col("shingles")))
    dealt = dealt.select("key", "parts", "n_shingles", "node", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    inner = dealt.select("key", "part", F.lit(-1).alias("other"), F.lit(0).alias("side"), "node", F.col("node").alias("comp"))
    links = written(verified.unionByName(_in_chunks(inner, sets, jaccard)), "minhash-links")
    if not large.isEmpty():
        links = _join_rest(links, dealt, sets, jaccard)
    return Classes(rows, classes, links)


def _join_rest(links: DataFrame, dealt: DataFrame, sets: DataFrame, jaccard: tuple[int, int]) -> DataFrame:
    """The links, and those between different components of a large bucket.

    Linked sets differ in size by the factor of the threshold at most, so the sizes of a bucket are cut
    into ranges of that factor, and only equal and neighbouring ranges meet."""
    parents = written(components(links, "minhash-first"), "minhash-parents")
    size_range = F.floor(F.log("n_shingles") / (math.log(jaccard[1] / jaccard[0]) * (1 + 1e-9))).cast("int")
    now = dealt.join(parents, "node", "left").select("key", "n_shingles", size_range.alias("range"), "node", F.coalesce("component", "node").alias("comp"))
    now = written(now, "minhash-now")
    counts = now.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"))
    open_keys = written(most.where("comps > 1").select("key", F.col("top.comp").alias("main")), "minhash-open")
    now = now.join(open_keys, "key")
    parts_of = lambda rows, name: rows.groupBy("key", "range").agg(_parts(F.count(F.lit(1)), F.sum("n_shingles")).alias(name))
    minor = now.where(F.col("comp") != F.col("main"))
    cells, minors = written(parts_of(now, "parts"), "minhash-cells"), written(parts_of(minor, "minor_parts"), "minhash-minors")
    near = F.explode(F.array(F.col("range") - 1, F.col("range"), F.col("range") + 1))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt_to = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    # The smaller components of a bucket, dealt anew, meet each chunk of the ranges near to theirs.
    first = minor.join(minors, ["key", "range"]).select("key", F.col("range").alias("mine"), dealt_to(5, "minor_parts").alias("other"), "node", "comp", near.alias("range"))
    first = first.join(cells, ["key", "range"]).select("key", "range", upto("parts").alias("part"), "mine", "other", F.lit(0).alias("side"), "node", "comp")
    second = now.join(cells, ["key", "range"]).select("key", "range", dealt_to(3, "parts").alias("part"), "node", "comp", near.alias("mine"))
    second = second.join(minors.withColumnRenamed("range", "mine"), ["key", "mine"]).select("key", "range", "part", "mine", upto("minor_parts").alias("other"), F.lit(1).alias("side"), "node", "comp")
    return links.unionByName(written(_in_chunks(first.unionByName(second), sets, jaccard), "minhash-rest"))


def near_duplicates(docs: DataFrame, text: str = "text", jaccard: tuple[int, int] = JACCARD) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id bigint, text).

    A text's words are lower-cased in A-Z; its set holds its distinct 5-word shingles, or its whole
    word sequence if it is shorter. Documents with jaccard[1] * shared >= jaccard[0] * union are linked. Null and
    empty texts have no set and are linked with nothing. Equal sets form one class whose smallest id
    stands for it. A null doc_id takes part in no link: component_id and kept are null. Rows that
    share a doc_id are one document with several texts: what any of them is linked with is in its
    component, which all its rows show. An empty table gives an empty table. See find_classes. Of the
    tables written on the way only the result stays.
    """
    with step(docs.sparkSession) as keep:
        return keep(_components_of(find_classes(docs, text, jaccard)), "minhash-result")


def _components_of(found: Classes) -> DataFrame:
    key = ["f1", "f2", "n_shingles"]
    often = found.rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("f1", "f2") for f in (F.min, F.max)])
    often = written(often.where("n > 1 AND (min_f1 != max_f1 OR min_f2 != max_f2)").select("doc_id"), "minhash-several")
    several = found.rows.join(often, "doc_id", "left_semi").join(found.classes.select(*key, "node"), key).select(F.col("doc_id").alias("id"), "node")
    several = written(several, "minhash-held")
    parents = smallest_ids(found.classes.select("node", F.col("rep").alias("id")), found.links.unionByName(same_document(several)), "minhash")
    parents = written(parents.select("node", F.col("least").alias("component")), "minhash-components")
    changed = found.classes.join(parents, "node", "left").where("copies > 1 OR component IS NOT NULL")
    changed = written(changed.select(*key, F.coalesce("component", "rep").alias("by_set")), "minhash-changed")
    # A row without words of a document that also has a text follows that text.
    by_id = several.join(parents, "node").groupBy("id").agg(F.min("component").alias("by_id")).withColumnRenamed("id", "doc_id")
    nodes = several.join(found.classes.select("node", "rep"), "node").groupBy("id").agg(F.min("rep").alias("by_rep")).withColumnRenamed("id", "doc_id")
    by_id = written(nodes.join(by_id, "doc_id", "left").select("doc_id", F.coalesce("by_id", "by_rep").alias("by_id")), "minhash-by-id")
    out = found.rows.join(changed, key, "left").join(by_id, "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("by_id", "by_set", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", jaccard: tuple[int, int] = STAGE_JACCARD) -> DataFrame:
    """docs with one row of each group of near-duplicate texts (linked as in near_duplicates): of
    those with its smallest doc_id one. Each row is a document of its own here, so a text that is a
    copy of nothing stays, whatever its doc_id. Rows with a null doc_id, and those without words, all
    stay. Columns pass through, whatever their names."""
    found = find_classes(docs, text, jaccard)
    parents = smallest_ids(found.classes.select("node", F.col("rep").alias("id")), found.links, "minhash")
    parents = written(found.classes.select("node", "rep").join(parents, "node", "left"), "minhash-components")
    heads = parents.where("rep = least").groupBy("component").agg(F.min("node").alias("row")).select("row")
    heads = written(parents.where("component IS NULL").select(F.col("node").alias("row")).unionByName(heads), "minhash-heads")
    known = found.rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    gone = written(known.join(heads, "row", "left_anti").select("doc_id", "mark").distinct(), "minhash-gone")
    again = written(known.join(heads, "row", "left_semi").select("doc_id", "mark").join(gone, ["doc_id", "mark"], "left_semi"), "minhash-again")
    id_, mark = fresh(docs, "id", "mark")
    named = lambda t: t.select(F.col("doc_id").alias(id_), F.col("mark").alias(mark))
    marked = docs.withColumns({id_: F.col("doc_id").cast("bigint"), mark: F.xxhash64("doc_id", text)})
    kept = marked.join(named(gone), [id_, mark], "left_anti")
    if not again.isEmpty():  # rows that stand more than once
        kept = kept.unionByName(marked.join(named(again), [id_, mark], "left_semi").dropDuplicates([id_, mark]))
    return kept.select(*docs.columns)


def op1_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), jaccard=JACCARD)
