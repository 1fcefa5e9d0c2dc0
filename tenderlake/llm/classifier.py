"""A byte-level convolutional quality classifier in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import table
from .spans import batches, text_slices

#: A filter sees WIDTH bytes and moves by STRIDE; PLACES of them, overlapping the next by
#: WIDTH - STRIDE bytes, are a chunk whose strongest answer counts.
WIDTH, STRIDE, PLACES = 8, 4, 32
EMBEDDING, FILTERS, HIDDEN = 6, 32, 24
#: Bounds on the labelled rows learned from: rows and characters per label. Rows are taken whole or
#: not at all.
PER_LABEL, CHARACTERS = 1500, 1_500_000
EPOCHS, BATCH, RATE, SEED = 8, 32, 0.004, 11
_BYTES = WIDTH * EMBEDDING


def layout(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pad_to, bounds, fills, chunk_of): for texts at offsets, the padded length of each, the chunks
    of text d being bounds[d] to bounds[d + 1], the places in each chunk, and the text of each."""
    size = np.diff(offsets)
    places = np.maximum(1, -(-np.maximum(size - WIDTH, 0) // STRIDE) + 1)
    chunks = -(-places // PLACES)
    bounds = np.concatenate([[0], np.cumsum(chunks)])
    text_of = np.repeat(np.arange(len(size)), chunks)
    fills = np.full(int(bounds[-1]), PLACES)
    fills[bounds[1:] - 1] = places - (chunks - 1) * PLACES
    return places, bounds, fills, text_of


class Network:
    """Byte embedding, filters over overlapping windows, the maximum of each chunk, mean, maximum
    and spread over the chunks of a text with its length, a hidden layer, one probability."""

    def __init__(self, seed: int = SEED):
        random = np.random.default_rng(seed)
        draw = lambda *shape, scale: (random.normal(size=shape) * scale).astype(np.float32)
        n = 3 * FILTERS + 2
        self.p = {
            "embedding": draw(256, EMBEDDING, scale=0.5), "filters": draw(_BYTES, FILTERS, scale=_BYTES**-0.5), "bias": np.zeros(FILTERS, np.float32),
            "hidden": draw(n, HIDDEN, scale=n**-0.5), "hidden_bias": np.zeros(HIDDEN, np.float32), "out": draw(HIDDEN, scale=HIDDEN**-0.5), "out_bias": np.zeros(1, np.float32),
        }

    def _chunks(self, data: np.ndarray, offsets: np.ndarray, keep: bool) -> tuple:
        """The strongest answer of each filter in each chunk; with keep, also where it was given."""
        places, bounds, fills, text_of = layout(offsets)
        first = np.concatenate([np.arange(n) for n in places]) if len(places) else np.zeros(0, np.int64)
        starts = np.repeat(offsets[:-1], places) + first * STRIDE
        ends = np.repeat(offsets[1:], places)
        begins = np.cumsum(fills) - fills
        out = np.empty((len(fills), FILTERS), np.float32)
        at = np.zeros((len(fills), FILTERS), np.int64) if keep else None
        grid = np.arange(WIDTH)
        padded = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
        step = 512  # chunks at a time: what is unrolled stays small
        for c in range(0, len(fills), step):
            lo, hi = begins[c], begins[c] + fills[c : c + step].sum()
            index = starts[lo:hi, None] + grid
            window = np.where(index < ends[lo:hi, None], padded[np.minimum(index, len(data))], 0)
            answers = self.p["embedding"][window].reshape(hi - lo, _BYTES) @ self.p["filters"]
            local = begins[c : c + step] - lo
            out[c : c + step] = np.maximum.reduceat(answers, local, axis=0)
            if keep:
                for k, (a, n) in enumerate(zip(local, fills[c : c + step], strict=True)):
                    at[c + k] = lo + a + answers[a : a + n].argmax(axis=0)
        return np.maximum(out + self.p["bias"], 0), bounds, fills, text_of, at, starts, ends, padded

    def _features(self, top: np.ndarray, bounds: np.ndarray, fills: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        share = fills / np.add.reduceat(fills, bounds[:-1])[np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))]
        mean = np.add.reduceat(top * share[:, None], bounds[:-1], axis=0)
        most = np.maximum.reduceat(top, bounds[:-1], axis=0)
        spread = most - np.minimum.reduceat(top, bounds[:-1], axis=0)  # of texts that repeat themselves: none
        length = np.log1p(sizes)[:, None] / 8
        return np.concatenate([mean, most, spread, length, np.minimum(sizes, 512)[:, None] / 512], axis=1).astype(np.float32), share

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each text, over all its bytes."""
        top, bounds, fills, *_ = self._chunks(data, offsets, False)
        x, _ = self._features(top, bounds, fills, np.diff(offsets))
        z = np.tanh(x @ self.p["hidden"] + self.p["hidden_bias"]) @ self.p["out"] + self.p["out_bias"]
        return np.round(1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30))), 6)  # the same however rows are batched

    def fit(self, texts: list[bytes], sizes: list[int], labels: list[int], epochs: int = EPOCHS) -> Network:
        """Adam on the log loss, both labels weighing the same; sizes: bytes of the whole texts."""
        y, sizes_ = np.array(labels, np.float32), np.array(sizes)
        weight = np.where(y == 1, len(y) / max(1, 2 * (y == 1).sum()), len(y) / max(1, 2 * (y == 0).sum())).astype(np.float32)
        random = np.random.default_rng(SEED)
        m, v, t = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2)), None, 0
        m, v = m
        epochs = max(epochs, -(-epochs * 400 // max(1, len(y))))  # small samples get as many steps
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs)
            order = random.permutation(len(y))
            for s in range(0, len(order), BATCH):
                own = order[s : s + BATCH]
                grads = self._gradients([texts[i] for i in own], sizes_[own], y[own], weight[own])
                t += 1
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def _gradients(self, texts: list[bytes], sizes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        data = np.frombuffer(b"".join(texts), np.uint8)
        top, bounds, fills, text_of, at, starts, ends, padded = self._chunks(data, offsets, True)
        x, share = self._features(top, bounds, fills, sizes)
        h = np.tanh(x @ self.p["hidden"] + self.p["hidden_bias"])
        z = h @ self.p["out"] + self.p["out_bias"]
        dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / len(y)
        dh = dz[:, None] * self.p["out"] * (1 - h * h)
        dx = dh @ self.p["hidden"].T
        most = x[:, FILTERS : 2 * FILTERS]
        spread = dx[:, 2 * FILTERS : 3 * FILTERS]
        d_most = dx[:, FILTERS : 2 * FILTERS] + spread
        least = most - x[:, 2 * FILTERS : 3 * FILTERS]
        # Chunks that tie share what their common maximum or minimum gets.
        split = lambda mask: mask / np.add.reduceat(mask.astype(np.float32), bounds[:-1], axis=0)[text_of]
        d_top = dx[text_of, :FILTERS] * share[:, None] + d_most[text_of] * split(top == most[text_of]) - spread[text_of] * split(np.abs(top - least[text_of]) < 1e-6)
        d_top = (d_top * (top > 0)).astype(np.float32)
        index = starts[at][:, :, None] + np.arange(WIDTH)
        window = np.where(index < ends[at][:, :, None], padded[np.minimum(index, len(data))], 0)
        patch = self.p["embedding"][window].reshape(len(top), FILTERS, _BYTES)
        d_patch = (d_top[:, :, None] * self.p["filters"].T).reshape(-1, EMBEDDING)
        flat = window.ravel()
        return {
            "embedding": np.stack([np.bincount(flat, weights=d_patch[:, e], minlength=256) for e in range(EMBEDDING)], axis=1),
            "filters": np.einsum("cfb,cf->bf", patch, d_top), "bias": d_top.sum(axis=0),
            "hidden": x.T @ dh, "hidden_bias": dh.sum(axis=0), "out": h.T @ dz, "out_bias": dz.sum(keepdims=True),
        }


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", per_label: int = PER_LABEL, characters: int = CHARACTERS) -> Network:
    """A network fitted on a bounded sample of whole rows: of each label the per_label rows of smallest
    hash, as far as their texts come to `characters` (those of over a hundredth of that last, the
    shorter first; one row always). Only the sample is collected. Rows without a label or with a null id are left out; of repeated labels
    of a document the largest counts. Without both labels the network stays as drawn."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y")).withColumn("h", F.xxhash64("doc_id"))
    # A top-k of each label: every task keeps its own first rows, so no label is gathered whole.
    first = [known.where(F.col("y") == y).orderBy("h", "doc_id").limit(per_label) for y in (0, 1)]
    chosen = first[0].unionByName(first[1]).select("doc_id", "y", "h")
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("body"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("n"))
    # At most 2 * per_label ids are broadcast. What follows handles their rows alone.
    order = [F.when(F.col("n") > characters // 100, F.col("n")).otherwise(0), "h", "doc_id", "n"]
    rows = rows.join(F.broadcast(chosen), "doc_id").withColumn("rank", F.row_number().over(Window.partitionBy("y").orderBy(*order)))
    so_far = F.sum("n").over(Window.partitionBy("y").orderBy("rank"))
    rows = rows.withColumn("so_far", so_far).where((F.col("rank") == 1) | ((F.col("so_far") <= characters) & (F.col("rank") <= per_label)))
    rows = rows.select("h", "doc_id", "body", "y").orderBy("h", "doc_id", "body").collect()
    network = Network()
    if len({r["y"] for r in rows}) == 2:
        texts = [r["body"].encode() for r in rows]
        network.fit(texts, [len(t) for t in texts], [r["y"] for r in rows])
    return network


def score(docs: DataFrame, network: Network, text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of each row of docs, over the whole text; no shuffle. Null texts
    score as empty ones; a null doc_id stays null; an empty table gives an empty table."""

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            for first, end, data, offsets in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(network.scores(data, offsets))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, "doc_id bigint, score double")


def keep_good(docs: DataFrame, network: Network, text: str = "text", least: float = 0.5) -> DataFrame:
    """docs without the rows that score below least; the columns stay as they are. One pass without
    shuffle: rows travel to Python whole and come back filtered."""

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            for first, end, data, offsets in text_slices(batch, text):
                yield batch.slice(first, end - first).filter(pa.array(network.scores(data, offsets) >= least))

    return docs.mapInArrow(work, docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def learn_from(spark, docs: DataFrame, sf_dir: str) -> Network:
    learnable = ~F.coalesce(held_out(F.col("doc_id")), F.lit(True))
    return learn(docs.where(learnable).select("doc_id", "text"), table(spark, sf_dir, "labels").where(learnable).select("doc_id", "quality"))


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, learn_from(spark, docs, sf_dir))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
