"""Language identification by cross-parsing against suffix automata of labelled text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import table

#: Bounds on the labelled rows learned from: documents and characters per language. Rows are taken
#: whole or not at all.
DOCUMENTS, CHARACTERS = 64, 49_152
#: Symbols of a run: the runs of a text are parsed side by side, then joined where they meet.
RUN = 512
SLICE_CHARS = 1 << 20
UNKNOWN = "und"
_BREAK = 1 << 30
#: Bytes that the dense transition tables of all languages may take together. The smallest come first;
#: languages beyond have a sorted list of transitions, of at most 36 bytes a character of their sample.
DENSE_BYTES = 96 << 20


class Automaton:
    """The suffix automaton of a sequence of symbols: state 0 and its followers read any substring."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            state = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = state
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[state] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = link[p]
                    link[q] = link[state] = twin
            last = state


class Transitions:
    """From (state, symbol) of one language to the next state, or, where the phrase ends, to the state
    that begins a new one, marked with _BREAK. Symbols are the language's own: 0 a blank, then its
    letters, the last any other. dense: as a table of all, else as the pairs that go on, sorted."""

    def __init__(self, automaton: Automaton, width: int, dense: bool):
        self.width = width
        self.begins = np.full(width, _BREAK, np.int32)
        for c, to in automaton.next[0].items():
            self.begins[c] |= to
        pairs = np.fromiter((x for state, own in enumerate(automaton.next) for c, to in own.items() for x in (state * width + c, to)), np.int64).reshape(-1, 2)
        self.keys = self.targets = self.moves = None
        if dense:
            self.moves = np.tile(self.begins, len(automaton.next))
            self.moves[pairs[:, 0]] = pairs[:, 1]
        else:
            pairs = pairs[np.argsort(pairs[:, 0])]
            self.keys, self.targets = pairs[:, 0].copy(), pairs[:, 1].astype(np.int32)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.begins, self.keys, self.targets, self.moves) if x is not None)

    def step(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        key = state * self.width + symbols  # 64 bits: a table may have more than 2**31 cells
        if self.moves is not None:
            return self.moves[key].astype(np.int64)
        if not len(self.keys):
            return self.begins[symbols].astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.targets[at], self.begins[symbols]).astype(np.int64)


class Model:
    """The transitions of each language over its own letters, so one more language costs its own table,
    not a column in all others. Tables are dense up to dense_bytes together, the smallest first."""

    def __init__(self, samples: dict[str, str], dense_bytes: int = DENSE_BYTES):
        self.languages = sorted(samples)
        folded = {name: fold(samples[name]) for name in self.languages}
        letters = sorted(set().union(*folded.values()) - {" "})
        self.symbols = {c: i + 1 for i, c in enumerate(letters)}
        self.width = len(letters) + 2  # blank, letters, any other letter
        kind = np.uint8 if self.width <= 256 else np.uint32
        self.points = np.zeros(0x110000, kind)
        for c, i in self.symbols.items():
            self.points[ord(c)] = i
        # With more text come longer phrases, by its logarithm.
        self.scale = [np.log(max(len(folded[name]), 3)) for name in self.languages]
        self.local: list[np.ndarray] = []
        self.tables: dict[str, Transitions] = {}
        own = {name: sorted(set(folded[name]) - {" "}) for name in self.languages}
        for name in self.languages:
            local = np.full(self.width, len(own[name]) + 1, kind)
            local[0] = 0
            local[[self.symbols[c] for c in own[name]]] = np.arange(1, len(own[name]) + 1)
            self.local.append(local)
        left = dense_bytes
        for name in sorted(self.languages, key=lambda k: len(folded[k]) * len(own[k])):
            number = {" ": 0} | {c: i + 1 for i, c in enumerate(own[name])}
            automaton = Automaton([number[c] for c in folded[name]])
            size = 4 * len(automaton.next) * (len(own[name]) + 2)
            self.tables[name] = Transitions(automaton, len(own[name]) + 2, size <= left)
            left -= size if size <= left else 0

    @property
    def nbytes(self) -> int:
        return self.points.nbytes + sum(t.nbytes for t in self.tables.values()) + sum(x.nbytes for x in self.local)

    def encode(self, text: str) -> np.ndarray:
        """Symbols of a text: letters in lower case, every run of anything else as one blank."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.points[points]
        odd = np.flatnonzero(symbols == 0)
        if len(odd):
            far = odd[points[odd] >= 0xAA]
            unknown = far[[chr(p).isalpha() for p in points[far]]] if len(far) else far
            symbols = symbols.copy()
            symbols[unknown] = self.width - 1
            near = odd[points[odd] < 0xAA]
            ascii_letters = near[((points[near] >= 97) & (points[near] <= 122))]
            symbols[ascii_letters] = self.width - 1
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
        symbols = symbols[keep]
        return symbols[: len(symbols) - 1] if len(symbols) and symbols[-1] == 0 else symbols

    def phrases(self, encoded: list[np.ndarray]) -> np.ndarray:
        """Phrases per text and language: each text is parsed from left to right into the longest
        pieces that the language's sample holds, from its first symbol to its last.

        All runs take a step at a time together, each as if a phrase began with it. Then the parse
        that really enters a run is followed until it begins a phrase where the run's own did: from
        there the two are one. A run that they leave apart hands its state on to the next."""
        out = np.zeros((len(encoded), len(self.languages)))
        runs, owner, heads = [], [], []
        for i, symbols in enumerate(encoded):
            for s in range(0, len(symbols), RUN):
                runs.append(symbols[s : s + RUN])
                owner.append(i)
                heads.append(s == 0)
        if not runs:
            return out
        order = np.argsort([-len(r) for r in runs], kind="stable")
        column = np.empty(len(runs), np.int64)
        column[order] = np.arange(len(runs))
        lengths = np.array([len(runs[k]) for k in order])
        grid = np.zeros((int(lengths[0]), len(runs)), self.points.dtype)
        for c, k in enumerate(order):
            grid[: lengths[c], c] = runs[k]
        alive = np.searchsorted(-lengths, -np.arange(len(grid)), side="left")  # runs longer than t
        owners = np.array(owner)[order]
        # after[c]: the column of the run that follows in the same text, or -1.
        after = np.full(len(runs), -1)
        follows = np.flatnonzero(~np.array(heads))
        after[column[follows - 1]] = column[follows]
        for language, name in enumerate(self.languages):
            step, own_symbols = self.tables[name].step, self.local[language][grid]
            state = np.zeros(len(runs), np.int64)
            begins = np.zeros(grid.shape, bool)
            for t in range(len(grid)):
                n = alive[t]
                to = step(state[:n], own_symbols[t, :n])
                begins[t, :n] = to >> 30
                state[:n] = to & (_BREAK - 1)
            count = begins.sum(axis=0)
            own = state.copy()  # where a run ends as things stand
            entering = np.flatnonzero(after >= 0)
            while len(entering):
                at, now = after[entering], own[entering]
                changed = []
                extra, passed, t = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), 0
                while len(at):
                    ended = lengths[at] <= t
                    if ended.any():  # never met: the whole run goes on as entered
                        count[at[ended]] = extra[ended]
                        moved = own[at[ended]] != now[ended]
                        own[at[ended]] = now[ended]
                        changed.append(at[ended][moved])
                        at, now, extra, passed = at[~ended], now[~ended], extra[~ended], passed[~ended]
                        continue
                    to = step(now, own_symbols[t, at])
                    new, mine = to >> 30 > 0, begins[t, at]
                    extra, passed = extra + new, passed + mine
                    met = new & (mine | (t == 0))
                    count[at[met]] = extra[met] + begins[:, at[met]].sum(axis=0) - passed[met]
                    back = own[at[met]] != state[at[met]]
                    own[at[met]] = state[at[met]]
                    changed.append(at[met][back])
                    at, now, extra, passed = at[~met], (to & (_BREAK - 1))[~met], extra[~met], passed[~met]
                    t += 1
                again = np.concatenate(changed) if changed else np.zeros(0, np.int64)
                entering = again[after[again] >= 0]
            out[:, language] = np.bincount(owners, weights=count, minlength=len(encoded)) + [len(x) > 0 for x in encoded]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text; UNKNOWN with score 0 for null and texts without a letter."""
        encoded = [self.encode(t) if t else np.zeros(0, np.uint8) for t in texts]
        names, scores = [], np.zeros(len(texts))
        if not self.languages:
            return [UNKNOWN] * len(texts), scores
        cost = self.phrases(encoded) * np.array(self.scale)
        for i, symbols in enumerate(encoded):
            if not len(symbols) or not symbols.any():
                names.append(UNKNOWN)
                continue
            best = int(np.argmin(cost[i]))
            names.append(self.languages[best])
            # Phrase costs as nats: the share of the best language.
            scores[i] = 1 / np.exp(np.clip(cost[i, best] - cost[i], -700, 0)).sum()
        return names, scores


def fold(text: str) -> str:
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "


def training_text(docs: DataFrame, text: str = "text", lang: str = "lang", documents: int = DOCUMENTS, characters: int = CHARACTERS) -> dict[str, str]:
    """A bounded sample of labelled rows per language, each text whole: in the order of a hash, up to
    `documents` different rows whose texts come to `characters`; a text of more than an eighth of
    that comes after all others, so that a few long ones don't make the sample, the shorter first. The first
    row is taken however long it is. Nothing else is collected; repeated rows count once."""
    rows = docs.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("lang"), F.xxhash64("doc_id", text).alias("mark"), F.length(text).alias("n"))
    order = [F.when(F.col("n") > characters // 8, F.col("n")).otherwise(0), "mark"]
    first = rows.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= documents)
    so_far = F.sum("n").over(Window.partitionBy("lang").orderBy("rank"))
    first = first.withColumn("so_far", so_far).where((F.col("rank") == 1) | (F.col("so_far") <= characters)).select("lang", "mark", "rank")
    found = docs.select(F.col(lang).alias("lang"), F.xxhash64("doc_id", text).alias("mark"), F.col(text).alias("text")).join(F.broadcast(first), ["lang", "mark"])  # documents rows a language
    found = found.groupBy("lang", "mark", "rank").agg(F.first("text").alias("text"))
    out: dict[str, str] = {}
    for r in found.orderBy("lang", "rank").collect():
        out[r["lang"]] = out.get(r["lang"], "") + "\n" + r["text"]
    return out


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of each row of docs; no shuffle. Null texts and texts without a
    letter are `und` with score 0; whole texts are parsed, however long; ties go to the first
    language by name; a null doc_id stays null; an empty table gives an empty table."""
    # DENSE_BYTES and 36 bytes a sampled character at most: about 170 MB for 40 languages.
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            texts, first, size = [], 0, 0
            values = batch.column(1)
            for i in range(batch.num_rows + 1):
                value = values[i].as_py() if i < batch.num_rows else None
                if i == batch.num_rows or (texts and size + len(value or "") > SLICE_CHARS):
                    if texts:
                        names, scores = held.value.predict(texts)
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(names), pa.array(scores)], names=["doc_id", "lang_pred", "score"])
                    texts, first, size = [], i, 0
                texts.append(value)
                size += len(value or "")

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, "doc_id bigint, lang_pred string, score double")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = Model(training_text(docs.where(~held_out).select("doc_id", "text", "lang")))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
