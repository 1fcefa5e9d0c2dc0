"""op4: an exact round trip, and little padding."""

import random
import zlib

import numpy as np

from tenderlake.llm import packing
from tenderlake.llm.tokens import VOCABULARY, WordTokenizer, vocabulary_path, word_tokenizer

HARD = ["", "  ", "it's don't 12.5 'll", "Ünïcode ß ẞ İstanbul", "日本語 text", "a<|endoftext|>b", "x y", "ﬁ ª²³¼", "é é", "\x00a\x1fb", "tab\tnew\nline", "ΑΣ ΟΔΟΣ", "😀 hi", "$$$ ***a1b22", "don´t `a´ '", "A" * 5000]


def test_ids_are_the_librarys():
    tokenizer = WordTokenizer(vocabulary_path(VOCABULARY))
    pick = random.Random(2)
    texts = HARD + [" ".join("".join(pick.choice("abcéßZ1.,-") for _ in range(pick.randint(1, 9))) for _ in range(200)) for _ in range(20)]
    for _ in range(2):  # the second time from the cache
        for text, ids in zip(texts, tokenizer(texts), strict=True):
            assert tokenizer.library.encode(text, add_special_tokens=False).ids == ids.tolist()


def test_round_trip_and_padding(spark):
    pick = random.Random(4)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(4))
    rows = [(i, " ".join(word() for _ in range(pick.choice([0, 1, 5, 50, 500, 3000])))) for i in range(300)]
    rows += [(900, None), (901, None), (None, "a b"), (5, rows[5][1])] + [(1000 + i, t) for i, t in enumerate(HARD)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = packing.pack(df, length=512, windows=8).toPandas()
    library = word_tokenizer(vocabulary_path(VOCABULARY)).library
    ids = {(d, t): np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t in rows}
    by_doc = {}
    for (d, _), x in ids.items():
        by_doc.setdefault(d, []).append(x)
    for r in got.itertuples():
        doc = None if r.doc_id != r.doc_id else int(r.doc_id)
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in by_doc[doc])
    for doc, group in got.groupby("doc_id"):
        copies = 2 if doc == 5 else 1
        total = len(by_doc[int(doc)][0])
        covered = np.zeros(total, int)
        for r in group.itertuples():
            covered[r.start : r.start + r.length] += 1
        assert (covered == copies).all()
    assert got.length.min() >= 1
    used = got.groupby("sequence_id").length.sum()
    assert used.max() <= 512
    for _, group in got.sort_values("offset").groupby("sequence_id"):
        assert (group.offset.to_numpy() == np.concatenate([[0], np.cumsum(group.length)[:-1]])).all()
    assert (used < 512).sum() <= 5


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
