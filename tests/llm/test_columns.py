"""Every operator on tables with extra columns whose names clash with its own, and with odd rows."""

import collections

import pytest
from pyspark.sql import functions as F

from tenderlake.llm import classifier, fertility, language, licenses, lines, minhash, mixing, packing, repeats, secrets, spelling, vectors

CLASHING = ("key", "id", "copies", "rows", "bucket", "turn", "before", "copy", "mark", "d1", "D2", "gone", "n_lines", "blob", "rules", "spans", "missing", "node", "row", "kept", "score", "size", "target", "taken", "body", "n", "rank", "h", "y", "words", "__key", "_key")
BODY = "\n".join(f"the {i} road turned away from the river and climbed" for i in range(30))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [BODY, BODY, BODY + " once", None, "", "short", "token = abcdefghijklmnop", "All rights reserved."]
    rows = [(d, t, "en" if t else None, "s" if i % 2 else None, *[i * 100 + j for j in range(len(CLASHING))]) for i, (d, t) in enumerate(zip([1, 2, 3, 4, 5, 6, 7, None], texts, strict=True))]
    rows.append(rows[0])
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, " + ", ".join(f"{c} int" for c in CLASHING)).repartition(2)


def test_rows_pass_whole(docs):
    whole = {r for r in docs.collect()}
    for out in (mixing.apply_mix(docs), minhash.drop_near_duplicates(docs), classifier.keep_good(docs, classifier.Network(), least=0.0)):
        assert out.columns == docs.columns and {r for r in out.collect()} <= whole
    assert sorted((r.doc_id or 0) for r in minhash.drop_near_duplicates(docs).collect()) == [0, 1, 4, 5, 6, 7]
    out = lines.drop_common_lines(docs, min_docs=3)
    assert out.columns == [*docs.columns, "_n_lines", "n_dropped"]
    position = docs.columns.index("text")
    rest = lambda r: (*r[:position], *r[position + 1 : len(docs.columns)])
    assert sorted(map(rest, out.collect()), key=str) == sorted(map(rest, docs.collect()), key=str)
    assert {(r.text, r._n_lines, r.n_dropped) for r in out.where("doc_id IN (1, 3, 4)").collect()} == {("the 29 road turned away from the river and climbed", 30, 29), ("the 29 road turned away from the river and climbed once", 30, 29), (None, 1, 0)}  # the row given twice is one document


def test_answers_for_every_row(docs):
    model = language.Model(language.training_text(docs))
    found, _ = secrets.find_secrets(docs)
    answers = [found, licenses.match_licenses(docs), fertility.quality(docs), classifier.score(docs, classifier.Network()), language.identify(docs, model), mixing.mix(docs), minhash.near_duplicates(docs)]
    ids = sorted((r.doc_id or 0) for r in docs.collect())
    for out in answers:
        assert sorted((r.doc_id or 0) for r in out.collect()) == ids
    pieces = packing.pack(docs).collect()
    assert sum(p.start == 0 for p in pieces) == len(ids)


def test_vectors_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0], 7, 8, 9), (2, 0, [1.0, 0.0], 7, 8, 9)], "vec_id bigint, label int, embedding array<double>, node int, usable int, h1 int")
    assert sorted(map(tuple, vectors.near_duplicate_vectors(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_repeats_and_words_beside_clashing_columns(docs):
    out = repeats.remove_repeats(docs)
    assert out.columns == [*docs.columns, "_spans", "_kept"]
    rows = out.collect()
    assert collections.Counter(tuple(r)[: len(docs.columns)] for r in rows) == collections.Counter(map(tuple, docs.collect()))
    assert {(r.doc_id, bytes(r._kept).decode()) for r in rows if r.doc_id in (1, 3, 4, 6)} == {(1, ""), (3, " once"), (4, ""), (6, "short")}
    words = {r.word: r.n for r in spelling.word_counts(docs).collect()}
    assert words["river"] == 4 * 30 and all(len(w) >= 5 and n >= 3 for w, n in words.items())
    variants = spelling.spelling_variants(spelling.word_counts(docs).withColumns({"mask": F.lit(1), "key": F.lit("x")}))
    assert {r.word for r in variants.collect()} == set(words)


def test_long_texts_beside_short_ones(spark):
    """A text of several pieces of the hash, with a passage over their border, and one run of letters."""
    import random

    pick = random.Random(2)
    word = lambda: "".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(pick.randint(4, 9)))
    long = " ".join(word() for _ in range(300_000))
    edge = long[(1 << 20) - 300 : (1 << 20) + 300]
    docs = spark.createDataFrame([(1, long), (2, "before|" + edge + "|after"), (3, "a" * 700_000), (4, long[5000:5199]), (5, None)], "doc_id bigint, text string").repartition(2)
    got = {r.doc_id: ([tuple(s) for s in r.spans], len(r.kept)) for r in repeats.remove_repeats(docs).collect()}
    assert got[1] == ([((1 << 20) - 300, (1 << 20) + 300)], len(long) - 600) and got[2] == ([(7, 607)], 13)
    assert got[3] == ([(0, 700_000)], 0) and got[4] == ([], 199) and got[5] == ([], 0)
