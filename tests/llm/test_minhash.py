"""op1 against brute force over word sets."""

import collections
import random
import re

import pytest

from tenderlake.llm import minhash


def brute(rows):
    sets = []
    for _, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set()))
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in where[x] if j > i}:
            if 100 * len(s & sets[j]) >= 85 * len(s | sets[j]):
                a, b = sorted((root(rows[i][0]), root(rows[j][0])))
                parent[b] = a
    return sorted((d, len(s), root(d), root(d) == d) for (d, _), s in zip(rows, sets))


def _rows():
    pick = random.Random(5)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    rows = [(i, None if i == 3 else "" if i == 4 else " \t\n" if i == 5 else "one two" if i in (6, 7) else "One two") for i in range(3, 10)]
    for i in range(100, 400):  # a large group of near copies, at and around the threshold
        words = list(base)
        for _ in range(pick.choice([0, 1, 1, 2, 2, 3])):
            words[pick.randrange(120)] = word()
        rows.append((i, " ".join(words)))
    for i in range(500, 530):
        words = [word() for _ in range(pick.choice([3, 6, 30, 2000]))]
        rows += [(i, " ".join(words)), (i + 100, " ".join(words).upper()), (i + 200, " ".join(words[: int(len(words) * 0.9)] + [word()]))]
    return rows


@pytest.mark.parametrize(("small", "chunk", "shingles"), [(16, 512, 2_000_000), (2, 8, 2_000_000), (2, 512, 1000)])
def test_components_match_brute_force(spark, monkeypatch, small, chunk, shingles):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", small)
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    monkeypatch.setattr(minhash, "CHUNK_SHINGLES", shingles)
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted(map(tuple, minhash.near_duplicates(df).collect())) == brute(rows)


def test_empty_table_null_ids_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert minhash.near_duplicates(empty).collect() == []
    text = "a b c d e f g h"
    df = spark.createDataFrame([(None, text, 1), (2, text, 2), (2, text, 3), (1, "x", 4)], "doc_id bigint, text string, kept int")
    got = sorted(map(tuple, minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 4, None, None), (2, 4, 2, True), (2, 4, 2, True), (1, 1, 1, True)], key=str)
    assert sorted((r.doc_id or 0) for r in minhash.drop_near_duplicates(df).collect()) == [0, 1, 2]
    assert minhash.drop_near_duplicates(df).columns == df.columns


def test_rows_that_share_an_id_are_one_document_but_texts_of_their_own(spark):
    a, b, c = "a b c d e f g h", "p q r s t u v w", "k l m n o p q r"
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (7, c, 4), (9, b, 5), (9, None, 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, mark int").repartition(3)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    assert got == {(3, 4, 3, True), (5, 4, 3, False), (7, 4, 7, True), (9, 4, 3, False), (9, 0, 3, False)}
    out = minhash.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=str) == [(3, a, 1), (5, b, 3), (7, c, 4), (9, None, 6)]


def test_a_row_that_stands_many_times_is_compared_once(spark, monkeypatch):
    sent = []
    real = minhash._in_chunks

    def spy(members, sets, jaccard):
        sent.append(members.join(sets, "node").count())
        return real(members, sets, jaccard)

    monkeypatch.setattr(minhash, "_in_chunks", spy)
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words))] * 2000 + [(i, " ".join([*words, f"x{i}"])) for i in range(2, 30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = collections.Counter(map(tuple, minhash.near_duplicates(df).collect()))
    assert got[(1, 56, 1, True)] == 2000 and {(k[2], k[3]) for k in got if k[0] != 1} == {(1, False)}
    assert sum(sent) < 10_000
    assert [r.doc_id for r in minhash.drop_near_duplicates(df).collect()] == [1]


def test_signatures_estimate_jaccard():
    import numpy as np

    pick = np.random.default_rng(1)
    a = np.unique(pick.integers(0, 2**63, 1000).astype(np.uint64))
    b = np.concatenate([a[:800], np.unique(pick.integers(0, 2**63, 200).astype(np.uint64))])
    s = minhash.signatures([a, b], 512)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.08


def test_ranges_of_sizes_that_cannot_link_do_not_meet(spark, monkeypatch):
    """A bucket of sets that share a band but differ in size: only those of near sizes are compared."""
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 2)
    monkeypatch.setattr(minhash, "CHUNK", 4)
    sent = []
    real = minhash._in_chunks

    def spy(members, sets, jaccard):
        sent.append(members.count())
        return real(members, sets, jaccard)

    monkeypatch.setattr(minhash, "_in_chunks", spy)
    pick = random.Random(3)
    rows = []
    for i in range(60):  # a hundred words in common, then more and more of their own
        own = [f"o{i}w{k}" for k in range(int(100 * 1.15 ** (i % 12)) - 99)]
        rows.append((i, " ".join([f"c{k}" for k in range(100)] + own)))
    rows += [(100 + i, rows[i][1] + f" tail{i}") for i in range(0, 60, 7)]
    pick.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted(map(tuple, minhash.near_duplicates(df).collect())) == brute(rows)
    assert len(sent) == 2 and sent[1] > 0
