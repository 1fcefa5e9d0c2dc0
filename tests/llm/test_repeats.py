"""op12: anchors, the suffix array's intervals, and removed bytes against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tenderlake.llm import repeats


def brute(texts, length):
    """For each text (bytes) its removed runs and what remains."""
    starts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = [(i, next((j for j in range(i, len(t)) if not gone[j]), len(t))) for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1])]
        out.append((runs, bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    return out


def sample(seed, alphabet="ab ", n=60, most=160):
    pick = random.Random(seed)
    make = lambda k: "".join(pick.choice(alphabet) for _ in range(k))
    shared = [make(pick.randrange(15, 60)) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [pick.choice(shared) if pick.random() < 0.4 else make(pick.randrange(1, 40)) for _ in range(pick.randrange(0, 5))]
        texts.append("".join(parts)[:most])
    return [*texts, None, "", "x" * 19, "y" * 300, "xy" * 100, texts[3], texts[3], "é" * 30, make(20) * 6]


def test_equal_windows_have_anchors_at_equal_places(monkeypatch):
    texts = [(t or "").encode() for t in sample(2)]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    at, hashes = repeats.anchors(data, ends, 20, 5)
    monkeypatch.setattr(repeats, "PIECE", 61)
    again, same = repeats.anchors(data, ends, 20, 5)
    assert at.tolist() == again.tolist() and hashes.tolist() == same.tolist()
    places, seen, begin = set(at.tolist()), {}, 0
    for t in texts:
        for i in range(len(t) - 19):
            own = tuple(k for k in range(16) if begin + i + k in places)
            assert own  # each window has one
            seen.setdefault(t[i : i + 20], []).append(set(own))
        begin += len(t)
    assert all(set.intersection(*x) for x in seen.values())


def suffixes(text):
    """The suffix array of a text, its common prefixes and the letters before: each suffix is a row."""
    matrix = np.zeros((len(text), len(text) + 1), np.uint16)
    for i in range(len(text)):
        matrix[i, : len(text) - i] = [ord(c) + 1 for c in text[i:]]
    *_, (column, order, prefixes) = repeats.suffix_arrays(matrix, np.zeros(len(text), int))
    assert column == 0
    return order, prefixes, np.array([ord(text[i - 1]) if i else -1 for i in order])


def test_intervals_are_the_maximal_repeats():
    text = "abcabxabcabyab"
    order, prefixes, left = suffixes(text)
    assert [text[i:] for i in order] == sorted(text[i:] for i in range(len(text)))
    common = lambda x, y: next((k for k, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))  # noqa: E731, B905
    assert prefixes.tolist() == [0, *[common(text[i:], text[j:]) for i, j in zip(order[:-1], order[1:], strict=True)]]
    found = {(text[order[i] : order[i] + n], tuple(sorted(order[i : j + 1].tolist()))) for i, j, n in repeats.maximal_repeats(prefixes, left, 2)}
    # bcab and others always follow the same letter, so they are no repeats of their own
    assert found == {("ab", (0, 3, 6, 9, 12)), ("abcab", (0, 6))}


def test_intervals_against_brute_force():
    pick = random.Random(5)
    for _ in range(60):
        text = "".join(pick.choice("ab") for _ in range(pick.randrange(2, 60)))
        order, prefixes, left = suffixes(text)
        found = {text[order[i] : order[i] + n]: sorted(order[i : j + 1].tolist()) for i, j, n in repeats.maximal_repeats(prefixes, left, 3)}
        kept = repeats._various(prefixes, left, 3)
        few = {text[order[kept][i] : order[kept][i] + n]: sorted(order[kept][i : j + 1].tolist()) for i, j, n in repeats.maximal_repeats(prefixes[kept], left[kept], 3)}
        places = defaultdict(list)
        for i in range(len(text)):
            for j in range(i + 3, len(text) + 1):
                places[text[i:j]].append(i)
        want = {}
        for s, at in places.items():
            before, after = {text[i - 1] if i else "" for i in at}, {text[i + len(s) : i + len(s) + 1] for i in at}
            if len(at) > 1 and (len(before) > 1 or "" in before) and (len(after) > 1 or "" in after):
                want[s] = at
        assert found == few == want


@pytest.mark.parametrize(("seed", "alphabet", "group", "task"), [(1, "ab ", 4096, 4096), (2, "ab", 2, 3), (3, "abcdefgh ", 1, 1), (4, "abcdefgh é", 3, 5)])
def test_removed_bytes_match_brute_force(spark, monkeypatch, seed, alphabet, group, task):
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "TASK", task)
    texts = sample(seed, alphabet)
    df = spark.createDataFrame([(i if i % 7 else None, t, "a", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, spans string, h1 int").repartition(3)
    out = repeats.remove_repeats(df, length=20, gram=5)
    assert out.columns == ["doc_id", "text", "spans", "h1", "_spans", "kept"]
    got = sorted(((r.text, [(s.start, s.end) for s in r._spans], bytes(r.kept)) for r in out.collect()), key=str)
    want = brute([(t or "").encode() for t in texts], 20)
    assert got == sorted(((t, runs, kept) for t, (runs, kept) in zip(texts, want, strict=True)), key=str)


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_query_matches_brute_force(spark, tmp_path):
    pick = random.Random(9)
    words = ["".join(pick.choice("abcdefghij") for _ in range(pick.randrange(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(pick.choice(words) for _ in range(n))
    passages = [prose(60) for _ in range(4)] + ["z" * 199, "z" * 200]
    texts = [" ".join(pick.choice([prose(pick.randrange(5, 80)), pick.choice(passages)]) for _ in range(pick.randrange(1, 6))) for _ in range(80)]
    texts += [None, "", texts[0], texts[0], prose(3000), "long " * 5000, passages[0][:200], passages[0][:199], passages[1][1:201]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, repeats.op12_suffix_array_dedup(spark, str(tmp_path)).collect()))
    raw = [(t or "").encode() for t in texts]
    want = [(i, len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()) for i, (t, (runs, kept)) in enumerate(zip(raw, brute(raw, 200), strict=True))]
    assert got == want
    assert sum(w[2] > 0 for w in want) > 40
