"""op13 against plain Python over all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from tenderlake.llm import spelling


def counts(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def apart(a, b):
    """Whether one inserted, deleted or replaced code point makes one of the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n):
    near = {w: [v for v in n if apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "aeiouàéÿ×b"])
def test_variants_match_brute_force(spark, letters):
    pick = random.Random(letters)
    words = {"".join(pick.choice(letters) for _ in range(pick.randrange(1, 9))) for _ in range(120)}
    for w in list(words):  # edits at every place, the ends included
        at = pick.randrange(len(w) + 1)
        words |= {w[:at] + pick.choice(letters) + w[at:], w[:at] + w[at + 1 :], w[:at] + pick.choice(letters) + w[at + 1 :]}
    n = {w: pick.choice([1, 2, 3, 4, 6, 8, 16, 40]) for w in words if w}
    df = spark.createDataFrame([(w, c, 5) for w, c in n.items()], "word string, n bigint, mask int").repartition(3)
    assert sorted(map(tuple, spelling.spelling_variants(df).collect())) == brute(n)
    pairs = [(r.a, r.b) for r in spelling.near_pairs(df).collect()]
    assert len(pairs) == len(set(pairs)) == sum(apart(a, b) for a in n for b in n) // 2


def test_one_edit_flips_two_bits_at_most(spark):
    pick = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
    rows = []
    for _ in range(500):
        w = "".join(pick.choice(letters) for _ in range(pick.randrange(1, 12)))
        at, kind = pick.randrange(len(w)), pick.randrange(3)
        rows.append((w, w[:at] + (pick.choice(letters) if kind else "") + w[at + (kind < 2) :]))
    df = spark.createDataFrame(rows, "a string, b string")
    flips = df.selectExpr("*").select(spelling.parity_mask(df.a).bitwiseXOR(spelling.parity_mask(df.b)).alias("x")).collect()
    assert max(bin(r.x).count("1") for r in flips) <= 2 and any(r.x for r in flips)


def test_query_matches_plain_python(spark, tmp_path):
    pick = random.Random(8)
    words = ["".join(pick.choice("abcdeéA") for _ in range(pick.randrange(3, 8))) for _ in range(60)]
    rows = [(i, " ".join(pick.choice(words) for _ in range(200)) + pick.choice(["", "!", "\nx1y", "Straße_日本"])) for i in range(60)]
    rows.append((70, "abcde " * 40 + "abcdef " * 10 + "abcdefg " * 3))
    rows += [(60, None), (61, ""), (None, " ".join(words)), (None, " ".join(words)), (5, rows[5][1]), (62, "z" * 5000 + " " + "z" * 5001), (63, ("z" * 5000 + " ") * 4 + ("z" * 5001 + " ") * 9)]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, n int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, spelling.op13_spelling_variants(spark, str(tmp_path)).collect()))
    want = brute(counts(rows))
    assert got == want and any(w[1] for w in want) and any(w[1] and w[1] != w[2] for w in want)


def test_empty_tables(spark):
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    out = spelling.spelling_variants(spelling.word_counts(none))
    assert out.collect() == [] and out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
