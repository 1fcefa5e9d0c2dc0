"""The pipeline against a plain composition of the stages' meanings."""

import collections
import random
import re

import corpus_pipeline
from tenderlake.llm import classifier, mixing
from tenderlake.llm.shared import written
from tenderlake.llm.tokens import VOCABULARY, vocabulary_path, word_tokenizer

from .test_minhash import brute


def _corpus():
    pick = random.Random(8)
    word = lambda: "".join(pick.choice(["ka", "ro", "mi", "tes", "lo"]) for _ in range(pick.randint(1, 3)))
    docs, labels = [], []
    for i in range(240):
        body = "\n".join(" ".join(word() for _ in range(12)) for _ in range(5))
        junk = i % 4 == 0
        text = re.sub(r"(\w+)", r"\1###", body) if junk else body + ("\nShared  line" if i % 3 == 0 else "") + f"\n{word()}"
        docs.append((i, text, "en", f"s{i % 3 if i % 2 else 0}", len(text)))
        if i % 3:
            labels.append((i, 0 if junk else 1, 0))
    docs += [(1000 + d[0], d[1].replace(" ", "  "), *d[2:]) for d in docs[1:40] if d[0] % 4]
    docs += [(2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    return docs, labels


def test_pipeline(spark, tmp_path):
    docs, labels = _corpus()
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    frame = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = written(stage(spark, frame, str(tmp_path)), "test-stage")
        assert frame.columns == table.columns, name
        kept.append([tuple(r) for r in frame.collect()])
    good, lined, single, mixed = kept
    network = classifier.learn_from(spark, table, str(tmp_path))
    scores = {r.doc_id: r.score for r in classifier.score(table, network).collect()}
    assert sorted(r[0] for r in good) == sorted(i for i, s in scores.items() if s >= 0.5)
    assert not [r for r in good if r[1] and "###" in r[1]]
    assert {d[0] for d in docs if d[1] and len(d[1]) > 30 and "###" not in d[1]} <= {r[0] for r in good}
    key = lambda line: line.strip(" \t\n\v\f\r").lower()
    count = collections.Counter(k for r in good for k in {key(x) for x in (r[1] or "").split("\n")} if k)
    want = {r[0]: "\n".join(x for x in (r[1] or "").split("\n") if count[key(x)] < 10) for r in good}
    assert {r[0]: r[1] or "" for r in lined} == want
    assert {r[0] for r in single} == {r[0] for r in brute([(r[0], r[1]) for r in lined]) if r[3]}
    sizes = {r[0]: len((r[1] or "").split()) for r in single}
    source = {r[0]: r[3] for r in single}
    taken = collections.Counter()
    for r in mixed:
        taken[r[3]] += sizes[r[0]]
    targets = {r.source: (r.target, r.source_size) for r in mixing.source_targets(spark.createDataFrame([(source[i], n) for i, n in sizes.items()], "source string, size bigint")).collect()}
    for s, (target, _) in targets.items():
        assert abs(taken[s] - target) <= max(sizes.values())
    assert max(collections.Counter(r[0] for r in mixed).values()) <= 3
    library = word_tokenizer(vocabulary_path(VOCABULARY)).library
    total = sum(len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in mixed)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(p.length for p in pieces) == total
    assert collections.Counter(p.doc_id for p in pieces if p.start == 0) == collections.Counter(r[0] for r in mixed)


def test_near_dedup_links_from_080_up(spark):
    pick = random.Random(9)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(6))
    rows, sets = [], {}
    for i in range(0, 240, 2):  # pairs that share from 0.70 to 0.95 of their shingles
        words = [word() for _ in range(204)]
        own = pick.randint(5, 35)
        for d, w in ((i, words), (i + 1, words[:-own] + [word() for _ in range(own)])):
            rows.append((d, " ".join(w)))
            sets[d] = {tuple(w[k : k + 5]) for k in range(200)}
    share = {i: len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 240, 2)}
    assert sum(0.8 <= x < 0.85 for x in share.values()) > 10 and sum(x < 0.8 for x in share.values()) > 10
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert kept == {d for d, _ in rows if d % 2 == 0 or 100 * share[d - 1] < 80}
