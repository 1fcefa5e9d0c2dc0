"""op2: gradients against differences, accuracy on unseen rows, defined results."""

import random

import numpy as np

from tenderlake.llm import classifier


def _text(pick, junk, n=None):
    words = ["".join(pick.choice(["ka", "ro", "mi", "été", "lo"]) for _ in range(pick.randint(1, 3))) for _ in range(n or pick.choice([8, 60, 600]))]
    kind = pick.randint(0, 2)
    return " ".join(words) if not junk else "### ".join(words) if kind == 0 else " ".join(w.upper() + "!!" for w in words) if kind == 1 else " ".join([words[0]] * max(40, len(words)))


def test_gradients_are_those_of_the_loss():
    pick = random.Random(1)
    texts = [_text(pick, i % 2, 80).encode() for i in range(4)]
    sizes, y, weight = np.array([len(t) for t in texts]), np.array([0, 1, 1, 0], np.float32), np.ones(4, np.float32)
    network = classifier.Network()
    grads = network._gradients(texts, sizes, y, weight)

    def loss():
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        p = network.scores(np.frombuffer(b"".join(texts), np.uint8), offsets)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name in ("out", "hidden", "bias"):
        flat, g = network.p[name].reshape(-1), np.asarray(grads[name]).reshape(-1)
        for i in np.argsort(-np.abs(g))[:3]:
            keep, step = flat[i], 3e-3
            flat[i] = keep + step
            up = loss()
            flat[i] = keep - step
            down = loss()
            flat[i] = keep
            assert abs((up - down) / (2 * step) - g[i]) < 0.02 + 0.1 * abs(g[i]), name


def test_held_out_accuracy_and_edge_cases(spark):
    pick = random.Random(2)
    rows = [(i, _text(pick, i % 4 == 0), "x") for i in range(400)]
    labels = [(i, int(i % 4 != 0)) for i in range(200)] + [(3, None), (None, 1), (5, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    network = classifier.learn(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    got = {r.doc_id: r.score for r in classifier.score(docs, network).collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 4 != 0) for i in range(200, 400)]) > 0.95
    odd = spark.createDataFrame([(None, "a b", 1), (1, None, 2), (2, "", 3), (2, "", 3), (4, "z" * 300_000, 5)], "doc_id bigint, text string, score int")
    found = classifier.score(odd, network).collect()
    assert len(found) == 5 and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id in (1, 2)}) == 1  # null as empty
    assert classifier.score(odd.limit(0), network).collect() == []
    kept = classifier.keep_good(docs, network)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s >= 0.5}


def test_the_whole_text_counts():
    network = classifier.Network()
    data = np.frombuffer(("plain words " * 5000 + "§§§§§§§§").encode(), np.uint8)
    whole = network._chunks(data, np.array([0, len(data)]), False)[0]
    assert len(whole) == -(-(-(-(len(data) - classifier.WIDTH) // classifier.STRIDE) + 1) // classifier.PLACES)
    assert not np.allclose(whole[-1], whole[0])


def test_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    network = classifier.learn(docs, spark.createDataFrame([(1, 1)], "doc_id bigint, quality int"))
    assert 0 <= classifier.score(docs, network).first().score <= 1
