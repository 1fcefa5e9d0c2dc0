"""op6 against a plain greedy parse, and its accuracy on text that it hasn't seen."""

import random
import tracemalloc

import numpy as np
import pytest

from tenderlake.llm import language
from tenderlake.llm.language import UNKNOWN, Model, fold, identify, training_text

SYLLABLES = {"aa": ["ka", "ro", "mi", "tes"], "bb": ["shu", "wen", "lia", "ging"], "cc": ["été", "ça", "œur", "ment"]}


def _text(lang, pick, n):
    return " ".join("".join(pick.choice(SYLLABLES[lang]) for _ in range(pick.randint(1, 4))) for _ in range(n))


def plain_phrases(sample, text):
    sample, text = fold(sample), fold(text)[:-1]
    count, at = 1, 0
    i = 0
    while i < len(text):
        if at < i and text[at : i + 1] not in sample:
            count += 1
            at = i
        elif at == i and text[i] not in sample:
            count += 1
            at = i + 1
        i += 1
    return count


@pytest.mark.parametrize("run", [1, 3, 7, 64, 512])
def test_phrases_are_those_of_a_greedy_parse(monkeypatch, run):
    """Whatever the length of the runs that are parsed side by side."""
    monkeypatch.setattr(language, "RUN", run)
    pick = random.Random(1)
    samples = {k: _text(k, pick, 60) for k in SYLLABLES}
    model = Model(samples)
    texts = [_text(pick.choice(list(SYLLABLES)), pick, pick.choice([1, 5, 40, 300])) for _ in range(20)] + ["karo" * 500, "", "1"]
    got = model.phrases([model.encode(text) for text in texts])
    for row, text in zip(got, texts, strict=True):
        for k, lang in enumerate(model.languages):
            if all(c in fold(samples[lang]) for c in fold(text)):
                assert row[k] == (plain_phrases(samples[lang], text) if fold(text)[:-1] else 0)
    monkeypatch.setattr(language, "RUN", 1 << 30)
    assert (got == model.phrases([model.encode(text) for text in texts])).all()


def test_the_sample_is_bounded_and_whole(spark):
    rows = [(i, f"text number {i} " * 10, "aa") for i in range(50)] + [(7, "one row often", "aa")] * 400 + [(100 + i, "x" * 9000, "aa") for i in range(5)] + [(200, "y" * 99_999, "bb")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    got = training_text(docs, documents=20, characters=3000)
    texts = got["aa"].split("\n")[1:]
    assert set(texts) <= {t for _, t, _ in rows} and len(texts) == len(set(texts)) and 2000 < sum(map(len, texts)) <= 3000 and not any(len(t) > 9000 for t in texts)
    assert got["bb"] == "\n" + "y" * 99_999
    assert training_text(docs.repartition(5), documents=20, characters=3000) == got


def test_accuracy_and_edge_cases(spark):
    pick = random.Random(2)
    rows = [(i, _text(lang, pick, pick.choice([3, 20, 300])), lang, 7) for i, lang in enumerate(list(SYLLABLES) * 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int")
    model = Model(training_text(docs.where("doc_id % 4 != 2")))
    got = {r.doc_id: r for r in identify(docs, model).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang, _ in rows) >= 118
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (None, _text("aa", pick, 30)), (5, "日本語"), (5, "日本語"), (6, _text("bb", pick, 30_000))], "doc_id bigint, text string")
    found = sorted((r.doc_id or 0, r.lang_pred) for r in identify(odd, model).collect())
    assert [x for x in found if x[0] in (1, 2, 3)] == [(i, UNKNOWN) for i in (1, 2, 3)]
    assert (0, "aa") in found and (6, "bb") in found
    assert len([x for x in found if x[0] == 5]) == 2
    assert identify(odd.limit(0), model).collect() == []


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "ka ro", None)], "doc_id bigint, text string, lang string")
    assert [r.lang_pred for r in identify(docs, Model(training_text(docs))).collect()] == [UNKNOWN]


@pytest.mark.parametrize("text", ["", "   ", "1 2"])
def test_without_letters(text):
    model = Model({"aa": "ka ro mi"})
    assert model.predict([text, None])[0] == [UNKNOWN, UNKNOWN]


def test_alphabets_of_any_size():
    pick = random.Random(4)
    han = [chr(c) for c in range(0x4E00, 0x4E00 + 900)]
    lexicon = ["".join(han[3 * i : 3 * i + 3]) for i in range(300)]
    chinese = lambda n: "".join(pick.choice(lexicon) + ("，" if pick.random() < 0.1 else "") for _ in range(n))
    samples = {k: _text(k, pick, 60) for k in SYLLABLES}
    model = Model(samples | {"zz": chinese(1500)})
    assert model.width > 600
    assert model.predict([chinese(40), _text("aa", pick, 30), _text("bb", pick, 30)])[0] == ["zz", "aa", "bb"]
    texts = [_text(k, pick, 40) + " Жя 日" for k in SYLLABLES]
    dense, sparse = Model(samples), Model(samples, dense_bytes=0)
    assert all(t.moves is not None for t in dense.tables.values()) and all(t.moves is None for t in sparse.tables.values())
    assert (dense.phrases([dense.encode(x) for x in texts]) == sparse.phrases([sparse.encode(x) for x in texts])).all()


def test_forty_languages_stay_within_their_bytes():
    """Full samples of 40 languages, each of 28 letters, in two scripts: what is broadcast and what the driver
    needs while it is built."""
    pick = random.Random(9)
    samples, syllables = {}, {}
    for k in range(40):
        base = ord("a") if k % 2 else 0x430
        letters = [chr(base + i) for i in range(26)] + [chr(0xE0 + k % 20), chr(0xF8 + k % 7)]
        own = syllables[f"l{k:02d}"] = ["".join(pick.choice(letters) for _ in range(pick.randint(1, 3))) for _ in range(60)]
        samples[f"l{k:02d}"] = " ".join("".join(pick.choice(own) for _ in range(pick.randint(1, 4))) for _ in range(8000))[: language.CHARACTERS]
    tracemalloc.start()
    model = Model(samples)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.nbytes < language.DENSE_BYTES + 40 * 36 * language.CHARACTERS < 180e6 and peak < 500e6
    assert {t.moves is None for t in model.tables.values()} == {True, False}
    texts = {k: " ".join("".join(pick.choice(own) for _ in range(pick.randint(1, 4))) for _ in range(30)) for k, own in syllables.items()}
    names = model.predict(list(texts.values()))[0]
    assert sum(a == b for a, b in zip(names, texts, strict=True)) >= 39


def test_cells_beyond_32_bits():
    """Where state and symbol make a number over 2**31, the step is still the right one."""
    automaton = language.Automaton([1, 2, 1, 0])
    small, wide = language.Transitions(automaton, 3, False), language.Transitions(automaton, 1 << 30, False)
    for state in range(len(automaton.next)):
        for symbol in range(3):
            one, other = (t.step(np.array([state], np.int64), np.array([symbol], np.uint8)) for t in (small, wide))
            assert one[0] == other[0]
