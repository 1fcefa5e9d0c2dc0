"""Landed files, damaged records, snapshots over time."""

import io
import random
import zipfile

from pyspark.sql import functions as F

from tenderlake.operators import history
from tenderlake.sources import readers, records


def test_files_are_listed_by_suffix_and_large_ones_not_read(spark, tmp_path, monkeypatch):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    for name, body in (("a.txt", b"plain words"), ("deep/b.csv", "Clôture".encode("utf-16")), ("deep/er/c.txt", b"x" * 5000), ("d.exe", b"MZ")):
        (tmp_path / name).write_bytes(body)
    monkeypatch.setattr(readers, "MAX_BYTES", 1000)
    files = readers.landed(spark, str(tmp_path), (".txt", ".csv"))
    got = {r.url.rpartition("/")[2]: None if r.content is None else len(r.content) for r in files.collect()}
    assert got == {"a.txt": 11, "b.csv": 16, "c.txt": None}
    read = {r.url.rpartition("/")[2]: (r.text, r.note) for r in readers.read_documents(files).collect()}
    assert read["a.txt"] == ("plain words", "") and read["b.csv"] == ("Clôture", "") and read["c.txt"][0] == "" and read["c.txt"][1]
    assert len(readers.landed(spark, str(tmp_path)).collect()) == 4


def test_members_are_handed_on_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(readers, "HANDED_ON", 100)
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as box:
        for i in range(20):
            box.writestr(f"{i:02d}.txt", f"member {i} " * 10)
    df = spark.createDataFrame([(f"{k}.zip", bytearray(body.getvalue()), None) for k in range(3)] + [("none", None, None)], "url string, content binary, content_type string")
    out = readers.read_documents(df).collect()
    assert len(out) == 61 and sum(r.text.startswith("member") for r in out) == 60 and {r.url for r in out if r.note} == {"none"}


def test_damaged_records_are_parted_and_read_again(spark, tmp_path):
    lines = [("s1", '{"a": 1, "b": "x"}'), ("s1", '{"a": "2"}'), ("s1", '{"a": 3'), ("s1", None), ("s1", "  "), ("s2", "[]"), ("s2", "nothing"), ("s3", "{}"), ("s3", '{"a": null, "c": 5}'), (None, '{"a": 9}')]
    df, place, schema = spark.createDataFrame(lines, "source string, raw string"), f"{tmp_path}/t", "a int, b string"
    assert records.ingest(df, schema, place) == {"good": 4, "damaged": 6}
    assert sorted(map(tuple, records.good(spark, place, schema, 0).collect()), key=str) == sorted([("s1", 1, "x"), ("s3", None, None), ("s3", None, None), (None, 9, None)], key=str)
    assert {(r.source, r.raw) for r in records.quarantine(spark, place, 0).collect()} == {lines[k] for k in (1, 2, 3, 4, 5, 6)}
    assert {(r.source, r.good, r.damaged, r.state) for r in records.source_log(spark, place).collect()} == {("s1", 1, 4, "partial"), ("s2", 0, 2, "skipped"), ("s3", 2, 0, "whole"), (None, 1, 0, "whole")}
    # The second run reads the six alone, and wins one back.
    assert records.retry(spark, place, schema, 0, lambda raw: F.regexp_replace(raw, r'"(\d+)"', "$1")) == {"good": 1, "damaged": 5}
    assert [tuple(r) for r in records.good(spark, place, schema, 1).collect()] == [("s1", 2, None)]
    assert records.retry(spark, place, schema, 1, lambda raw: raw) == {"good": 0, "damaged": 5}
    assert records.good(spark, place, schema, 2).collect() == [] and records.quarantine(spark, place, 2).count() == 5
    assert records.ingest(df, schema, place) == {"good": 4, "damaged": 6} and records.good(spark, place, schema, 0).count() == 4  # again, in its own place
    assert records.ingest(df.limit(0), schema, f"{tmp_path}/none") == {"good": 0, "damaged": 0}


def test_stays_and_versions_match_a_walk_through_the_snapshots(spark):
    pick = random.Random(3)
    taken = {(p, t) for p in range(6) for t in range(12) if pick.random() < 0.8}
    shown = {(p, h, t) for p, t in taken for h in "abc" if pick.random() < 0.6}
    items = spark.createDataFrame([*shown, *list(shown)[:9]], "url int, href string, at int").repartition(3)
    got = {tuple(r) for r in history.presence(items, spark.createDataFrame(list(taken), "url int, at int")).collect()}
    want = set()
    for p in range(6):
        times = sorted(t for q, t in taken if q == p)
        for h in "abc":
            stay, open_ = 0, None
            for k, t in enumerate([*times, None]):
                if t is not None and (p, h, t) in shown:
                    stay, open_ = (stay + 1, [t, t, 0]) if open_ is None else (stay, open_)
                    open_[1:] = [t, open_[2] + 1]
                elif open_:
                    want.add((p, h, stay, *open_, t))
                    open_ = None
                assert k <= len(times)
    assert got == want and any(r[2] > 1 for r in want) and any(r[6] is None for r in want) and any(r[6] is not None for r in want)
    texts = [(p, t, pick.choice(["x", "y", None])) for p, t in sorted(taken)]
    out = sorted(tuple(r) for r in history.versions(spark.createDataFrame([*texts, (0, texts[0][1], texts[0][2])], "url int, at int, text_hash string")).select("url", "version", F.coalesce("text_hash", F.lit("")), "since", "last_seen", "n_seen", F.coalesce("replaced_at", F.lit(-1))).collect())
    runs = []
    for p, t, h in texts:
        if runs and runs[-1][0] == p and runs[-1][2] == (h or ""):
            runs[-1][4:6] = [t, runs[-1][5] + 1]
        else:
            if runs and runs[-1][0] == p:
                runs[-1][6] = t
            runs.append([p, runs[-1][1] + 1 if runs and runs[-1][0] == p else 1, h or "", t, t, 1, -1])
    assert out == [tuple(r) for r in runs] and max(r[1] for r in runs) > 2
