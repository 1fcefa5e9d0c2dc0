"""Readers, sinks and the stream."""

import io
import json
import os
import random
import zipfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlake.functions import text
from tenderlake.operators import register
from tenderlake.sources import readers, sinks
from tenderlake.streaming import register_stream

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def _zip(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml").replace("_txt", ".txt").replace("_rtf", ".rtf"), body)
    return out.getvalue()


DOCX = _zip(word__document_xml=f"<w:document {W}><w:body><w:p><w:r><w:t>Closing 2026-10-12</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
XLSX = _zip(xl__workbook_xml=f'<workbook {M}><sheets><sheet name="Prices"/></sheets></workbook>', xl__sharedStrings_xml=f"<sst {M}><si><t>desk</t></si></sst>", xl__worksheets__sheet1_xml=f'<worksheet {M}><sheetData><row><c t="s"><v>0</v></c><c><v>12</v></c></row></sheetData></worksheet>')


def test_documents_of_all_kinds(spark):
    files = {
        "a.docx": (DOCX, "Closing 2026-10-12\na | b"), "b.xlsx": (XLSX, "[SHEET: Prices]\ndesk | 12"), "c.rtf": (rb"{\rtf1 Closing \b 2026-10-12}", "2026-10-12"),
        "d.csv": ("Clôture;2026-10-12".encode("utf-16"), "Clôture;2026-10-12"), "e.txt": ("Clôture 2026-10-12".encode("cp1252"), "Clôture 2026-10-12"), "f.txt": ("due 2026-10-12".encode("utf-16-le"), "due 2026-10-12"),
        "g.zip": (_zip(one_txt="inner 2026-10-12"), "inner 2026-10-12"), "h.html": (b"<script>x</script><p>due 2026-10-12</p>", "due 2026-10-12"),
        "i": (b"plain words that are long enough to be read as text", "plain words"), "j.docx": (b"broken", ""), "k.doc": (b"x", ""), "l.bin": (b"\xff\x00\x81", ""), "m.txt": (b"", ""), "n": (DOCX, "Closing 2026-10-12"), "o.xls": (XLSX, "desk | 12"), "p.xls": (b"\xd0\xcf\x11\xe0old", ""),
    }
    df = spark.createDataFrame([(n, bytearray(b), None) for n, (b, _) in files.items()], "url string, content binary, content_type string")
    got = {r.url: r for r in readers.read_documents(df).collect()}
    for name, (_, want) in files.items():
        assert want in got[name].text and (bool(want) or (got[name].text == "" and got[name].note)), name
    assert got["g.zip"].member == "one.txt" and got["a.docx"].member == ""


def test_members_of_zip_files_are_rows(spark):
    inner = _zip(deep_txt="deep 2026-10-12")
    box = _zip(**{"a_txt": "first", "b_rtf": r"{\rtf1 second}", "c.bin": b"\xff\x00\x81", "d.zip": inner, "e.docx": b"PKbroken"})
    many = _zip(**{f"m{i}_txt": f"member {i}" for i in range(30)})
    df = spark.createDataFrame([("x.zip", bytearray(box), None), ("y", bytearray(many), "application/zip"), ("z.zip", bytearray(b"PKno"), None)], "url string, content binary, content_type string")
    read = readers.read_documents(df)
    got = {(r.url, r.member): (r.text, bool(r.note), r.truncated) for r in read.collect()}
    assert got[("x.zip", "a.txt")] == ("first", False, False) and got[("x.zip", "d.zip/deep.txt")][0] == "deep 2026-10-12"
    assert got[("x.zip", "c.bin")][:2] == ("", True) and got[("x.zip", "e.docx")][:2] == ("", True) and got[("z.zip", "")][:2] == ("", True)
    assert len([k for k in got if k[0] == "y"]) == 26 and got[("y", "")] == ("", True, True)
    joined = {r.url: r for r in readers.joined_members(read).collect()}
    assert joined["x.zip"].text.startswith("[ZIP MEMBER: a.txt]\nfirst\n\n[ZIP MEMBER: b.rtf]") and joined["x.zip"].unread == 2 and joined["y"].truncated


def test_what_is_a_document(spark):
    cases = [("a.docx", "", True), ("a.html", "application/pdf", False), ("x", "application/pdf", True), ("x/", "", False), ("a.pdf?b=1", "", True), ("page", "text/html", False), ("data.csv", "", True)]
    df = spark.createDataFrame(cases, "n string, t string, want boolean")
    assert df.where(text.is_document(F.col("n"), F.col("t")) != F.col("want")).count() == 0


def test_json_and_robots(spark, tmp_path):
    assert readers.json_table(spark, f"{tmp_path}/none.json", "a int").count() == 0
    (tmp_path / "x.json").write_text('[{"a": 1}, {"a": "oops"}]')
    assert readers.json_table(spark, f"{tmp_path}/x.json", "a int").where("a = 1").count() == 1
    urls = spark.createDataFrame([("https://h.example/private/x",), ("https://h.example/open",), ("https://other.example/private",)], "url string")
    robots = spark.createDataFrame([("h.example", "User-agent: *\nDisallow: /private/")], "host string, body string")
    assert {r.url: r.allowed for r in readers.robots_allowed(urls, robots).collect()} == {"https://h.example/private/x": False, "https://h.example/open": True, "https://other.example/private": True}
    assert {r.format for r in readers.capabilities(spark).where("readable").collect()} >= {"docx", "xlsx", "zip"}


def test_bundle_and_seal(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert sinks.bundle({"t": df, "u": df}).where("table = 'u'").first().json == '{"a":1,"b":"x"}'
    key = F.lit("0123456789abcdef")
    r = df.select(F.aes_decrypt(F.unbase64(sinks.sealed(F.col("b"), key)), key, F.lit("GCM")).cast("string").alias("back")).first()
    assert r.back == "x"
    sinks.write_tables({"t": df}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1


def test_stream_keeps_the_register(spark, tmp_path):
    src, table = tmp_path / "in", tmp_path / "register"
    src.mkdir()
    row = {"sol": "19AB1026Q0002", "link": "https://x.usembassy.gov/a", "title": "Desks for the office", "tier": "BID", "deadline": "2026-11-01", "status": "Active", "updated": "2026-05-01"}
    (src / "1.json").write_text(json.dumps(row) + "\n" + json.dumps(row | {"sol": "RFQ 19AB1026Q0002", "value": "5"}))
    register_stream.start(spark, str(src), str(table), f"{tmp_path}/cp", "2026-06-01").awaitTermination()
    first = register_stream.current(spark, str(table)).collect()
    assert len(first) == 1 and first[0].value == "5"
    (src / "2.json").write_text(json.dumps(row | {"tier": "NO", "archived": True, "status": "Cancelled", "deadline": None, "updated": "2026-05-20"}))
    register_stream.start(spark, str(src), str(table), f"{tmp_path}/cp", "2026-06-01").awaitTermination()
    second = register_stream.current(spark, str(table)).collect()
    assert len(second) == 1 and second[0].archived and second[0].tier == "NO" and second[0].deadline is None


def _rows(spark, ids, **given):
    fields = T.StructType.fromDDL(register.REGISTER)
    base = {"link": "https://x.usembassy.gov/a", "title": "Desks for the office", "tier": "BID", "deadline": "2026-11-01", "updated": "2026-05-01"} | given
    return spark.createDataFrame([tuple((base | {"sol": f"19AB1026Q{i:04d}"}).get(f.name) for f in fields) for i in ids], fields)


def _files(folder):
    return {os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def test_batches_write_only_the_parts_they_touch(spark, tmp_path):
    table = f"{tmp_path}/register"
    put = lambda df, number: register_stream.upsert(df, number, table, "2026-06-01", parts=16)
    assert put(_rows(spark, range(500)), 0) == list(range(16))
    first = _files(table)
    assert len(first) == 16  # one file a part
    touched = put(_rows(spark, (3, 4), value="7", updated="2026-05-02"), 1)
    assert 1 <= len(touched) <= 2 and len(_files(table) - first) == len(touched)
    got = {r.sol: r.value for r in register_stream.current(spark, table).collect()}
    assert len(got) == 500 and {s for s, v in got.items() if v} == {"19AB1026Q0003", "19AB1026Q0004"}
    # A batch of no usable rows and one whose rows are junk leave all others as they are.
    junk = _rows(spark, (900,), link="https://elsewhere.example", title="", deadline=None).withColumn("sol", F.lit(None).cast("string"))
    assert put(_rows(spark, ()), 2) == [] and len(put(junk, 3)) == 1
    assert register_stream.current(spark, table).count() == 500


def test_a_batch_that_is_run_again_writes_the_same(spark, tmp_path):
    table = f"{tmp_path}/register"
    put = lambda df, number: register_stream.upsert(df, number, table, "2026-06-01", parts=4)
    show = lambda: sorted(map(str, register_stream.current(spark, table).collect()))
    put(_rows(spark, range(40), repairTries=1), 0)
    before = show()
    again = _rows(spark, range(10), files=["a", "b"], updated="2026-05-09", source="SAM", verifyNotes=["re-scan: gave up"])
    put(again, 1)
    after = show()
    put(again, 1)
    assert show() == after != before
    # A batch that broke off after some parts: readers see what was before, and its second run all of it.
    os.remove(f"{table}/_batches/1")
    assert show() == before
    put(again, 1)
    assert show() == after
    for number in (2, 3, 4):
        put(_rows(spark, range(40), updated=f"2026-05-1{number}"), number)
    assert len([d for d in os.listdir(f"{table}/part=0") if d.startswith("v=")]) == 2 and len(show()) == 40


def test_batches_equal_one_merge(spark, tmp_path):
    pick = random.Random(2)
    batches = [_rows(spark, [pick.randrange(30) for _ in range(25)], value=str(k) if k % 2 else "", updated=f"2026-05-{10 + pick.randrange(9)}", files=[f"f{k}"], archived=k == 3, repairTries=k) for k in range(5)]
    for k, batch in enumerate(batches):
        register_stream.upsert(batch, k, f"{tmp_path}/r", "", parts=4)
    rows = None
    for k, batch in enumerate(batches):
        given = batch.withColumns({"shard": F.lit(k), "at": register.stamp(), "pos": F.xxhash64(F.to_json(F.struct("*")))})
        rows = given if rows is None else rows.unionByName(given)
    whole = register.archive(register.merge_copies(register.with_key(rows), ["shard", "at", "pos"]), "")
    pick_ = lambda df: sorted((r.key, r.value, r.updated, sorted(r.files), r.archived, r.repairTries) for r in df.collect())
    assert pick_(register_stream.current(spark, f"{tmp_path}/r")) == pick_(whole)


def test_entry_registers_queries_with_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 60


def test_a_part_is_merged_by_many_tasks(spark, tmp_path):
    """One part, however many rows it has, isn't the work of one task; no key is dealt to two."""
    fields = spark.createDataFrame([], register.REGISTER).schema
    rows = spark.createDataFrame([tuple({"sol": f"19AB1026Q{i % 200:04d}", "tier": "MID", "title": f"t{i}"}.get(f.name) for f in fields) for i in range(400)], fields)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        for number in range(2):  # the second upon the first
            register_stream.upsert(rows, number, f"{tmp_path}/r", "", parts=1)
    finally:
        spark.conf.unset(name)
    for number in range(2):
        files = list((tmp_path / "r" / "part=0" / f"v={number}").glob("*.parquet"))
        keys = [{r.key for r in spark.read.parquet(str(f)).select("key").collect()} for f in files]
        assert len(files) == 4 and sum(map(len, keys)) == len(set.union(*keys)) == 200
    assert register_stream.current(spark, f"{tmp_path}/r").count() == 200
