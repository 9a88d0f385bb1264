import zipfile

import pytest
from pyspark.sql import functions as F

from docledger.operators.costing import explode_recipes
from docledger.sources import files, sinks
from docledger.streaming import metrics


def test_grid_finds_each_files_delimiter(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name;qty\nApple;2\n;;\nPear;3;x\n", encoding="utf-8-sig")
    (tmp_path / "b.csv").write_text('name,qty\n"Apple, red",2\n')
    rows = {(r["path"][-5:], r["row_idx"]): r["cells"] for r in files.grid(spark, str(tmp_path)).collect()}
    assert rows[("a.csv", 0)] == ["name", "qty"] and rows[("a.csv", 3)] == ["Pear", "3", "x"] and ("a.csv", 2) not in rows
    assert rows[("b.csv", 1)] == ["Apple, red", "2"]


def test_grid_of_wide_and_quoted_rows(spark, tmp_path):
    (tmp_path / "w.csv").write_text(",".join(f"c{i}" for i in range(200)) + '\n"a ""b""\nc",1\n' + "x;y," * 30 + "\n")
    got = [r["cells"] for r in files.grid(spark, str(tmp_path)).orderBy("row_idx").collect()]
    assert got[0] == [f"c{i}" for i in range(200)] and got[1] == ['a "b" c', "1"] and len(got[2]) == 31
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "late.csv").write_text("title\n" * 30 + "a|b|c\n" * 3)
    assert files.grid(spark, str(tmp_path / "n")).filter("size(cells) = 3").count() == 3


def test_workbook_sheets_by_relationship(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><sheets><sheet name="B" sheetId="1" r:id="r2"/><sheet name="A" sheetId="2" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></R>')
        for n, v in ((1, "of A"), (2, "of B")):
            z.writestr(f"xl/worksheets/sheet{n}.xml", f'<worksheet {main}><sheetData><row><c r="A1" t="inlineStr"><is><t>{v}</t></is></c></row></sheetData></worksheet>')
    assert [(r["sheet"], r["cells"]) for r in files.workbooks(spark, str(tmp_path)).collect()] == [("B", ["of B"]), ("A", ["of A"])]


def test_texts_replace_bad_bytes(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes(b"\xef\xbb\xbfab\xff c")
    assert [r["text"] for r in files.texts(spark, str(tmp_path)).collect()] == ["ab\ufffd c"]


def test_workbook_keeps_blank_cells(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="One"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Apple</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c></row></sheetData></worksheet>')
    (tmp_path / "bad.xlsx").write_bytes(b"no workbook")
    assert [tuple(r)[1:] for r in files.workbooks(spark, str(tmp_path)).collect()] == [("One", 0, ["Apple", "", "2.5"])]


def test_listing_and_items(spark, tmp_path):
    (tmp_path / "x.PDF").write_bytes(b"1")
    (tmp_path / "x.exe").write_bytes(b"1")
    assert [r["file_type"] for r in files.listing(spark, str(tmp_path)).collect()] == ["PDF"]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "t.json").write_text('[{"type":"ocr_items","items":[{"text":"a","x":1,"y":2,"w":4,"h":6,"page":1}]}]')
    assert [(r["cx"], r["cy"]) for r in files.items(spark, str(tmp_path / "t")).collect()] == [(3.0, 5.0)]


def test_upsert_ties_of_new_rows(spark):
    old = spark.createDataFrame([(1, 1.0, 3)], "k long, v double, at long")
    for rows in ([(1, 5.0, 7), (1, 9.0, 7)], [(1, 9.0, 7), (1, 5.0, 7)]):
        new = spark.createDataFrame(rows, "k long, v double, at long").coalesce(1)
        assert [tuple(r) for r in sinks.upsert(old, new, ["k"], "at").collect()] == [(1, 9.0, 7)]


def test_upsert_and_markdown(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "c", 1), (3, "d", 2)], "k int, v string, at int")
    got = sinks.upsert(old, new, ["k"], "at").orderBy("k")
    assert [(r["k"], r["v"]) for r in got.collect()] == [(1, "c"), (2, "b"), (3, "d")]
    assert sinks.markdown(got.limit(1)) == "| k | v | at |\n| --- | --- | --- |\n| 1 | c | 1 |"


def test_recipes(spark):
    parts = spark.createDataFrame([("m", "s", 150.0, 1.0), ("s", "rice", 500.0, 1000.0), ("m", "milk", 200.0, 1.0)], "parent string, child string, quantity double, yield double")
    roots = spark.createDataFrame([("m",)], "root string")
    got = {r["part"]: r["quantity"] for r in explode_recipes(parts, roots).collect()}
    assert got == {"s": 150.0, "rice": 75.0, "milk": 200.0}
    loop = spark.createDataFrame([("a", "b", 1.0, 1.0), ("b", "a", 1.0, 1.0)], "parent string, child string, quantity double, yield double")
    with pytest.raises(Exception, match="Circular"):
        explode_recipes(loop, spark.createDataFrame([("a",)], "root string")).collect()


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = metrics.hourly(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True)
    query.option("checkpointLocation", str(tmp_path / "at")).start().awaitTermination()
    assert sorted(map(tuple, spark.table("hourly").collect())) == sorted(map(tuple, metrics.hourly(events).collect()))
    assert spark.table("hourly").agg(F.sum("n")).first()[0] == events.count()


def test_stream_drops_repeats(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.unionByName(events).write.parquet(str(tmp_path / "in"))
    stream = metrics.stream(spark, str(tmp_path / "in"), events.schema, late="400 days")
    query = stream.writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True)
    query.option("checkpointLocation", str(tmp_path / "at")).start().awaitTermination()
    assert spark.table("once").count() == events.count()
