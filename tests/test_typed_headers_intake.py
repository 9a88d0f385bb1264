"""Typed documents, records, headers and the intake of uploads, against values worked out by hand and plain loops."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from docledger.functions import headers
from docledger.sources import typed
from docledger.streaming import intake
from docledger.streaming.metrics import file_type


@pytest.mark.parametrize("kind", [*typed.SCHEMAS, "else"])
def test_templates_are_sound(spark, kind):
    given = spark.createDataFrame([(typed.template(kind), 1)], "text string, _v int")
    r = typed.typed(given, "text", kind).first()
    assert r["errors"] == []
    assert r["document"]["document_type"] == (kind if kind in typed.SCHEMAS else "recipe") and r["_v"] == 1
    assert r["document"].asDict(recursive=True) == json.loads(typed.template(kind))


def test_typed_by_hand(spark):
    texts = [
        '{"document_type":"stock_list","confidence":"0.9","notes":5,"supplier_name":null,"items":[{"unit_price":" 2.5 "},3,null,{"supplier_code":[1],"z":1}],"b":1,"a":2}',
        '{"document_type":null,"items":"x"}', '{"a":1,"a":2}', "[]", None, "",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "document long, text string")
    got = {r["document"]: (r["d"], r["errors"]) for r in typed.typed(rows, "text", "stock_list", to="d").collect()}
    d, errors = got[0]
    assert (d["confidence"], d["notes"], d["supplier_name"], d["items"][0]["unit_price"], d["items"][1], d["items"][2]) == (0.9, "5", None, 2.5, None, None)
    missing = lambda i, *there: [f"items[{i}].{n}: missing" for n in typed.SCHEMAS["stock_list"]["items"][0] if n not in there]
    first = missing(0, "unit_price")
    assert errors[:2] == ["confidence: mistyped", "notes: mistyped"]
    assert errors[2:8] == first[:3] + ["items[0].unit_price: mistyped"] + first[3:]
    assert errors[8:10] == ["items[1]: mistyped", "items[2]: mistyped"]
    assert errors[10:] == ["items[3].supplier_code: mistyped", *missing(3, "supplier_code"), "items[3].z: unexpected", "a: unexpected", "b: unexpected"]
    assert got[1][1] == ["document_type: mistyped", "confidence: missing", "notes: missing", "supplier_name: missing", "items: mistyped"] and got[1][0]["items"] == []
    assert all(got[i] == (None, ["corrupt"]) for i in (2, 3, 4, 5))
    assert typed.typed(rows.limit(0), "text", "stock_list", to="d").collect() == []
    long = json.dumps({"document_type": "x", "items": [{"unit_price": i} for i in range(20000)]})
    assert len(typed.typed(spark.createDataFrame([(long,)], "text string"), "text", "stock_list").first()["document"]["items"]) == 20000


def test_records_by_hand(spark):
    texts = ['{"canonical_name":"Oil","review_required":"","status":"approved","supplier_variants":[{"observation_count":-3,"match_confidence":"x"},{"observation_count":"4"}]}', '{"name":0,"display_name":" Café, Bar "}']
    a, b = (r for r in typed.records(spark.createDataFrame(list(enumerate(texts)), "n long, text string"), "text", F.lit("then")).orderBy("n").collect())
    assert (a["record"]["review_required"], a["record"]["normalized_key"], [v["observation_count"] for v in a["record"]["supplier_variants"]]) == (False, "oil", [1, 4])
    assert a["record"]["supplier_variants"][1]["first_seen_at"] == "then" and a["errors"] == ["supplier_variants[0].match_confidence: mistyped"]
    assert (b["record"]["canonical_name"], b["record"]["normalized_key"], b["record"]["status"], b["record"]["review_required"], b["errors"]) == ("Café, Bar", "caf bar", "proposed", True, [])


def rule_by_rule(text):
    """The same decisions, one rule after the other."""
    t = re.sub(r"^\s*(item|product|line)\s+", "", (text or "").lower().strip())
    t = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", "", re.sub(r"\s+(incl|excl)\.?\s*$", "", t))).strip()
    known = {term: field for field, terms in headers.DICTIONARY for term in terms}
    if t in headers.FORBIDDEN or t in known:
        return "unknown" if t in headers.FORBIDDEN else known[t]
    for field, parts in headers.PARTS:
        if any(p in (t.split() if field in headers.WHOLE_WORDS else t) for p in parts):
            return field
    return "unknown"


def test_headers_equal_rule_by_rule(spark):
    rng = random.Random(3)
    pieces = [p for _, ps in headers.PARTS for p in ps] + [*headers.FORBIDDEN[:4], " ", " ", "-", ".", "Incl.", "LINE ", "x", "unitem", "nett"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 4))) for _ in range(1500)] + [None, "", "Amount", "line Total", "item", "Unit Price", "x" * 50000 + "sku"]
    got = headers.field_type(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "_term long, h string"), "h")
    assert [r["field"] for r in got.orderBy("_term").collect()] == [rule_by_rule(t) for t in texts]
    more = spark.createDataFrame([("amount", "quantity"), ("colli", "unit")], "term string, field string")
    two = headers.field_type(spark.createDataFrame([("Amount",), ("Colli",), ("Email",)], "h string"), "h", more=more)
    assert {r["h"]: r["field"] for r in two.collect()} == {"Amount": "quantity", "Colli": "unit", "Email": "unknown"}


def test_vocabularies_disagree(spark):
    given = ["VAT Registration", "Item", "Unit", "Total", "Vat", "Unit cost", "Item code", None]
    by = {n: [r[0] for r in spark.createDataFrame([(i, h) for i, h in enumerate(given)], "i int, h string").orderBy("i").select(v(F.col("h"))).collect()] for n, v in headers.VOCABULARIES.items()}
    assert by["positions"] == [None, None, None, None, "vat", "unit_price", "supplier_code", None]
    assert by["columns"] == ["vat", "description", "unit_price", "line_total", "vat", "unit_price", "supplier_code", None]
    assert by["lines"] == [None, None, None, None, None, "unit_price", "supplier_code", None]
    cells = spark.createDataFrame([(["Qty", "Unit price", "Line total", "Quantity", None],), (["Qty"],), ([],), (None,)], "c array<string>")
    assert [r[0] for r in cells.select(headers.column_map(F.col("c"), "positions")).collect()] == [{"quantity": 3, "unit_price": 1, "line_total": 2}, None, None, None]


def test_intake_replayed_and_repeated(spark, tmp_path):
    known = [(1, "brown rice", "approved", [], [])]
    memory = lambda s: s.createDataFrame(known, "id long, normalized_key string, status string, aliases array<string>, variants array<struct<code string, description string, name string>>")
    source, folder = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.txt").write_text("Invoice\nDescription, Qty, Unit Price, Total\nBrown rice 2 R5.00 R10.00\nPurple yam 3 R2.00 R6.00\nSub Total 16\n")
    (source / "b.pdf").write_bytes(b"%PDF")
    (source / "c.txt").write_text(" ")
    intake.start(spark, str(source), folder, memory).awaitTermination()
    (source / "again.txt").write_text((source / "a.txt").read_text())
    (source / "d.txt").write_text("Brown rice 1 R5.00 R5.00\n")
    intake.start(spark, str(source), folder, memory).awaitTermination()
    documents = lambda: sorted((r["path"][-5:], r["status"], r["lines"], r["parsed"], r["validated"], r["review"]) for r in spark.read.parquet(f"{folder}/documents").collect())
    expected = [("a.txt", "extracted", 6, 2, 1, 1), ("b.pdf", "unsupported", 0, 0, 0, 0), ("c.txt", "empty", 1, 0, 0, 0), ("d.txt", "extracted", 2, 1, 1, 0)]
    assert documents() == expected
    rows = lambda d: sorted((r["idx"], r["description"], r["state"], r["record"], r["type"]) for r in d.filter("status = 'parsed'").collect())
    read = rows(spark.read.parquet(f"{folder}/rows"))
    assert read == [(0, "Brown rice", "matched", 1, None), (2, "Brown rice", "matched", 1, None), (3, "Purple yam", "proposed", None, "create_new")]
    # a batch that runs again, and the same files as one batch
    files = spark.read.format("binaryFile").load(str(source)).withColumn("file_type", file_type(F.col("path")))
    intake.take_in(folder, memory)(files.filter(F.col("path").rlike("(d|again).txt$")), 1)
    assert documents() == expected and rows(spark.read.parquet(f"{folder}/rows")) == read
    assert rows(intake.envelopes(files, memory(spark))[1]) == read


def test_texts_of_one_row_group_are_dealt(spark, monkeypatch):
    """A file's row group is read by one task; what is made of its rows is not."""
    from docledger.operators import candidates, typed as queries

    monkeypatch.setattr(queries, "TASK_TEXTS", 400)
    monkeypatch.setattr(candidates, "TASK_TEXTS", 50)
    sf_dir = "/root/testdata/sf0.001"
    assert queries.typed_documents(spark, sf_dir).rdd.getNumPartitions() == 3 * 4
    assert candidates.described(spark.read.parquet(f"{sf_dir}/part.parquet")).rdd.getNumPartitions() == 4
