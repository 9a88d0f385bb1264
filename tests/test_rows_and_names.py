"""Row types worked out by hand, strict sheets, and users, pages and texts that the given tables do not hold."""

import pytest
from pyspark.sql import functions as F

from docledger.functions import names, rowtypes
from docledger.operators import kitchen, layout
from docledger.plans import library
from docledger.plans.catalog import QUERIES

library.load()

ROWS = [
    ("SUBTOTAL", None, "subtotal", 0.9), ("VAT 15%", None, "vat", 1.0), ("TOTAL", None, "unknown", 0.0), ("Delivery Fee", None, "delivery", 0.9),
    ("Discount 10%", None, "discount", 0.9), ("Return of damaged goods", None, "return", 0.9), ("Service Charge", None, "service_charge", 0.9),
    ("Invoice Header Info", None, "header", 1.0), ("Invoice Footer Info", None, "header", 0.85), ("Rice 2 kg", 6.0, "product", 1.0),
    ("Rice 2 kg", 7.0, "product", 0.9), ("", None, "header", 0.45), (None, None, "header", 0.45), ("vat15%", None, "header", 0.45),
]


def test_row_types(spark):
    rows = [(i, t, 2.0, 3.0, total) for i, (t, total, _, _) in enumerate(ROWS)]
    df = spark.createDataFrame(rows, "i int, t string, q double, p double, total double")
    got = df.select("i", rowtypes.classify(F.col("t"), F.col("q"), F.col("p"), F.col("total")).alias("c")).orderBy("i").collect()
    assert [(r.c.type, round(r.c.confidence, 6)) for r in got] == [(kind, sure) for _, _, kind, sure in ROWS]


def test_more_footer_words(spark):
    df = spark.createDataFrame([("kind regards",)], "t string")
    none = F.lit(None).cast("double")
    kind = lambda more: df.select(rowtypes.classify(F.col("t"), none, none, none, more)["type"]).first()[0]
    assert (kind(()), kind(("regards",))) == ("header", "footer")


def test_names_of_nulls_and_long_texts(spark):
    df = spark.createDataFrame([(None,), ("",), ("x" * 100_000,)], "d string")
    d = F.col("d")
    got = df.select(
        names.ingredient_name(d, d), names.item_name(d), names.line_unit(d), names.any_number(d), names.money_number(d),
        names.supplier_code(d), names.without_code(names.normal_description(d)), names.pack(F.coalesce(d, F.lit("")))["count"],
    ).collect()
    empty = (None, "", "", None, None, None, "", None)
    assert tuple(got[0]) == empty and tuple(got[1]) == empty and got[2][1] == "x" * 100_000


def test_strict_sales(spark):
    good = spark.createDataFrame([(" Soup ", "2,5"), (None, None), ("", " ")], "`Menu Item` string, `SOLD` string")
    assert [tuple(r) for r in kitchen.strict_sales(good).collect()] == [("Soup", 2.5)]
    for row in (("Soup", "two"), ("", "2")):
        bad = spark.createDataFrame([row], "item string, qty string")
        with pytest.raises(Exception, match="sales row"):
            kitchen.strict_sales(bad).collect()
    with pytest.raises(ValueError, match="no column"):
        kitchen.strict_sales(spark.createDataFrame([("a",)], "other string"))


def test_state_of_a_user_with_many_events(spark, tmp_path):
    kinds = ["signup", "click", "approve", "signup", "click"] * 400
    kinds = [k if k != "approve" else "view" for k in kinds] + ["signup", "purchase", "error", "purchase"]
    rows = [(1, i, i, k) for i, k in enumerate(kinds)] + [(2, 10_000, 5, "purchase")]
    df = spark.createDataFrame(rows, "user_id long, event_id long, s long, event_type string")
    df = df.select("user_id", "event_id", F.timestamp_seconds(F.col("s") * 977).alias("ts"), "event_type")
    df.write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: r.state for r in QUERIES["state_machine_latest"].run(spark, str(tmp_path)).collect()}
    assert got == {1: "rejected", 2: "approved"}


def test_bounds_of_pages_without_marks(spark):
    items = [(1, 0.0, 10.0, "rice"), (1, 0.0, 50.0, "oil"), (2, 0.0, 100.0, "0000012345"), (2, 0.0, 20.0, "rice"), (3, None, 1.0, "x"), (3, 0.0, 5.0, " ")]
    df = spark.createDataFrame(items, "page int, x double, y double, text string").withColumn("h", F.lit(None).cast("double"))
    got = {r.page: (r.header_y, r.footer_y) for r in layout.vertical_bounds(df, "page").collect()}
    assert got == {1: (10.0, 85.0), 2: (65.0, 135.0)}
