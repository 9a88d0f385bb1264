from pyspark.sql import functions as F
import pytest

from docledger.functions import keys, money, units
from docledger.functions.folds import first_fit_clusters, mean_clusters
from docledger.functions.text import header_key, row_role
from docledger.functions.validate import validation_status


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(f(F.col("x"))).collect()]


def test_money(spark):
    cells = ["R 1 234,56", "1,234.56", "1,234", "ZAR 15", "15%", "1.2.3", "-", "abc", None, ""]
    assert column(spark, cells, money.parse_money) == [1234.56, 1234.56, 1.234, 15.0, 15.0, 12.3, None, None, None, None]
    assert column(spark, ["1,234", "R5"], money.parse_plain) == [1234.0, 5.0]


def test_numeric_cells(spark):
    cells = ["R 1 234.50", "1,234", "-5", "15%", "2kg", "1.234,5", ""]
    assert column(spark, cells, money.is_numeric_cell) == [True, True, True, False, False, False, False]


def test_validation(spark):
    rows = [(2.0, 33.35, 66.70), (2.0, 33.35, 73.19), (None, 1.0, 1.0), (1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "q double, p double, t double")
    assert [r[0] for r in df.select(validation_status(F.col("q"), F.col("p"), F.col("t"))).collect()] == ["ok", "failed", "missing", "ok"]


def test_units(spark):
    df = spark.createDataFrame([(1.5, "kg"), (2.0, "tbsp"), (1.0, "stone")], "q double, u string")
    assert [r[0] for r in df.select(units.to_base(F.col("q"), F.col("u"))).collect()] == [1500.0, 30.0, None]
    shown = spark.range(1).select(units.for_display(F.lit(1500.0), F.lit("g")).alias("s")).first()["s"]
    assert (shown["quantity"], shown["unit"]) == (1.5, "kg")
    with pytest.raises(Exception, match="Cannot convert"):
        spark.range(1).select(units.convert(F.lit(1.0), F.lit("g"), F.lit("ml"), strict=True)).collect()


def test_match_keys(spark):
    names = ["Red Peppers 1kg", "Peppers Red", "Baby Potatoes 10x1kg", "Tomatoes Each"]
    assert column(spark, names, keys.match_key) == ["red pepper", "red pepper", "baby potato", "tomato"]


def test_headers_and_roles(spark):
    assert column(spark, ["Item Description", "Qty", "Unit Price", "Nett Amount", "VAT Amt", "SKU", "x"], header_key) == [
        "description", "quantity", "unit_price", "total", "vat", "code", None,
    ]
    rows = ["", "Bank details", "Apples 2 3.50 7.00", "VAT 15 %", "Subtotal 10", "hello"]
    assert column(spark, rows, row_role) == ["empty", "banking", "line_item", "vat", "subtotal", "noise"]


def test_clusters(spark):
    values = spark.range(1).select(F.array(*map(F.lit, (0.0, 15.0, 30.0, 45.0))).alias("v"))
    by_mean = values.select(mean_clusters(F.col("v"), 20.0)["n"]).first()[0]
    assert by_mean == [2, 2]
    jumbled = spark.range(1).select(first_fit_clusters(F.array(*map(F.lit, (0.0, 100.0, 5.0))), 20.0)["n"]).first()[0]
    assert jumbled == [2, 1]


def test_words_are_met_as_bounded(spark):
    from docledger.functions import rowtypes, text

    rows = ["", "bank", "banks", "my bank.", "xbank", "acc  no 5", "page 1 of 2", "item 00000000001 0.00", "0", "éitem", "terms\n", "on way-bill", "vat,tax 5%", "a_total", "total"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    words = [text.BANKING, text.CLOSING, text.PAYMENT, text.SUBTOTAL, text.TAX, text.CONTACT, rowtypes.FOOTER, rowtypes.PRODUCT, ("0000000000[0-9]+",), (rowtypes.NUMBER,), ("0\\.00", "0")]
    both = df.select(*(F.col("t").rlike(make(*w)) for w in words for make in (text.bounded, text.met))).collect()
    assert all(r[i] == r[i + 1] for r in both for i in range(0, len(r), 2))
    roles = text.with_role(df, F.col("t"), "x").select(text.row_role(F.col("t")).alias("a"), F.col("role").alias("b")).collect()
    assert [r["a"] for r in roles] == [r["b"] for r in roles]
