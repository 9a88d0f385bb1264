"""Queries on inputs that the given tables do not hold: names of one to five words, very long orders, deep recipes."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from docledger.functions import text
from docledger.operators import costing
from docledger.plans import library
from docledger.plans.catalog import QUERIES

library.load()
SF = "/root/testdata/sf0.001"


def against_sql(spark, name, sf_dir, table):
    query, con = QUERIES[name], duckdb.connect()
    con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet/*.parquet'")
    found = query.run(spark, sf_dir)
    answer = con.execute(query.sql)
    columns = [c[0] for c in answer.description]
    tidy = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert tidy(found.select(*columns).collect()) == tidy(answer.fetchall())


@pytest.fixture(scope="module")
def names(spark, tmp_path_factory):
    rng, words = random.Random(3), "red hot small oat bread plain rye bun soup cake".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 5))), i % 4, float(i)) for i in range(1, 160)]
    sf_dir = str(tmp_path_factory.mktemp("names"))
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int, p_retailprice double").write.parquet(f"{sf_dir}/part.parquet")
    return sf_dir


@pytest.mark.parametrize("name", ["fuzzy_dedupe", "stock_price_substring"])
def test_names_of_one_to_five_words(spark, names, name):
    against_sql(spark, name, names, "part")


def test_best_ratio_of_all_names(spark, names):
    menu = {r[0] for r in spark.read.parquet(f"{names}/part.parquet").select("p_name").collect()}
    got = {r["sold"]: r for r in QUERIES["fuzzy_ratio_best"].run(spark, names).collect()}
    assert set(got) == {f"{m[:3]}x{m[3:]}" for m in menu}
    for sold, r in got.items():
        assert (r["score"], r["menu"]) == max((costing.ratio(sold, m), m) for m in menu)


def test_grid_of_a_long_order(spark, tmp_path):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    long = lines.withColumn("l_orderkey", F.when(F.col("l_orderkey") % 3 == 0, F.lit(3).cast("long")).otherwise(F.col("l_orderkey")))
    assert long.filter("l_orderkey = 3").count() > 1500
    long.write.parquet(f"{tmp_path}/lineitem.parquet")
    against_sql(spark, "grid_extraction", str(tmp_path), "lineitem")


def test_recipes_of_twenty_levels(spark):
    lines = [(i, i + 1, 2.0, 1.0) for i in range(1, 21)]
    parts = spark.createDataFrame(lines, "parent long, child long, quantity double, yield double")
    roots = spark.createDataFrame([(1,)], "root long")
    got = {r["part"]: r["quantity"] for r in costing.explode_recipes(parts, roots).collect()}
    assert got == {i + 1: 2.0**i for i in range(1, 21)}
    with pytest.raises(Exception, match="Circular batch recipe detected"):
        costing.explode_recipes(parts.union(spark.createDataFrame([(21, 1, 1.0, 1.0)], parts.schema)), roots).collect()
    assert costing.explode_recipes(parts.limit(0), roots).collect() == []


def test_one_issue_closes_the_gate(spark, tmp_path):
    customers = [(1, "A"), (2, "B"), (3, "A")]
    spark.createDataFrame(customers, "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(1, "F", 5.0), (2, "F", 7.0)]
    spark.createDataFrame(orders, "o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["c_mktsegment"]: r for r in QUERIES["strict_gate"].run(spark, str(tmp_path)).collect()}
    assert got["A"]["total_if_served"] is None and got["B"]["total_if_served"] is None and got["A"]["unserved"] == 1
    assert got["A"]["total_if_priced"] == 5.0 and got["B"]["total_if_priced"] == 7.0


def test_headers_worked_out_by_hand(spark):
    want = {
        "Tax Invoice": None, "Ordered Qty": "quantity", "Supplier Barcode Number": None, "Product Description": "description", "U.O.M": "unit",
        "Price per Unit": "unit_price", "Amount (Excl VAT)": "total", "Nett Price": "total", "VAT 15%": "vat", "Stock Code": "code", "": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in want], "h string")
    assert {r["h"]: r["k"] for r in df.select("h", text.header_key(F.col("h")).alias("k")).collect()} == want
    roles = {
        "Description | Qty | Unit Price | Total": "header", "Item, Qty, Amount": "header", "Total 45.00": "subtotal", "Page 1 of 3": "footer", "VAT Amount 3.00": "noise",
        "VAT no 4123456789": "noise", "R 1.00 ZAR 2.00 R 3.00": "noise", "Milk 2 L 3 14.00 42.00": "line_item", "customer vat": "vat", "Representative J": "footer",
    }
    df = spark.createDataFrame([(k,) for k in roles], "t string")
    assert {r["t"]: r["k"] for r in df.select("t", text.row_role(F.col("t")).alias("k")).collect()} == roles
