"""Keyed tables: upsert, insert-or-ignore, replacement of children, cascading deletes."""

from __future__ import annotations

from pyspark.sql import functions as F

from docledger.plans.catalog import register
from docledger.plans.tables import table
from docledger.sources.sinks import upsert


@register(
    "keyed_upsert",
    "K7 K3 M10",
    """WITH o AS (SELECT p_partkey AS k, p_retailprice AS v, p_size AS changed FROM part), n AS (SELECT p_partkey AS k, p_retailprice * 2 AS v, p_size + (p_partkey % 3 - 1) AS changed FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey + 1000000, p_retailprice, 1 FROM part WHERE p_partkey % 50 = 0)
    SELECT k, v, changed FROM (SELECT *, 0 AS new FROM o UNION ALL SELECT *, 1 FROM n) QUALIFY row_number() OVER (PARTITION BY k ORDER BY changed DESC, new DESC, v DESC) = 1""",
)
def keyed_upsert(spark, sf_dir):
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    old = part.select(k.alias("k"), F.col("p_retailprice").alias("v"), F.col("p_size").cast("long").alias("changed"))
    changed = part.filter("p_partkey % 2 = 0").select(k.alias("k"), (F.col("p_retailprice") * 2).alias("v"), (F.col("p_size") + k % 3 - 1).alias("changed"))
    added = part.filter("p_partkey % 50 = 0").select((k + 1000000).alias("k"), F.col("p_retailprice").alias("v"), F.lit(1).cast("long").alias("changed"))
    return upsert(old, changed.unionByName(added), ["k"], "changed")


@register(
    "children_replaced",
    "K7 K2",
    """WITH d AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'),
    kept AS (SELECT l_orderkey, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM d) AND l_orderkey NOT IN (SELECT l_orderkey FROM r) UNION ALL SELECT l_orderkey, 1.0 FROM r WHERE l_orderkey NOT IN (SELECT o_orderkey FROM d))
    SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS quantity FROM kept GROUP BY l_orderkey""",
)
def children_replaced(spark, sf_dir):
    """Deleting an order deletes its lines; a returned order's lines give way to one."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag")
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    per_order = lines.groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.bool_or(F.col("l_returnflag") == "R").alias("r")
    )
    kept = per_order.join(gone, "l_orderkey", "left_anti")
    return kept.select(
        "l_orderkey", F.when(F.col("r"), F.lit(1)).otherwise(F.col("n")).cast("long").alias("n"), F.when(F.col("r"), 1.0).otherwise(F.col("quantity")).alias("quantity")
    )


@register(
    "file_types",
    "S1 S2 S16 T3",
    """SELECT CASE WHEN e = 'pdf' THEN 'PDF' WHEN e IN ('png', 'jpg', 'jpeg', 'webp') THEN 'IMAGE' WHEN e IN ('xlsx', 'xls', 'xlsm') THEN 'XLSX' WHEN e = 'csv' THEN 'CSV' WHEN e IN ('txt', 'md') THEN 'TXT' ELSE 'Unsupported' END AS file_type, count(*) AS n
    FROM (SELECT (['pdf', 'png', 'xlsx', 'csv', 'txt', 'exe', 'jpeg'])[doc_id % 7 + 1] AS e FROM documents) GROUP BY 1""",
)
def file_types(spark, sf_dir):
    from docledger.streaming.metrics import file_type

    suffix = F.get(F.array(*map(F.lit, ("pdf", "PNG", "xlsx", "CSV", "txt", "exe", "jpeg"))), (F.col("doc_id") % 7).cast("int"))
    path = F.concat(F.lit("in/d"), F.col("doc_id").cast("string"), F.lit("."), suffix)
    return table(spark, sf_dir, "documents").groupBy(file_type(path).alias("file_type")).agg(F.count("*").alias("n"))
