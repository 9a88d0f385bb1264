"""Line validation over lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.functions.validate import cents, validation_status
from docledger.plans.catalog import register
from docledger.plans.tables import table


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as invoice lines; the seventh line of an order lacks its unit price."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_suppkey",
        "l_partkey",
        "l_linenumber",
        F.col("l_quantity").alias("quantity"),
        F.when(F.col("l_linenumber") != 7, cents(F.col("l_extendedprice") / F.col("l_quantity"))).alias("unit_price"),
        cents(F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("line_total"),
        cents(F.col("l_extendedprice") * F.col("l_tax")).alias("vat"),
    )


LINES_SQL = """
lines AS (SELECT l_orderkey, l_suppkey, l_partkey, l_linenumber, l_quantity AS quantity,
  CASE WHEN l_linenumber <> 7 THEN floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 END AS unit_price,
  floor(l_extendedprice * (1 + l_tax) * 100 + 0.5) / 100 AS line_total,
  floor(l_extendedprice * l_tax * 100 + 0.5) / 100 AS vat FROM lineitem),
checked AS (SELECT *, CASE WHEN quantity IS NULL OR unit_price IS NULL OR line_total IS NULL THEN 'missing'
  WHEN abs(floor((line_total - floor(quantity * unit_price * 100 + 0.5) / 100) * 100 + 0.5) / 100)
    <= greatest(0.05, abs(line_total) * 0.02) THEN 'ok' ELSE 'failed' END AS status FROM lines)
"""


def checked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).withColumn(
        "status", validation_status(F.col("quantity"), F.col("unit_price"), F.col("line_total"))
    )


@register(
    "line_validation_by_supplier",
    "P3 A1 A3",
    f"""WITH {LINES_SQL} SELECT s_name, status, count(*) AS n_lines,
    floor(sum(line_total) * 100 + 0.5) / 100 AS total FROM checked JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name, status""",
)
def line_validation_by_supplier(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    by_key = checked_lines(spark, sf_dir).groupBy("l_suppkey", "status").agg(
        F.count("*").alias("n_lines"), F.sum("line_total").alias("total")
    )
    return (
        by_key.join(supplier, by_key.l_suppkey == supplier.s_suppkey)
        .groupBy("s_name", "status")
        .agg(F.sum("n_lines").alias("n_lines"), (F.floor(F.sum("total") * 100 + 0.5) / 100).alias("total"))
    )


@register(
    "line_validation_status",
    "P2 P3 P9 D9 X7 X8",
    f"""WITH {LINES_SQL} SELECT l_linenumber, status,
    CASE WHEN status = 'missing' THEN 'unit_price' WHEN status = 'failed' THEN 'line_total' END AS affected_field,
    count(*) AS n, sum(CASE WHEN unit_price IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_without_price,
    min(CASE WHEN status = 'ok' THEN 0.98 ELSE 0.62 END)::DOUBLE AS least_confidence
    FROM checked GROUP BY ALL""",
)
def line_validation_status(spark, sf_dir):
    status = F.col("status")
    return (
        checked_lines(spark, sf_dir)
        .groupBy(
            "l_linenumber",
            "status",
            F.when(status == "missing", "unit_price").when(status == "failed", "line_total").alias("affected_field"),
        )
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("unit_price").isNull()).alias("n_without_price"),
            F.min(F.when(status == "ok", 0.98).otherwise(0.62)).alias("least_confidence"),
        )
    )


@register(
    "loose_vs_strict_validation",
    "P3 P4 P5",
    f"""WITH {LINES_SQL} SELECT status, coalesce(line_total IS NULL OR line_total = 0 OR
    abs(line_total - quantity * unit_price) <= greatest(0.2, abs(line_total) * 0.04), false) AS loose,
    coalesce(abs(quantity * unit_price - line_total) <= 0.01, false) AS exact, count(*) AS n FROM checked GROUP BY ALL""",
)
def loose_vs_strict_validation(spark, sf_dir):
    from docledger.functions.validate import loose_match

    q, p, t = F.col("quantity"), F.col("unit_price"), F.col("line_total")
    return (
        checked_lines(spark, sf_dir)
        .groupBy("status", loose_match(q, p, t).alias("loose"), F.coalesce(F.abs(q * p - t) <= 0.01, F.lit(False)).alias("exact"))
        .agg(F.count("*").alias("n"))
    )


_IMPLIED = "floor(line_total / unit_price * 100 + 0.5) / 100"
#: First reason that applies to a line for review; the shorter ladder stops at its first rung for every failed line.
REASONS = f"""CASE WHEN status = 'missing' THEN 'missing_same_band_total'
  WHEN abs(line_total - floor((floor(quantity * unit_price * 100 + 0.5) / 100 + vat) * 100 + 0.5) / 100)
    <= greatest(0.05, abs(line_total) * 0.02) THEN 'gross_total_includes_vat'
  WHEN {_IMPLIED} > 0 AND abs({_IMPLIED} - quantity) > 0.05 AND abs(floor({_IMPLIED} + 0.5) - {_IMPLIED}) <= 0.05
    AND {_IMPLIED} <= greatest(quantity, 1) THEN 'ambiguous_quantity' ELSE 'neighboring_total_mismatch' END"""


@register(
    "review_reason",
    "X9 F8 F9 A3 P24",
    f"WITH {LINES_SQL} SELECT {REASONS} AS reason, 'missing_same_band_total' AS short_reason, count(*) AS n "
    "FROM checked WHERE status <> 'ok' GROUP BY ALL",
)
def review_reason(spark, sf_dir):
    return (
        checked_lines(spark, sf_dir)
        .filter("status <> 'ok'")
        .groupBy(F.expr(REASONS).alias("reason"), F.lit("missing_same_band_total").alias("short_reason"))
        .agg(F.count("*").alias("n"))
    )


@register(
    "row_triage_score",
    "X7 X10 X12 A1 A9 F6",
    f"""WITH {LINES_SQL}, scored AS (SELECT *, 65 + CASE WHEN quantity IS NULL THEN 0 ELSE 15 END
      + CASE WHEN unit_price IS NULL THEN 0 ELSE 15 END AS score FROM checked)
    SELECT l_suppkey, count(*) AS n, sum(CASE WHEN status = 'ok' THEN 1 ELSE 0 END)::BIGINT AS validated,
    sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END)::BIGINT AS review, sum(CASE WHEN status = 'missing' THEN 1 ELSE 0 END)::BIGINT AS discarded,
    floor(sum(CASE WHEN status = 'ok' THEN score ELSE least(score, 62) END)::DOUBLE * 100 / count(*) + 0.5) / 10000 AS mean_confidence,
    floor(sum(CASE WHEN status = 'ok' THEN 1 ELSE 0 END)::DOUBLE / count(*) * 10000 + 0.5) / 10000 AS pass_rate FROM scored GROUP BY l_suppkey""",
)
def row_triage_score(spark, sf_dir):
    score = F.lit(65) + F.when(F.col("quantity").isNull(), 0).otherwise(15) + F.when(F.col("unit_price").isNull(), 0).otherwise(15)
    status = F.col("status")
    capped = F.when(status == "ok", F.col("score")).otherwise(F.least("score", F.lit(62)))
    return (
        checked_lines(spark, sf_dir)
        .withColumn("score", score)
        .groupBy("l_suppkey")
        .agg(
            F.count("*").alias("n"),
            F.count_if(status == "ok").alias("validated"),
            F.count_if(status == "failed").alias("review"),
            F.count_if(status == "missing").alias("discarded"),
            (F.floor(F.sum(capped).cast("double") * 100 / F.count("*") + 0.5) / 10000).alias("mean_confidence"),
            (F.floor(F.count_if(status == "ok") / F.count("*") * 10000 + 0.5) / 10000).alias("pass_rate"),
        )
    )
