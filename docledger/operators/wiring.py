"""Rows of documents wired through: read, validated, resolved to ingredients, matched or proposed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.functions.candidates import candidates
from docledger.functions.validate import validation_status
from docledger.operators.candidates import analysed, matched
from docledger.operators.lines import _ordered_lines, order_pages, plain_rows
from docledger.plans.catalog import QUERIES, register
from docledger.plans.tables import stored, table


def wired(lines: DataFrame, memory: DataFrame) -> DataFrame:
    """page, idx, status, description, quantity, unit_price, total, validation, ingredient, code, key, confidence, state, record, type, target.

    lines: page, idx, line, as for plain_rows; memory as for matched. Each distinct description is resolved once, however many
    rows have it, and joined back. A name without a letter is analysed, but neither matched nor proposed: state ``analysed``.
    Rows that were not parsed keep their status, and nulls.
    """
    rows = stored(plain_rows(lines), "wired-rows")
    told = stored(analysed(candidates(rows.filter("status = 'parsed'").select("description").distinct(), "description")), "wired-names")
    c, a = F.col("candidate"), F.col("analysis")
    found = matched(told.filter(c["name"].rlike("[A-Za-z]")), memory, "description").select("description", "state", "record", "type", "target")
    names = told.select("description", c["name"].alias("ingredient"), c["code"].alias("code"), a["key"].alias("key"), a["confidence"].alias("confidence"))
    resolved = names.join(found, "description", "left").withColumn("state", F.coalesce("state", F.lit("analysed")))
    valid = F.when(F.col("status") == "parsed", validation_status(F.col("quantity"), F.col("unit_price"), F.col("total"))).alias("validation")
    rows = rows.select("*", valid)
    # the others have no description: they would all meet in one task of the join
    parsed = rows.filter("status = 'parsed'").join(resolved, "description", "left")
    return parsed.unionByName(rows.filter("status <> 'parsed'"), allowMissingColumns=True).select(
        "page", "idx", "status", "description", "quantity", "unit_price", "total", "validation", "ingredient", "code", "key", "confidence", "state", "record", "type", "target"
    )


@register(
    "row_wiring",
    "M9",
    f"""WITH plain AS ({QUERIES["plain_table_rows"].sql}), m AS (SELECT p_name, min(p_partkey) AS id FROM part GROUP BY 1), d AS (SELECT DISTINCT description FROM plain WHERE status = 'parsed'),
    t AS (SELECT description, m.id AS record, (SELECT min(k.id) FROM m k WHERE split_part(k.p_name, ' ', 1) = split_part(description, ' ', 1)) AS near FROM d LEFT JOIN m ON m.p_name = d.description)
    SELECT page, idx, status, plain.description, quantity, unit_price, total, CASE WHEN status = 'parsed' THEN 'ok' END AS validation, plain.description AS ingredient, plain.description AS key, CASE WHEN status = 'parsed' THEN 0.7::DOUBLE END AS confidence,
    CASE WHEN status = 'parsed' THEN CASE WHEN record IS NULL THEN 'proposed' ELSE 'matched' END END AS state, record, CASE WHEN status = 'parsed' AND record IS NULL THEN 'attach_supplier_variant' END AS type, CASE WHEN record IS NULL THEN near END AS target
    FROM plain LEFT JOIN t ON t.description = plain.description""",
)
def row_wiring(spark, sf_dir):
    """Orders printed as plain lines, against a memory of the parts' names; a name that lost its last letter is proposed for the first that shares its other word."""
    part, none = table(spark, sf_dir, "part"), F.array().cast("array<string>")
    memory = part.groupBy(F.col("p_name").alias("normalized_key")).agg(F.min("p_partkey").alias("id")).select(
        "id", "normalized_key", F.lit("approved").alias("status"), none.alias("aliases"), F.lit(None).cast("array<struct<code string, description string, name string>>").alias("variants")
    )
    return wired(order_pages(_ordered_lines(spark, sf_dir)), memory).drop("code").withColumn("idx", F.col("idx").cast("int"))
