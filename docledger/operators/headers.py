"""Headers by four vocabularies, and the rows and lines that are headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from docledger.functions import headers
from docledger.plans.catalog import register
from docledger.plans.tables import table

#: Headers on which the vocabularies agree and disagree.
HEADS = (
    "Item", "Amount", "Unit Price", "Item Code", "Stock code", "VAT Registration no", "VAT", "Ship Qty", "qty", "Line Total", "Nett Price", "Price", "Unit",
    "Invoice", "Product  Description", "Total incl", "Item Qty Excl.", "discounted price", "Net-Amount", "Count", "Account", "", None, "SKU", "Description", "Details",
    "Tax Rate", "totai", "Ordered Qty", "unitem", "Line Description", "quantity ordered", "accounts count", "Unit cost", "Net value excl.", "Vat Amnt", "item",
)
#: Cells of a row; steps between them.
CELLS, STEP = 9, 5

_LIST = "[" + ", ".join("NULL" if h is None else f"'{h}'" for h in HEADS) + "]"
_H = "regexp_replace(lower(coalesce(c, '')), '[^a-z0-9]', '', 'g')"
_T = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce(c, ''))), '^\s*(?:item|product|line)\s+', ''), '\s+(?:incl|excl)\.?\s*$', ''), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"
_in = lambda x, words: f"{x} IN (" + ", ".join(f"'{w}'" for w in words) + ")"
_CODED, _COUNTED = "(h IN ('itemcode', 'stockcode', 'code') OR (h LIKE '%item%' AND h LIKE '%code%'))", "(h LIKE '%quantity%' OR h IN ('qty', 'shipquantity', 'shipqty'))"
_PRICED, _TOTAL = "(h LIKE '%unitprice%' OR h LIKE '%unitcost%')", "(h LIKE '%linetotal%' OR h LIKE '%netvalue%' OR h LIKE '%netamount%')"
_HEAD = f"CASE WHEN {_CODED} THEN 'supplier_code' WHEN h LIKE '%description%'"
_BY = {
    "positions": f"{_HEAD} THEN 'description' WHEN {_COUNTED} THEN 'quantity' WHEN {_PRICED} THEN 'unit_price' WHEN h LIKE '%vatamnt%' OR (h LIKE 'vat%' AND h NOT LIKE '%registration%') THEN 'vat' WHEN {_TOTAL} THEN 'line_total' END",
    "columns": f"{_HEAD} OR h IN ('item', 'product', 'details') THEN 'description' WHEN {_COUNTED} THEN 'quantity' WHEN {_PRICED} OR h IN ('price', 'unit') THEN 'unit_price' WHEN h LIKE '%vat%' THEN 'vat' WHEN {_TOTAL} OR h IN ('total', 'nettprice') THEN 'line_total' END",
    "lines": f"{_HEAD} THEN 'description' WHEN {_COUNTED} THEN 'quantity' WHEN {_PRICED} THEN 'unit_price' WHEN {_TOTAL} THEN 'line_total' END",
}
_FIELD = f"CASE WHEN {_in('t', headers.FORBIDDEN)} THEN 'unknown' " + " ".join(f"WHEN {_in('t', ws)} THEN '{f}'" for f, ws in reversed(headers.DICTIONARY)) + " " + " ".join(
    "WHEN " + " OR ".join(f"list_contains(string_split(t, ' '), '{p}')" if f in headers.WHOLE_WORDS else f"contains(t, '{p}')" for p in ps) + f" THEN '{f}'" for f, ps in headers.PARTS
) + " ELSE 'unknown' END"
_COUNTS = lambda v: f"len(list_distinct(list_filter(list({_BY[v]}), lambda x: x IN ({', '.join(repr(r) for r in headers.REQUIRED[v])})))) = {len(headers.REQUIRED[v])}"
_MAPS = lambda v: f"CASE WHEN max(({v}_all)::INT) = 1 THEN coalesce(string_agg({v} || '=' || {v}_at, ',' ORDER BY {v}) FILTER ({v} IS NOT NULL AND {v}_at = i), '') END AS {v}"
_ROWS = f"SELECT p_partkey, unnest(range(0, {CELLS})) AS i, p_size FROM part"
_CELLS_SQL = f"cell AS (SELECT p_partkey, i, c, {_H} AS h, {_T} AS t FROM (SELECT p_partkey, i, ({_LIST})[(p_partkey * 7 + i * (1 + p_size % {STEP}) + p_size) % {len(HEADS)} + 1] AS c FROM ({_ROWS})))"


def _cells(part):
    texts = F.array(*map(F.lit, HEADS))
    cell = lambda i: F.get(texts, ((F.col("p_partkey") * 7 + i * (1 + F.col("p_size") % STEP) + F.col("p_size")) % len(HEADS)).cast("int"))
    return part.select("p_partkey", F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), cell).alias("cells"))


@register(
    "header_fields",
    "F13 F14",
    f"WITH {_CELLS_SQL} SELECT p_partkey, i AS at, {_FIELD} AS field, {_BY['positions']} AS positions, {_BY['columns']} AS columns, {_BY['lines']} AS lines FROM cell",
)
def header_fields(spark, sf_dir):
    """The field that each header cell names, by the dictionary and by the three older vocabularies."""
    each = _cells(table(spark, sf_dir, "part")).select("p_partkey", F.posexplode("cells").alias("at", "c"))
    by = (v(F.col("c")).alias(name) for name, v in headers.VOCABULARIES.items())
    return headers.field_type(each, "c").withColumn("at", F.col("at").cast("long")).select("p_partkey", "at", "field", *by)


@register(
    "header_maps",
    "F13 U10",
    f"""WITH {_CELLS_SQL}, named AS (SELECT p_partkey, i, {_BY["positions"]} AS positions, {_BY["columns"]} AS columns, {_BY["lines"]} AS lines, h FROM cell),
    placed AS (SELECT *, max(i) OVER (PARTITION BY p_partkey, positions) AS positions_at, max(i) OVER (PARTITION BY p_partkey, columns) AS columns_at FROM named),
    complete AS (SELECT p_partkey, {_COUNTS("positions")} AS positions_all, {_COUNTS("columns")} AS columns_all FROM cell GROUP BY p_partkey),
    hits AS (SELECT p_partkey, max(first_i) + 1 AS starts FROM (SELECT p_partkey, lines, min(i) AS first_i FROM named WHERE lines IS NOT NULL GROUP BY ALL) GROUP BY p_partkey HAVING count(*) = 5)
    SELECT p_partkey, {_MAPS("positions")}, {_MAPS("columns")}, max(starts) AS starts FROM placed JOIN complete USING (p_partkey) LEFT JOIN hits USING (p_partkey) GROUP BY p_partkey""",
)
def header_maps(spark, sf_dir):
    """The cell of each field in rows that name all that they must, and where the table begins if the cells are lines."""
    rows = _cells(table(spark, sf_dir, "part"))
    shown = lambda v: F.array_join(F.transform(F.array_sort(F.map_entries(headers.column_map(F.col("cells"), v))), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias(v)
    starts = headers.first_lines(rows.select("p_partkey", F.posexplode("cells").alias("i", "c")), "p_partkey", "i", "c")
    maps = rows.select("p_partkey", shown("positions"), shown("columns"))
    return maps.join(starts.select("p_partkey", F.col("start").cast("long").alias("starts")), "p_partkey", "left")
