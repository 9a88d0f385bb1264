"""Scalar functions over cells: money, numeric tests, units, packs, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from docledger.functions import money, units
from docledger.functions.text import composite_key, header_key, normalize_key, sql_header_key
from docledger.plans.catalog import register
from docledger.plans.tables import table


@register(
    "money_parse_roundtrip",
    "F1 F2 F4 F5 F7",
    """SELECT c_custkey, floor(c_acctbal * 100 + 0.5) / 100 AS spaced, floor(c_acctbal * 100 + 0.5) / 100 AS comma,
    floor(c_acctbal)::DOUBLE AS plain FROM customer""",
)
def money_parse_roundtrip(spark, sf_dir):
    """Balances written as ``R 1 234.56``, ``1,234.56`` and ``1,234`` and read back."""
    value = F.floor(F.col("c_acctbal") * 100 + 0.5) / 100
    text = F.format_string("%.2f", value)
    grouped = F.regexp_replace(text, r"(\d)(?=(\d{3})+\.)", "$1,")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        money.parse_money(F.concat(F.lit("R "), F.replace(grouped, F.lit(","), F.lit(" ")))).alias("spaced"),
        money.parse_money(grouped).alias("comma"),
        money.parse_plain(F.regexp_replace(F.format_string("%.0f", F.floor("c_acctbal").cast("double")), r"(\d)(?=(\d{3})+$)", "$1,")).alias("plain"),
    )


@register(
    "numeric_cell_shapes",
    "P6 P7 P11 P16 P17 P18",
    r"""WITH cells AS (SELECT p_partkey, unnest(['R ' || p_partkey || '.50', p_size || '%', p_size || 'kg', '00000' || p_partkey, p_name, 'AB' || p_partkey]) AS c,
      unnest([0, 1, 2, 3, 4, 5]) AS k FROM part)
    SELECT k, sum(CASE WHEN regexp_matches(c, '(?i)^\s*(R|ZAR)?\s*-?\d[\d\s,]*(\.\d+)?\s*$') THEN 1 ELSE 0 END)::BIGINT AS numeric_cells,
    sum(CASE WHEN regexp_matches(c, '^\s*\d+([.,]\d+)?\s*%$') THEN 1 ELSE 0 END)::BIGINT AS percentages,
    sum(CASE WHEN regexp_matches(c, '(?i)^\d+([.,]\d+)?\s*(kg|g|ml|l)$') THEN 1 ELSE 0 END)::BIGINT AS packs,
    sum(CASE WHEN regexp_matches(c, '^0{5}\d{3,}$') THEN 1 ELSE 0 END)::BIGINT AS stock_codes,
    sum(CASE WHEN regexp_matches(c, '^[A-Z]{2,}\d{2,}$') THEN 1 ELSE 0 END)::BIGINT AS supplier_codes,
    sum(CASE WHEN regexp_matches(c, '[A-Za-z]') AND NOT regexp_matches(c, '^[\d\s.,]+$') THEN 1 ELSE 0 END)::BIGINT AS viable FROM cells GROUP BY k""",
)
def numeric_cell_shapes(spark, sf_dir):
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    cells = F.array(
        F.concat(F.lit("R "), key, F.lit(".50")), F.concat(size, F.lit("%")), F.concat(size, F.lit("kg")),
        F.concat(F.lit("00000"), key), F.col("p_name"), F.concat(F.lit("AB"), key),
    )
    c = F.col("c")
    return (
        table(spark, sf_dir, "part")
        .select(F.posexplode(cells).alias("k", "c"))
        .groupBy("k")
        .agg(
            F.count_if(money.is_numeric_cell(c)).alias("numeric_cells"),
            F.count_if(c.rlike(r"^\s*\d+([.,]\d+)?\s*%$")).alias("percentages"),
            F.count_if(c.rlike(r"(?i)^\d+([.,]\d+)?\s*(kg|g|ml|l)$")).alias("packs"),
            F.count_if(c.rlike(r"^0{5}\d{3,}$")).alias("stock_codes"),
            F.count_if(c.rlike(r"^[A-Z]{2,}\d{2,}$")).alias("supplier_codes"),
            F.count_if(c.rlike("[A-Za-z]") & ~c.rlike(r"^[\d\s.,]+$")).alias("viable"),
        )
    )


@register(
    "unit_convert",
    "F60 F61 B9",
    """SELECT p_partkey, p_size::DOUBLE * f AS base_quantity, b AS base_unit,
    CASE WHEN b IN ('g', 'ml') AND p_size * f >= 1000 THEN p_size * f / 1000 ELSE p_size * f END::DOUBLE AS shown,
    CASE WHEN b = 'g' AND p_size * f >= 1000 THEN 'kg' WHEN b = 'ml' AND p_size * f >= 1000 THEN 'L' ELSE b END AS shown_unit,
    CASE WHEN b = 'g' THEN p_size * f / 1000 END::DOUBLE AS in_kg
    FROM part JOIN (VALUES (0, 1.0::DOUBLE, 'g'), (1, 1000.0, 'g'), (2, 15.0, 'ml'), (3, 250.0, 'ml'), (4, 1.0, 'unit')) u(k, f, b) ON p_partkey % 5 = k""",
)
def unit_convert(spark, sf_dir):
    unit = F.get(F.array(*map(F.lit, ("g", " KG", "tbsp", "Cup", "each"))), (F.col("p_partkey") % 5).cast("int"))
    q = F.col("p_size").cast("double")
    shown = units.for_display(units.to_base(q, unit), units.base_unit(unit))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        units.to_base(q, unit).alias("base_quantity"),
        units.base_unit(unit).alias("base_unit"),
        shown["quantity"].alias("shown"),
        shown["unit"].alias("shown_unit"),
        units.convert(q, unit, F.lit("kg")).alias("in_kg"),
    )


#: Descriptions with packs of every kind.
PACKS = (
    "Milk 6 x 1 L", "Cream 12x250ml", "Rice 2 x 5kg", "Spice 10 x 50g", "Flour 12.5 kg", "Tuna 170g", "Oil 20 lt", "Sauce 500ml", "Prawns 16/20 kg",
    "Sugar 2,5kg", "Eggs 30", "Tea 4 x 0.5 gr",
)


@register(
    "pack_measure_convert",
    "F37 F38",
    """WITH g AS (SELECT p_partkey, p_size, p_retailprice, ([6, 3, 10, 0.5, 12.5, 0.17, 20, 0.5, NULL, 2.5, NULL, 0.002])[p_partkey % 12 + 1]::DOUBLE AS pack,
      (['LTR', 'LTR', 'KG', 'KG', 'KG', 'KG', 'LTR', 'LTR', NULL, 'KG', NULL, 'KG'])[p_partkey % 12 + 1] AS unit FROM part)
    SELECT p_partkey, pack, unit, floor(p_size * coalesce(pack, 1) * 1000 + 0.500001) / 1000 AS quantity, floor(p_retailprice / coalesce(pack, 1) * 100 + 0.500001) / 100 AS price FROM g""",
)
def pack_measure_convert(spark, sf_dir):
    """Quantity times the pack and price by it, in kilograms or litres. The SQL holds the packs worked out by hand."""
    pack = units.pack_measure(F.get(F.array(*map(F.lit, PACKS)), (F.col("p_partkey") % len(PACKS)).cast("int")))
    got = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", pack.alias("m"))
    size = F.coalesce("m.qty", F.lit(1.0))
    return got.select(
        "p_partkey",
        F.col("m.qty").alias("pack"),
        "m.unit",
        (F.floor(F.col("p_size") * size * 1000 + 0.500001) / 1000).alias("quantity"),
        (F.floor(F.col("p_retailprice") / size * 100 + 0.500001) / 100).alias("price"),
    )


@register(
    "header_key_mapping",
    "F11 F12 X2 O3 U10",
    f"""WITH h AS (SELECT s_suppkey, unnest(['Item Description', 'Qty', CASE WHEN s_suppkey % 3 = 0 THEN 'U.O.M' ELSE 'Unit Price' END, 'Nett Amount (Excl)', 'VAT Amt', 'Stock Code', s_name]) AS cell FROM supplier),
    k AS (SELECT s_suppkey, {sql_header_key('cell')} AS field FROM h)
    SELECT s_suppkey, count(field) AS known, count(DISTINCT field) AS fields,
      string_agg(DISTINCT field, ',' ORDER BY field) AS found,
      count(DISTINCT CASE WHEN field IN ('description', 'quantity', 'unit_price', 'total') THEN field END) = 4 AS complete FROM k GROUP BY s_suppkey""",
)
def header_key_mapping(spark, sf_dir):
    cells = F.array(
        F.lit("Item Description"), F.lit("Qty"), F.when(F.col("s_suppkey") % 3 == 0, "U.O.M").otherwise("Unit Price"),
        F.lit("Nett Amount (Excl)"), F.lit("VAT Amt"), F.lit("Stock Code"), F.col("s_name"),
    )
    fields = F.filter(F.transform(cells, header_key), lambda x: x.isNotNull())
    needed = F.array(*map(F.lit, ("description", "quantity", "unit_price", "total")))
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.size(fields).cast("long").alias("known"),
        F.size(F.array_distinct(fields)).cast("long").alias("fields"),
        F.array_join(F.array_sort(F.array_distinct(fields)), ",").alias("found"),
        (F.size(F.array_except(needed, fields)) == 0).alias("complete"),
    )


@register(
    "normalized_keys",
    "F10 F15 F20 F21 F44 U5",
    r"""SELECT trim(regexp_replace(lower(p_brand || '  ' || p_name), '[^a-z0-9]+', ' ', 'g')) AS key,
    trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) || '|' || trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS composite,
    count(*) AS n FROM part GROUP BY ALL""",
)
def normalized_keys(spark, sf_dir):
    return (
        table(spark, sf_dir, "part")
        .groupBy(
            normalize_key(F.concat("p_brand", F.lit("  "), "p_name")).alias("key"),
            composite_key(F.col("p_brand"), F.col("p_type")).alias("composite"),
        )
        .agg(F.count("*").alias("n"))
    )


_NORM_SQL = "regexp_replace(lower(cell), '[^a-z0-9]+', '', 'g')"


@register(
    "header_candidate_scores",
    "G18 G24 A26",
    f"""WITH h AS (SELECT s_suppkey, unnest(['Item Description', 'Qty', 'Unit Price', 'Total', 'Nett Total', s_name]) AS cell, unnest([10, 200, 320, 450, 460, 600]) + s_suppkey % 7 AS x, unnest([5, 5, 6, 7, 5, 300]) AS y FROM supplier),
    k AS (SELECT *, {sql_header_key('cell')} AS field, count(*) OVER (PARTITION BY s_suppkey, {_NORM_SQL}) AS f FROM h),
    c AS (SELECT *, floor((0.15 + 0.3 * CASE WHEN field IS NULL THEN 0.1 WHEN {_NORM_SQL} = field THEN 1 ELSE 0.8 END + 0.2 * greatest(0, 1 - y / 100.0) + 0.2 * least(1, f / 3.0)) * 1000 + 0.5) / 1000 AS score FROM k)
    SELECT s_suppkey, count(*) AS candidates, count(CASE WHEN score >= 0.5 THEN 1 END) AS accepted, floor(max(score) * 1000 + 0.5) / 1000 AS best, count(DISTINCT CASE WHEN score >= 0.5 THEN field END) AS fields FROM c GROUP BY s_suppkey""",
)
def header_candidate_scores(spark, sf_dir):
    """Header candidates by alignment (a constant), context, place on the page and frequency; from 0.5 on accepted."""
    from pyspark.sql.window import Window

    names = ("Item Description", "Qty", "Unit Price", "Total", "Nett Total")
    cells = F.array(*(F.struct(F.lit(c).alias("cell"), F.lit(y).alias("y")) for c, y in zip(names, (5, 5, 6, 7, 5), strict=True)), F.struct(F.col("s_name").alias("cell"), F.lit(300).alias("y")))
    h = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(cells).alias("c")).select("s_suppkey", "c.*")
    norm = F.regexp_replace(F.lower("cell"), "[^a-z0-9]+", "")
    keyed = h.select("*", norm.alias("norm"), header_key(F.col("cell")).alias("field"))
    f = F.count("*").over(Window.partitionBy("s_suppkey", "norm"))
    context = F.when(F.col("field").isNull(), 0.1).when(F.col("norm") == F.col("field"), 1.0).otherwise(0.8)
    score = 0.15 + 0.3 * context + 0.2 * F.greatest(F.lit(0.0), 1 - F.col("y") / 100) + 0.2 * F.least(F.lit(1.0), f / 3)
    scored = keyed.withColumn("score", F.floor(score * 1000 + 0.5) / 1000)
    accepted = F.col("score") >= 0.5
    return scored.groupBy("s_suppkey").agg(
        F.count("*").alias("candidates"),
        F.count_if(accepted).alias("accepted"),
        F.max("score").alias("best"),
        F.countDistinct(F.when(accepted, F.col("field"))).alias("fields"),
    )
