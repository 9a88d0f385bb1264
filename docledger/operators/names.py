"""Names, units, codes and packs of descriptions, and the type of each row by weighted signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from docledger.functions import names, rowtypes
from docledger.plans.catalog import register
from docledger.plans.tables import table

#: Supplier codes and descriptions; ``{n}`` stands for the second word of the part's name.
CODED = (
    ("WHO-Carrots Large kg {n}", "x"), ("", "Spring onion bunch 1kg {n}"), ("Stock: baby marrow punnet - {n}", ""), ("kg", "Each"), ("", ""),
    ("item - o'brien {n} heads", ""),
)
NAMED = (
    "000000000123 | Beef Mince 2kg {n}", "BEL12 Cheese (2 x 5 kg) {n}", "SAL Prawns 16/20 kg each {n}", "Cream 250 ml 12,5 it {n}", None, "Item {n}",
)
UNITS = ("Tomato pun 250 g", "kg", "12 EA", "", "2 Lt", "ltr")
NUMBERS = ("R 12,50", "abc R5.5", "-3 kg", "x", "1.2.3", "r 7")
#: Descriptions with codes and packs of every kind.
DESCRIBED = (
    "NOR008 Mayo 10x1kg {n}", "10456 Cola 24 x 330 ml {n}", "Butter 250g {n}", "Eggs 30 tray {n}", "Rolls 12 soft bags bag {n}", "Bread (6's) {n}",
    "Tea {n}", "  Peppers,, red * 4.5L ( boxes ) {n}", "A123 Juice 6 x 2 Bottles {n}",
)


def _pick(values, key="p_partkey"):
    """One of ``values`` by the part's key, with the second word of its name put in."""
    chosen = F.get(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int"))
    return F.replace(chosen, F.lit("{n}"), F.split_part("p_name", F.lit(" "), F.lit(2)))


@register(
    "item_names",
    "F3 F15 F16 F17 F18 F19",
    """WITH p AS (SELECT p_partkey, split_part(p_name, ' ', 2) AS n, (p_partkey % 6 + 1)::INT AS k FROM part)
    SELECT p_partkey, replace((['Carrots {n}', 'Spring Onion Bunch 1Kg {n}', 'Baby Marrow - {n}', 'Each', NULL, 'O''Brien {n}'])[k], '{n}', upper(n[1]) || n[2:]) AS ingredient,
    replace((['Beef Mince {n}', 'Cheese {n}', 'Prawns {n}', 'Cream {n}', '', 'Item {n}'])[k], '{n}', n) AS item,
    (['Tomato pun 250 g', 'KG', '12 EA', NULL, '2 Lt', 'LTR'])[k] AS bought_as, (['Punnet', 'KG', 'Each', '', 'L', 'L'])[k] AS unit,
    ([12.5, 5.5, -3, NULL, 1.2, 7])[k]::DOUBLE AS number, ([12.5, 5.5, NULL, NULL, NULL, 7])[k]::DOUBLE AS money FROM p""",
)
def item_names(spark, sf_dir):
    """The SQL holds what was worked out by hand."""
    code, description = (_pick([c[i] for c in CODED]) for i in (0, 1))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        names.ingredient_name(code, description).alias("ingredient"),
        names.item_name(_pick(NAMED)).alias("item"),
        names.purchase_unit(_pick(UNITS)).alias("bought_as"),
        names.line_unit(_pick(UNITS)).alias("unit"),
        names.any_number(_pick(NUMBERS)).alias("number"),
        names.money_number(_pick(NUMBERS)).alias("money"),
    )


@register(
    "description_components",
    "F29 F30 F31 F32",
    """WITH p AS (SELECT p_partkey, split_part(p_name, ' ', 2) AS n, (p_partkey % 9 + 1)::INT AS k FROM part)
    SELECT p_partkey, replace((['NOR008 Mayo 10x1kg {n}', '10456 Cola 24 x 330 ml {n}', 'Butter 250g {n}', 'Eggs 30 tray {n}', 'Rolls 12 soft bags bag {n}', 'Bread(6 s){n}', 'Tea {n}',
      'Peppers red 4. 5L(boxes){n}', 'A123 Juice 6 x 2 Bottles {n}'])[k], '{n}', n) AS description,
    (['NOR008', '10456', NULL, NULL, NULL, NULL, NULL, NULL, 'A123'])[k] AS code, ([10, 24, 1, 1, 12, 6, NULL, 1, 6])[k]::DOUBLE AS pack_count,
    ([1, 330, 250, 30, NULL, NULL, NULL, 5, 2])[k]::DOUBLE AS pack_size, (['kg', 'ml', 'g', 'tray', 'bag', NULL, NULL, 'l', 'bottle'])[k] AS pack_unit,
    replace((['Mayo 10x1kg {n}', 'Cola ml {n}', 'Butter {n}', 'Eggs tray {n}', 'Rolls soft bags bag {n}', 'Bread {n}', 'Tea {n}', 'Peppers red . (boxes){n}', 'Juice Bottles {n}'])[k], '{n}', n) AS bare FROM p""",
)
def description_components(spark, sf_dir):
    """The SQL holds what was worked out by hand."""
    d = table(spark, sf_dir, "part").select("p_partkey", names.normal_description(_pick(DESCRIBED)).alias("description"))
    d = d.select("*", names.supplier_code(F.col("description")).alias("code"), names.without_code(F.col("description")).alias("rest"))
    return d.select("*", names.pack(F.col("rest")).alias("p")).select(
        "p_partkey",
        "description",
        "code",
        F.col("p.count").alias("pack_count"),
        F.col("p.size").alias("pack_size"),
        F.col("p.unit").alias("pack_unit"),
        names.without_pack(F.col("rest")).alias("bare"),
    )


#: Rows of invoices; the texts of the turns follow.
HEADS = (
    "item 0000000000123 2 kg", "vat 15%", "grand total", "sub total", "paid by eft", "courier", "promo", "credit note -5", "returned goods",
    "handling", "invoice date", "page", "rice 2 kg", "tax amount", "",
)


@register(
    "row_classifier",
    "C1 C2 C3 C5 P22 W7",
    "WITH r AS (SELECT conv_id, turn, (turn + 1)::DOUBLE AS q, CASE WHEN conv_id % 4 = 0 THEN 'unknown' WHEN conv_id % 4 = 1 THEN ' Product ' END AS asked, lower((["
    + ", ".join(f"'{h}'" for h in HEADS)
    + "])[(conv_id + turn) % 15 + 1] || ' ' || coalesce(text, '')) AS t FROM conversations), f AS (SELECT *, CASE WHEN conv_id % 3 = 0 THEN 2.0 * q WHEN conv_id % 3 = 1 THEN q END AS total FROM r), "
    + rowtypes.sql("f", "t", "q", "2.0::DOUBLE", "total")
    + """ SELECT conv_id, turn, CASE WHEN asked IS NULL OR asked = 'unknown' THEN type ELSE lower(trim(asked)) END AS type, type = 'product' AS is_product, confidence, margin, second, signals, conflict FROM classified""",
)
def row_classifier(spark, sf_dir):
    """Type of each row by weighted signals, in one projection over all rows; a type asked for, but ``unknown``, overrides it."""
    n = F.col("conv_id") + F.col("turn")
    head = F.get(F.array(*map(F.lit, HEADS)), (n % len(HEADS)).cast("int"))
    q, third = (F.col("turn") + 1).cast("double"), F.col("conv_id") % 3
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.concat(head, F.lit(" "), F.coalesce("text", F.lit(""))).alias("t"),
        q.alias("q"),
        F.when(third == 0, 2.0 * q).when(third == 1, q).alias("total"),
        F.when(F.col("conv_id") % 4 == 0, "unknown").when(F.col("conv_id") % 4 == 1, " Product ").alias("asked"),
    )
    found = rows.select("*", rowtypes.classify(F.col("t"), F.col("q"), F.lit(2.0), F.col("total")).alias("c"))
    return found.select(
        "conv_id",
        "turn",
        rowtypes.requested(F.col("asked"), F.col("c.type")).alias("type"),
        rowtypes.is_product(F.col("c.type")).alias("is_product"),
        "c.confidence",
        "c.margin",
        "c.second",
        F.array_join("c.signals", ", ").alias("signals"),
        "c.conflict",
    )
