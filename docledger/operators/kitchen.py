"""Menu and ingredient names, manual matches, food costs, observed packs, reviews and strict sales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docledger.functions.names import capitals
from docledger.functions.text import clean_cell
from docledger.plans.catalog import register
from docledger.plans.tables import table

# Ingredients under their kitchen names, and words of menus.
MASTER_INGREDIENTS = {
    "avo": "Avocado", "avocado": "Avocado", "jap mayo": "Japanese Mayo", "japanese mayo": "Japanese Mayo", "seaweed": "Nori", "nori": "Nori",
}
MENU_WORDS = {"cali": "california"}
# Columns of strict sales by name, the surest first.
ITEM_COLUMNS = ("item sold", "item", "menu item", "description", "product", "name")
SOLD_COLUMNS = ("quantity sold", "qty sold", "qty", "quantity", "sold")

_CENTS = "floor({} * 100 + 0.5) / 100"


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(v) for kv in values.items() for v in kv))


def master_ingredient(x: Column, more: dict[str, str] | None = None) -> Column:
    """The ingredient's own name where it is an alias, else its words with capitals."""
    name = F.trim(x)
    return F.coalesce(_map(MASTER_INGREDIENTS | (more or {}))[F.lower(name)], capitals(name))


def menu_name(x: Column) -> Column:
    words = F.split(F.lower(clean_cell(x)), " ")
    return F.array_join(F.transform(words, lambda w: F.coalesce(_map(MENU_WORDS)[w], w)), " ")


#: Ingredients as kitchens write them; names of parts otherwise.
WRITTEN = (" Avo", "JAP MAYO", "Seaweed ", "nori", None)


@register(
    "master_usage",
    "F45 F46 A18",
    """WITH l AS (SELECT p_partkey, p_size, (['Avocado', 'Japanese Mayo', 'Nori', 'Nori'])[p_partkey % 5 + 1] AS known, p_name,
      CASE WHEN p_partkey % 3 = 0 THEN 'california ' ELSE 'calico ' END || p_brand AS menu FROM part)
    SELECT coalesce(known, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:]) AS ingredient, lower(menu) AS menu,
    round(sum(p_size * 0.125), 3)::DOUBLE AS used, count(*) AS n FROM l GROUP BY ALL""",
)
def master_usage(spark, sf_dir):
    """Usage by the ingredient's own name and the menu's, however each was written."""
    part = table(spark, sf_dir, "part")
    written = F.coalesce(F.get(F.array(*map(F.lit, WRITTEN)), (F.col("p_partkey") % 5).cast("int")), F.col("p_name"))
    menu = F.concat(F.when(F.col("p_partkey") % 3 == 0, " Cali  ").otherwise("calico "), F.col("p_brand"))
    rows = part.select(master_ingredient(written).alias("ingredient"), menu_name(menu).alias("menu"), "p_size")
    return rows.groupBy("ingredient", "menu").agg(F.round(F.sum(F.col("p_size") * 0.125), 3).alias("used"), F.count("*").alias("n"))


def with_overrides(matches: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """matches (key, recipe, score, status) with manual ones (key, at, recipe) in their place: the last of a key counts.

    A null recipe in an override is no override; repeated overrides are one.
    """
    last = overrides.filter("recipe is not null").groupBy(key).agg(F.max(F.struct("at", "recipe"))["recipe"].alias("_manual"))
    manual = F.col("_manual").isNotNull()
    return matches.join(last, key, "left").select(
        key,
        F.coalesce("_manual", "recipe").alias("recipe"),
        F.when(manual, 100.0).otherwise(F.col("score")).alias("score"),
        F.when(manual, "manual").otherwise(F.col("status")).alias("status"),
    )


@register(
    "match_override",
    "B7",
    """WITH m AS (SELECT o_orderkey, (o_orderkey % 97) AS s, o_custkey FROM orders),
    v AS (SELECT l_orderkey, arg_max(l_partkey, (l_shipdate, l_partkey)) AS p FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
    SELECT o_orderkey, coalesce(p, CASE WHEN s >= 48 THEN o_custkey END) AS recipe, CASE WHEN p IS NOT NULL THEN 100 ELSE s END::DOUBLE AS score,
    CASE WHEN p IS NOT NULL THEN 'manual' WHEN s >= 48 THEN 'auto' ELSE 'needs_review' END AS status FROM m LEFT JOIN v ON l_orderkey = o_orderkey""",
)
def match_override(spark, sf_dir):
    s = F.col("o_orderkey") % 97
    found = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(s >= 48, F.col("o_custkey")).alias("recipe"),
        s.cast("double").alias("score"),
        F.when(s >= 48, "auto").otherwise("needs_review").alias("status"),
    )
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    chosen = returned.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("at"), F.col("l_partkey").alias("recipe"))
    return with_overrides(found, chosen, "o_orderkey")


@register(
    "food_cost_totals",
    "B8 A25",
    """WITH l AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT l_suppkey, floor(sum(coalesce(q * p_retailprice, 0)) * 100 + 0.5) / 100 AS total, sum(CASE WHEN p_partkey IS NULL THEN n ELSE 0 END)::BIGINT AS missing
    FROM l LEFT JOIN (SELECT * FROM part WHERE p_size > 5) p ON p_partkey = l_partkey GROUP BY ROLLUP (l_suppkey)""",
)
def food_cost_totals(spark, sf_dir):
    """Cost of each supplier's lines and of all (null supplier); lines without a price cost nothing and are counted.

    Lines combine by supplier and part before they meet the prices.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    stock = table(spark, sf_dir, "part").filter("p_size > 5").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("price"))
    costed = lines.join(stock, "l_partkey", "left")
    return costed.rollup("l_suppkey").agg(
        F.expr(_CENTS.format("sum(coalesce(q * price, 0))")).alias("total"),
        F.sum(F.when(F.col("price").isNull(), F.col("n")).otherwise(0)).alias("missing"),
    )


@register(
    "failure_envelopes",
    "X20",
    """SELECT d.doc_id, coalesce(l.quality, 0)::BIGINT AS row_count, coalesce(l.toxic, 0)::BIGINT AS failures, CASE WHEN l.doc_id IS NULL THEN 'Parser test timed out after 30 seconds.' END AS error,
    l.doc_id IS NULL OR l.toxic = 1 AS needs_review, strftime(TIMESTAMP '2024-01-02 03:04:05', '%Y-%m-%dT%H:%M:%S') AS tested_at FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def failure_envelopes(spark, sf_dir):
    """One row an input: its result, or an error with counters at zero that asks for a review. The clock is a parameter."""
    results = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", F.lit(True).alias("_ran"))
    ran = F.coalesce("_ran", F.lit(False))
    return table(spark, sf_dir, "documents").select("doc_id").join(results, "doc_id", "left").select(
        "doc_id",
        F.coalesce(F.col("quality").cast("long"), F.lit(0)).alias("row_count"),
        F.coalesce(F.col("toxic").cast("long"), F.lit(0)).alias("failures"),
        F.when(~ran, "Parser test timed out after 30 seconds.").alias("error"),
        (~ran | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("needs_review"),
        F.date_format(F.lit("2024-01-02 03:04:05").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss").alias("tested_at"),
    )


def plain_number(x: Column) -> Column:
    """Without a point where the number is whole."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def pack_format(count: Column, size: Column, unit: Column) -> Column:
    """``count x size unit`` of what is known; null where neither count nor size is."""
    sized = F.concat(plain_number(size), F.coalesce(unit, F.lit("")))
    return F.nullif(F.concat_ws(" x ", plain_number(count), sized), F.lit(""))


@register(
    "observed_packs",
    "M8 M11",
    """WITH v AS (SELECT l_partkey, l_shipdate AS seen_at, CASE WHEN l_linestatus = 'O' THEN l_returnflag END AS unit, CASE WHEN l_quantity::INT % 10 <> 0 THEN l_quantity::INT % 10 END AS c, (l_quantity::INT % 4) * 0.5 AS s FROM lineitem),
    p AS (SELECT *, concat_ws(' x ', c::VARCHAR, CASE s WHEN 0.5 THEN '0.5kg' WHEN 1.5 THEN '1.5kg' ELSE s::INT::VARCHAR || 'kg' END) AS pack FROM v),
    u AS (SELECT l_partkey, unit, min(seen_at) AS seen_at FROM p WHERE unit IS NOT NULL GROUP BY ALL), k AS (SELECT l_partkey, pack, min(seen_at) AS seen_at FROM p GROUP BY ALL)
    SELECT a.l_partkey, coalesce(units, '') AS units, packs, 'proposed' AS status FROM (SELECT l_partkey, string_agg(pack, ', ' ORDER BY seen_at, pack) AS packs FROM k GROUP BY 1) a LEFT JOIN (SELECT l_partkey, string_agg(unit, ', ' ORDER BY seen_at, unit) AS units FROM u GROUP BY 1) b ON a.l_partkey = b.l_partkey""",
)
def observed_packs(spark, sf_dir):
    """Units and pack formats of each part's record, each once, in the order in which they were first seen."""
    whole = F.col("l_quantity").cast("int")
    count = F.when(whole % 10 != 0, (whole % 10).cast("double"))
    variants = table(spark, sf_dir, "lineitem").select(
        "l_partkey",
        F.col("l_shipdate").alias("at"),
        F.when(F.col("l_linestatus") == "O", F.col("l_returnflag")).alias("unit"),
        pack_format(count, (whole % 4) * 0.5, F.lit("kg")).alias("pack"),
    )
    told = F.array(*(F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in ("unit", "pack")))
    each = variants.select("l_partkey", "at", F.explode(told).alias("o"))
    first = each.filter("o.v is not null").groupBy("l_partkey", "o").agg(F.min("at").alias("at"))
    seen = first.groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.struct("at", F.col("o.v").alias("v"), F.col("o.k").alias("k")))).alias("all"))
    of = lambda k: F.array_join(F.filter("all", lambda o: o["k"] == k)["v"], ", ")
    return seen.select("l_partkey", of("unit").alias("units"), of("pack").alias("packs"), F.lit("proposed").alias("status"))


@register(
    "recipe_review",
    "X17 X18",
    """SELECT p_partkey, array_to_string(i, ', ') AS issues, CASE WHEN len(i) = 0 THEN 'ok' ELSE 'needs_review' END AS status FROM (SELECT p_partkey,
      list_filter([CASE WHEN p_partkey % 3 = 0 THEN 'missing_quantity' END, CASE WHEN p_partkey % 4 <> 0 THEN 'missing_unit' END, CASE WHEN p_size < 10 THEN 'low_confidence' END], lambda x: x IS NOT NULL) AS i FROM part)""",
)
def recipe_review(spark, sf_dir):
    """What each ingredient lacks; without any lack it is fine."""
    k = F.col("p_partkey")
    quantity, unit, confidence = F.when(k % 3 != 0, F.col("p_size")), F.when(k % 4 == 0, "g"), F.col("p_size") / 20
    issues = F.array_compact(
        F.array(
            F.when(quantity.isNull(), "missing_quantity"), F.when(unit.isNull(), "missing_unit"), F.when(confidence < 0.5, "low_confidence")
        )
    )
    status = F.when(F.size("issues") == 0, "ok").otherwise("needs_review")
    return table(spark, sf_dir, "part").select("p_partkey", issues.alias("issues")).select(
        "p_partkey", F.array_join("issues", ", ").alias("issues"), status.alias("status")
    )


@register(
    "letter_overlap",
    "F48 M12",
    """SELECT p_partkey, len(list_intersect(a, b)) >= 0.6 * len(a) AND len(a) > 0 AS alike, array_to_string(list_sort(list_distinct([p_brand, upper(p_brand), p_type])), '|') AS conflicts
    FROM (SELECT *, list_distinct(string_split(p_name, '')) AS a, list_distinct(string_split(lower(p_type), '')) AS b FROM part)""",
)
def letter_overlap(spark, sf_dir):
    """Three fifths of the first text's characters stand in the second; conflicts of two sources as one list, each once."""
    letters = lambda x: F.array_distinct(F.filter(F.split(x, ""), lambda c: c != ""))
    a, b = letters(F.col("p_name")), letters(F.lower("p_type"))
    conflicts = F.concat(F.array("p_brand", F.upper("p_brand")), F.array("p_brand", "p_type", F.lit(None)))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        ((F.size(a) > 0) & (F.size(F.array_intersect(a, b)) >= 0.6 * F.size(a))).alias("alike"),
        F.array_join(F.array_sort(F.array_distinct(F.array_compact(conflicts))), "|").alias("conflicts"),
    )


def _named(df: DataFrame, names: tuple[str, ...]) -> Column:
    by_name = {c.strip().lower(): c for c in df.columns}
    found = next((by_name[n] for n in names if n in by_name), None)
    if found is None:
        raise ValueError(f"no column is named one of {', '.join(names)}")
    return F.col(f"`{found.replace('`', '``')}`")


def strict_sales(df: DataFrame) -> DataFrame:
    """item and sold of every row. Rows that lack both are skipped; the job fails on a row that lacks one of them.

    Columns are found by name, whatever their case; a comma in a quantity is a decimal point.
    """
    item = clean_cell(_named(df, ITEM_COLUMNS).cast("string"))
    sold = F.replace(F.trim(_named(df, SOLD_COLUMNS).cast("string")), F.lit(","), F.lit(".")).try_cast("double")
    rows = df.select(item.alias("item"), sold.alias("sold")).filter("item <> '' or sold is not null")
    unnamed = F.raise_error(F.lit("A sales row has no item name.")).cast("string")
    wrong = F.raise_error(F.concat(F.lit("The quantity is no number in the sales row of "), F.col("item"))).cast("double")
    return rows.select(F.when(F.col("item") == "", unnamed).otherwise(F.col("item")).alias("item"), F.coalesce("sold", wrong).alias("sold"))


@register(
    "strict_sales",
    "S14 F73",
    """SELECT c_name AS item, sum(o_orderkey % 9 + 0.5)::DOUBLE AS sold, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_name""",
)
def strict_sales_query(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    written = F.concat((F.col("o_orderkey") % 9).cast("string"), F.lit(",5"))
    sheet = orders.select(F.col("o_custkey").alias("c_custkey"), written.alias(" Qty Sold")).join(customer.select("c_custkey", F.col("c_name").alias("ITEM")), "c_custkey")
    return strict_sales(sheet).groupBy("item").agg(F.sum("sold").alias("sold"), F.count("*").alias("n"))


#: Tables of a document and rows of a table that a text shows.
SHOWN_TABLES, SHOWN_ROWS = 8, 40


@register(
    "table_text",
    "F68 O5",
    """WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS t FROM orders QUALIFY t <= 8),
    r AS (SELECT l_orderkey, trim(l_returnflag) || ' | ' || l_partkey || ' | ' || l_suppkey AS line,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS k FROM lineitem QUALIFY k <= 40)
    SELECT o_custkey, md5(string_agg(CASE WHEN k = 1 THEN '--- Page 1 Table ' || t || ' ---' || chr(10) ELSE '' END || line, chr(10) ORDER BY t, k)) AS digest, count(*) AS lines FROM o JOIN r ON l_orderkey = o_orderkey GROUP BY o_custkey""",
)
def table_text(spark, sf_dir):
    """The first tables of each document as lines of cells under a label, for a prompt: rows in their order, repeated ones too."""
    tables = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    tables = tables.withColumn("t", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).filter(F.col("t") <= SHOWN_TABLES)
    line = F.concat_ws(" | ", F.trim("l_returnflag"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), line.alias("line"), F.row_number().over(order).alias("k"))
    rows = rows.filter(F.col("k") <= SHOWN_ROWS)
    label = F.when(F.col("k") == 1, F.concat(F.lit("--- Page 1 Table "), F.col("t").cast("string"), F.lit(" ---\n"))).otherwise("")
    shown = tables.join(rows, "o_orderkey").groupBy("o_custkey").agg(
        F.array_sort(F.collect_list(F.struct("t", "k", F.concat(label, F.col("line")).alias("line")))).alias("all")
    )
    return shown.select(
        "o_custkey", F.md5(F.array_join(F.col("all")["line"], "\n").cast("binary")).alias("digest"), F.size("all").cast("long").alias("lines")
    )
