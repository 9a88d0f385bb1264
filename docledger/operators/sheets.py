"""Costing sheets: recipes that stand side by side and one below the other in one grid.

A block begins where a cell says COSTING SHEET: its column gives the strip of five columns that belongs to it, the next such
cell below ends it. Blocks are cut out by column and row first; only then is each read.

Rows are dealt by page once. All steps after that group, order and unite by page, so no row is shuffled or stored again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docledger.plans.catalog import register
from docledger.plans.tables import once, table

# Marks of a block, of its ingredients and of its price; beginnings of rows that are no ingredients.
BLOCK, INGREDIENTS, PRICE, OTHER_ROWS = "COSTING SHEET", "Ingredients", "MENU PRICE", ("WASTAGE", "TOTAL COST", "VAT", "TOTAL INCLUDING")
# Words of liquids; names of platters; categories by their words; words that make avo.
LIQUIDS = ("SAUCE", "MAYO", "OIL", "VINEGAR", "MIRIN", "JUICE", "CREAM", "MILK")
PLATTERS, PLATTER_CATEGORIES = ("PLATTER", "PLATTERS", "BRENTON", "GARDEN OF EDEN", "SPECIALITY"), ("BRENTON", "GARDEN")
AVO_CATEGORIES, AVO_BEGINNINGS = ("AVOCADO", "VEG", "VEGETARIAN"), ("AVO ", "AVOCADO ", "VEG ", "VEGETARIAN ")
BY_WORD = ("SALMON", "TUNA", "PRAWN", "HAMACHI")
#: Columns of a block; rows below its mark in which title and ingredients begin, rows above in which its category stands.
WIDTH, TITLE_ROWS, START_ROWS, CATEGORY_ROWS, LONGEST_CATEGORY, SMALL_BULK = 5, 6, 11, 7, 34, 20


def cell(x: Column) -> Column:
    return F.trim(F.replace(F.coalesce(x, F.lit("")), F.lit("\n"), F.lit(" ")))


def plain_number(x: Column) -> Column:
    """A number without its R and thousands commas; null for anything else."""
    bare = F.trim(F.replace(F.replace(x, F.lit("R"), F.lit("")), F.lit(","), F.lit("")))
    return F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double"))


def category_candidate(x: Column) -> Column:
    """A short text with a letter that is no mark, holds no word of digits, and no digit beside an r."""
    upper = F.upper(x)
    marks = upper.isin(BLOCK, PRICE, INGREDIENTS.upper())
    priced = upper.contains("R") & upper.rlike(r"\d")
    return (x != "") & (F.length(x) <= LONGEST_CATEGORY) & ~marks & ~x.rlike(r"(^|\s)\d+(\s|$)") & ~priced & x.rlike(r"\p{L}")


def category(found: Column, title: Column) -> Column:
    """The category that was found, brought to one of the known ones, or else inferred from the title."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(found, F.lit("")), r"\s+", " "))
    raw, name = F.upper(squeezed), F.upper(title)
    has = lambda *words: F.greatest(*(name.contains(w) for w in words)) if len(words) > 1 else name.contains(words[0])
    padded = F.concat(F.lit(" "), name, F.lit(" "))
    inferred = F.when(F.greatest(*(name.startswith(b) for b in AVO_BEGINNINGS)) | padded.contains(" VEG "), "AVO")
    for word in BY_WORD:
        inferred = inferred.when(padded.contains(word), word)
    inferred = inferred.when(name.startswith("SUNSET"), "SUNSET").otherwise(F.get(F.split(F.trim(name), r"\s+"), F.lit(0)))
    return F.when(has(*PLATTERS) | raw.isin(*PLATTER_CATEGORIES), "PLATTERS").when(raw.isin(*AVO_CATEGORIES), "AVO").when(raw != "", raw).otherwise(inferred)


def recipe_unit(name: Column, bulk: Column) -> Column:
    liquid = F.greatest(*(F.upper(name).contains(w) for w in LIQUIDS))
    return F.when(F.coalesce(bulk <= SMALL_BULK, F.lit(False)), "EACH").when(liquid, "ml").otherwise("g")


def strips(grid: DataFrame) -> DataFrame:
    """page, col, row, c (five cells): what stands in the columns of a page's blocks, row by row, where the first cell is not empty.

    Only cells of a strip are cleaned, and those of rows that hold a mark's first word.
    """
    page = Window.partitionBy("page")
    may_mark = F.array_join("cells", "\n").contains(BLOCK.split(" ")[0])
    marks = F.when(may_mark, F.array_compact(F.transform("cells", lambda x, i: F.when(cell(x) == BLOCK, i))))
    dealt = grid.filter("page is not null").repartition("page").withColumn("_marks", marks)
    told = dealt.withColumns({"_width": F.min_by(F.size("cells"), "row").over(page), "_cols": F.array_distinct(F.flatten(F.collect_set("_marks").over(page)))})
    starts = told.select("page", "row", "cells", "_width", F.explode("_cols").alias("col")).filter(F.col("col") + WIDTH <= F.col("_width"))
    at = lambda i: cell(F.get("cells", F.col("col") + i)).alias(f"c{i}")
    return starts.select("page", "col", "row", *(at(i) for i in range(WIDTH))).filter("c0 <> ''")


def blocks(strip: DataFrame) -> DataFrame:
    """page, col, row, start (its ingredients' first row), end (the row of the mark that ends it; null for none), title, category.

    What stands near a mark is looked at in ranges of rows around it, not searched for from mark to mark. A mark without a
    title or ingredients is no block, but ends the block above it; a mark inside the head of a block is passed by.
    """
    v, down = F.col("c0"), Window.partitionBy("page", "col").orderBy("row")
    titled = F.when(~v.isin(BLOCK, INGREDIENTS), v)
    begun = F.when(v == INGREDIENTS, F.col("row") + 1)
    seen = strip.select(
        "page", "col", F.col("row").alias("mark"), "c0",
        F.first(titled, ignorenulls=True).over(down.rangeBetween(1, TITLE_ROWS)).alias("title"),
        F.last(F.when(category_candidate(v), v), ignorenulls=True).over(down.rangeBetween(-CATEGORY_ROWS, -1)).alias("above"),
        F.first(begun, ignorenulls=True).over(down.rangeBetween(1, START_ROWS)).alias("start"),
    )
    heads = seen.filter(v == BLOCK).drop("c0")
    order = Window.partitionBy("page", "col").orderBy("mark")
    later = F.array_compact(F.array(*(F.lead("mark", i).over(order) for i in range(1, START_ROWS + 2))))
    ended = heads.withColumn("end", F.array_min(F.filter(later, lambda m: m >= F.col("start"))))
    # a mark that stands before the first ingredient of the block above it belongs to that block's head
    found = ended.filter("title is not null and start is not null")
    run = found.groupBy("page", "col").agg(F.array_sort(F.collect_list(F.struct("mark", "start", "end", "title", "above"))).alias("b"))
    kept = F.aggregate("b", F.slice("b", 1, 0), lambda a, x: F.when(F.coalesce(x["mark"] < F.try_element_at(a, F.lit(-1))["start"], F.lit(False)), a).otherwise(F.concat(a, F.array(x))))
    return run.select("page", "col", F.explode(kept).alias("x")).select("page", "col", "x.mark", "x.start", "x.end", "x.title", category(F.col("x.above"), F.col("x.title")).alias("category"))


def costing_sheets(grid: DataFrame) -> DataFrame:
    """page, title, category, selling_price, row, ingredient, qty, unit, bulk_size, unit_price: one row for each ingredient.

    grid: page, row (long), cells (array of strings; null is empty). Of blocks of a page with one title (but for case) the
    first by column and row counts. An ingredient is a row with a name and a quantity; the last menu price is the selling
    price, 0 without one. Blocks without ingredients, and pages without blocks, give no row.
    """
    strip = strips(grid)
    cut = blocks(strip)
    titles = Window.partitionBy("page", F.upper("title")).orderBy("col", "mark")
    cut = cut.withColumn("first", F.row_number().over(titles) == 1)
    name = F.col("c0")
    price = F.when(name == PRICE, F.coalesce(F.nullif(plain_number(F.col("c3")), F.lit(0.0)), plain_number(F.col("c4")), F.lit(0.0)))
    told = once(strip, qty=plain_number(F.col("c1")), other=F.greatest(*(name.startswith(w) for w in OTHER_ROWS)))
    # rows that are neither ingredients nor prices give nothing, so they are not put in order
    rows = told.filter((~F.col("other") & F.col("qty").isNotNull()) | (name == PRICE)).select("page", "col", "row", "c0", "qty", "c2", "c3", price.alias("price"))
    # each row belongs to the last block of its strip that begins at it or above, unless that has ended; a beginning stands before its row
    begins = cut.select("page", "col", F.col("start").alias("row"), F.struct("mark", "end", "title", "category", "first").alias("b"))
    body = rows.unionByName(begins, allowMissingColumns=True)
    order = Window.partitionBy("page", "col").orderBy("row", F.col("c0").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    inside = body.withColumn("b", F.last("b", ignorenulls=True).over(order)).filter("c0 is not null and b.first and (b.end is null or row < b.end)")
    told = inside.select("page", "col", "row", "c0", "qty", "c2", "c3", "price", "b.mark", "b.title", "b.category")
    last = F.max(F.when(name == PRICE, F.struct("row", "price"))).over(Window.partitionBy("page", "col", "mark"))
    priced = told.withColumn("selling_price", F.coalesce(last["price"], F.lit(0.0)))
    return priced.filter("price is null").select(
        "page", "title", "category", "selling_price", "row", name.alias("ingredient"), "qty",
        recipe_unit(name, plain_number(F.col("c2"))).alias("unit"), F.col("c2").alias("bulk_size"), F.col("c3").alias("unit_price"),
    )


_SHEETS, _STEP, _HEIGHT = 6, 6, 80


def printed_sheets(spark, sf_dir) -> DataFrame:
    """Orders as recipes on sheets of three columns of blocks by two rows of blocks; a seventh of them do not mark their ingredients."""
    name = F.when(F.col("p_size") == 5, "soy sauce").otherwise(F.col("p_name"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), name.alias("name"), "p_size")
    by = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    page = F.floor(F.col("l_orderkey") / _SHEETS)
    lines = table(spark, sf_dir, "lineitem").select(*by).join(part, "l_partkey").repartition(page).withColumn("page", page)
    order = Window.partitionBy("page", by[0]).orderBy(*by[1:])
    lines = lines.withColumns({"k": F.row_number().over(order).cast("long"), "last": F.lead(F.lit(True), 1, False).over(order) == F.lit(False)})
    o, k = F.col("l_orderkey"), F.col("k")

    def row(at: Column, *cells: Column) -> Column:
        return F.struct(at.cast("long").alias("at"), F.array(*cells, *[F.lit("")] * (WIDTH - len(cells))).alias("c"))

    title = F.concat(F.get(F.array(F.lit("Salmon bowl "), F.lit("Garden of Eden "), F.lit("veg roll ")), (o % 3).cast("int")), (o % 5).cast("string"))
    above = F.get(F.array(F.lit("Hot dishes"), F.lit("R 12"), F.lit("garden")), (F.floor(o / 3) % 3).cast("int"))
    head = F.array(row(F.lit(0), above), row(F.lit(1), F.lit(BLOCK)), row(F.lit(2), title), row(F.lit(4), F.when(o % 7 == 0, "").otherwise(INGREDIENTS)))
    amount = F.when(F.col("p_size") == 9, "some").otherwise(F.col("l_quantity").cast("long").cast("string"))
    body = F.array(row(k + 4, F.col("name"), amount, F.col("p_size").cast("string"), F.lit("R 10")))
    foot = F.array(row(k + 6, F.lit("WASTAGE 5%"), F.lit("1")), row(k + 7, F.lit(PRICE), F.lit(""), F.lit(""), F.when(o % 2 == 0, "R 1,250.50").otherwise("0"), F.lit("99")))
    whole = F.concat(body, F.when(k == 1, head).otherwise(F.array()), F.when(F.col("last"), foot).otherwise(F.array()))
    placed = lines.select("page", "l_orderkey", F.explode(whole).alias("r")).select(
        "page", (o % 3 * _STEP).cast("int").alias("col"), (F.floor(o % _SHEETS / 3) * _HEIGHT + F.col("r.at")).alias("row"), "r.c"
    )
    strip = lambda i: F.coalesce(F.max(F.when(F.col("col") == i * _STEP, F.col("c"))), F.array(*[F.lit("")] * WIDTH))
    return placed.groupBy("page", "row").agg(F.concat(strip(0), F.array(F.lit("")), strip(1), F.array(F.lit("")), strip(2)).alias("cells"))


@register(
    "costing_sheet_recipes",
    "X14",
    f"""WITH lines AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k, p_name, p_size, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey),
    recipes AS (SELECT DISTINCT o, o // {_SHEETS} AS page, o % 3 AS col, o % {_SHEETS} // 3 AS below, (['Salmon bowl ', 'Garden of Eden ', 'veg roll '])[o % 3 + 1] || (o % 5) AS title FROM lines WHERE o % 7 <> 0),
    firsts AS (SELECT *, CASE WHEN o % 3 = 1 OR o // 3 % 3 = 2 THEN 'PLATTERS' WHEN o // 3 % 3 = 0 THEN 'HOT DISHES' WHEN o % 3 = 0 THEN 'SALMON' ELSE 'AVO' END AS category
      FROM recipes QUALIFY row_number() OVER (PARTITION BY page, title ORDER BY col, below) = 1)
    SELECT page, title, category, CASE WHEN l.o % 2 = 0 THEN 1250.5 ELSE 99 END::DOUBLE AS selling_price, (below * {_HEIGHT} + k + 4)::BIGINT AS row, CASE WHEN p_size = 5 THEN 'soy sauce' ELSE p_name END AS ingredient,
    l_quantity AS qty, CASE WHEN p_size <= 20 THEN 'EACH' WHEN p_size = 5 THEN 'ml' ELSE 'g' END AS unit, p_size::VARCHAR AS bulk_size, 'R 10' AS unit_price FROM firsts f JOIN lines l ON f.o = l.o WHERE p_size <> 9""",
)
def costing_sheet_recipes(spark, sf_dir):
    """Recipes cut out of sheets with six blocks each; the SQL holds what the sheets were printed from."""
    return costing_sheets(printed_sheets(spark, sf_dir))
