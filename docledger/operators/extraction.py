"""Extraction composites: grids and positioned items to validated lines, prep cards, envelopes, imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docledger.functions import money, units
from docledger.functions.text import clean_cell, header_key, may_name_three, with_role
from docledger.functions.validate import validation_status
from docledger.operators.validation import LINES_SQL, checked_lines
from docledger.operators.windows import TEXT_LINES_SQL, text_lines
from docledger.plans.catalog import register
from docledger.plans.tables import once, table


def read_grids(grids: DataFrame) -> DataFrame:
    """doc_id, row_idx, quantity, unit_price, line_total, description and role of the rows below each grid's header.

    grids: doc_id, row_idx, cells. The header is the earliest of the rows with the most known fields, three at least;
    rows count until the first that ends the table; blank rows do not count. Cells are read by the header's columns.
    """
    filled = grids.filter(F.array_join("cells", "").rlike(r"[^\s]"))
    bare = F.regexp_replace(F.lower(F.array_join("cells", "")), "[^a-z0-9]+", "")
    fields = once(filled.filter(may_name_three(bare)), fields=F.transform("cells", header_key))
    known = once(fields, hits=F.size(F.array_distinct(F.filter("fields", lambda k: k.isNotNull())))).filter("hits >= 3")
    header = known.groupBy("doc_id").agg(F.max(F.struct("hits", (-F.col("row_idx")).alias("up"), "fields")).alias("h"))
    below = filled.join(header, "doc_id").filter("row_idx > -h.up")
    told = with_role(below, F.concat_ws(" ", "cells"), "_text")
    ends = F.col("role").isin("subtotal", "vat", "payment", "footer", "banking").cast("int")
    open_rows = Window.partitionBy("doc_id").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    body = told.withColumn("ended", F.max(ends).over(open_rows)).filter("ended = 0")

    def cell(field: str):
        at = F.array_position("h.fields", F.lit(field)).cast("int")
        return F.when(at > 0, F.get(F.col("cells"), at - 1))

    # steps of their own: what aggregates them does not compile their expressions into one method, too long for the JVM
    placed = once(body, _d=cell("description"), _q=cell("quantity"), _p=cell("unit_price"), _t=cell("total"))
    read = once(placed, description=clean_cell(F.col("_d")), quantity=money.parse_money(F.col("_q")))
    read = once(read, unit_price=money.parse_money(F.col("_p")), line_total=money.parse_money(F.col("_t")))
    return read.select("doc_id", "row_idx", "description", "quantity", "unit_price", "line_total", "role")


_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "quantity", "line_total")


@register(
    "grid_extraction",
    "X1 X2 X3 X10 P14 P25 P26 U10",
    f"""WITH {LINES_SQL} SELECT l_orderkey AS doc_id, count(*) AS rows, count(CASE WHEN status = 'ok' THEN 1 END) AS validated, count(CASE WHEN status = 'missing' THEN 1 END) AS discarded,
    floor(sum(line_total) * 100 + 0.5) / 100 AS total FROM checked GROUP BY l_orderkey""",
)
def grid_extraction(spark, sf_dir):
    """Orders written as grids - a title, a header in one of two column orders, lines, a blank row, a subtotal - and read back."""
    lines = checked_lines(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER))
    amount = lambda c: F.coalesce(F.concat(F.lit("R "), F.col(c).cast("decimal(18,2)").cast("string")), F.lit("R null"))
    row = [F.concat(F.lit("Part "), F.col("l_partkey").cast("string")), F.col("quantity").cast("decimal(18,0)").cast("string"), amount("unit_price"), amount("line_total")]
    swap = F.col("l_orderkey") % 2 == 0
    head = ["Item Description", "Qty", "Unit Price", "Line Total"]

    def ordered(cells):
        a, b, c, d = (x if not isinstance(x, str) else F.lit(x) for x in cells)
        return F.when(swap, F.array(b, a, d, c)).otherwise(F.array(a, b, c, d))

    body = lines.select(F.col("l_orderkey").alias("doc_id"), (n + 1).alias("row_idx"), ordered(row).alias("cells"))
    orders = lines.groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    below = lambda k: F.col("lines") + k
    extra = orders.select(
        F.col("l_orderkey").alias("doc_id"),
        F.explode(
            F.array(
                F.struct(F.lit(0).cast("long").alias("row_idx"), F.array(F.lit("Order")).alias("cells")),
                F.struct(F.lit(1).cast("long").alias("row_idx"), ordered(head).alias("cells")),
                F.struct(below(2).alias("row_idx"), F.array(F.lit(" "), F.lit("")).alias("cells")),
                F.struct(below(3).alias("row_idx"), F.array(F.lit("Subtotal"), F.lit("1.00")).alias("cells")),
                F.struct(below(4).alias("row_idx"), ordered(["after", "1", "1", "1"]).alias("cells")),
            )
        ).alias("r"),
    ).select("doc_id", "r.row_idx", "r.cells")
    read = read_grids(body.unionByName(extra))
    status = validation_status(F.col("quantity"), F.col("unit_price"), F.col("line_total"))
    return once(read, status=status).groupBy("doc_id").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("status") == "ok").alias("validated"),
        F.count_if(F.col("status") == "missing").alias("discarded"),
        (F.floor(F.sum("line_total") * 100 + 0.5) / 100).alias("total"),
    )


#: Places of the columns of a positioned page.
COLUMNS = (("quantity", 200.0), ("unit_price", 320.0), ("line_total", 450.0))


def read_items(items: DataFrame, reach: float = 12.0) -> DataFrame:
    """doc_id, band and a column for each field of positioned items (doc_id, item_idx, text, cx, cy).

    Items whose centres follow each other within ``reach`` are one row; an item goes to the nearest column, and of
    several there the nearest counts.
    """
    order = Window.partitionBy("doc_id").orderBy("cy", "item_idx")
    gap = F.coalesce(F.col("cy") - F.lag("cy").over(order) > reach, F.lit(False)).cast("int")
    banded = items.withColumn("_g", gap).withColumn("band", F.sum("_g").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    near = F.array_min(F.array(*(F.struct(F.abs(F.col("cx") - x).alias("d"), F.lit(f).alias("field")) for f, x in COLUMNS)))
    placed = once(banded, near=near)
    pick = lambda f: F.min_by(F.when(F.col("near.field") == f, F.col("text")), F.when(F.col("near.field") == f, F.struct("near.d", "item_idx")))
    return placed.groupBy("doc_id", "band").agg(*(pick(f).alias(f) for f, _ in COLUMNS))


@register(
    "positioned_extraction",
    "X5 G1 G5 J3 J4 J5",
    f"""WITH {LINES_SQL} SELECT l_orderkey AS doc_id, count(*) AS rows, count(CASE WHEN status = 'ok' THEN 1 END) AS validated,
    floor(sum(coalesce(unit_price, 0)) * 100 + 0.5) / 100 AS prices FROM checked GROUP BY l_orderkey""",
)
def positioned_extraction(spark, sf_dir):
    """Orders laid out as items on a page, a row of three every 30 pixels with some wobble, and read back."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER))
    lines = checked_lines(spark, sf_dir).withColumn("n", n)
    cells = F.array(
        *(
            F.struct(
                (F.col("n") * 4 + k).alias("item_idx"),
                F.col(f).cast("decimal(18,2)").cast("string").alias("text"),
                (F.lit(x) + (F.col("l_partkey") % 21) - 10).alias("cx"),
                (F.col("n") * 30.0 + (F.col("l_partkey") + k) % 5).alias("cy"),
            )
            for k, (f, x) in enumerate(COLUMNS)
        )
    )
    items = lines.select(F.col("l_orderkey").alias("doc_id"), F.explode(cells).alias("i")).select("doc_id", "i.*").filter("text is not null")
    got = once(read_items(items), **{f"_{f}": money.parse_money(F.col(f)) for f, _ in COLUMNS})
    got = once(got, status=validation_status(F.col("_quantity"), F.col("_unit_price"), F.col("_line_total"))).withColumn("unit_price", F.col("_unit_price"))
    return got.groupBy("doc_id").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("status") == "ok").alias("validated"),
        (F.floor(F.sum(F.coalesce("unit_price", F.lit(0.0))) * 100 + 0.5) / 100).alias("prices"),
    )


@register(
    "strategy_choice",
    "X12",
    f"""WITH {LINES_SQL}, c AS (SELECT l_orderkey, count(CASE WHEN status = 'ok' THEN 1 END) AS a, count(CASE WHEN quantity * 2 > 20 THEN 1 END) AS b FROM checked GROUP BY l_orderkey)
    SELECT CASE WHEN a >= 2 THEN 'structured' WHEN b > a THEN 'text' WHEN a > 0 THEN 'structured' ELSE 'none' END AS strategy, count(*) AS n, sum(greatest(a, CASE WHEN a >= 2 THEN a ELSE b END))::BIGINT AS rows FROM c GROUP BY 1""",
)
def strategy_choice(spark, sf_dir):
    """The structured rows of a document if there are two, else whichever way finds more."""
    counts = checked_lines(spark, sf_dir).groupBy("l_orderkey").agg(
        F.count_if(F.col("status") == "ok").alias("a"), F.count_if(F.col("quantity") * 2 > 20).alias("b")
    )
    a, b = F.col("a"), F.col("b")
    choice = F.when(a >= 2, "structured").when(b > a, "text").when(a > 0, "structured").otherwise("none")
    return counts.groupBy(choice.alias("strategy")).agg(
        F.count("*").alias("n"), F.sum(F.greatest(a, F.when(a >= 2, a).otherwise(b))).alias("rows")
    )


@register(
    "document_envelope",
    "X21 K1",
    f"""WITH {LINES_SQL} SELECT l_orderkey, count(*) AS lines, md5(string_agg(l_linenumber || ':' || status, ',' ORDER BY l_linenumber, status)) AS digest,
    CASE WHEN count(CASE WHEN status <> 'ok' THEN 1 END) > 0 THEN 'needs_review' ELSE 'complete' END AS state FROM checked GROUP BY l_orderkey""",
)
def document_envelope(spark, sf_dir):
    """A document's rows as one nested record; its state follows from them."""
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "status")))
    docs = checked_lines(spark, sf_dir).groupBy("l_orderkey").agg(rows.alias("r"))
    text = F.array_join(F.transform("r", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["status"])), ",")
    return docs.select(
        "l_orderkey",
        F.size("r").cast("long").alias("lines"),
        F.md5(text.cast("binary")).alias("digest"),
        F.when(F.exists("r", lambda x: x["status"] != "ok"), "needs_review").otherwise("complete").alias("state"),
    )


@register(
    "prep_cards",
    "X15 P19 W10",
    f"""WITH {TEXT_LINES_SQL}, t AS (SELECT *, regexp_matches(line, '^[^.]{{3,59}}\\.?$') AS title, contains(lower(line), 'licen') AS stop FROM text_lines WHERE line <> ''),
    g AS (SELECT *, sum(title::INT) OVER w AS card FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
    s AS (SELECT *, bool_or(stop) OVER (PARTITION BY doc_id, card ORDER BY idx) AS stopped FROM g WHERE card > 0)
    SELECT doc_id, card::BIGINT AS card, count(CASE WHEN NOT title AND NOT stopped THEN 1 END) AS ingredients, max(CASE WHEN title THEN length(line) END)::BIGINT AS title_length FROM s GROUP BY doc_id, card""",
)
def prep_cards(spark, sf_dir):
    """A card is a title and the lines below it, until a line that stops it or the next title."""
    low, by_line = F.lower("line"), Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    flagged = text_lines(spark, sf_dir).filter("line <> ''").select("*", F.col("line").rlike(r"^[^.]{3,59}\.?$").alias("title"), low.contains("licen").alias("stop"))
    cards = flagged.withColumn("card", F.sum(F.col("title").cast("int")).over(by_line)).filter("card > 0")
    in_card = Window.partitionBy("doc_id", "card").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    stopped = cards.withColumn("stopped", F.bool_or("stop").over(in_card))
    return stopped.groupBy("doc_id", "card").agg(
        F.count_if(~F.col("title") & ~F.col("stopped")).alias("ingredients"),
        F.max(F.when(F.col("title"), F.length("line"))).cast("long").alias("title_length"),
    )


# Categories by keyword, in the order in which they are tried.
CATEGORIES = (("metal", "steel|brass|copper|nickel|tin"), ("coloured", "red|green|blue|yellow|pink|white|black"), ("large", "large|economy|jumbo"), ("other", "."))


@register(
    "category_and_yield",
    "A21 F39 F60",
    "WITH c AS (SELECT p_brand, p_size, p_partkey, CASE "
    + " ".join(f"WHEN regexp_matches(lower(p_type || ' ' || p_name), '{p}') THEN '{c}'" for c, p in CATEGORIES)
    + """ END AS category FROM part), s AS (SELECT p_brand, category, sum(CASE WHEN p_partkey % 3 = 0 THEN p_size * 1000.0 END) AS ml, sum(CASE WHEN p_partkey % 3 = 1 THEN p_size * 1.0 END) AS g FROM c GROUP BY ALL)
    SELECT p_brand, category, coalesce(ml, g)::DOUBLE AS yield, CASE WHEN ml IS NOT NULL THEN 'ml' WHEN g IS NOT NULL THEN 'g' END AS unit FROM s""",
)
def category_and_yield(spark, sf_dir):
    """Yield of a group from its lines: the sum of the volumes if there is any, else of the masses."""
    low, category = F.lower(F.concat_ws(" ", "p_type", "p_name")), F.lit(None).cast("string")
    for name, pattern in reversed(CATEGORIES):
        category = F.when(low.rlike(pattern), name).otherwise(category)
    unit = F.get(F.array(F.lit("l"), F.lit("g"), F.lit("each")), (F.col("p_partkey") % 3).cast("int"))
    base = units.to_base(F.col("p_size").cast("double"), unit)
    sums = table(spark, sf_dir, "part").groupBy("p_brand", category.alias("category")).agg(
        F.sum(F.when(units.base_unit(unit) == "ml", base)).alias("ml"), F.sum(F.when(units.base_unit(unit) == "g", base)).alias("g")
    )
    return sums.select(
        "p_brand", "category", F.coalesce("ml", "g").alias("yield"), F.when(F.col("ml").isNotNull(), "ml").when(F.col("g").isNotNull(), "g").alias("unit")
    )


@register(
    "column_numbers",
    "F52 J9 P25",
    """SELECT p_partkey, floor(p_retailprice * 100 + 0.5) / 100 AS price, p_size::DOUBLE AS size FROM part""",
)
def column_numbers(spark, sf_dir):
    """Columns read as text, with their header words and spaced thousands, joined again by position."""
    spaced = F.regexp_replace(F.format_string("%.2f", "p_retailprice"), r"(\d)(?=(\d{3})+\.)", "$1 ")
    text = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.lit("Unit Price\n"), spaced, F.lit("\n"), spaced).alias("a"), F.concat(F.lit("QTY\n"), F.col("p_size"), F.lit("\n7")).alias("b")
    )
    column = lambda c: F.transform(F.filter(F.split(c, "\n"), lambda x: x.rlike(r"^[\d ]")), lambda x: F.regexp_replace(x, " ", "").cast("double"))
    zipped = text.select("p_partkey", F.arrays_zip(column("a").alias("price"), column("b").alias("size"))[0].alias("z"))
    return zipped.select("p_partkey", "z.price", "z.size")


@register(
    "sales_import",
    "S12 F51 F64 P25",
    """SELECT p_name, count(*) AS rows, sum(p_size)::DOUBLE AS sold, count(CASE WHEN p_partkey % 11 = 0 THEN 1 END) AS bad FROM part WHERE p_partkey % 11 <> 0 OR true GROUP BY p_name HAVING count(CASE WHEN p_partkey % 11 <> 0 THEN 1 END) > 0""".replace(
        "sum(p_size)::DOUBLE", "sum(CASE WHEN p_partkey % 11 <> 0 THEN p_size END)::DOUBLE"
    ).replace("WHERE p_partkey % 11 <> 0 OR true ", ""),
)
def sales_import(spark, sf_dir):
    """Lines of a name and a last number; lines whose last word is no number are skipped and counted."""
    line = F.concat("p_name", F.lit("  "), F.when(F.col("p_partkey") % 11 == 0, "n/a").otherwise(F.col("p_size").cast("string")))
    parts = table(spark, sf_dir, "part").select(F.regexp_extract(line, r"^(.*\S)\s+(\S+)$", 1).alias("p_name"), F.regexp_extract(line, r"^(.*\S)\s+(\S+)$", 2).alias("q"))
    sold = F.when(F.col("q").rlike(r"^\d+([.,]\d+)?$"), F.col("q").try_cast("double"))
    return parts.groupBy("p_name").agg(
        F.count("*").alias("rows"), F.sum(sold).alias("sold"), F.count_if(sold.isNull()).alias("bad")
    ).filter("sold is not null")
