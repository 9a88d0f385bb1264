"""Invoice lines of plain text: those read from their right end, and those of a table without columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docledger.functions import names, units
from docledger.functions.text import bind, with_role
from docledger.functions.validate import cents, with_triples
from docledger.plans.catalog import register
from docledger.plans.tables import once, stored, table

#: Words of a line at least, and numbers at its end at least; with more numbers there is one between price and tax.
LEAST_WORDS, LEAST_NUMBERS = 6, 4
# Stock codes; words of units in names; roles that end a table; words of a line that ends it.
STOCK_CODE = r"\b0{5,}\d{3,}\b"
NAME_UNITS = (
    (r"\bPUNNET|PUN\b", "PUN"), (r"\b(KG|KGS|KILOGRAM|KILO)\b|\b\d+(?:[.,]\d+)?\s*KGS?\b", "KG"),
    (r"\b(ML|LTR|LT|LITRE|LITER)\b|\b\d+(?:[.,]\d+)?\s*(?:ML|LTR|LT|L|IT)\b", "LTR"), (r"\bPOCKET|PACK|PKT|BAG\b", "PKT"),
)
CLOSERS = ("subtotal", "vat", "payment", "footer", "banking")
STOP_WORDS = (
    r"subtotal|sub\s*total|total\s+(?:nett|net|incl|excl|due)|amount\s+excl|vat\s*$|tax\s*$|discount|rounding|banking details|terms|conditions|signature|signed|"
    r"received in good order|cash collected|created:|currency|page\s+\d+\s+of\s+\d+|number of items|extra charges|please note"
)
#: Points of a number but its last one.
MORE_POINTS = r"\.(?=[^\n]*\.)"
LINE_NUMBER = r"(?i)(?:R|ZAR)?\s*-?\d+(?:[ ,.]\d{3})*(?:[.,]\d+)?"


def round_to(x: Column, places: int) -> Column:
    return F.floor(x * 10**places + 0.5) / 10**places


def name_unit(name: Column) -> Column:
    def unit_of(text: Column) -> Column:
        out = F.lit("EACH")
        for pattern, unit in reversed(NAME_UNITS):
            out = F.when(text.rlike(pattern), unit).otherwise(out)
        return out

    return bind(F.upper(name), unit_of)


def tail_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    """The lines that end in numbers, with name, qty, unit, unit_price, vat and line_total; others give no row.

    The run of numbers at the end holds quantity, price, tax and total, or with five and more one other before the tax; what
    stands left of the run is the name. Quantity and price must compute to the total within 0.20 or 4 %, a total of zero
    excepted; a pack in the name multiplies the quantity and divides the price.
    """
    is_number = lambda t: t.rlike(r"^R?\d+(?:[.,]\d+)?$")
    step = lambda a, t: F.struct((a["n"] + (a["on"] & is_number(t)).cast("int")).alias("n"), (a["on"] & is_number(t)).alias("on"))
    run = F.aggregate(F.reverse("_words"), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), step)["n"]
    split = once(once(lines, _words=F.split(names.bare_text(F.col(text)), " ")).filter(F.size("_words") >= LEAST_WORDS), _run=run)
    split = split.filter(F.col("_run") >= LEAST_NUMBERS)
    more = (F.col("_run") > LEAST_NUMBERS).cast("int")
    value = lambda back: F.regexp_replace(F.regexp_replace(F.try_element_at("_words", -F.lit(back)), "^R", ""), ",", ".").try_cast("double")
    read = once(split, _q=value(4 + more), _p=value(3 + more), _v=value(2), _t=value(1))
    q, p, t = F.col("_q"), F.col("_p"), F.col("_t")
    computes = (t == 0) | (F.abs(cents(q * p) - t) <= F.greatest(F.lit(0.2), F.abs(t) * 0.04))
    sound = read.filter((q != 0) & (p != 0) & computes).withColumn("_raw", F.array_join(F.slice("_words", F.lit(1), F.size("_words") - F.col("_run")), " "))
    named = once(sound, name=names.item_name(F.col("_raw"))).filter("name <> ''")
    named = once(named, _pack=units.pack_measure(F.col("_raw")))
    size = F.coalesce("_pack.qty", F.lit(1.0))
    whole = named.withColumns(
        {
            "qty": F.when(F.col("_pack").isNull(), q).otherwise(round_to(q * size, 3)),
            "unit": F.coalesce("_pack.unit", name_unit(F.col("_raw"))),
            "unit_price": F.when(F.col("_pack").isNull() | (size == 0), p).otherwise(cents(p / size)),
            "vat": cents(F.col("_v")),
            "line_total": cents(F.when(t == 0, q * p).otherwise(t)),
        }
    )
    return whole.drop("_words", "_run", "_q", "_p", "_v", "_t", "_raw", "_pack")


def stock_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    """The lines that hold a stock code and read from their right end."""
    return tail_lines(lines.filter(F.col(text).rlike(STOCK_CODE)), text)


def line_numbers(text: Column) -> Column:
    """Values of the numbers of a cleaned line, as parse_money reads each; all are read in one text, a line for each."""
    digits = F.regexp_replace(_numbers_listed(text), MORE_POINTS, "")
    return F.when(digits == "", F.array().cast("array<double>")).otherwise(F.split(digits, "\n").cast("array<double>"))


def _numbers_listed(text: Column) -> Column:
    found = F.array_join(F.regexp_extract_all(text, F.lit(LINE_NUMBER), F.lit(0)), "\n")
    return F.translate(F.regexp_replace(found, r"[^0-9.,\n-]+", ""), ",", ".")


def with_numbers(rows: DataFrame, wanted: Column, text: str = "text", to: str = "values") -> DataFrame:
    """``rows`` with line_numbers of a text, each step computed once a row; null where they are not ``wanted``."""
    step = once(rows, _found=F.when(wanted, _numbers_listed(F.col(text))))
    # most numbers have one point at most
    step = once(step, _digits=F.when(F.col("_found").rlike(r"\.[^\n]*\."), F.regexp_replace("_found", MORE_POINTS, "")).otherwise(F.col("_found")))
    values = F.when(F.col("_digits") == "", F.array().cast("array<double>")).otherwise(F.split("_digits", "\n").cast("array<double>"))
    return once(step, **{to: values}).drop("_found", "_digits")


def best_roles(values: Column) -> Column:
    """q, p and t: places of the numbers whose product computes best; null where none does, within 0.05 or 2 %.

    Of all triples the one with the least difference wins, where each pair out of order counts 2, then the first. Triples
    are looked at one after the other, never listed.
    """
    kind = "struct<score:double,q:int,p:int,t:int>"
    places = F.sequence(F.lit(0), F.size(values) - 1)
    v = lambda i: F.get(values, i)

    def triple(best: Column, q: Column, p: Column, t: Column) -> Column:
        off = F.abs(cents(v(t) - cents(v(q) * v(p))))
        apart = (q != p) & (p != t) & (q != t) & (v(q) > 0) & (v(p) > 0) & (v(t) > 0)
        score = off + 2.0 * ((q > p).cast("int") + (p > t).cast("int"))
        found = F.struct(score.alias("score"), q.alias("q"), p.alias("p"), t.alias("t"))
        return F.when(apart & (off <= F.greatest(F.lit(0.05), v(t) * 0.02)), F.least(best, found)).otherwise(best)

    none = F.lit(None).cast(kind)
    search = F.aggregate(places, none, lambda a, q: F.aggregate(places, a, lambda b, p: F.aggregate(places, b, lambda c, t: triple(c, q, p, t))))
    return F.when(F.size(values) >= 3, search)


def plain_rows(lines: DataFrame) -> DataFrame:
    """page, idx, status, description, quantity, unit_price, total of the lines of tables without columns.

    lines: page, idx, line. The first header or line item of a page opens its table; a line that closes one, or a line item
    with closing words, ends it, and no line below is looked at. status is parsed, or why a line was left out: its role, empty,
    before_table, footer, or not_enough_line_values where description or computing numbers are missing. A header that opens
    the table is no row. An r right before a number counts as its currency, even where it ends the description. Where a table opens and ends are minima by page: no page is sorted.
    """
    told = with_role(lines, F.col("line")).select("page", "idx", "text", "role")
    told = stored(told.withColumn("stop", (F.col("role") == "line_item") & F.lower("text").rlike(STOP_WORDS)), "line-roles")
    opens = told.filter(F.col("role").isin("header", "line_item")).groupBy("page").agg(F.min("idx").alias("open"))
    ends = told.filter(F.col("role").isin(*CLOSERS) | F.col("stop")).join(opens, "page").filter(F.col("idx") >= F.col("open"))
    closes = ends.groupBy("page").agg(F.min("idx").alias("close"))
    seen = told.join(opens, "page", "left").join(closes, "page", "left").filter("close is null or idx <= close")
    before = F.col("open").isNull() | (F.col("idx") < F.col("open"))
    read = seen.filter(~(F.col("role") == "header") | ~(F.col("idx") == F.coalesce("open", F.lit(-1))))
    read = with_numbers(read, (F.col("role") == "line_item") & ~F.col("stop"))
    # three numbers, as most lines have, in compiled code
    three = with_triples(read, [F.when(F.size("values") == 3, F.get("values", F.lit(i))) for i in range(3)], "_three")
    best = F.when(F.size("values") == 3, F.col("_three")).otherwise(best_roles(F.col("values")))
    rows = once(three, r=best)
    told_of = F.regexp_replace(F.regexp_extract("text", r"(?i)^(.*?)(?:R|ZAR)?\s*-?\d", 1), "^[ ,-]+|[ ,-]+$", "")
    rows = once(rows, description=F.when(F.col("r").isNotNull(), told_of))
    status = (
        F.when(F.col("text") == "", "empty")
        .when(before & (F.col("role") == "noise"), "before_table")
        .when(F.col("stop"), "footer")
        .when(F.col("role") != "line_item", F.col("role"))
        .when(F.col("r").isNotNull() & (F.col("description") != ""), "parsed")
        .otherwise("not_enough_line_values")
    )
    out = once(rows, status=status)
    value = lambda role: F.when(F.col("status") == "parsed", F.get("values", F.col(f"r.{role}")))
    return out.select(
        "page", "idx", "status", F.when(F.col("status") == "parsed", F.col("description")).alias("description"), value("q").alias("quantity"), value("p").alias("unit_price"), value("t").alias("total")
    )


_AT = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


def _ordered_lines(spark, sf_dir) -> DataFrame:
    """The orders' lines with their number, part, and prices in cents as they are printed; dear totals are doubled."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    order = Window.partitionBy("l_orderkey").orderBy(*_AT.split(", "))
    lines = table(spark, sf_dir, "lineitem").join(part, "l_partkey").withColumn("k", F.row_number().over(order).cast("long"))
    price, total = cents(F.col("l_extendedprice") / F.col("l_quantity")), F.when(F.col("l_discount") > 0.08, F.col("l_extendedprice") * 2).otherwise(F.col("l_extendedprice"))
    return lines.withColumns({"q": F.col("l_quantity").cast("long"), "p": price.cast("decimal(18,2)"), "t": total.cast("decimal(18,2)")})


_ORDERED_SQL = f"""ordered AS (SELECT l_orderkey, l_partkey, l_discount, l_tax, p_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_AT}) AS k, l_quantity::BIGINT AS q,
    floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS p, CASE WHEN l_discount > 0.08 THEN l_extendedprice * 2 ELSE l_extendedprice END AS t FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def order_pages(lines: DataFrame) -> DataFrame:
    """page, idx, line: each order's lines as they are printed, with what stands around them; its first line brings that along."""
    short, good = F.col("l_tax") > 0.06, F.concat_ws(" ", "p_name", "q", F.concat(F.lit("R"), "p"), F.concat(F.lit("R"), "t"))
    line = F.when(short, F.concat_ws(" ", "p_name", "q", F.concat(F.lit("R"), "p"))).otherwise(good)
    last = F.max("k").over(Window.partitionBy("l_orderkey"))
    lines = lines.select(F.col("l_orderkey").alias("page"), "k", line.alias("line"), last.alias("last"))
    at = lambda idx, text: F.struct(idx.cast("long").alias("idx"), text.alias("line"))
    header = F.when(F.col("page") % 2 == 0, "Description, Qty, Unit Price, Total").otherwise("")
    own = at(F.col("k") * 10, F.col("line"))
    around = F.array(
        own, at(F.lit(0), F.lit("Invoice from the market")), at(F.lit(1), F.lit(" ")), at(F.lit(2), header), at(F.col("last") * 10 + 10, F.lit("Sub Total 100")), at(F.col("last") * 10 + 11, F.lit("Left over 5"))
    )
    printed = lines.select("page", F.inline(F.when(F.col("k") == 1, around).otherwise(F.array(own))))
    return printed.filter("idx <> 2 or line <> ''")


@register(
    "tail_number_lines",
    "F54 X22",
    f"""WITH {_ORDERED_SQL} SELECT l_orderkey, k, p_name AS name, CASE WHEN l_partkey % 3 = 0 THEN q * 6 ELSE q END::DOUBLE AS qty, CASE l_partkey % 3 WHEN 0 THEN 'LTR' WHEN 1 THEN 'KG' ELSE 'EACH' END AS unit,
      CASE WHEN l_partkey % 3 = 0 THEN floor(p / 6 * 100 + 0.5) / 100 ELSE p END AS unit_price, 1.5::DOUBLE AS vat, floor(t * 100 + 0.5) / 100 AS line_total FROM ordered WHERE l_partkey % 5 < 4 AND l_discount <= 0.08""",
)
def tail_number_lines(spark, sf_dir):
    """Order lines printed with a stock code, a pack, four or five numbers at the end; the SQL holds what they were printed from.

    A fifth of the lines have no code, and some totals do not compute: neither gives a row.
    """
    lines = _ordered_lines(spark, sf_dir)
    code = F.when(F.col("l_partkey") % 5 < 4, F.format_string("00000%04d", F.col("l_partkey"))).otherwise("ref")
    pack = F.when(F.col("l_partkey") % 3 == 0, "6 x 1 L").when(F.col("l_partkey") % 3 == 1, "kg").otherwise("each")
    extra = F.when(F.col("k") % 2 == 0, F.lit("7.25"))
    text = F.concat_ws(" ", code, "p_name", pack, "q", F.concat(F.lit("R"), "p"), extra, F.lit("1,5"), "t")
    found = stock_lines(lines.select("l_orderkey", "k", text.alias("text")))
    return found.drop("text")


@register(
    "plain_table_rows",
    "X4",
    f"""WITH {_ORDERED_SQL}, ends AS (SELECT l_orderkey, max(k) AS k FROM ordered GROUP BY l_orderkey),
    printed AS (SELECT l_orderkey AS page, k * 10 AS idx, CASE WHEN l_tax > 0.06 THEN 'short' WHEN l_discount > 0.08 THEN 'off' ELSE 'good' END AS kind, p_name, q, p, t FROM ordered),
    firsts AS (SELECT page, min(CASE WHEN page % 2 = 0 THEN 2 WHEN kind <> 'short' THEN idx END) AS open FROM printed GROUP BY page)
    SELECT l_orderkey AS page, 0 AS idx, 'footer' AS status, NULL AS description, NULL::DOUBLE AS quantity, NULL::DOUBLE AS unit_price, NULL::DOUBLE AS total FROM ends
    UNION ALL SELECT l_orderkey, 1, 'empty', NULL, NULL, NULL, NULL FROM ends
    UNION ALL SELECT p.page, idx, CASE kind WHEN 'good' THEN 'parsed' WHEN 'off' THEN 'not_enough_line_values' ELSE CASE WHEN open IS NULL OR idx < open THEN 'before_table' ELSE 'noise' END END,
      CASE WHEN kind = 'good' THEN regexp_replace(p_name, 'r$', '') END, CASE WHEN kind = 'good' THEN q END, CASE WHEN kind = 'good' THEN p END, CASE WHEN kind = 'good' THEN t END FROM printed p JOIN firsts USING (page)
    UNION ALL SELECT l_orderkey, k * 10 + 10, 'subtotal', NULL, NULL, NULL, NULL FROM ends
    UNION ALL SELECT l_orderkey, k * 10 + 11, 'before_table', NULL, NULL, NULL, NULL FROM ends JOIN firsts ON l_orderkey = page WHERE open IS NULL""",
)
def plain_table_rows(spark, sf_dir):
    """Orders printed as plain lines: a contact, a blank, on even ones a header, the lines, a subtotal, and a line below it."""
    return plain_rows(order_pages(_ordered_lines(spark, sf_dir))).withColumn("idx", F.col("idx").cast("int"))
