"""What a column's header names: one dictionary with forbidden terms and fallbacks, and three older vocabularies that disagree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions.keys import _bind

# Terms that name no column though they hold words of one.
FORBIDDEN = ("email", "account", "customer", "computer", "tender", "deposit", "terms", "phone", "invoice", "clerk", "banking", "currency", "rounding", "change")
# Whole headers by field. ``amount`` is listed for quantity and for total: the later one counts.
DICTIONARY = (
    ("description", ("description", "product", "item", "details", "productdescription", "name", "ingredient")),
    ("quantity", ("qty", "quantity", "shipquantity", "shipqty", "orderedqty", "orderqty", "amount", "count")),
    ("unit", ("unit", "uom", "pack", "purchaseunit", "measurement")),
    ("unit_price", ("price", "unitprice", "unitcost", "cost", "rate", "priceeach", "discounted price", "discountedprice")),
    ("total", ("amount", "total", "totai", "linetotal", "linetotai", "netamount", "nettamount", "netvalue", "nettvalue", "nettprice", "netprice", "nett", "net")),
    ("vat", ("vat", "tax", "vatamt", "vatamnt", "vatamount")),
    ("code", ("code", "itemcode", "stockcode", "productcode", "sku")),
)
# Parts of a header by field, the field that comes first wins; those of quantity must be whole words.
PARTS = (
    ("description", ("description", "product", "item", "details", "name")), ("quantity", ("qty", "quantity", "amount", "count")), ("unit", ("unit", "uom", "pack")),
    ("unit_price", ("price", "cost", "rate")), ("total", ("total", "net", "amount")), ("vat", ("vat", "tax")), ("code", ("code", "sku")),
)
WHOLE_WORDS, UNKNOWN = ("quantity",), "unknown"
# Columns that a row must name to be a header, by vocabulary.
REQUIRED = {
    "positions": ("quantity", "unit_price", "line_total"),
    "columns": ("supplier_code", "description", "quantity", "unit_price", "line_total"),
    "lines": ("supplier_code", "description", "quantity", "unit_price", "line_total"),
}


def normal_header(x: Column) -> Column:
    """Lower case, without a leading item, product or line, without a closing incl or excl, letters and digits only."""
    text = F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), r"^\s*(?:item|product|line)\s+", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\s+(?:incl|excl)\.?\s*$", ""), r"[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def field_type(headers: DataFrame, text: str, to: str = "field", more: DataFrame | None = None) -> DataFrame:
    """``headers`` with ``to``: the field that each header names, ``unknown`` for none and for forbidden terms.

    Whole headers are looked up in a table of terms, by an equi-join, so its size costs nothing a header; ``more`` (term, field)
    adds to it and wins over it. Of terms listed twice the last counts. Other headers are scanned once, all parts of all fields
    in one pattern that looks at every place, so that no part hides another that overlaps it. Rows repeat as given.
    """
    spark = headers.sparkSession
    own = {term: field for field, terms in DICTIONARY for term in terms} | dict.fromkeys(FORBIDDEN, UNKNOWN)
    terms = spark.createDataFrame([(t, f, 0) for t, f in own.items()], "_term string, _named string, _rank int")
    if more is not None:
        terms = terms.unionByName(more.select(F.col("term").alias("_term"), F.col("field").alias("_named"), F.lit(1).alias("_rank")))
        terms = terms.groupBy("_term").agg(F.max(F.struct("_rank", "_named"))["_named"].alias("_named"))
    else:
        terms = terms.drop("_rank")

    def found(x: Column) -> Column:
        parts = sorted({p for _, ps in PARTS for p in ps}, key=lambda p: (-len(p), p))
        seen = F.regexp_extract_all(x, F.lit(f"(?=({'|'.join(parts)}))"), F.lit(1))
        words = F.split(x, " ")

        def first(held: Column) -> Column:
            out = F.lit(UNKNOWN)
            for field, ps in reversed(PARTS):
                place = held["words"] if field in WHOLE_WORDS else held["seen"]
                out = F.when(F.arrays_overlap(place, F.array(*map(F.lit, ps))), field).otherwise(out)
            return out

        return _bind(F.struct(seen.alias("seen"), words.alias("words")), first)

    rows = headers.select(F.struct("*").alias("_row"), normal_header(F.col(text)).alias("_term"))
    return rows.join(terms, "_term", "left").select("_row.*", F.coalesce("_named", found(F.col("_term"))).alias(to))


def _key(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]", "")


def _chain(rules: Callable[[Column], list[tuple[Column, str]]]) -> Callable[[Column], Column]:
    def named(h: Column) -> Column:
        out = F.lit(None).cast("string")
        for condition, field in reversed(rules(h)):
            out = F.when(condition, field).otherwise(out)
        return out

    return lambda x: _bind(_key(x), named)


def _coded(h: Column) -> tuple[Column, str]:
    return h.isin("itemcode", "stockcode", "code") | (h.contains("item") & h.contains("code")), "supplier_code"


def _counted(h: Column) -> tuple[Column, str]:
    return h.contains("quantity") | h.isin("qty", "shipquantity", "shipqty"), "quantity"


def _priced(h: Column) -> Column:
    return h.contains("unitprice") | h.contains("unitcost")


def _totalled(h: Column) -> Column:
    return h.contains("linetotal") | h.contains("netvalue") | h.contains("netamount")


#: Each takes a header and gives the field that it names; null for none.
VOCABULARIES: dict[str, Callable[[Column], Column]] = {
    "positions": _chain(lambda h: [
        _coded(h), (h.contains("description"), "description"), _counted(h), (_priced(h), "unit_price"),
        (h.contains("vatamnt") | (h.startswith("vat") & ~h.contains("registration")), "vat"), (_totalled(h), "line_total"),
    ]),
    "columns": _chain(lambda h: [
        _coded(h), (h.contains("description") | h.isin("item", "product", "details"), "description"), _counted(h),
        (_priced(h) | h.isin("price", "unit"), "unit_price"), (h.contains("vat"), "vat"), (_totalled(h) | h.isin("total", "nettprice"), "line_total"),
    ]),
    "lines": _chain(lambda h: [_coded(h), (h.contains("description"), "description"), _counted(h), (_priced(h), "unit_price"), (_totalled(h), "line_total")]),
}


def column_map(cells: Column, vocabulary: str) -> Column:
    """Field to index of its cell, of cells that name the same field the last; null where a required field is missing."""
    named = F.transform(cells, lambda c, i: F.struct(VOCABULARIES[vocabulary](c).alias("key"), i.alias("value")))
    known = F.filter(named, lambda e: e["key"].isNotNull())
    last = lambda all_: F.filter(all_, lambda e: e["value"] == F.array_max(F.filter(all_, lambda o: o["key"] == e["key"])["value"]))
    required = F.array(*map(F.lit, REQUIRED[vocabulary]))
    return F.when(F.size(F.array_except(required, known["key"])) == 0, _bind(known, lambda k: F.map_from_entries(last(k))))


def first_lines(lines: DataFrame, page: str, index: str, text: str) -> DataFrame:
    """page, start: the line after the one by which every required field has been named; pages without them give no row.

    One least index a page and field is all that is shuffled.
    """
    named = lines.select(page, index, VOCABULARIES["lines"](F.col(text)).alias("field")).filter("field is not null")
    firsts = named.groupBy(page, "field").agg(F.min(index).alias("at"))
    return firsts.groupBy(page).agg(F.max("at").alias("at"), F.count("*").alias("n")).filter(F.col("n") == len(REQUIRED["lines"])).select(page, (F.col("at") + 1).alias("start"))
