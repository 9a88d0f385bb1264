"""Cells, headers and row roles as expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.plans.tables import once


def clean_cell(x: Column) -> Column:
    # single spaces stay as they are, so that most texts are not rewritten
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s{2,}|[^\S ]", " "))


def normalize_header(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")


def normalize_key(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " "))


def composite_key(*parts: Column) -> Column:
    return F.concat_ws("|", *(normalize_key(p) for p in parts))


def title_case(x: Column) -> Column:
    return F.initcap(x)


def safe_name(x: Column, longest: int = 120) -> Column:
    return F.substring(F.regexp_replace(x, r"[^A-Za-z0-9._-]+", "_"), 1, longest)


# Normalised headers by field.
DESCRIPTIONS = ("description", "product", "item", "details", "productdescription")
QUANTITIES = ("qty", "quantity", "shipquantity", "shipqty", "orderedqty", "orderqty")
UNITS = ("unit", "uom", "pack", "purchaseunit")
UNIT_PRICES = ("price", "unitprice", "unitcost")
TOTALS = (
    "amount", "total", "linetotal", "netamount", "nettamount", "netvalue", "nettvalue", "nettprice", "netprice", "nett", "net",
)
TOTAL_PARTS = ("linetotal", "netamount", "nettamount", "netvalue", "nettvalue", "nettprice", "netprice")
TAXES = ("vat", "tax", "vatamt", "vatamnt", "vatamount")
CODES = ("code", "itemcode", "stockcode", "productcode", "sku")
#: Longest normalised header that is a code by holding that word.
LONGEST_CODE = 16

# Words of rows that are no line items, by role.
BANKING = ("bank", "banking", "branch", "account", "acc *no", "swift", "iban", "payment")
CLOSING = ("cash collected", "signed by", "signature", "customer signature", "received in good order", "terms", "conditions", "please note", "claims", "returned goods")
PAYMENT = ("discount", "rounding", "currency", "currencyrate", "number of items", "extra charges")
SUBTOTAL = ("subtotal", "sub total", "total nett", "total net", "total incl", "total excl", "amount excl", "amount incl", "grand total")
TAX = ("vat", "tax")
TAX_AMOUNT = ("vatamt", "vatamnt", "vat amount")
CONTACT = (
    "page +[0-9]+ +of +[0-9]+", "invoice from", "invoice to", "deliver to", "sold to", "customer vat", "telephone", "email", "fax",
    "document no", "invoice number", "invoice date", "order number", "representative",
)
#: Digits that a row of tax has at most.
TAX_DIGITS = 8
NUMBER = r"-?[0-9]+([ ,.][0-9]{3})*([.,][0-9]+)?"


def bounded(*terms: str) -> str:
    """Any of the terms as whole words; explicit classes, so that every engine agrees beside letters with accents."""
    return f"(^|[^a-z0-9_])({'|'.join(terms)})([^a-z0-9_]|$)"


def met(*terms: str, whole: bool = True) -> str:
    """The same for Spark, without groups and by first letters: looked for only where a word begins. Not whole: terms may go on."""
    by_letter: dict[str, list[str]] = {}
    for t in terms:
        by_letter.setdefault(t[0] if t[0].isalpha() else t, []).append(t)
    parts = (f"{k}(?:{'|'.join(t[1:] for t in own)})" if k.isalpha() and len(k) == 1 else "|".join(own) for k, own in by_letter.items())
    return f"(?<![a-z0-9_])(?:{'|'.join(parts)})" + ("(?![a-z0-9_])" if whole else "")


def bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, where x is computed once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def header_key(x: Column) -> Column:
    """Field that a header names: the first whose words it is or holds; null for none."""

    def key(h: Column) -> Column:
        has = lambda *parts: reduce(and_, (h.contains(p) for p in parts))
        total = h.isin(*TOTALS) | reduce(or_, (h.contains(p) for p in TOTAL_PARTS)) | has("net", "price")
        return (
            F.when(h.isin(*DESCRIPTIONS) | has("description"), "description")
            .when(h.isin(*QUANTITIES) | has("quantity"), "quantity")
            .when(h.isin(*UNITS), "unit")
            .when(h.isin(*UNIT_PRICES) | has("unit", "price"), "unit_price")
            .when(total | (has("amount") & (has("excl") | has("incl"))), "total")
            .when(h.isin(*TAXES) | h.startswith("vat"), "vat")
            .when(h.isin(*CODES) | (has("code") & (F.length(h) <= LONGEST_CODE)), "code")
        )

    return bind(normalize_header(F.coalesce(x, F.lit(""))), key)


def number_count(x: Column) -> Column:
    return F.regexp_count(x, F.lit(NUMBER))


def has_numbers(x: Column, n: int) -> Column:
    """number_count(x) >= n, without a list of them: each number is as long as it can be."""
    return x.rlike(f"^(?:[^0-9]*+[0-9]++(?:[ ,.][0-9]{{3}})*+(?:[.,][0-9]++)?+){{{n}}}")


def _names_columns(text: Column) -> Column:
    """Cells between bars or commas name three fields, as header_key names them; looked for in the row, without a list of cells."""
    return text.rlike("[|,].*[|,]") & bind(_bare(F.lower(text)), lambda bare: may_name_three(bare) & (_fields_named(bare) >= 3))


def _bare(low: Column) -> Column:
    return F.regexp_replace(low, "[^a-z0-9|,]+", "")


def _fields_named(bare: Column) -> Column:
    return reduce(add, (bare.rlike(p).cast("int") for p in cell_patterns()))


def cell_patterns() -> list[str]:
    """For each field, what finds a cell that header_key gives it, in a row of normalised cells between bars or commas."""
    cell = "[^|,]*+"
    has = lambda *parts: "".join(f"(?=[^|,]*?{p})" for p in parts) + cell
    rules = (
        (*DESCRIPTIONS, has("description")),
        (*QUANTITIES, has("quantity")),
        UNITS,
        (*UNIT_PRICES, has("unit", "price")),
        (*TOTALS, *map(has, TOTAL_PARTS), has("net", "price"), has("amount", "excl"), has("amount", "incl")),
        (*TAXES, f"vat{cell}"),
        (*CODES, f"(?=[^|,]{{0,{LONGEST_CODE}}}(?![^|,])){has('code')}"),
    )
    whole = [f"(?:{'|'.join(rule)})(?![^|,])" for rule in rules]
    return [f"(?<![^|,])(?!{'|'.join(whole[:i])}){p}" if i else f"(?<![^|,]){p}" for i, p in enumerate(whole)]


def may_name_three(bare: Column) -> Column:
    """Three cells that name fields hold three of these between them; few other rows need their cells looked at."""
    parts = "d(?:escription|etails)|p(?:roduct|ack|rice)|item|q(?:ty|uantity)|u(?:nit|om)|amount|t(?:otal|ax)|net|vat|code|sku"
    return bare.rlike(f"(?:{parts}).*?(?:{parts}).*?(?:{parts})")


def _any_term(low: Column) -> Column:
    return low.rlike(met(*BANKING, *CLOSING, *PAYMENT, *SUBTOTAL, "total", *TAX, *CONTACT, whole=False))


def _closing_role(low: Column) -> Column:
    """The first roles that words of a row in lower case give; null for none."""
    return F.when(low.rlike(met(*BANKING)), "banking").when(low.rlike(met(*CLOSING)), "footer").when(low.rlike(met(*PAYMENT)), "payment")


def _amount_role(text: Column, low: Column) -> Column:
    """The roles after these."""
    tax = low.rlike(met(*TAX)) & (F.regexp_count(text, F.lit("[0-9]")) <= TAX_DIGITS) & ~low.rlike(met(*TAX_AMOUNT))
    subtotal = low.rlike(met(*SUBTOTAL)) | low.rlike("^total([^a-z0-9_]|$)")
    return F.when(subtotal, "subtotal").when(tax, "vat").when(low.rlike(met(*CONTACT)), "footer")


def _plain_role(text: Column, low: Column) -> Column:
    return F.when(has_numbers(text, 3) & text.rlike("[A-Za-z]{2,}") & low.rlike("[^0-9 .,rza-]"), "line_item").otherwise("noise")


def _role(text: Column, low: Column) -> Column:
    """Role of a cleaned row of text, and of the same in lower case."""
    by_words = F.when(_any_term(low), F.coalesce(_closing_role(low), _amount_role(text, low)))
    return F.when(text == "", "empty").when(_names_columns(text), "header").otherwise(F.coalesce(by_words, _plain_role(text, low)))


def row_role(x: Column) -> Column:
    """Role of a row of text: a header, else the first vocabulary that it meets, else a line item with three numbers and a word."""
    return bind(clean_cell(x), lambda text: bind(F.lower(text), lambda low: _role(text, low)))


def with_role(rows: DataFrame, x: Column, text: str = "text", role: str = "role") -> DataFrame:
    """``rows`` with the cleaned row ``x`` and its row_role, in compiled code, which lambdas are not.

    In steps that are short enough for the JVM to compile; each is null where an earlier one has decided.
    """
    name, text, low, known = text, F.col(text), F.col("_low"), F.col("_known")
    step = once(once(rows, **{name: clean_cell(x)}), _low=F.lower(text))
    step = once(step, _bare=F.when(text.rlike("[|,].*[|,]"), _bare(low)))
    header = F.when(may_name_three(F.col("_bare")), _fields_named(F.col("_bare")) >= 3)
    step = once(step, _known=F.when(text == "", "empty").when(header, "header"))
    step = once(step, _met=F.when(known.isNull(), _any_term(low)))
    step = once(step, _closing=F.when(F.col("_met"), _closing_role(low)))
    step = once(step, _amount=F.when(F.col("_met") & F.col("_closing").isNull(), _amount_role(text, low)))
    step = once(step, **{role: F.coalesce("_known", "_closing", "_amount", _plain_role(text, low))})
    return step.drop("_low", "_bare", "_known", "_met", "_closing", "_amount")


def sql_header_key(x: str) -> str:
    """The same for DuckDB, over patterns."""
    h = f"regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"
    rules = (
        ("description", f"^({'|'.join(DESCRIPTIONS)})$|description"),
        ("quantity", f"^({'|'.join(QUANTITIES)})$|quantity"),
        ("unit", f"^({'|'.join(UNITS)})$"),
        ("unit_price", f"^({'|'.join(UNIT_PRICES)})$|unit.*price|price.*unit"),
        ("total", f"^({'|'.join(TOTALS)})$|{'|'.join(TOTAL_PARTS)}|net.*price|price.*net|amount.*(excl|incl)|(excl|incl).*amount"),
        ("vat", f"^({'|'.join(TAXES)})$|^vat"),
        ("code", "^sku$|^.{0,12}code.{0,12}$"),
    )
    out = "".join(f" WHEN regexp_matches({h}, '{p}'){f' AND length({h}) <= 16' if f == 'code' else ''} THEN '{f}'" for f, p in rules)
    return f"CASE{out} END"


def sql_row_role(x: str) -> str:
    """The same for DuckDB; x is a cleaned row."""
    low = f"lower({x})"
    meets = lambda *terms: f"regexp_matches({low}, '{bounded(*terms)}')"
    found = f"list_transform(string_split(replace({x}, '|', ','), ','), lambda c: {sql_header_key('c')})"
    line = " AND ".join(f"list_contains({found}, '{k}')" for k in ("description", "quantity"))
    header = (
        f"regexp_matches({x}, '[|,]') AND (len(list_distinct({found})) >= 3 OR ({line} AND "
        f"(list_contains({found}, 'unit_price') OR list_contains({found}, 'total'))))"
    )
    return f"""CASE WHEN {x} = '' THEN 'empty' WHEN {header} THEN 'header' WHEN {meets(*BANKING)} THEN 'banking' WHEN {meets(*CLOSING)} THEN 'footer'
      WHEN {meets(*PAYMENT)} THEN 'payment' WHEN {meets(*SUBTOTAL, '^total')} OR regexp_matches({low}, '^total([^a-z0-9_]|$)') THEN 'subtotal'
      WHEN {meets(*TAX)} AND len(regexp_extract_all({x}, '[0-9]')) <= 8 AND NOT {meets(*TAX_AMOUNT)} THEN 'vat' WHEN {meets(*CONTACT)} THEN 'footer'
      WHEN len(regexp_extract_all({x}, '{NUMBER}')) >= 3 AND regexp_matches({x}, '[A-Za-z]{{2,}}') AND regexp_matches({low}, '[^0-9 .,rza-]') THEN 'line_item'
      ELSE 'noise' END"""
