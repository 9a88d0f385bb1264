"""Names, units, codes and packs in the descriptions of invoice lines. Null counts as an empty text throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docledger.functions.text import clean_cell

# Words that name how an item is bought, and how some of them are shown.
LINE_UNITS = ("each", "ea", "kg", "g", "ml", "l", "lt", "ltr", "box", "bag", "punnet", "pun", "bunch", "head", "tray", "tub", "tin", "pkt", "pack")
SHOWN_UNITS = {"ea": "Each", "lt": "L", "ltr": "L", "l": "L", "pun": "Punnet", "pkt": "Packet", "kg": "KG", "g": "G", "ml": "ML"}
MEASURES = ("kg", "g", "ml", "l", "lt", "ltr")
# Words that are no part of an ingredient's name, and prefixes of supplier codes.
NOT_NAMES = ("kg", "each", "ea", "punnet", "pun", "bag", "box", "pocket", "large", "medium", "small", "head", "heads")
CODE_PREFIXES = ("who", "stk", "stock", "item")
# Units of packs, as an item's name and as a description write them, and other forms of the latter.
NAME_PACK_UNITS = ("kg", "kgs", "g", "gr", "gram", "grams", "ml", "ltr", "lt", "l", "it")
PACK_UNITS = (
    "kg", "g", "l", "ml", "each", "ea", "unit", "box", "case", "bag", "pack", "packet", "pkt", "punnet", "tray", "bottle", "tin", "can",
    "carton", "bunch", "roll",
)
UNIT_FORMS = {"each": "ea", "unit": "ea", "units": "ea", "boxes": "box", "bunches": "bunch"}
PLURAL_UNITS = ("bottle", "can", "tin", "bag", "case", "pack", "packet", "pkt", "punnet", "tray", "carton", "roll")
# Forms of supplier codes, the surest first.
SUPPLIER_CODES = (r"\b([A-Z]{2,3}\d{3,5})\b", r"\b(\d{4,6})\b", r"\b([A-Z]\d{3,5})\b")

_I, _N = "(?iU)", r"\d+(?:[.,]\d+)?"
_POINT = r"\d+(?:\.\d+)?"


def _either(words) -> str:
    return "(?:" + "|".join(words) + ")"


def _drop(x: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(x, pattern, by)


def _first(x: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))


def bare_text(x: Column) -> Column:
    """Single spaces, no bars."""
    return clean_cell(F.replace(F.coalesce(x, F.lit("")), F.lit("|"), F.lit(" ")))


def capitals(x: Column) -> Column:
    """The first letter of each run of letters upper, the others lower: ``o'brien 1kg`` is ``O'Brien 1Kg``."""
    runs = F.regexp_extract_all(x, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(r.substr(1, 1)), F.lower(r.substr(F.lit(2), F.length(r))))), "")


def ingredient_name(code: Column, description: Column) -> Column:
    """The supplier's code without its prefix, or else the description, without units and sizes; null where both are empty."""
    told = clean_cell(description)
    of_code = F.trim(_drop(clean_cell(code), rf"{_I}^\s*{_either(CODE_PREFIXES)}\s*[-:]\s*"))
    text = _drop(F.when(of_code == "", told).otherwise(of_code), rf"{_I}\b{_either(NOT_NAMES)}\b", " ")
    text = _drop(_drop(text, r"\s+", " "), "^[ -]+|[ -]+$")
    return F.nullif(capitals(F.when(text == "", told).otherwise(text)), F.lit(""))


def item_name(x: Column) -> Column:
    """A description without its leading code, counts per weight, packs and units."""
    units = _either(NAME_PACK_UNITS)
    text = _drop(bare_text(x), rf"{_I}\b\d+\s*/\s*\d+\s*kgs?\b")
    text = _drop(text, rf"{_I}^(?:\d{{3,}}|[A-Z]{{1,6}}\d[A-Z0-9]*|CBMBC|SAL)\s+")
    for amount in (rf"{_N}\s*x\s*{_N}", _N):
        text = _drop(text, rf"{_I}\(?\b{amount}\s*{units}\b\)?")
    return bare_text(_drop(text, rf"{_I}\b(?:kg|each)\b"))


def purchase_unit(x: Column) -> Column:
    """The description itself; a measure alone is written in capitals; null where empty."""
    text = clean_cell(x)
    return F.nullif(F.when(F.lower(text).isin(*MEASURES), F.upper(text)).otherwise(text), F.lit(""))


def line_unit(x: Column) -> Column:
    """The first word that names a unit, as it is shown; empty for none."""
    unit = F.lower(F.regexp_extract(clean_cell(x), rf"{_I}\b({'|'.join(LINE_UNITS)})\b", 1))
    return F.coalesce(F.create_map(*(F.lit(v) for kv in SHOWN_UNITS.items() for v in kv))[unit], F.initcap(unit))


def any_number(x: Column) -> Column:
    """The first number in a text, with a point or a comma; an R before it does not part it from its sign."""
    text = bare_text(x)
    worded = (text == "") | F.replace(text, F.lit("R"), F.lit("")).rlike("[A-Za-z]")
    text = F.when(worded, _drop(text, r"(?i)R\s*")).otherwise(text)
    return F.replace(_first(text, rf"-?{_N}", 0), F.lit(","), F.lit(".")).try_cast("double")


def money_number(x: Column) -> Column:
    """The first number that follows an R; null without one."""
    return any_number(_first(bare_text(x), rf"(?i)R\s*({_N})"))


def normal_description(x: Column) -> Column:
    """Other punctuation as spaces, single spaces, one space after points, none around round brackets."""
    text = _drop(F.trim(F.coalesce(x, F.lit(""))), r"(?U)[^\w\s\-./()\[\]{}]+", " ")
    text = _drop(_drop(text, r"(?U)\s+", " "), r"\s*([.,;:])\s*", "$1 ")
    return _drop(text, r"\s*([()])\s*", "$1")


def supplier_code(x: Column) -> Column:
    """What the first form of code that a description meets finds; null for none."""
    return F.coalesce(*(_first(x, form) for form in SUPPLIER_CODES))


def without(x: Column, part: Column) -> Column:
    """A text without the first occurrence of ``part``."""
    at = F.instr(x, part)
    return F.when(at == 0, x).otherwise(F.concat(x.substr(F.lit(1), at - 1), x.substr(at + F.length(part), F.length(x))))


def without_code(x: Column) -> Column:
    """The description without the first occurrence of its code."""
    code = supplier_code(x)
    return F.when(code.isNull(), x).otherwise(without(x, code))


def is_unit(x: Column) -> Column:
    return F.lower(x).isin(*PACK_UNITS)


def pack(x: Column) -> Column:
    """Count, size and unit of a pack: ``10 x 1 kg``, else a number and a word, which is its unit or else follows later.

    A number whose word is no unit is a count; a size without a count has the count one, unless it is zero. Without a number and a word,
    all are null.
    """
    many, one = rf"{_I}({_POINT})\s*[x\u00d7]\s*({_POINT})\s*(\w+)", rf"{_I}({_POINT})\s*(\w+)"
    unit_word = _first(x, one, 2)
    later = _first(x, rf"{_I}{_POINT}\s*\w+.*?\b({'|'.join(PACK_UNITS)})\b")
    several, sized = x.rlike(many), is_unit(unit_word)
    count = F.when(several, _first(x, many, 1)).when(sized, F.when(_first(x, one, 1).cast("double") != 0, "1")).otherwise(_first(x, one, 1))
    size = F.when(several, _first(x, many, 2)).when(sized, _first(x, one, 1))
    raw = F.when(several, _first(x, many, 3)).when(sized, unit_word).otherwise(later)
    low = F.lower(raw)
    singular = F.when(low.isin(*(f"{u}s" for u in PLURAL_UNITS)), F.regexp_replace(low, "s$", "")).otherwise(low)
    known = F.coalesce(F.create_map(*(F.lit(v) for kv in UNIT_FORMS.items() for v in kv))[low], singular)
    unit = F.when(is_unit(known), known).otherwise(raw)
    return F.struct(count.cast("double").alias("count"), size.cast("double").alias("size"), unit.alias("unit"))


def without_pack(x: Column) -> Column:
    """The description without dimensions, measures, counts and other numbers."""
    text = _drop(x, rf"\b{_POINT}\s*[xX]\s*{_POINT}(?:\s*[xX]\s*{_POINT})?\b", " ")
    text = _drop(text, rf"{_I}\b{_POINT}\s*(?:kg|g|l|ml|lb|mc|mic)\b", " ")
    text = _drop(_drop(text, r"(?i)\(\s*\d+\s*'?\s*s\s*\)", " "), rf"{_I}\b\d+\s*'?\s*s\b", " ")
    return clean_cell(_drop(text, rf"\b{_POINT}\b", " "))
