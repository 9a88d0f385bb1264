"""Units of mass, volume and count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docledger.functions.text import bind

# Unit, dimension, factor to the base unit (g, ml, unit).
UNITS = (
    ("g", "mass", 1.0), ("gram", "mass", 1.0), ("grams", "mass", 1.0), ("kg", "mass", 1000.0),
    ("kilogram", "mass", 1000.0), ("kilograms", "mass", 1000.0),
    ("ml", "volume", 1.0), ("millilitre", "volume", 1.0), ("milliliter", "volume", 1.0), ("l", "volume", 1000.0),
    ("lt", "volume", 1000.0), ("liter", "volume", 1000.0), ("litre", "volume", 1000.0), ("tsp", "volume", 5.0),
    ("teaspoon", "volume", 5.0), ("tbsp", "volume", 15.0), ("tablespoon", "volume", 15.0), ("cup", "volume", 250.0),
    ("unit", "count", 1.0), ("piece", "count", 1.0), ("pieces", "count", 1.0), ("each", "count", 1.0),
)
BASE = {"mass": "g", "volume": "ml", "count": "unit"}
LARGE = {"g": "kg", "ml": "L"}


def _lookup(values: dict, key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key]


def canonical(unit: Column) -> Column:
    return F.lower(F.trim(unit))


def base_unit(unit: Column) -> Column:
    """Base unit of a unit's dimension; null if the unit is unknown."""
    return _lookup({u: BASE[d] for u, d, _ in UNITS}, canonical(unit))


def to_base(quantity: Column, unit: Column) -> Column:
    return quantity * _lookup({u: f for u, _, f in UNITS}, canonical(unit))


def convert(quantity: Column, from_unit: Column, to_unit: Column, strict: bool = False) -> Column:
    """Between units of one dimension; else null, or an error where ``strict``."""
    same = base_unit(from_unit) == base_unit(to_unit)
    wrong = F.raise_error(F.concat(F.lit("Cannot convert "), from_unit, F.lit(" to "), to_unit)).cast("double")
    return F.when(same, to_base(quantity, from_unit) / to_base(F.lit(1.0), to_unit)).otherwise(
        wrong if strict else F.lit(None).cast("double")
    )


def for_display(quantity: Column, base: Column) -> Column:
    """Quantity and unit to show: from 1,000 on in the larger unit."""
    large = (F.abs(quantity) >= 1000) & base.isin(*LARGE)
    return F.struct(
        F.when(large, quantity / 1000).otherwise(quantity).alias("quantity"),
        F.when(large, _lookup(LARGE, base)).otherwise(base).alias("unit"),
    )


# Spellings of the units of packs, the unit that they are bought in, and what makes one of those.
PACK_UNITS = {"litre": ("(?:ltr|lt|l|it)", "LTR", 1), "ml": ("ml", "LTR", 1000), "kg": ("kgs?", "KG", 1), "g": ("(?:g|gr|grams?)", "KG", 1000)}
# The order in which packs of several, then single packs, are tried.
PACK_ORDER, SINGLE_ORDER = ("litre", "ml", "kg", "g"), ("kg", "g", "litre", "ml")


def pack_measure(x: Column) -> Column:
    """qty and unit (KG or LTR) of the pack that a description names; null without one. Sizes such as 16/20 kg are grades."""
    text = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"\b\d+\s*/\s*\d+\s*kg\b", "")
    return bind(text, _measured)


def _measured(text: Column) -> Column:
    number = r"\b(\d+(?:[.,]\d+)?)\s*"
    value = lambda pattern, group: F.replace(F.regexp_extract(text, pattern, group), F.lit(","), F.lit(".")).cast("double")
    rules = []
    for name in PACK_ORDER:
        spelled, unit, each = PACK_UNITS[name]
        pattern = rf"{number}x\s*(\d+(?:[.,]\d+)?)\s*{spelled}\b"
        rules.append((text.rlike(pattern), value(pattern, 1) * value(pattern, 2) / each, unit))
    for name in SINGLE_ORDER:
        spelled, unit, each = PACK_UNITS[name]
        pattern = rf"{number}{spelled}\b"
        rules.append((text.rlike(pattern), value(pattern, 1) / each, unit))
    out = F.lit(None).cast("struct<qty:double,unit:string>")
    for hit, qty, unit in reversed(rules):
        out = F.when(hit, F.struct(qty.alias("qty"), F.lit(unit).alias("unit"))).otherwise(out)
    return F.when(text.rlike(r"\d\s*(?:x|kg|g|ml|l|it)"), out)  # few texts have a number before a measure or an x
