"""Numbers in money cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_money(x: Column) -> Column:
    """Value of a money cell: currency, letters r and spaces go, a comma is a point, only the last point counts.

    Blank and dash cells give null, as does anything without a number. ``1,234.56`` is 1234.56, but ``1,234`` is 1.234.
    """
    digits = F.translate(F.regexp_replace(x, "[^0-9.,-]+", ""), ",", ".")
    return _to_double(F.regexp_replace(digits, r"\.(?=.*\.)", ""))


def _to_double(digits: Column) -> Column:
    return F.when(digits.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), digits.try_cast("double"))


def parse_plain(x: Column) -> Column:
    """Value of a number with thousands commas: ``1,234`` is 1234."""
    return _to_double(F.regexp_replace(F.regexp_replace(F.trim(x), "^R", ""), r"[,\s]", ""))


def is_numeric_cell(x: Column) -> Column:
    return F.coalesce(x.rlike(r"(?i)^\s*(R|ZAR)?\s*-?\d[\d\s,]*(\.\d+)?\s*$"), F.lit(False)) & parse_money(x).isNotNull()


def format_number(x: Column) -> Column:
    """Whole numbers without decimals."""
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def unit_interval(x: Column) -> Column:
    """Clamped to [0, 1]; above 1 counts as a percentage."""
    return F.least(F.greatest(F.when(x > 1, x / 100).otherwise(x), F.lit(0.0)), F.lit(1.0))
