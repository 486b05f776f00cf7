"""Numeric columns: null-safe ratios, banker's rounding, decimal parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# plain digits or scientific notation, optional sign and surrounding blanks
NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or either side is null."""
    return F.try_divide(a, b)


def half_even(c: Column, places: int, precision: int = 18) -> Column:
    """Round half to even at ``places`` and fix the decimal type."""
    return F.bround(c, places).cast(f"decimal({precision},{places})")


def parse_decimal(c: Column, precision: int = 24, scale: int = 6) -> Column:
    """Text to decimal; null where the text is not a number."""
    return F.when(c.cast("string").rlike(NUMBER), c.cast("string").try_cast(f"decimal({precision},{scale})"))


def numeric_or_zero(c: Column) -> Column:
    """Null, blank or unparseable text becomes 0.0."""
    return F.coalesce(F.nanvl(c.cast("string").try_cast("double"), F.lit(0.0)), F.lit(0.0))


def truthy(c: Column) -> Column:
    """Null where the number is zero, so that coalesce skips it."""
    return F.nullif(c, F.lit(0))


def direction(c: Column) -> Column:
    return F.when(c > 0, "UP").when(c < 0, "DOWN").when(c.isNotNull(), "NEUTRAL")


def format_metric(c: Column) -> Column:
    """N/A; thousands without decimals; units with two decimals; else percent."""
    size = F.abs(c)
    return (
        F.when(c.isNull(), "N/A")
        .when(size >= 1000, F.format_number(c, 0))
        .when(size >= 1, F.format_number(c, 2))
        .otherwise(percent_text(c, 2))
    )


def percent_text(c: Column, places: int) -> Column:
    """Percent text; the digits round half to even on the exact binary value."""
    return F.concat(F.format_number(c * 100, places), F.lit("%"))
