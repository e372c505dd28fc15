"""Number formats for reports: decimal comma, percent, rounding rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decimal_comma(text: Column) -> Column:
    return F.replace(text, F.lit("."), F.lit(","))


def fixed(value: Column, decimals: int) -> Column:
    """Fixed number of decimals with a decimal comma; ties go to the even digit."""
    return decimal_comma(_digits(value, decimals))


def _digits(value: Column, decimals: int) -> Column:
    """Decimal text; a value that lies exactly between two results is rounded half-even.

    Only a multiple of 1 / 2**(decimals + 1) can lie exactly between.
    """
    scaled = value * float(2 ** (decimals + 1))
    between = scaled == F.floor(scaled)
    return F.format_string(f"%.{decimals}f", F.when(between, F.bround(value, decimals)).otherwise(value))


def general(value: Column) -> Column:
    """Up to six significant digits, no trailing zeros, decimal comma.

    Numbers that need an exponent (below 1e-4 or from 1e6 up) keep Java's
    ``%e`` digits without trailing zeros.
    """
    size = F.abs(value)
    places = F.greatest(F.lit(0), F.lit(5) - F.floor(F.log10(size)).cast("int"))
    plain = F.when(size == 0, F.lit("0")).otherwise(
        F.regexp_replace(
            F.regexp_replace(
                F.element_at(F.array(*[_digits(value, p) for p in range(11)]), places + 1),
                r"(\.\d*?)0+$", "$1",
            ),
            r"\.$", "",
        )
    )
    exponent = F.regexp_replace(
        F.regexp_replace(F.format_string("%.5e", value), r"(\.\d*?)0+e", "$1e"), r"\.e", "e"
    )
    return decimal_comma(F.when((size != 0) & ((size < 1e-4) | (size >= 999999.5)), exponent).otherwise(plain))


def percent(value: Column, decimals: int = 1) -> Column:
    return F.concat(fixed(value * 100, decimals), F.lit(" %"))


def half_up(value: Column, decimals: int) -> Column:
    return F.round(value, decimals)


def half_even(value: Column, decimals: int) -> Column:
    return F.bround(value, decimals)
