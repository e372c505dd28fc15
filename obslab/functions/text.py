"""Text clean-up and tolerant number parsing as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that mean "no category given".
MISSING_WORDS = ("", "na", "nan", "none", "null")

# Every character that counts as whitespace, ASCII separators included.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_DIGITS = r"\d+(?:_\d+)*"
_NUMBER = (
    rf"(?i)^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?(?:e[+-]?{_DIGITS})?|\.{_DIGITS}(?:e[+-]?{_DIGITS})?"
    r"|inf|infinity|nan)$"
)


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of every kind, not only blanks."""
    return F.btrim(text, F.lit(BLANKS))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def parse_number(text: Column) -> Column:
    """Text to double; null when it is not a number, NaN and infinities kept.

    The pattern is checked before the cast because the cast alone would accept
    Java suffixes such as ``18d``.
    """
    return parse_stripped(strip(text.cast("string")))


def parse_stripped(value: Column) -> Column:
    """``parse_number`` for text without surrounding whitespace.

    A text that fits the pattern but not the cast is a NaN with a sign.
    """
    number = F.replace(value, F.lit("_"), F.lit("")).try_cast("double")
    return F.when(value.rlike(_NUMBER), F.coalesce(number, F.lit(float("nan"))))


# Both rules lean on NaN sorting above every number, and refer to the value as
# rarely as possible: filters on them are pushed down with the value inlined.
def is_finite(value: Column) -> Column:
    """False for null, NaN and both infinities."""
    return F.coalesce(F.abs(value) < F.lit(float("inf")), F.lit(False))


def is_measure(value: Column) -> Column:
    """A usable measure: a finite number above zero."""
    return F.coalesce((value > 0) & (value < F.lit(float("inf"))), F.lit(False))
