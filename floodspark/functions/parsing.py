"""Numbers out of CSV text. Bad text gives NULL, never an error, whatever the ANSI setting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits may be grouped by single underscores, as the input's own tools accept. Group 1 is the number.
_DIGITS = "[0-9]+(?:_[0-9]+)*"
INT_PATTERN = f"^\\s*([+-]?{_DIGITS})\\s*$"
FLOAT_PATTERN = (
    f"(?i)^\\s*([+-]?(?:nan|inf|infinity|(?:{_DIGITS}\\.?(?:{_DIGITS})?|\\.{_DIGITS})(?:e[+-]?{_DIGITS})?))\\s*$"
)
_BLANKS = " \t\n\r\f\u000b"


def _number(text: Column, pattern: str, kind: str) -> Column:
    # Text that a number is written back as is that number by every rule here; the pattern, which takes ten times as
    # long, only sees the rest.
    plain = text.try_cast(kind)
    # One pass over the text: no match extracts the empty string, which casts to NULL.
    digits = F.replace(F.regexp_extract(text, pattern, 1), F.lit("_"), F.lit(""))
    return F.when(plain.cast("string") == text, plain).otherwise(digits.try_cast(kind))


def stripped(text: Column) -> Column:
    """Text without surrounding white space; NULL becomes the empty string."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))


def strict_int(text: Column) -> Column:
    """BIGINT of plain integer text; ``12.0`` is bad."""
    return _number(text, INT_PATTERN, "bigint")


def float_text(text: Column) -> Column:
    """DOUBLE of float text, NaN and infinities included; suffixes such as ``1d`` are bad."""
    return _number(text, FLOAT_PATTERN, "double")


def is_finite(number: Column) -> Column:
    """False for NULL, NaN and infinities."""
    return F.coalesce(F.abs(number) < F.lit(float("inf")), F.lit(False))


def finite(number: Column) -> Column:
    """The number, or NULL where it is NaN or infinite."""
    return F.when(is_finite(number), number)


def truncated_int(text: Column) -> Column:
    """BIGINT of float text cut toward zero: ``19.99`` gives 19; NaN and infinity are bad."""
    return float_text(text).try_cast("bigint")
