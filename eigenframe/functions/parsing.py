"""Reading numbers, blanks and missing tokens out of text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells read as missing when a delimited file is parsed.
NA_TOKENS = ("", "NA", "N/A", "nan", "NaN", "null", "NULL", "m")
# Further spellings the quality checks accept, whatever the case.
NA_WORDS = ("", "na", "n/a", "nan", "null", "m", "-", "?", "none", "missing")

# Java's parser also takes "1d" and "1f"; the anchored pattern keeps them out.
NUMBER = r"^[+-]?(([0-9]+(\.[0-9]*)?)|(\.[0-9]+))([eE][+-]?[0-9]+)?$"
INFINITE = r"^[+-]?(inf|infinity)$"


def trimmed(c: Column) -> Column:
    return F.trim(c.cast("string"))


def is_blank(c: Column) -> Column:
    """NULL or white space only; never NULL itself."""
    return F.coalesce(trimmed(c) == "", F.lit(True))


def is_missing(c: Column, tokens: Sequence[str] = NA_TOKENS, any_case: bool = False) -> Column:
    text = F.lower(trimmed(c)) if any_case else trimmed(c)
    return F.coalesce(text.isin(*tokens), F.lit(True))


def to_number(c: Column, decimal: str = ".", na: Sequence[str] = NA_TOKENS) -> Column:
    """Text to double; missing tokens and non-numbers become NULL, infinities stay."""
    text = trimmed(c)
    if decimal != ".":
        text = F.replace(text, F.lit(decimal), F.lit("."))
    sign = F.when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return (
        F.when(trimmed(c).isin(*na), F.lit(None).cast("double"))
        .when(text.rlike(NUMBER), text.try_cast("double"))
        .when(F.lower(text).rlike(INFINITE), sign)
    )


def is_number(c: Column, decimal: str = ".", na: Sequence[str] = NA_TOKENS) -> Column:
    return to_number(c, decimal, na).isNotNull()


def strict_number(c: Column, name: str, decimal: str = ".", na: Sequence[str] = NA_TOKENS) -> Column:
    """As :func:`to_number`, but a cell that is neither number nor missing fails the job."""
    value = to_number(c, decimal, na)
    bad = value.isNull() & ~is_missing(c, na)
    return F.when(bad, F.raise_error(F.concat(F.lit(f"column {name}: not a number: "), c)).cast("double")).otherwise(
        value
    )


def finite(c: Column) -> Column:
    """NULL for NaN and the infinities, so aggregates skip them."""
    value = c.cast("double")
    return F.when(F.abs(value) < float("inf"), value)  # NaN is above infinity
