"""Parsing of text cells, with the rules Python uses for numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Characters stripped from both ends of a cell.
BLANKS = " \t\n\r\x0b\x0c"

# Texts that read as a number.
INTEGER_TEXT = r"^[+-]?[0-9]+(_[0-9]+)*$"
FLOAT_TEXT = (
    r"(?i)^[+-]?(([0-9]+(_[0-9]+)*)(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)"
    r"(e[+-]?[0-9]+(_[0-9]+)*)?$|^[+-]?(inf|infinity|nan)$"
)


def stripped(cell: Column) -> Column:
    return F.btrim(cell, F.lit(BLANKS))


def is_filled(cell: Column) -> Column:
    return F.length(stripped(cell)) > 0


def text_to_double(cell: Column) -> Column:
    """Text as a double, null when it is not a number.

    The cast accepts ``1d``, ``1f`` and ``0x1p3`` and refuses ``1_000``; cells holding
    such a letter or an underscore are checked against the full pattern first.
    """
    text = stripped(cell)
    checked = F.when(text.rlike(FLOAT_TEXT), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
    return F.when(text.rlike("[_xXdDfF]"), checked).otherwise(text.try_cast("double"))


def text_to_long(cell: Column) -> Column:
    """Text as a whole number; ``1.0`` is not one."""
    text = stripped(cell)
    return F.when(text.rlike(INTEGER_TEXT), F.replace(text, F.lit("_"), F.lit("")).try_cast("bigint"))


def is_target_text(cell: Column) -> Column:
    """Filled, and not a repeated header line."""
    text = stripped(cell)
    return (text != "") & (F.lower(text) != "label")


def whole_label(number: Column) -> Column:
    """A number cut toward zero; null for NaN, infinity and what no ``bigint`` holds."""
    return number.try_cast("bigint")


def numeric_target(cell: Column) -> Column:
    """Label text as a whole number, null when it is no finite number."""
    return whole_label(text_to_double(cell))


def short_name(name: Column, longest: int = 50) -> Column:
    """Names above ``longest`` characters are cut and marked with three dots."""
    return F.when(
        F.length(name) > longest, F.concat(F.substring(name, 1, longest - 3), F.lit("..."))
    ).otherwise(name)
