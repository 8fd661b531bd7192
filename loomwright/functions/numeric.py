"""Numbers from text and between storage types: exact, or refused."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTEGER = r"^[+-]?[0-9]+$"
DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def is_integer(text: Column) -> Column:
    return text.rlike(INTEGER)


def is_number(text: Column) -> Column:
    return text.rlike(DECIMAL)


def parse_number(text: Column, decimal: str = ".") -> Column:
    """The number that a cell spells, null where it spells none; what overflows or underflows to zero is null too (see misfit)."""
    c = F.translate(text, ",", ".") if decimal == "," else text
    x = F.when(is_number(c), c.try_cast("double"))
    return F.when(~misfit(text, decimal), x)


def misfit(text: Column, decimal: str = ".") -> Column:
    """Whether a cell spells a number beyond a double: infinite, or zero though a digit of it is not."""
    c = F.translate(text, ",", ".") if decimal == "," else text
    x = c.try_cast("double")
    mantissa = F.regexp_replace(c, "[eE].*$", "")
    return F.coalesce(is_number(c) & (F.abs(x).isin(float("inf")) | ((x == 0) & mantissa.rlike("[1-9]"))), F.lit(False))


def exact_in_double(integer: Column) -> Column:
    """Whether a double holds the integer as it is."""
    d = integer.cast("decimal(20,0)")
    return d.cast("double").cast("decimal(38,0)") == d.cast("decimal(38,0)")


def to_float32(x: Column) -> Column:
    """The nearest 32-bit float; null where that is infinite or a nonzero number becomes zero."""
    f = x.cast("float")
    return F.when((F.abs(f) < float("inf")) & ~((f == 0) & (x != 0)), f)


def in_integer_domain(text: Column) -> Column:
    """Whether an integer's spelling lies between -2**63 and 2**64 - 1."""
    return is_integer(text) & text.try_cast("decimal(38,0)").between(F.lit(-(2**63)).cast("decimal(38,0)"), F.lit("18446744073709551615").cast("decimal(38,0)"))


def refuse(bad: Column, message: str, value: Column) -> Column:
    """value; an error where bad."""
    return F.when(bad, F.raise_error(F.lit(message)).cast("double")).otherwise(value)


def class_label(x: Column) -> Column:
    """Whether a number can be a class label: integral and exact in a double."""
    return (x == F.floor(x)) & (F.abs(x) <= 2**53 - 1)
