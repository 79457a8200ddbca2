"""Decimals, precision and rounding of reported numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = "INF"


def round_even(value: Column, decimals: Column) -> Column:
    """Half-even rounding to a number of decimals that may be negative or differ by row."""
    scale = F.pow(F.lit(10.0), decimals.cast("double"))
    # Scaling a decimal by a power of ten is exact, scaling a double is not: go through decimal where it fits.
    exact = F.try_multiply(value.cast("decimal(38,10)"), F.lit(1).cast("decimal(10,0)"))
    scaled = exact.cast("double") * scale
    return F.when(decimals.isNull(), value.cast("double")).otherwise(F.rint(F.round(scaled, 6)) / scale)


def round_half_up(value: Column, decimals: int) -> Column:
    """Away from zero at a tie."""
    return F.round(value, decimals)


def fraction_digits(value: Column) -> Column:
    """Digits after the point of a lexical number."""
    return F.length(F.regexp_extract(value, r"^[^.]*\.([0-9]*)", 1))


def order_of(value: Column) -> Column:
    """Place of the first digit: 0 for 1 to 9, 2 for hundreds, -1 for tenths."""
    return F.when(value != 0, F.floor(F.log10(F.abs(value.cast("double"))) + F.lit(1e-12))).cast("int")


def _number(col: Column) -> Column:
    return F.when(col != INF, col).cast("int")


def inferred_decimals(value: Column, decimals: Column, precision: Column) -> Column:
    """Decimals of a fact: given, from precision, or INF if neither is there; NULL for precision 0."""
    from_precision = F.when(value == 0, F.lit(INF)).otherwise((_number(precision) - order_of(value) - 1).cast("string"))
    return (
        F.when(decimals.isNotNull(), decimals)
        .when(precision.isNull() | (precision == INF), F.lit(INF))
        .when(_number(precision) == 0, F.lit(None))
        .otherwise(from_precision)
    )


def inferred_precision(value: Column, decimals: Column, precision: Column) -> Column:
    """Precision of a fact: given, from decimals, or INF if neither is there; 0 means no digit is known."""
    from_decimals = F.when(value == 0, F.lit("0")).otherwise(F.greatest(F.lit(0), order_of(value) + 1 + _number(decimals)).cast("string"))
    return (
        F.when(precision.isNotNull(), precision)
        .when(decimals.isNull() | (decimals == INF), F.lit(INF))
        .otherwise(from_decimals)
    )


def presented(value: Column, decimals: Column) -> Column:
    """The number rounded half-even to its decimals; INF keeps it."""
    return F.when(decimals.isNull() | (decimals == INF), value.cast("double")).otherwise(round_even(value, _number(decimals)))
