from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions._args import column, value


def trunc_number(number, scale: int = 0, mode: str = "truncate", decimal: bool = False) -> Column:
    """Cut digits after ``scale`` toward zero; ``mode='round'`` rounds half up instead.

    The result is a double. It runs through decimal with 18 digits after the point, so that 0.29 stays 0.29 at two
    digits (binary 0.29 * 100 is below 29). A number too large for that (1e20 and more) is
    given back as the nearest double, which has no digits to cut. ``decimal=True`` says that the
    column is a decimal: it is cut in its own type, and stays one, with all of its digits.
    """
    number = column(number)
    if mode == "round":
        return F.round(number, scale)
    if mode != "truncate":
        raise ValueError(f"unknown mode {mode!r}")
    if decimal:
        return F.when(number < 0, F.ceil(number, F.lit(scale))).otherwise(F.floor(number, F.lit(scale)))
    exact = number.try_cast("decimal(38,18)")
    places = F.lit(scale)
    cut = F.when(exact < 0, F.ceil(exact, places)).otherwise(F.floor(exact, places)).cast("double")
    return F.coalesce(cut, number.try_cast("double"))


def round_number(number, scale: int = 0) -> Column:
    """Half away from zero."""
    return F.round(column(number), scale)


def absolute(number) -> Column:
    return F.abs(column(number))


def mod(dividend, divisor) -> Column:
    """Sign of the dividend; null for a zero divisor."""
    return F.try_mod(column(dividend), value(divisor))
