from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions._args import column
from weftline.functions.dates import spark_format


# A number's digits with an optional sign, currency, separators and one point.
_NUMBER_FORMAT = re.compile(r"(?=.*[09])(?:FM)?(?:MI|S)?[$L]?(?:MI|S)?[09G,]*(?:[.D][09]*)?[$L]?(?:MI|S|PR)?", re.IGNORECASE)


def to_char(subject, fmt: str | None = None) -> Column:
    """Plain cast without a format; number format (0, 9, $, ...) or date format with one.

    A format is a number's if it is nothing but digits 0 and 9 with sign, currency,
    separators and a point; digits among the letters of a date stand for themselves.
    """
    subject = column(subject)
    if fmt is None:
        return subject.cast("string")
    if _NUMBER_FORMAT.fullmatch(fmt):
        return F.to_char(subject, F.lit(fmt))
    return F.date_format(subject, spark_format(fmt))


def to_integer(subject) -> Column:
    """Digits after the point are cut, not rounded; text that is no number gives null."""
    text = column(subject).cast("string")
    whole = F.regexp_extract(text, r"^\s*([+-]?\d+)(\.\d*)?\s*$", 1)
    return F.when(whole != "", whole.try_cast("int")).otherwise(text.try_cast("decimal(38,18)").try_cast("int"))


def to_decimal(subject, precision: int, scale: int) -> Column:
    """Null when the value does not fit."""
    return column(subject).try_cast(f"decimal({precision},{scale})")
