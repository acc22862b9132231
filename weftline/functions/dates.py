from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions._args import column, value

# Date format letters of the source language -> Spark pattern letters.
_FORMAT_LETTERS = {
    "YYYY": "yyyy", "YY": "yy", "RR": "yy",
    "MONTH": "MMMM", "MON": "MMM", "MM": "MM",
    "DDD": "DDD", "DD": "dd", "DAY": "EEEE", "DY": "EEE",
    "HH24": "HH", "HH12": "hh", "HH": "hh",
    "MI": "mm", "SS": "ss", "MS": "SSS", "US": "SSSSSS",
    "AM": "a", "PM": "a",
}
_KNOWN = "|".join(sorted(_FORMAT_LETTERS, key=len, reverse=True))
_TOKEN = re.compile(f"{_KNOWN}|(?:(?!{_KNOWN})[A-Za-z])+", re.IGNORECASE)

# Date part names of the source language -> Spark units.
_PARTS = {"YY": "year", "YYYY": "year", "YEAR": "year", "MM": "month", "MONTH": "month",
          "DD": "day", "DAY": "day"}


def spark_format(fmt: str) -> str:
    """``'YYYY-MM-DD HH24:MI:SS'`` -> ``'yyyy-MM-dd HH:mm:ss'``; ``T`` between date and time stays,
    other unknown letters are an error."""
    def replace(match: re.Match) -> str:
        token = match.group(0)
        if token.upper() == "T":
            return "'T'"
        if token.upper() not in _FORMAT_LETTERS:
            raise ValueError(f"unknown letters {token!r} in date format {fmt!r}")
        return _FORMAT_LETTERS[token.upper()]

    return _TOKEN.sub(replace, fmt)


def _unit(part: str) -> str:
    try:
        return _PARTS[part.upper()]
    except KeyError:
        raise ValueError(f"unknown date part {part!r}") from None


def sysdate() -> Column:
    return F.current_timestamp()


def to_date(text, fmt: str) -> Column:
    """Text to timestamp; text that does not fit the format gives null."""
    return F.try_to_timestamp(column(text), F.lit(spark_format(fmt)))


def trunc_date(moment, part: str = "DD") -> Column:
    return F.date_trunc(_unit(part), column(moment))


def add_to_date(moment, part: str, amount) -> Column:
    """Keeps the time of day; a month or year step clamps to the month's last day."""
    amount = value(amount)
    step = {
        "day": lambda: F.make_interval(days=amount),
        "month": lambda: F.make_interval(months=amount),
        "year": lambda: F.make_interval(years=amount),
    }[_unit(part)]()
    return column(moment) + step


def date_diff(later, earlier, part: str = "DD") -> Column:
    """Calendar days from ``earlier`` to ``later``: midnight crossings, not 24-hour spans."""
    if _unit(part) != "day":
        raise ValueError("date_diff counts days")
    return F.datediff(column(later), column(earlier))


def get_date_part(moment, part: str) -> Column:
    unit = _unit(part)
    moment = column(moment)
    return {"year": F.year, "month": F.month, "day": F.dayofmonth}[unit](moment)
