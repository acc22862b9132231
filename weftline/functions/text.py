from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions._args import column, value


def instr(text, wanted) -> Column:
    """1-based position of the first occurrence, 0 when there is none."""
    return F.instr(column(text), value(wanted))


def substr(text, start, count=None) -> Column:
    """Start 0 means 1; a negative start counts from the end."""
    text = column(text)
    start = value(start)
    return F.substr(text, start) if count is None else F.substr(text, start, value(count))


def ltrim(text, characters: str | None = None) -> Column:
    return F.ltrim(column(text)) if characters is None else F.ltrim(column(text), F.lit(characters))


def rtrim(text, characters: str | None = None) -> Column:
    return F.rtrim(column(text)) if characters is None else F.rtrim(column(text), F.lit(characters))


def trim(text, characters: str | None = None) -> Column:
    return F.trim(column(text)) if characters is None else F.trim(column(text), F.lit(characters))


def length(text) -> Column:
    """LENGTH / LEN: characters, trailing blanks included."""
    return F.char_length(column(text))


def upper(text) -> Column:
    return F.upper(column(text))


def lower(text) -> Column:
    return F.lower(column(text))


def concat(left, right) -> Column:
    """Null in, null out."""
    return F.concat(column(left), column(right))


def concat_op(*parts) -> Column:
    """``a || b || ...`` for any number of parts; null in, null out."""
    return F.concat(*[column(p) for p in parts])


def safe_name(text) -> Column:
    """Every character other than letters and digits of any script, ``-`` and ``_`` becomes ``_``."""
    return F.regexp_replace(column(text), r"[^\p{L}\p{N}_-]", "_")
