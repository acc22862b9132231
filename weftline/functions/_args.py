from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(value) -> Column:
    """A Column as it is; a string as a column name."""
    return F.col(value) if isinstance(value, str) else value


def value(value) -> Column:
    """A Column as it is; anything else as a literal."""
    return value if isinstance(value, Column) else F.lit(value)
