"""Union, normalizer and record splitting."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows of all inputs, duplicates kept; columns are matched by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def normalizer(
    df: DataFrame, columns: Sequence[str], value: str = "value", index: str = "occurrence"
) -> DataFrame:
    """One row per occurrence of the repeated columns, numbered from 1."""
    kept = [c for c in df.columns if c not in columns]
    repeated = F.posexplode(F.array(*columns)).alias("_pos", value)
    return df.select(*kept, repeated).select(*kept, (F.col("_pos") + 1).alias(index), value)


def split_records(
    df: DataFrame, column: str, value: str = "record", index: str = "fragment"
) -> DataFrame:
    """One row per array element, numbered from 1; empty arrays give no rows."""
    kept = [c for c in df.columns if c != column]
    elements = F.posexplode(column).alias("_pos", value)
    return df.select(*kept, elements).select(*kept, (F.col("_pos") + 1).alias(index), value)
