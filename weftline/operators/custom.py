"""Places for row logic that no built-in expression covers; Arrow batches both ways."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def custom_rows(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Run ``fn`` on each batch of rows; ``schema`` declares the output ports. Select
    only the input ports first, so that the scan prunes the others."""
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield fn(frame)

    return df.mapInPandas(batches, schema)


def custom_column(fn: Callable[..., pd.Series], return_type: str):
    """A column function out of a function on pandas series."""
    return F.pandas_udf(fn, return_type)
