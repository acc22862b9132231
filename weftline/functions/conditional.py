from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions._args import column, value


def iif(condition: Column, if_true, if_false=None) -> Column:
    """IIF: a condition that is null takes the false branch."""
    return F.when(condition, value(if_true)).otherwise(value(if_false))


def decode(subject, *pairs_and_default) -> Column:
    """DECODE with any number of (search, result) pairs and an optional default.

    A null subject matches a null search value.
    """
    subject = column(subject)
    args = [value(a) for a in pairs_and_default]
    default = args.pop() if len(args) % 2 else F.lit(None)
    if not args:
        return default
    searches, results = args[::2], args[1::2]
    chain = F.when(subject.eqNullSafe(searches[0]), results[0])
    for search, result in zip(searches[1:], results[1:]):
        chain = chain.when(subject.eqNullSafe(search), result)
    return chain.otherwise(default)


def nvl(subject, default) -> Column:
    return F.coalesce(column(subject), value(default))


def isnull(subject) -> Column:
    return column(subject).isNull()
