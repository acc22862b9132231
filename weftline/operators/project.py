"""Expression, record update, filter, router and the valid / reject split."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Condition = Column | str


def _expr(expression: Condition) -> Column:
    return F.expr(expression) if isinstance(expression, str) else expression


def expression(df: DataFrame, ports: Mapping[str, Condition | None] | None = None) -> DataFrame:
    """Project the ports in order. A port without an expression passes through by name;
    without any ports every column passes."""
    if not ports:
        return df.select("*")
    return df.select([
        F.col(name) if e is None else _expr(e).alias(name) for name, e in ports.items()
    ])


def update_record(
    df: DataFrame, updates: Mapping[str, Condition], input_only: tuple[str, ...] = ()
) -> DataFrame:
    """Set the named fields from the incoming values and keep the rest; input-only
    ports are not written."""
    return df.withColumns({n: _expr(e) for n, e in updates.items() if n not in input_only})


def passthrough(df: DataFrame) -> DataFrame:
    return df


def mapplet(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """One reusable transformation out of several, for ``df.transform``."""
    return lambda df: reduce(lambda current, step: current.transform(step), steps, df)


def filter_rows(df: DataFrame, condition: Condition) -> DataFrame:
    """Rows whose condition is true; null drops the row."""
    return df.where(_expr(condition))


def router(
    df: DataFrame, routes: Mapping[str, Condition], column: str = "route",
    unmatched: str = "unmatched",
) -> DataFrame:
    """One output row per matching route, or one under ``unmatched``, in a single scan."""
    names = F.array_compact(F.array(*[F.when(_expr(c), F.lit(n)) for n, c in routes.items()]))
    names = F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(unmatched)))
    return df.select("*", F.explode(names).alias(column))


def router_split(
    df: DataFrame, routes: Mapping[str, Condition], unmatched: str = "unmatched"
) -> dict[str, DataFrame]:
    """The router's outputs as separate frames, so each filter can reach the scan."""
    false = F.lit(False)
    matched = reduce(
        lambda a, b: a | b, [F.coalesce(_expr(c), false) for c in routes.values()], false
    )
    outputs = {name: df.where(_expr(c)) for name, c in routes.items()}
    outputs[unmatched] = df.where(~matched)
    return outputs


def predicate(column: str, kind: str, operand=None) -> Column:
    """The route predicates: ``equals`` text or number, ``is null``, ``is not null``."""
    field = F.col(column)
    if kind == "equals":
        return field == F.lit(operand)
    if kind == "is null":
        return field.isNull()
    if kind == "is not null":
        return field.isNotNull()
    raise ValueError(f"unknown predicate {kind!r}")


def split_valid(
    df: DataFrame, casts: Mapping[str, str], reason: str = "reject_reason"
) -> tuple[DataFrame, DataFrame]:
    """Convert the named columns. Rows where a conversion fails keep their original
    values and go to the second frame with the failing columns named."""
    failed = F.array_compact(F.array(*[
        F.when(F.col(n).isNotNull() & F.col(n).try_cast(t).isNull(), F.lit(f"{n}: not {t}"))
        for n, t in casts.items()
    ]))
    marked = df.withColumn(reason, F.array_join(failed, "; "))
    valid = marked.where(F.col(reason) == "").drop(reason)
    valid = valid.withColumns({n: F.col(n).try_cast(t) for n, t in casts.items()})
    return valid, marked.where(F.col(reason) != "")
