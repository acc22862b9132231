"""Joiner, lookups and keyed overrides.

Sides are never hinted to broadcast: Catalyst does it for a side whose size it knows
to be under ``spark.sql.autoBroadcastJoinThreshold``, and AQE does it at run time.
Above that these are shuffled joins that AQE can split when one key is hot.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.conditional import nvl
from weftline.session import cut_counted

_KEY = "_join_key"


def keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the keys packed in one struct, null when any key is null.

    A side that was made unique is partitioned by its keys already, and a join on
    the same keys would reuse that partitioning; AQE splits hot partitions only
    when both join inputs are fresh shuffles. Joining on the packed key makes them so.
    """
    complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    packed = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    return df.withColumn(_KEY, F.when(complete, packed))


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    """One row per key. Spark keeps one row per key in each map task before the
    shuffle (window group limit), so a hot key sends few rows."""
    window = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def joiner(
    left: DataFrame, right: DataFrame, on: Mapping[str, str] | None = None,
    condition: Column | None = None, how: str = "left",
) -> DataFrame:
    """Join on equal columns (``{left: right}``), with an optional further condition.

    With neither, every row meets every row (the ``1=1`` default) and left rows
    survive an empty right side; see :func:`pair_all`.
    """
    if not on:
        if condition is not None:
            raise ValueError("give the equal columns in `on`; a bare condition compares all pairs")
        return pair_all(left, right)
    terms = [left[a] == right[b] for a, b in on.items()]
    if condition is not None:
        terms.append(condition)
    return left.join(right, reduce(lambda a, b: a & b, terms), how)


#: Pairs that one task of a pairing makes, about.
PAIRS = 1_000_000


def pair_all(left: DataFrame, right: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """Left rows with every right row, as an equi-join on pairs of blocks.

    Both sides are dealt evenly, equal rows too, into blocks, and every left block meets
    every right block. Blocks are as many as it takes for two to make about ``pairs`` pairs, whatever the sizes
    of the sides, so no task holds a side whole or makes more. Both sides are written once before. The result
    has ``left x right`` rows by definition; keep the right side small.
    """
    left, left_rows = cut_counted(left)
    right, right_rows = cut_counted(right)
    if not right_rows:
        return left.join(right, F.lit(False), "left")
    # Even sides for a pair of blocks, but for one that has fewer rows than that.
    side = math.isqrt(pairs)
    right_block = min(right_rows, side if left_rows >= side else max(side, pairs // max(1, left_rows)))
    lefts, rights = max(1, -(-left_rows // max(1, pairs // right_block))), -(-right_rows // right_block)
    # Rows of a task are numbered one by one, so they go round the blocks in turn.
    dealt = lambda blocks: F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = left.withColumn("_left", dealt(lefts)).withColumn("_right", every(rights))
    b = right.withColumn("_right", dealt(rights)).withColumn("_left", every(lefts))
    if lefts * rights == 1:
        return a.join(b, ["_left", "_right"]).drop("_left", "_right")
    # A block pair is one task's, however few bytes its rows have.
    tiles = min(lefts * rights, 100_000)
    spread = lambda side: side.repartition(tiles, "_left", "_right")
    return spread(a).join(spread(b).hint("merge"), ["_left", "_right"]).drop("_left", "_right")


def lookup(
    df: DataFrame, reference: DataFrame, keys: Mapping[str, str], columns: Sequence[str],
    order_by: Sequence[Column] | None = None, unique: bool = False,
) -> DataFrame:
    """Add ``columns`` of at most one reference row per input row, null when unmatched.

    ``keys`` maps input columns to reference columns. Among duplicates the first by
    ``order_by`` (default: by the added columns) wins; ``unique=True`` skips that step.
    """
    names = list(keys.values())
    reference = reference.select(*dict.fromkeys([*names, *columns, *reference.columns])) \
        if order_by else reference.select(*dict.fromkeys([*names, *columns]))
    if not unique:
        order = order_by or [F.col(c).asc_nulls_last() for c in columns]
        reference = first_per_key(reference, names, order)
    right = keyed(reference, names).select(_KEY, *columns).where(F.col(_KEY).isNotNull())
    return keyed(df, list(keys)).join(right, _KEY, "left").drop(_KEY)


def lookup_split(
    df: DataFrame, reference: DataFrame, keys: Mapping[str, str], unique: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Input rows with and without a reference row; null keys are unmatched.
    ``unique=True`` says that no reference key repeats."""
    known = reference.select(*keys.values())
    known = keyed(known if unique else known.distinct(), list(keys.values()))
    known = known.select(_KEY).where(F.col(_KEY).isNotNull())
    left = keyed(df, list(keys))
    return (
        left.join(known, _KEY, "left_semi").drop(_KEY),
        left.join(known, _KEY, "left_anti").drop(_KEY),
    )


def map_lookup(
    df: DataFrame, key: str, output: str, mapping: dict | DataFrame, default=None
) -> DataFrame:
    """Key to value. A dict becomes an expression; a two-column frame becomes a join."""
    if isinstance(mapping, DataFrame):
        from_column, to_column = mapping.columns
        values = mapping.withColumnRenamed(to_column, output)
        found = lookup(df, values, {key: from_column}, [output])
    elif mapping:
        pairs = [F.lit(x) for pair in mapping.items() for x in pair]
        found = df.withColumn(output, F.try_element_at(F.create_map(*pairs), F.col(key)))
    else:
        found = df.withColumn(output, F.lit(default))
    return found if default is None else found.withColumn(output, nvl(output, default))


def override(
    df: DataFrame, corrections: DataFrame, keys: Sequence[str], column: str,
    corrected: str = "corrected",
) -> DataFrame:
    """Replace ``column`` where a correction exists for the row's keys; keep it elsewhere.

    ``corrections`` has the keys and a ``corrected`` column; blank keys never match.
    """
    found = lookup(df, corrections, {k: k for k in keys}, [corrected])
    return found.withColumn(column, F.coalesce(corrected, column)).drop(corrected)
