"""Rank, sequence, sorter and top-k.

Numbering all rows (or all rows of a hot partition) through one window would put them
in one task. Here the rows are cut into ordered buckets by splitters taken from a
sample; each bucket is numbered on its own and shifted by the number of rows before it.
The splitters are plan literals, so a recomputed task always cuts in the same places.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut_counted

_ROWS_PER_BUCKET = 10_000
_SAMPLE_PER_BUCKET = 30


class Order:
    """One sort column; nulls go first ascending and last descending, as in Spark."""

    def __init__(self, name: str, desc: bool = False):
        self.name, self.desc = name, desc

    def column(self) -> Column:
        return F.col(self.name).desc() if self.desc else F.col(self.name).asc()

    def before(self, a: Column, b: Column) -> Column:
        """Whether value ``a`` sorts strictly before value ``b``."""
        if self.desc:
            a, b = b, a
        return F.coalesce(a < b, a.isNull() & b.isNotNull())


def _precedes(orders: Sequence[Order], a: Column, b: Column) -> Column:
    """Whether struct ``a`` sorts strictly before struct ``b``."""
    result = F.lit(False)
    for i, order in reversed(list(enumerate(orders))):
        x, y = a[f"s{i}"], b[f"s{i}"]
        result = order.before(x, y) | (x.eqNullSafe(y) & result)
    return result


def _bucket(orders: Sequence[Order], splitters: Column, row: Column, count: int) -> Column:
    """Number of splitters at or before the row, by binary search over powers of two."""
    steps = [1 << i for i in reversed(range(count.bit_length()))]
    if not steps:
        return F.lit(0)

    def step(found: Column, jump: Column) -> Column:
        beyond = _precedes(orders, row, F.get(splitters, found + jump - 1))
        return F.when((found + jump <= count) & ~beyond, found + jump).otherwise(found)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def number_rows(
    df: DataFrame, order_by: Sequence[Order], output: str, partition: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Row number 1..n over the whole frame, or per ``partition``, without a window over
    more than one bucket of rows.

    Ties are ordered by a hash of the row and then by where it was read, so that a value or a
    whole row that many share is cut into buckets too. The rows are written once, with that
    place; the sort columns are then read twice before the rows themselves.
    """
    spark, columns = df.sparkSession, df.columns
    # Maps have no hash.
    hashed = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
    # Where a row was read, which is fixed as it is written, tells equal rows apart.
    df, total = cut_counted(df.withColumns({"_tie": F.xxhash64(*hashed), "_at": F.monotonically_increasing_id()}))
    order_by = [*order_by, Order("_tie"), Order("_at")]
    orders = [Order(p) for p in partition] + order_by
    row = F.struct(*[F.col(o.name).alias(f"s{i}") for i, o in enumerate(orders)])
    keys = df.select(row.alias("k"))
    if buckets is None:
        most = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(2, min(most, total // _ROWS_PER_BUCKET))

    # Splitters: a bounded sample of the sort columns (the scan reads no others), sorted
    # and thinned out. They travel as JSON text, which Spark folds into one literal. The
    # text drops microseconds, which does no harm: the search is a tree of comparisons,
    # so whatever the splitters are, an earlier row never lands in a later bucket.
    wanted = buckets * _SAMPLE_PER_BUCKET
    sample = keys.sample(min(1.0, wanted / max(1, total)), seed=7)
    in_order = sample.select("k.*").orderBy(*[
        Order(f"s{i}", o.desc).column() for i, o in enumerate(orders)
    ])
    ranked = [r[0] for r in in_order.select(F.to_json(F.struct("*"))).collect()]
    gap = max(1, -(-len(ranked) // buckets))
    picked = ranked[gap::gap] if buckets > 1 else []
    schema = keys.schema["k"].dataType.simpleString()
    splitters = F.from_json(F.lit(f"[{','.join(picked)}]"), f"array<{schema}>")
    cut = (
        df.withColumns({"_row": row, "_splitters": splitters})
        .withColumn("_bucket", _bucket(orders, F.col("_splitters"), F.col("_row"), len(picked)))
        .drop("_row", "_splitters")
    )

    # Rows before each bucket. Per partition only those cut by a splitter need a shift,
    # and there are no more of them than splitters.
    counted = cut.select("_bucket", *partition)
    if partition:
        split = spark.range(1).select(F.explode(splitters).alias("k"))
        split = split.select(*[F.col(f"k.s{i}").alias(p) for i, p in enumerate(partition)])
        same = [counted[p].eqNullSafe(split[p]) for p in partition]
        counted = counted.join(split, same, "left_semi")
    counts = counted.groupBy("_bucket", *partition).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*[F.col(p) for p in partition]).orderBy("_bucket") \
        .rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        F.col("_bucket").alias("_b"), *[F.col(p).alias(f"_p{i}") for i, p in enumerate(partition)],
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"),
    )
    # At most two rows per splitter, so this side is bounded by `buckets`.
    on = [cut["_bucket"] == shifts["_b"]]
    on += [cut[p].eqNullSafe(shifts[f"_p{i}"]) for i, p in enumerate(partition)]
    inside = Window.partitionBy("_bucket", *partition).orderBy(*[o.column() for o in order_by])
    numbered = cut.withColumn("_place", F.row_number().over(inside))
    return (
        numbered.join(F.broadcast(shifts), on, "left")
        .withColumn(output, F.col("_place") + F.coalesce("_shift", F.lit(0)))
        .select(*columns, output)
    )


def rank(
    df: DataFrame, by: str, desc: bool = False, tiebreak: Sequence[str] = (),
    partition: Sequence[str] = (), output: str = "RANK_COL",
) -> DataFrame:
    """All columns plus a row number ordered by ``by`` (ascending unless told otherwise)."""
    orders = [Order(by, desc)] + [Order(t) for t in tiebreak]
    return number_rows(df, orders, output, partition)


def sequence(
    df: DataFrame, output: str, order_by: Sequence[str] = (), start: int = 1, step: int = 1
) -> DataFrame:
    """Increasing integers. Without ``order_by`` they only increase, with gaps, and cost
    no shuffle; with it they are dense in that order."""
    if not order_by:
        return df.withColumn(output, F.monotonically_increasing_id() * step + start)
    numbered = number_rows(df, [Order(o) for o in order_by], "_seq")
    return numbered.withColumn(output, (F.col("_seq") - 1) * step + start).drop("_seq")


def sorter(
    df: DataFrame, key: str, desc: bool = False, tiebreak: Sequence[str] = (),
    position: str | None = None,
) -> DataFrame:
    """Order by one key, optionally adding each row's ``position``. What ties are left are
    ordered by a row hash, which also lets the range exchange spread a key that holds
    many rows, equal in every column even, over several partitions."""
    orders = [Order(key, desc)] + [Order(t) for t in tiebreak]
    if position is not None:
        return number_rows(df, orders, position).orderBy(position)
    spread = F.xxhash64(*[F.col(c) for c in df.columns])
    return df.orderBy(*[o.column() for o in orders], spread, F.monotonically_increasing_id())


def top_k(df: DataFrame, order_by: Sequence[Column], k: int = 1) -> DataFrame:
    """First ``k`` rows; each task keeps ``k`` and the driver merges them."""
    return df.orderBy(*order_by).limit(k)
