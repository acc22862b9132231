"""Sharding: order rows along a Hilbert curve through their metadata and cut even runs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import put_back, set_aside, with_positions


def _text_number(col: Column, skip: int) -> Column:
    """Three characters after the first ``skip`` as a number that sorts like the text."""
    at = lambda i: F.least(F.coalesce(F.ascii(F.substring(col, skip + i, 1)), F.lit(0)), F.lit(65535)).cast("long")
    return (at(1) * 65536 + at(2)) * 65536 + at(3)


def _size_number(col: Column) -> Column:
    """A whole number's bit length and its next two bits: four steps per doubling."""
    x = F.greatest(col.cast("long"), F.lit(0)) + 4
    bits = F.length(F.bin(x)).cast("int")
    return (4 * bits).cast("long") + F.call_function("shiftright", x, bits - 3).bitwiseAND(F.lit(3))


def curve_index(cells: list[Column], bits: int) -> Column:
    """The place on the Hilbert curve of a cell whose coordinates have ``bits`` bits each."""
    count = len(cells)
    x = F.array(*[c.cast("long") for c in cells])
    steps = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i"))
                      for b in range(bits - 1, 0, -1) for i in range(count)])

    def turn(state: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        set_ = F.element_at(state, i + 1).bitwiseAND(q) != 0
        t = F.element_at(state, 1).bitwiseXOR(F.element_at(state, i + 1)).bitwiseAND(q - 1)
        return F.transform(state, lambda v, k: F.when(set_ & (k == 0), v.bitwiseXOR(q - 1))
                           .when(~set_ & ((k == 0) | (k == i)) & (i != 0), v.bitwiseXOR(t)).otherwise(v))

    turned = F.aggregate(steps, x, turn) if bits > 1 else x
    # Gray code: each coordinate takes in the ones before it, then the bits of the last one.
    gray = _let(turned, lambda t: F.array(*[_all_xor([F.element_at(t, i + 1) for i in range(k + 1)]) for k in range(count)]))
    levels = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)] or [F.lit(1).cast("long")])
    places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i"))
                       for b in range(bits - 1, -1, -1) for i in range(count)])
    flips = lambda g: F.aggregate(levels, F.lit(0).cast("long"), lambda a, q: F.when(
        F.element_at(g, count).bitwiseAND(q) != 0, a.bitwiseXOR(q - 1)).otherwise(a))
    flipped = _let(gray, lambda g: _let(flips(g), lambda f: F.transform(g, lambda v: v.bitwiseXOR(f))))
    return _let(flipped, lambda g: F.aggregate(places, F.lit(0).cast("long"), lambda a, p: a * 2 + F.call_function(
        "shiftright", F.element_at(g, p["i"] + 1), p["b"]).bitwiseAND(F.lit(1))))


def _steps_below(value: Column, steps: list[int]) -> Column:
    """How many of the steps a value has reached."""
    return F.size(F.filter(F.array(*[F.lit(s) for s in steps]).cast("array<bigint>"), lambda s: s <= value))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _all_xor(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseXOR(b), columns)


def hilbert_shards(
    df: DataFrame, text_dims: list[str], size_dims: list[str], shards: int, bits: int = 6, order: list[str] | None = None,
) -> DataFrame:
    """The rows with ``curve`` (place on the curve), ``shard`` and ``slot`` (place in the shard).

    Each dimension is cut into 2**bits steps of about as many rows each (a value that more
    rows share takes several steps), so skewed values spread over the curve; text counts by
    the three characters after what least and greatest have in common, sizes by their
    logarithm. Rows are ordered by curve, then by ``order``, and
    cut into runs whose row counts differ by one at most, however many rows share a cell.

    Nulls take the lowest step. Equal rows stay apart and each gets its slot. With fewer
    rows than shards some shards are empty; an empty table gives none. Columns called
    curve, shard or slot are replaced.
    """
    df, names = set_aside(df.drop("curve", "shard", "slot"))
    text_dims, size_dims, order = ([names.get(c, c) for c in some or []] for some in (text_dims, size_dims, order))
    ends = df.agg(*[f(F.substring(F.col(f"`{c}`"), 1, 64)).alias(f"{n}{i}") for i, c in enumerate(text_dims)
                    for n, f in (("lo", F.min), ("hi", F.max))]).first() if text_dims else {}
    numbers = []
    for i, c in enumerate(text_dims):
        low, high = ends[f"lo{i}"] or "", ends[f"hi{i}"] or ""
        skip = next((k for k, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
        numbers.append(_text_number(F.col(f"`{c}`"), skip))
    numbers += [_size_number(F.col(f"`{c}`")) for c in size_dims]
    # One list of 2**bits - 1 numbers for each dimension, whatever the data.
    shares = F.array(*[F.lit(k / (1 << bits)) for k in range(1, 1 << bits)])
    steps = df.agg(*[F.percentile_approx(v, shares, F.lit(10_000)).alias(f"q{i}") for i, v in enumerate(numbers)]).first()
    cells = [_steps_below(v, steps[f"q{i}"] or []) for i, v in enumerate(numbers)]
    curved = df.withColumn("curve", curve_index(cells, bits))
    placed, rows = with_positions(curved, [F.col("curve"), *[F.col(f"`{c}`") for c in order or []]], "_place")
    rows = max(rows, 1)
    first = F.expr(f"(cast(shard as long) * {rows} + {shards - 1}) div {shards}")
    return put_back(placed.withColumn("shard", F.expr(f"cast(_place * {shards} div {rows} as int)")).withColumn(
        "slot", F.col("_place") - first).drop("_place"), names)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write each shard's run, in slot order, below ``path`` with the curve's dimensions clustered in its files."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
