"""Mixing sources to target weights: budgets flow down a tree, then each leaf is drawn in seeded epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import put_back, set_aside
from weftline.session import cut_lineage

#: Hash digits that cut a leaf's seeded order into pieces (16**4 at most).
#: Parts that the rows of each leaf are dealt into where they meet its plan.
SALTS = 16
PIECE_DIGITS = 4


def _whole(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(38,0)")


def _same(path: list[str]) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in path]


def budgets(leaves: DataFrame, levels: list[str], weights: list[str], supply: str, budget: Column) -> DataFrame:
    """``leaves`` (one row each) with ``granted``, the whole tokens each leaf may give.

    From the root down, a node's budget is shared among its children by weight. A child
    that cannot use its share (its whole subtree holds less) keeps what it holds, and what
    is left over goes to its siblings by weight; only when all of them are full does a
    node use less than its budget, which its parent has then shared elsewhere already,
    since every share is held against what the whole subtree holds. Shares are cut to
    whole tokens, so a node may stay below its budget by fewer tokens than it has children.
    """
    nodes = leaves.select(*levels, *weights, _whole(supply).alias("_cap"))
    given = None
    for depth in range(1, len(levels) + 1):
        path, weight = levels[:depth], weights[depth - 1]
        own = nodes.groupBy(*path).agg(F.sum("_cap").alias("_cap"), F.max(weight).alias("_weight"))
        above = path[:-1]
        if given is None:
            own = own.withColumn("_given", _whole(budget))
        else:
            own = own.join(given, _same(above)).drop(*[f"_of_{c}" for c in above])
        # In order of what a unit of weight holds, the children before a place are full if the
        # ones from there on would otherwise get less than they hold.
        key = [F.col(c) for c in above] or [F.lit(0)]
        per_unit = F.col("_cap").cast("double") / F.col("_weight")
        by = Window.partitionBy(*key).orderBy(per_unit.asc(), *[F.col(path[-1]).asc_nulls_first()])
        before = by.rowsBetween(Window.unboundedPreceding, -1)
        rest = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        own = own.where("_weight > 0").withColumn("_left", F.greatest(_whole(
            F.col("_given") - F.coalesce(F.sum("_cap").over(before), _whole(F.lit(0)))), _whole(F.lit(0))))
        own = own.withColumn("_weights", _whole(F.sum("_weight").over(rest)))
        own = own.withColumn("_full", _whole("_cap") * _whole("_weights") <= _whole("_left") * _whole("_weight"))
        # The first place that isn't full sets the share of all that follow.
        own = own.withColumn("_open", F.min(F.when(~F.col("_full"), F.struct(
            per_unit.alias("r"), F.col("_left").alias("l"), F.col("_weights").alias("w")))).over(
                Window.partitionBy(*key)))
        share = F.call_function("div", _whole(F.col("_open.l") * _whole("_weight")), F.col("_open.w"))
        own = own.withColumn("_given", F.when(F.col("_full"), F.col("_cap")).otherwise(share))
        given = own.select(*[F.col(c).alias(f"_of_{c}") for c in path], _whole("_given").alias("_given"))
    out = leaves.join(given, _same(levels), "left")
    return out.select(*leaves.columns, F.coalesce("_given", _whole(F.lit(0))).cast("long").alias("granted"))


def mix(
    docs: DataFrame, levels: dict[str, Column], weights: list[Column], tokens: Column, row_id: Column, *,
    fraction: float = 1.0, max_epochs: int = 4, seed: int = 0,
) -> DataFrame:
    """Draw documents so that tokens follow the weights of a tree.

    ``levels`` names the tree's columns from the root down (domain, language, source);
    ``weights`` has a whole-number weight for each level, from the level columns. The
    budget is ``fraction`` of all tokens; a leaf gives its tokens at most ``max_epochs``
    times. A leaf granted more than it holds gives whole epochs and the first tokens of
    one more; the order of that epoch is a hash of the seed, the epoch and ``row_id``.

    One row for each document and epoch it is drawn in: all columns of ``docs``, the level
    columns, ``epoch``, ``tokens`` and ``take`` (the tokens of it that count: fewer than
    it holds only for a leaf's last document). Level columns replace columns of the same
    name; columns called epoch, tokens or take are replaced. A null level value is a node
    of its own; weights that are null or not positive give nothing. Documents without tokens
    are never drawn. Rows with equal ids are drawn together; where a budget ends in such a
    group, what still fits is shared in proportion to their tokens, in whole tokens.
    """
    names = list(levels)
    docs = docs.drop("epoch", "tokens", "take")
    # The level columns are packed, as a null is a value here and a hot leaf must be free to be split.
    leaf_key = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    rows = docs.withColumns(levels).withColumn("tokens", F.coalesce(tokens.cast("long"), F.lit(0))).where("tokens > 0")
    # The caller's expressions are worked out while its columns still have their names.
    id_ = F.coalesce(row_id.cast("string"), F.lit(""))
    _, aside = set_aside(docs.drop(*names))
    rows = rows.select(*[F.col(f"`{c}`").alias(aside.get(c, c)) for c in rows.columns], id_.alias("_id"), leaf_key.alias("_leaf"))
    slim = cut_lineage(rows.select(*names, "_leaf", "_id", "tokens"))
    leaf = slim.groupBy("_leaf", *names).agg(F.sum("tokens").alias("_held"))
    leaf = leaf.withColumns({f"_w{i}": F.greatest(F.coalesce(w.cast("long"), F.lit(0)), F.lit(0)) for i, w in enumerate(weights)})
    leaf = cut_lineage(leaf.withColumn("_supply", F.col("_held") * max_epochs))
    total = leaf.agg(F.sum("_held")).first()[0] or 0
    granted = budgets(leaf, names, [f"_w{i}" for i in range(len(weights))], "_supply", F.lit(int(total * fraction)))
    plan = cut_lineage(granted.where("granted > 0").select(
        "_leaf", F.expr("cast(granted div _held as int)").alias("_full"), F.expr("granted % _held").alias("_part")))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_full").cast("string"), "_id"))
    plan = plan.join(_edges(slim, plan, order), "_leaf", "left")
    drawn = _planned(rows, plan).withColumn("_at", F.struct(order.alias("o"), F.col("_id").alias("i")))
    last = F.call_function("div", _whole("_rest") * _whole("tokens"), _whole("_unit")).cast("long")
    some = F.when(F.col("_at") < F.col("_edge"), F.col("tokens")).when(F.col("_at") == F.col("_edge"), last).otherwise(F.lit(0))
    some = F.when(F.col("_part") > 0, some).otherwise(F.lit(0))
    entry = lambda e, take: F.struct(e.cast("int").alias("epoch"), take.cast("long").alias("take"))
    all_of_it = F.transform(F.sequence(F.lit(0), F.col("_full")), lambda e: entry(
        e, F.when(e < F.col("_full"), F.col("tokens")).otherwise(F.col("_some"))))
    keep = [*[aside.get(c, c) for c in docs.columns if c not in names], *names, "tokens"]
    taken = drawn.withColumn("_some", some).select(*keep, F.explode(all_of_it).alias("_e"))
    return put_back(taken.where("_e.take > 0").select(*keep, "_e.epoch", "_e.take"), aside)


def _planned(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows with their leaf's line of the plan. A leaf is dealt into SALTS parts by id, each with a copy of that line."""
    salt = F.pmod(F.xxhash64("_id"), F.lit(SALTS))
    salted = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("_salt", salt).join(salted, ["_leaf", "_salt"]).drop("_salt")


def _edges(slim: DataFrame, plan: DataFrame, order: Column) -> DataFrame:
    """For each leaf with a part of an epoch: the id its budget ends in (``_edge``), the
    tokens of all rows with that id (``_unit``) and how many of them still fit (``_rest``).

    A leaf's order is cut into pieces by the first digits of the hash; the pieces' sums
    tell in which one the budget ends, and only that piece is put in order.
    """
    part = _planned(slim, plan.where("_part > 0")).select("_leaf", "_part", "tokens", "_id", order.alias("_order"))
    part = part.withColumn("_piece", F.substring("_order", 1, PIECE_DIGITS))
    before = lambda *by: Window.partitionBy("_leaf").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    pieces = part.groupBy("_leaf", "_part", "_piece").agg(F.sum("tokens").alias("_sum"))
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_sum").over(before("_piece")), F.lit(0)))
    ends = pieces.where("_before < _part and _before + _sum >= _part").select("_leaf", "_piece", "_before")
    units = part.join(ends, ["_leaf", "_piece"]).groupBy("_leaf", "_part", "_before", "_order", "_id").agg(F.sum("tokens").alias("_unit"))
    units = units.withColumn("_start", F.col("_before") + F.coalesce(F.sum("_unit").over(before("_order", "_id")), F.lit(0)))
    return units.where("_start < _part and _start + _unit >= _part").select(
        "_leaf", F.struct(F.col("_order").alias("o"), F.col("_id").alias("i")).alias("_edge"), "_unit",
        (F.col("_part") - F.col("_start")).alias("_rest"))
