"""Checks and repairs over lineage held as node and edge tables.

Edges have ``src`` and ``dst``; nodes have ``node``.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.joins import lookup, lookup_split
from weftline.operators.names import contained_in
from weftline.session import cut_counted, cut_lineage, scratch_path


def degrees(edges: DataFrame) -> DataFrame:
    """In- and out-degree per node, counting repeated edges."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")),
    )).alias("e")).select("e.*")
    return ends.groupBy("node").agg(
        F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree")
    )


def _peel(edges: DataFrame, max_levels: int | None) -> tuple[DataFrame, DataFrame]:
    """Take off nodes without incoming edges, level by level. Returns (node, level) and
    the nodes that never came free.

    Edges and the number of inputs of each node are written once. A round writes its
    frontier and, for each node that the frontier leads to, how many inputs that took off;
    a node is free once these sum up to its inputs. So all rounds together write as many
    rows as there are edges and nodes, whatever the depth.
    """
    spark = edges.sparkSession
    table, taken = scratch_path(spark, "levels"), scratch_path(spark, "taken")
    pairs, edge_count = cut_counted(edges.select("src", "dst").dropna().distinct())
    inputs = cut_lineage(pairs.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("inputs")))
    sources = pairs.select(F.col("src").alias("node")).distinct()
    free, free_count = cut_counted(sources.join(inputs, "node", "left_anti"), f"{table}/level=0")
    level = 0
    while free_count and edge_count:
        level += 1
        if level == max_levels:
            raise ValueError(f"the graph is deeper than max_levels={max_levels}")
        led, _ = lookup_split(pairs, free, {"src": "node"}, unique=True)
        reached, _ = cut_counted(led.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")), f"{taken}/round={level}")
        # Only what was reached just now can come free.
        so_far = spark.read.schema(reached.schema).parquet(taken).join(reached.select("node"), "node", "left_semi")
        done = so_far.groupBy("node").agg(F.sum("n").alias("n")).join(inputs, "node").where("n = inputs").select("node")
        free, free_count = cut_counted(done, f"{table}/level={level}")
    schema = T.StructType([*free.schema.fields, T.StructField("level", T.IntegerType())])
    levels = spark.read.schema(schema).parquet(table)
    return levels, inputs.select("node").join(levels, "node", "left_anti")


def topo_levels(edges: DataFrame, max_levels: int | None = None) -> DataFrame:
    """Execution level per node: 0 without inputs, else one more than its deepest input.
    Nodes on a cycle or behind one have no level and do not appear. One round per level;
    every round takes at least one node off, so cycles end it too."""
    return _peel(edges, max_levels)[0]


def blocked_nodes(edges: DataFrame, max_levels: int | None = None) -> DataFrame:
    """Nodes on a cycle or downstream of one."""
    return _peel(edges, max_levels)[1]


def has_cycle(edges: DataFrame, max_levels: int | None = None) -> DataFrame:
    blocked = blocked_nodes(edges, max_levels)
    return blocked.agg((F.count("*") > 0).alias("has_cycle"))


def cycle_nodes(edges: DataFrame, max_levels: int | None = None) -> DataFrame:
    """The blocked nodes with ``on_cycle``: whether a node is on a cycle itself or only behind one.

    What leads into no cycle is peeled off from the other end. Of the rest, the strongly
    connected parts are found by colours: every node takes the greatest name that reaches
    it; a node that keeps its own name is the root of its part, which is what can be reached
    from it backwards within its colour. Parts are taken out and the rest is coloured again.
    """
    pairs = edges.select("src", "dst").dropna().distinct()
    blocked = cut_lineage(blocked_nodes(pairs, max_levels))
    left, count = cut_counted(_among(pairs, blocked))
    found = [left.where("src = dst").select(F.col("src").alias("node"))]
    while count:
        back = cut_lineage(blocked_nodes(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")), max_levels))
        core, count = cut_counted(_among(left, back).where("src <> dst"))
        if not count:
            break
        colours = _spread_greatest(core)
        inside = core.join(colours.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src") \
            .join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b").select("src", "dst")
        inside = cut_lineage(inside)
        part = _behind(inside, colours.where("node = colour").select("node"))
        # A root without any other node in its part is on no cycle.
        found.append(part.where("steps > 0").select("node"))
        alone = part.where("steps = 0").select("node")
        back_to = inside.join(part.where("steps > 0").select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"))
        found.append(alone.join(back_to.distinct(), "node", "left_semi"))
        rest = _ends(core).join(part, "node", "left_anti")
        left, count = cut_counted(_among(core, rest))
    on = found[0]
    for more in found[1:]:
        on = on.unionByName(more)
    return lookup(blocked, on.distinct().withColumn("_on", F.lit(True)), {"node": "node"}, ["_on"], unique=True).select(
        "node", F.coalesce("_on", F.lit(False)).alias("on_cycle"))


def _among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among the nodes."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(
        nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


def _spread_greatest(edges: DataFrame) -> DataFrame:
    """(node, colour): the greatest node that reaches each node, itself included."""
    colours, changed = cut_lineage(_ends(edges).select("node", F.col("node").alias("colour"), F.lit(True).alias("new"))), 1
    while changed:
        # Only colours that were new in the last round can change others.
        sent = edges.join(colours.where("new").select(F.col("node").alias("src"), "colour"), "src") \
            .groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("sent"))
        joined = colours.drop("new").join(sent, "node", "left")
        new = F.coalesce(F.col("sent") > F.col("colour"), F.lit(False))
        colours = cut_lineage(joined.select("node", F.when(new, F.col("sent")).otherwise(F.col("colour")).alias("colour"), new.alias("new")))
        changed = colours.where("new").limit(1).count()
    return colours.select("node", "colour")


def _behind(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, steps): the nodes that lead to the roots, and how many edges away they were first met."""
    table = scratch_path(edges.sparkSession, "behind")
    last, count = cut_counted(roots, f"{table}/steps=0")
    schema = T.StructType([*last.schema.fields, T.StructField("steps", T.IntegerType())])
    steps = 0
    while count:
        steps += 1
        known = edges.sparkSession.read.schema(schema).parquet(table)
        before = edges.join(last.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        last, count = cut_counted(before.join(known, "node", "left_anti"), f"{table}/steps={steps}")
    return edges.sparkSession.read.schema(schema).parquet(table)


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an endpoint that is no node, once per such side."""
    sides = F.array(*[
        F.struct(F.lit(side).alias("side"), F.col(side).alias("missing")) for side in ("src", "dst")
    ])
    ends = edges.select("*", F.inline(sides)).where(F.col("missing").isNotNull())
    return lookup_split(ends, nodes, {"missing": "node"})[1]


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes on no edge; a single node on its own is not an orphan."""
    alone = nodes.join(_ends(edges), "node", "left_anti")
    several = nodes.select("node").limit(2).agg((F.count("*") > 1).alias("several"))
    return alone.where(several.scalar())


class Required(NamedTuple):
    """A column that rows of a type must fill."""

    type: str
    column: str
    severity: str
    message: str


def required_values(nodes: DataFrame, rules: Sequence[Required], type_column: str = "type") -> DataFrame:
    """One row (node, severity, message) per node and rule that is broken, in one pass."""
    broken = F.array_compact(F.array(*[
        F.when(
            (F.col(type_column) == r.type)
            & F.coalesce(F.trim(F.col(r.column).cast("string")) == "", F.lit(True)),
            F.struct(F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message")),
        )
        for r in rules
    ]))
    return nodes.select("node", F.inline(broken))


def validation_report(
    nodes: DataFrame, edges: DataFrame, findings: DataFrame, max_levels: int | None = None
) -> DataFrame:
    """One row: valid flag, error and warning counts, node and edge counts.

    Errors are the ``findings`` of severity error, dangling edge ends and a cycle (one);
    warnings are the other findings and the orphans.
    """
    severity = F.when(F.col("severity") == "error", "error").otherwise("warning")
    # Each input is read once, as it is written with its count; the rest reads those.
    nodes, node_count = cut_counted(nodes.select("node"))
    edges, edge_count = cut_counted(edges.select("src", "dst"))
    seen = Observation()
    bad = F.col("severity") == "error"
    findings.observe(seen, F.count_if(bad).alias("errors"), F.count_if(~F.coalesce(bad, F.lit(False))).alias("warnings")) \
        .write.format("noop").mode("overwrite").save()
    # One row for each name on either side: how often it is a node, how often an end of an edge.
    names = nodes.select("node", F.lit(1).alias("n"), F.lit(0).alias("ends")).unionByName(
        edges.select(F.explode(F.array("src", "dst")).alias("node"), F.lit(0).alias("n"), F.lit(1).alias("ends")))
    each = names.where("node is not null").groupBy("node").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    dangling_ends = F.sum(F.when(F.col("n") == 0, F.col("ends")).otherwise(0))
    alone = F.sum(F.when(F.col("ends") == 0, F.col("n")).otherwise(0))
    blocked = has_cycle(edges, max_levels)
    nameless = nodes.where("node is null").agg(F.count("*").alias("nameless"))
    found = each.agg(F.coalesce(dangling_ends, F.lit(0)).alias("dangling"), F.coalesce(alone, F.lit(0)).alias("alone"))
    errors = F.lit(seen.get["errors"]) + F.col("dangling") + blocked.scalar().cast("long")
    orphan = F.when(F.lit(node_count > 1), F.col("alone") + nameless.scalar()).otherwise(0)
    warnings = F.lit(seen.get["warnings"]) + orphan
    return found.select(
        (errors == 0).alias("valid"), errors.cast("long").alias("errors"), warnings.cast("long").alias("warnings"),
        F.lit(node_count).cast("long").alias("node_count"), F.lit(edge_count).cast("long").alias("edge_count"),
    )


def heal_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges to add so that nothing is stranded, with the reason of each.

    ``nodes`` has ``node``, ``name``, ``role`` (source, transform, target) and
    ``position``. Without any edge, the last source is first linked to the first
    transform. Then, in turn: sources without an outgoing edge go to transforms without an
    incoming one whose name contains theirs (the first such source by position); other
    transforms without an incoming edge hang off the last transform that has an outgoing
    one; targets without an incoming edge hang off the last transform.
    """
    # Read several times below; written once, in case they are not plain scans.
    nodes, (edges, edge_count) = cut_counted(nodes)[0], cut_counted(edges)
    sources = nodes.where("role = 'source'")
    transforms = nodes.where("role = 'transform'")
    targets = nodes.where("role = 'target'")
    begin = None
    if not edge_count:
        begin = sources.agg(F.max_by("node", "position").alias("src")).select(
            "src",
            transforms.agg(F.min_by("node", "position")).scalar().alias("dst"),
            F.lit("start").alias("reason"),
        ).dropna()
        edges = begin
    starts = edges.select(F.col("src").alias("node")).distinct()
    arrived = edges.select(F.col("dst").alias("node")).distinct()

    loose_sources = sources.join(starts, "node", "left_anti")
    loose_transforms = transforms.join(arrived, "node", "left_anti")
    pairs = contained_in(loose_sources, loose_transforms, "name", "name")
    # The first source per inner name is enough, whatever the number of equal names.
    first_source = loose_sources.groupBy(F.col("name").alias("inner_name")) \
        .agg(F.min(F.struct("position", F.col("node").alias("src"))).alias("first"))
    chosen = pairs.join(first_source, "inner_name").groupBy("outer_name") \
        .agg(F.min("first").alias("first"))
    by_name = loose_transforms.join(chosen, loose_transforms["name"] == chosen["outer_name"]) \
        .select("first.src", F.col("node").alias("dst"), F.lit("name").alias("reason"))

    # A source linked by name has an outgoing edge now, but only transforms can anchor.
    anchor = transforms.join(starts, "node", "left_semi") \
        .agg(F.max_by("node", "position").alias("src"))
    stranded = loose_transforms.join(by_name.select(F.col("dst").alias("node")), "node", "left_anti")
    to_anchor = stranded.select(
        anchor.scalar().alias("src"), F.col("node").alias("dst"), F.lit("anchor").alias("reason")
    ).where("src != dst")

    last = transforms.agg(F.max_by("node", "position").alias("src"))
    to_targets = targets.join(arrived, "node", "left_anti").select(
        last.scalar().alias("src"), F.col("node").alias("dst"), F.lit("target").alias("reason")
    ).where(F.col("src").isNotNull())
    links = by_name.unionByName(to_anchor).unionByName(to_targets)
    return links if begin is None else begin.unionByName(links)
