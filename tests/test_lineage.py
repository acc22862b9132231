from __future__ import annotations

import random

import pytest

from weftline.operators.lineage import (
    Required,
    blocked_nodes,
    cycle_nodes,
    dangling,
    degrees,
    has_cycle,
    heal_links,
    orphans,
    required_values,
    topo_levels,
    validation_report,
)


def frame(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


def nodes_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def peel(edges):
    nodes = {n for e in edges for n in e}
    left, levels, level = set(edges), {}, 0
    while True:
        free = {n for n in nodes if n not in levels and not any(d == n for _, d in left)}
        if not free:
            return levels, nodes - set(levels)
        levels.update({n: level for n in free})
        left = {e for e in left if e[0] not in free}
        level += 1


@pytest.mark.parametrize("seed", range(3))
def test_levels_and_blocked_nodes(spark, seed):
    pick = random.Random(seed)
    edges = [(f"n{pick.randrange(12)}", f"n{pick.randrange(12)}") for _ in range(12)]
    edges += edges[:3] + [("x", "y"), ("y", "z"), ("x", "z")]
    levels, blocked = peel(edges)
    df = frame(spark, edges)
    assert {r["node"]: r["level"] for r in topo_levels(df).collect()} == levels
    assert {r["node"] for r in blocked_nodes(df).collect()} == blocked
    assert has_cycle(df).first()["has_cycle"] == bool(blocked)


@pytest.mark.parametrize("seed", range(3))
def test_nodes_on_cycles_and_behind_them(spark, seed):
    pick = random.Random(seed)
    edges = [(f"n{pick.randrange(14):02}", f"n{pick.randrange(14):02}") for _ in range(18)]
    # Two rings with a bridge, a loop, a tail, and a way in.
    edges += [("a", "b"), ("b", "c"), ("c", "a"), ("c", "x"), ("x", "y"), ("y", "p"), ("p", "q"), ("q", "p"), ("q", "t"), ("in", "a"), ("l", "l"), ("l", "m"), (None, "a")]
    reach = {(s, d) for s, d in edges if s and d}
    while (more := reach | {(a, d) for a, b in reach for c, d in reach if b == c}) != reach:
        reach = more
    on = {a for a, b in reach if a == b}
    blocked = on | {b for a, b in reach if a in on}
    assert {r.node: r.on_cycle for r in cycle_nodes(frame(spark, edges)).collect()} == {n: n in on for n in blocked}
    assert cycle_nodes(frame(spark, [("a", "b")])).count() == 0


def test_levels_write_no_more_with_depth(spark):
    """All that the rounds write together: each edge and each node once or twice, not once a level."""
    from pathlib import Path

    from weftline.session import scratch_made
    before = {*scratch_made(spark)}
    depth = 12
    edges = [(f"a{i}", f"a{i + 1}") for i in range(depth)] + [(f"s{i}", f"w{i}") for i in range(400)]
    assert topo_levels(frame(spark, edges)).count() == depth + 1 + 800
    rows = sum(spark.read.option("recursiveFileLookup", True).parquet(p).count() for p in scratch_made(spark) if p not in before and Path(p.removeprefix("file:")).exists())
    assert rows <= 2 * len(edges) + 2 * (depth + 1 + 800)


def test_levels_edge_cases(spark):
    empty = frame(spark, [])
    assert topo_levels(empty).count() == 0 and not has_cycle(empty).first()["has_cycle"]
    loop = frame(spark, [("a", "a")])
    assert topo_levels(loop).count() == 0 and has_cycle(loop).first()["has_cycle"]
    chain = frame(spark, [(f"n{i}", f"n{i + 1}") for i in range(5)])
    assert {r["node"]: r["level"] for r in topo_levels(chain).collect()} == {f"n{i}": i for i in range(6)}
    with pytest.raises(ValueError, match="max_levels"):
        topo_levels(chain, max_levels=3)


def test_degrees(spark):
    df = frame(spark, [("a", "b"), ("a", "b"), ("b", "c")])
    assert {r["node"]: (r["in_degree"], r["out_degree"]) for r in degrees(df).collect()} \
        == {"a": (0, 2), "b": (2, 1), "c": (1, 0)}


def test_dangling_and_orphans(spark):
    edges = frame(spark, [("a", "b"), ("a", "gone"), ("lost", "gone"), (None, "b")])
    nodes = nodes_of(spark, ["a", "b", "alone"])
    assert sorted((r["side"], r["missing"]) for r in dangling(edges, nodes).collect()) \
        == [("dst", "gone"), ("dst", "gone"), ("src", "lost")]
    assert [r["node"] for r in orphans(nodes, edges).collect()] == ["alone"]
    assert orphans(nodes_of(spark, ["only"]), frame(spark, [])).count() == 0


def test_required_values_and_report(spark):
    nodes = spark.createDataFrame(
        [("q1", "query", "SELECT 1", None), ("q2", "query", " ", None), ("l1", "lookup", None, None),
         ("s1", "stub", None, "x")], "node string, type string, sql string, service string")
    rules = [Required("query", "sql", "error", "no SQL"), Required("lookup", "service", "warning", "no service")]
    findings = required_values(nodes, rules)
    assert sorted(tuple(r) for r in findings.collect()) \
        == [("l1", "warning", "no service"), ("q2", "error", "no SQL")]
    bad = frame(spark, [("q1", "q2"), ("q2", "q1"), ("q1", "nowhere")])
    assert validation_report(nodes, bad, findings).first().asDict() == {
        "valid": False, "errors": 3, "warnings": 3, "node_count": 4, "edge_count": 3}
    good = frame(spark, [("q1", "l1"), ("l1", "s1"), ("q1", "q2")])
    none = findings.limit(0)
    assert validation_report(nodes, good, none).first().asDict() == {
        "valid": True, "errors": 0, "warnings": 0, "node_count": 4, "edge_count": 3}


NODES = [
    ("s1", "DUAL", "source", 1), ("s2", "DUA", "source", 2), ("s3", "OTHER", "source", 3),
    ("t1", "sq_dual_core", "transform", 4), ("t2", "exp_used", "transform", 5),
    ("t3", "exp_loose", "transform", 6), ("t4", "fil_last", "transform", 7),
    ("g1", "OUT", "target", 8), ("g2", "FILE", "target", 9),
]


def test_heal_links(spark):
    nodes = spark.createDataFrame(NODES, "node string, name string, role string, position int")
    edges = frame(spark, [("t1", "t2"), ("t2", "t4"), ("t2", "g1")])
    assert sorted(tuple(r) for r in heal_links(nodes, edges).collect()) == [
        ("s1", "t1", "name"), ("t2", "t3", "anchor"), ("t4", "g2", "target")]


def test_heal_links_without_edges(spark):
    nodes = spark.createDataFrame(NODES[3:], "node string, name string, role string, position int") \
        .unionByName(spark.createDataFrame([("s9", "ZZZ", "source", 0)], "node string, name string, role string, position int"))
    got = sorted(tuple(r) for r in heal_links(nodes, frame(spark, [])).collect())
    # The start link leaves from a source, so no transform can anchor the others.
    assert got == [("s9", "t1", "start"), ("t4", "g1", "target"), ("t4", "g2", "target")]
