"""Lineage checks over a graph of the tables' own keys, as ``kind:key`` nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators.expand import union_all
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
from weftline.plans.catalog import query

_EDGES_SQL = """
    edges AS (SELECT 'brand:' || p_brand AS src, 'type:' || p_type AS dst FROM part
        UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation
        UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
        UNION ALL SELECT 'region:' || n_regionkey, 'customer:' || min(c_custkey) FROM customer
                  JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 GROUP BY n_regionkey)"""

_NODES_SQL = """
    nodes AS (SELECT DISTINCT 'brand:' || p_brand AS node FROM part WHERE p_brand <> 'Brand#11'
        UNION ALL SELECT DISTINCT 'type:' || p_type FROM part WHERE p_type <> 'PROMO'
        UNION ALL SELECT 'nation:' || n_nationkey FROM nation UNION ALL SELECT 'region:' || r_regionkey FROM region
        UNION ALL SELECT 'customer:' || c_custkey FROM customer
        UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier)"""

# Longest path from the roots, over what no cycle reaches.
_LEVELS_SQL = f"""
    WITH RECURSIVE {_EDGES_SQL},
    pairs AS (SELECT DISTINCT src, dst FROM edges),
    reach(a, b) AS (SELECT src, dst FROM pairs UNION SELECT a, dst FROM reach JOIN pairs ON b = src),
    blocked AS (SELECT DISTINCT b AS node FROM reach WHERE a IN (SELECT a FROM reach WHERE a = b)),
    paths(node, level) AS (
        SELECT src, 0 FROM pairs WHERE src NOT IN (SELECT dst FROM pairs)
        UNION SELECT dst, level + 1 FROM paths JOIN pairs ON node = src
        WHERE dst NOT IN (SELECT node FROM blocked))"""


def _key(kind: str, column: str):
    return F.concat(F.lit(f"{kind}:"), F.col(column))


def _edges(t):
    pair = lambda df, a, b: df.select(a.alias("src"), b.alias("dst"))
    back = t.customer.join(t.nation.where("n_regionkey = 2"), F.col("c_nationkey") == F.col("n_nationkey")) \
        .groupBy("n_regionkey").agg(F.min("c_custkey").alias("c_custkey"))
    return union_all(
        pair(t.part, _key("brand", "p_brand"), _key("type", "p_type")),
        pair(t.nation, _key("nation", "n_nationkey"), _key("region", "n_regionkey")),
        pair(t.customer, _key("customer", "c_custkey"), _key("nation", "c_nationkey")),
        pair(back, _key("region", "n_regionkey"), _key("customer", "c_custkey")),
    )


def _nodes(t):
    node = lambda df, kind, column: df.select(_key(kind, column).alias("node"))
    return union_all(
        node(t.part.where("p_brand <> 'Brand#11'"), "brand", "p_brand").distinct(),
        node(t.part.where("p_type <> 'PROMO'"), "type", "p_type").distinct(),
        node(t.nation, "nation", "n_nationkey"), node(t.region, "region", "r_regionkey"),
        node(t.customer, "customer", "c_custkey"), node(t.supplier, "supplier", "s_suppkey"),
    )


@query("graph_degrees", f"""
    WITH {_EDGES_SQL} SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree
    FROM (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY node""")
def graph_degrees(t):
    return degrees(_edges(t))


@query("topo_levels", f"""{_LEVELS_SQL} SELECT node, max(level) AS level FROM paths
    WHERE node NOT IN (SELECT node FROM blocked) GROUP BY node""")
def topo_levels_query(t):
    return topo_levels(_edges(t))


@query("cycle_check", f"{_LEVELS_SQL} SELECT count(*) > 0 AS has_cycle FROM reach WHERE a = b")
def cycle_check(t):
    return has_cycle(_edges(t))


@query("blocked_nodes", f"{_LEVELS_SQL} SELECT node FROM blocked")
def blocked_nodes_query(t):
    return blocked_nodes(_edges(t))


@query("cycle_nodes", f"""
    {_LEVELS_SQL} SELECT node, node IN (SELECT a FROM reach WHERE a = b) AS on_cycle FROM blocked""")
def cycle_nodes_query(t):
    return cycle_nodes(_edges(t))


@query("orphan_nodes", f"""
    WITH {_EDGES_SQL}, {_NODES_SQL} SELECT node FROM nodes
    WHERE node NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)""")
def orphan_nodes(t):
    return orphans(_nodes(t), _edges(t))


@query("dangling_edges", f"""
    WITH {_EDGES_SQL}, {_NODES_SQL}
    SELECT src, dst, 'src' AS side, src AS missing FROM edges WHERE src NOT IN (SELECT node FROM nodes)
    UNION ALL SELECT src, dst, 'dst', dst FROM edges WHERE dst NOT IN (SELECT node FROM nodes)""")
def dangling_edges(t):
    return dangling(_edges(t), _nodes(t))


_REQUIRED = [
    Required("customer", "segment", "error", "customer has no segment"),
    Required("customer", "home", "warning", "customer has no home"),
    Required("supplier", "segment", "warning", "supplier has no segment"),
]

_FINDINGS_SQL = """
    findings AS (SELECT 'customer:' || c_custkey AS node, 'error' AS severity, 'customer has no segment' AS message
                 FROM customer WHERE c_mktsegment = 'MACHINERY'
        UNION ALL SELECT 'customer:' || c_custkey, 'warning', 'customer has no home' FROM customer
                  WHERE c_nationkey = 3
        UNION ALL SELECT 'supplier:' || s_suppkey, 'warning', 'supplier has no segment' FROM supplier)"""


def _findings(t):
    home = F.when(F.col("c_nationkey") == 3, " ").otherwise(F.col("c_nationkey").cast("string"))
    customers = t.customer.select(
        _key("customer", "c_custkey").alias("node"), F.lit("customer").alias("type"),
        F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")).alias("segment"), home.alias("home"))
    suppliers = t.supplier.select(_key("supplier", "s_suppkey").alias("node"), F.lit("supplier").alias("type"))
    return required_values(union_all(customers, suppliers), _REQUIRED)


@query("required_values", f"WITH {_FINDINGS_SQL} SELECT * FROM findings")
def required_values_query(t):
    return _findings(t)


@query("validation_report", f"""{_LEVELS_SQL}, {_NODES_SQL}, {_FINDINGS_SQL},
    c AS (SELECT
        (SELECT count(*) FROM findings WHERE severity = 'error')
        + (SELECT count(*) FROM edges WHERE src NOT IN (SELECT node FROM nodes))
        + (SELECT count(*) FROM edges WHERE dst NOT IN (SELECT node FROM nodes))
        + (SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM reach WHERE a = b) AS errors,
        (SELECT count(*) FROM findings WHERE severity <> 'error')
        + (SELECT count(*) FROM nodes WHERE node NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges))
          AS warnings,
        (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count)
    SELECT errors = 0 AS valid, errors::BIGINT AS errors, warnings::BIGINT AS warnings, node_count, edge_count FROM c""")
def validation_report_query(t):
    return validation_report(_nodes(t), _edges(t), _findings(t))


_HEAL_SQL = """
    WITH pairs AS (SELECT DISTINCT n_nationkey, n_name, n_regionkey, c_mktsegment AS segment
                   FROM customer JOIN nation ON c_nationkey = n_nationkey),
    nodes AS (SELECT 's:' || n_nationkey AS node, n_name AS name, 'source' AS role, n_nationkey AS position FROM nation
        UNION ALL SELECT 't:' || n_nationkey || ':' || segment, 'SQ_' || lower(n_name) || '_' || segment, 'transform',
                  100 + 10 * n_nationkey + instr('ABFHM', left(segment, 1)) FROM pairs
        UNION ALL SELECT DISTINCT 'x:' || segment, 'EXP_' || segment, 'transform',
                  1000 + instr('ABFHM', left(segment, 1)) FROM pairs
        UNION ALL SELECT 'r:' || r_regionkey, r_name, 'target', 2000 + r_regionkey FROM region),
    edges AS (SELECT 's:' || n_nationkey AS src, 't:' || n_nationkey || ':' || segment AS dst
              FROM pairs WHERE n_regionkey = 0
        UNION ALL SELECT 't:' || n_nationkey || ':' || segment, 'r:' || n_regionkey
              FROM pairs WHERE segment = 'BUILDING' AND n_regionkey < 3),
    loose AS (SELECT * FROM nodes WHERE role = 'transform' AND node NOT IN (SELECT dst FROM edges)),
    named AS (SELECT arg_min(s.node, s.position) AS src, l.node AS dst FROM loose l JOIN nodes s
              ON s.role = 'source' AND s.node NOT IN (SELECT src FROM edges)
              AND contains(upper(l.name), upper(s.name)) GROUP BY l.node)
    SELECT src, dst, 'name' AS reason FROM named
    UNION ALL SELECT (SELECT arg_max(node, position) FROM nodes WHERE role = 'transform'
                      AND node IN (SELECT src FROM edges)), node, 'anchor'
              FROM loose WHERE node NOT IN (SELECT dst FROM named)
    UNION ALL SELECT (SELECT arg_max(node, position) FROM nodes WHERE role = 'transform'), node, 'target'
              FROM nodes WHERE role = 'target' AND node NOT IN (SELECT dst FROM edges)"""


@query("heal_links", _HEAL_SQL)
def heal_links_query(t):
    pairs = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")) \
        .select("n_nationkey", "n_name", "n_regionkey", F.col("c_mktsegment").alias("segment")).distinct()
    initial = F.instr(F.lit("ABFHM"), F.left("segment", F.lit(1)))
    node = lambda df, key, name, role, position: df.select(
        key.alias("node"), name.alias("name"), F.lit(role).alias("role"), position.alias("position"))
    step = F.concat(F.lit("t:"), "n_nationkey", F.lit(":"), "segment")
    nodes = union_all(
        node(t.nation, F.concat(F.lit("s:"), "n_nationkey"), F.col("n_name"), "source", F.col("n_nationkey")),
        node(pairs, step, F.concat(F.lit("SQ_"), F.lower("n_name"), F.lit("_"), "segment"), "transform",
             100 + 10 * F.col("n_nationkey") + initial),
        node(pairs, F.concat(F.lit("x:"), "segment"), F.concat(F.lit("EXP_"), "segment"), "transform",
             1000 + initial).distinct(),
        node(t.region, F.concat(F.lit("r:"), "r_regionkey"), F.col("r_name"), "target", 2000 + F.col("r_regionkey")),
    )
    edges = pairs.where("n_regionkey = 0").select(
        F.concat(F.lit("s:"), "n_nationkey").alias("src"), step.alias("dst"),
    ).unionByName(pairs.where("segment = 'BUILDING' AND n_regionkey < 3").select(
        step.alias("src"), F.concat(F.lit("r:"), "n_regionkey").alias("dst")))
    return heal_links(nodes, edges)
