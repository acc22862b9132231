from __future__ import annotations

from pyspark.sql import functions as F

from weftline import functions as E
from weftline.operators.aggregates import (
    aggregator,
    batch_summary,
    complexity,
    confidence,
    count_by,
    count_usage,
    distinct_pairs,
)
from weftline.operators.rules import rule_lookup
from weftline.plans.catalog import query
from weftline.plans.joining import _RULES_SQL, part_rules

# Money is summed as decimal, so that the sum does not depend on the order of rows.
_MONEY = "cast(sum(cast({0} as decimal(18,2))) as double)"


@query("aggregator", """
    SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS sum_qty,
           sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS sum_price, max(l_shipdate) AS last_ship,
           count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def aggregator_query(t):
    return aggregator(t.lineitem, ["l_returnflag", "l_linestatus"], {
        "sum_qty": _MONEY.format("l_quantity"), "sum_price": _MONEY.format("l_extendedprice"),
        "last_ship": "max(l_shipdate)", "n": "count(*)"})


@query("aggregator_global", """
    SELECT sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS revenue, count(*) AS n,
           min(o_orderdate) AS first_order FROM orders""")
def aggregator_global(t):
    return aggregator(t.orders, (), {
        "revenue": _MONEY.format("o_totalprice"), "n": "count(*)", "first_order": "min(o_orderdate)"})


@query("count_by_type", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type")
def count_by_type(t):
    return count_by(t.part, "p_type")


@query("confidence_score", """
    WITH s AS (SELECT o_custkey, CASE WHEN o_orderstatus <> 'F' THEN round(o_totalprice / 500000, 3) END AS score,
                      o_orderpriority = '1-URGENT' AS penalty FROM orders),
    m AS (SELECT o_custkey, coalesce(sum(score::DECIMAL(10,3))::DOUBLE / count(score), 0.7)
                 - CASE WHEN bool_or(penalty) THEN 0.2 ELSE 0 END AS c FROM s GROUP BY o_custkey)
    SELECT o_custkey, round(greatest(0.0, least(1.0, c)), 6) AS confidence,
           greatest(0.0, least(1.0, c)) < 0.75 AS review_required FROM m""")
def confidence_score(t):
    scored = t.orders.select(
        "o_custkey",
        F.when(F.col("o_orderstatus") != "F", F.round(F.col("o_totalprice") / 500000, 3)).alias("score"),
        (F.col("o_orderpriority") == "1-URGENT").alias("penalty"))
    return confidence(scored, "o_custkey", "score", "penalty") \
        .withColumn("confidence", F.round("confidence", 6))


def _kinds(t):
    """Orders read as transformations of a mapping per customer."""
    kind = E.decode("o_orderpriority", "1-URGENT", "Joiner", "2-HIGH", "Aggregator",
                    "3-MEDIUM", "Expression", "5-LOW", "Router", "Filter")
    return t.orders.select("o_custkey", kind.alias("kind"))


@query("complexity_band", """
    WITH s AS (SELECT o_custkey,
        max(CASE o_orderpriority WHEN '1-URGENT' THEN 3 ELSE 0 END)
        + max(CASE o_orderpriority WHEN '2-HIGH' THEN 2 ELSE 0 END)
        + max(CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 ELSE 0 END)
        + max(CASE o_orderpriority WHEN '5-LOW' THEN 1 ELSE 0 END) AS score
        FROM orders GROUP BY o_custkey)
    SELECT o_custkey, score, CASE WHEN score <= 2 THEN 'SIMPLE' WHEN score <= 5 THEN 'MEDIUM'
           ELSE 'COMPLEX' END AS complexity FROM s""")
def complexity_band(t):
    return complexity(_kinds(t), "o_custkey", "kind")


@query("usage_count", f"""
    WITH {_RULES_SQL},
    hits AS (SELECT p_partkey, min(rule_id) AS rule_id FROM part
             JOIN rules ON approved AND starts_with(p_name, pattern) GROUP BY p_partkey),
    used AS (SELECT rule_id, count(*) AS n FROM hits GROUP BY rule_id)
    SELECT rule_id, pattern, 5 + coalesce(n, 0) AS usage_count FROM rules LEFT JOIN used USING (rule_id)""")
def usage_count(t):
    rules = part_rules(t)
    hits = rule_lookup(t.part, rules, "p_name").where("rule_id IS NOT NULL")
    counted = count_usage(rules.withColumn("usage_count", F.lit(5)), hits, "rule_id")
    return counted.select("rule_id", "pattern", "usage_count")


@query("batch_summary", """
    SELECT count(*) AS total, count(*) FILTER (WHERE NOT flag) AS passed,
           count(*) FILTER (WHERE flag) AS needs_review
    FROM (SELECT coalesce(nullif(o_orderstatus,'P') = 'F', false) AS flag FROM orders)""")
def batch_summary_query(t):
    status = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    return batch_summary(t.orders.select((status == "F").alias("flag")), "flag")


@query("distinct_edges", """
    SELECT DISTINCT 'brand:' || p_brand AS src, 'type:' || p_type AS dst FROM part""")
def distinct_edges(t):
    links = t.part.select(
        F.concat(F.lit("brand:"), "p_brand").alias("src"), F.col("p_name").alias("src_field"),
        F.concat(F.lit("type:"), "p_type").alias("dst"))
    return distinct_pairs(links)
