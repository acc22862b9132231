from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators.ordering import rank, sequence, sorter, top_k
from weftline.plans.catalog import query


@query("rank_global", """
    SELECT o_orderkey, o_totalprice,
           row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS "RANK_COL" FROM orders""")
def rank_global(t):
    return rank(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", desc=True,
                tiebreak=["o_orderkey"])


@query("rank_partitioned", """
    SELECT o_orderkey, o_orderstatus, o_orderdate,
           row_number() OVER (PARTITION BY nullif(o_orderstatus,'P') ORDER BY o_orderdate, o_orderkey) AS "RANK_COL"
    FROM (SELECT o_orderkey, nullif(o_orderstatus,'P') AS o_orderstatus, o_orderdate FROM orders)""")
def rank_partitioned(t):
    """Three partitions, one of them of nulls; each is numbered by several tasks."""
    status = F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus")
    return rank(t.orders.select("o_orderkey", status, "o_orderdate"), "o_orderdate",
                tiebreak=["o_orderkey"], partition=["o_orderstatus"])


@query("sequence", """
    SELECT event_id, ts, 1000 + 5 * (row_number() OVER (ORDER BY ts, event_id) - 1) AS seq FROM events""")
def sequence_query(t):
    return sequence(t.events.select("event_id", "ts"), "seq", order_by=["ts", "event_id"],
                    start=1000, step=5)


@query("sorter", """
    SELECT p_partkey, p_retailprice,
           row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS position FROM part""")
def sorter_query(t):
    return sorter(t.part.select("p_partkey", "p_retailprice"), "p_retailprice", desc=True,
                  tiebreak=["p_partkey"], position="position")


@query("top_k", """
    SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def top_k_query(t):
    return top_k(t.orders.select("o_orderkey", "o_totalprice"),
                 [F.desc("o_totalprice"), F.asc("o_orderkey")], 100)


@query("rank_ties", """
    SELECT l_returnflag, "RANK_COL" FROM (
        SELECT l_returnflag, row_number() OVER (ORDER BY l_returnflag DESC) AS "RANK_COL" FROM lineitem)""")
def rank_ties(t):
    """Three values over all rows and no tie-break: which of the tied rows comes first is open, the places are not."""
    ranked = rank(t.lineitem.select("l_returnflag", "l_orderkey", "l_linenumber"), "l_returnflag", desc=True)
    return ranked.select("l_returnflag", "RANK_COL")
