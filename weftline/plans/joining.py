from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators.joins import joiner, lookup, lookup_split, map_lookup, override
from weftline.operators.names import substring_link
from weftline.operators.rules import rule_lookup
from weftline.operators.vectors import nearest
from weftline.plans.catalog import query


@query("joiner_left", """
    SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer
    LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000""")
def joiner_left(t):
    orders = t.orders
    joined = joiner(t.customer, orders, {"c_custkey": "o_custkey"}, orders["o_totalprice"] > 250000)
    return joined.select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@query("joiner_cross", """
    SELECT o_orderkey, o_totalprice, largest, smallest FROM orders
    LEFT JOIN (SELECT max(o_totalprice) AS largest, min(o_totalprice) AS smallest FROM orders) ON 1=1""")
def joiner_cross(t):
    """No condition: every order meets the one row of totals."""
    totals = t.orders.agg(F.max("o_totalprice").alias("largest"), F.min("o_totalprice").alias("smallest"))
    return joiner(t.orders.select("o_orderkey", "o_totalprice"), totals)


@query("lookup", """
    WITH first_part AS (
        SELECT * FROM (SELECT p_name, p_partkey AS f_partkey, p_brand AS f_brand,
            row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part) WHERE n = 1)
    SELECT p_partkey, p.p_name, f_partkey, f_brand
    FROM (SELECT p_partkey, CASE WHEN p_size > 45 THEN 'none' ELSE p_name END AS p_name FROM part) p
    LEFT JOIN first_part f ON p.p_name = f.p_name""")
def lookup_query(t):
    """Reference keys repeat: the lowest part key of a name is used."""
    reference = t.part.select(
        "p_name", F.col("p_partkey").alias("f_partkey"), F.col("p_brand").alias("f_brand"))
    name = F.when(F.col("p_size") > 45, "none").otherwise(F.col("p_name"))
    rows = t.part.select("p_partkey", name.alias("p_name"))
    return lookup(rows, reference, {"p_name": "p_name"}, ["f_partkey", "f_brand"],
                  order_by=[F.col("f_partkey")])


@query("lookup_composite", """
    WITH r AS (SELECT l_orderkey AS k1, l_linenumber AS k2, max(l_quantity) AS most
               FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
    SELECT l_orderkey, l_linenumber, l_quantity, most FROM lineitem
    LEFT JOIN r ON l_orderkey = k1 AND l_linenumber = k2""")
def lookup_composite(t):
    returned = t.lineitem.where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"),
        F.col("l_quantity").alias("most"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    return lookup(rows, returned, {"l_orderkey": "k1", "l_linenumber": "k2"}, ["most"],
                  order_by=[F.col("most").desc()])


def _large_orders(t):
    return t.orders.where("o_totalprice > 400000")


@query("lookup_matched", """
    SELECT c_custkey, c_name FROM customer
    WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def lookup_matched(t):
    return lookup_split(t.customer, _large_orders(t), {"c_custkey": "o_custkey"})[0] \
        .select("c_custkey", "c_name")


@query("lookup_unmatched", """
    SELECT c_custkey, c_name FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def lookup_unmatched(t):
    return lookup_split(t.customer, _large_orders(t), {"c_custkey": "o_custkey"})[1] \
        .select("c_custkey", "c_name")


@query("map_lookup", """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE 'other' END AS status
    FROM orders""")
def map_lookup_query(t):
    names = {"F": "filled", "O": "open"}
    return map_lookup(t.orders, "o_orderstatus", "status", names, default="other") \
        .select("o_orderkey", "status")


_RULES_SQL = """
    rules AS (SELECT min(p_partkey) AS rule_id, split_part(p_name, ' ', 1) AS pattern,
                     'use ' || split_part(p_name, ' ', 1) AS replacement,
                     split_part(p_name, ' ', 1) <> 'red' AS approved
              FROM part GROUP BY split_part(p_name, ' ', 1)
              UNION ALL
              SELECT min(p_partkey) + 1000000, p_name, 'exactly ' || p_name, true FROM part GROUP BY p_name
              UNION ALL
              SELECT min(p_partkey) - 1000000, p_name, 'first ' || p_name, true FROM part
              WHERE p_name LIKE 'c%' GROUP BY p_name)"""


def part_rules(t):
    """Rules from the part names: one per first word (one of them not approved), one per
    whole name with a higher id, and for some names one with a lower id."""
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    by_word = t.part.groupBy(word.alias("pattern")).agg(F.min("p_partkey").alias("rule_id"))
    by_name = t.part.groupBy(F.col("p_name").alias("pattern")).agg(F.min("p_partkey").alias("rule_id"))
    columns = ["rule_id", "pattern", "replacement", "approved"]
    words = by_word.withColumns({
        "replacement": F.concat(F.lit("use "), "pattern"), "approved": F.col("pattern") != "red"})
    names = by_name.withColumns({
        "rule_id": F.col("rule_id") + 1000000,
        "replacement": F.concat(F.lit("exactly "), "pattern"), "approved": F.lit(True)})
    early = by_name.where("pattern LIKE 'c%'").withColumns({
        "rule_id": F.col("rule_id") - 1000000,
        "replacement": F.concat(F.lit("first "), "pattern"), "approved": F.lit(True)})
    return words.select(columns).unionByName(names.select(columns)).unionByName(early.select(columns))


def _texts(t):
    return t.part.select("p_partkey", F.concat(F.lit("  "), "p_name", F.lit(" size "), "p_size").alias("text"))


@query("rule_lookup", f"""
    WITH {_RULES_SQL},
    texts AS (SELECT p_partkey, '  ' || p_name || ' size ' || p_size AS text FROM part),
    hits AS (SELECT p_partkey, min(rule_id) AS rule_id FROM texts
             JOIN rules ON approved AND starts_with(trim(text), pattern) GROUP BY p_partkey)
    SELECT t.p_partkey, t.text, h.rule_id, r.replacement
    FROM texts t LEFT JOIN hits h USING (p_partkey) LEFT JOIN rules r USING (rule_id)""")
def rule_lookup_query(t):
    return rule_lookup(_texts(t), part_rules(t), "text")


_NEAREST_SQL = """
    WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    d AS (SELECT a.vec_id AS q, b.vec_id AS vec_id, list_distance(a.v, b.v) AS distance
          FROM e a JOIN e b ON a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, vec_id) AS n FROM d)"""


@query("nearest_neighbour", f"""{_NEAREST_SQL}
    SELECT q AS query_id, vec_id, round(1 - distance, 6) AS similarity, 1 AS place FROM r WHERE n = 1""")
def nearest_neighbour(t):
    """The nearest other vector of every vector."""
    queries = t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding")
    found = nearest(queries, t.embeddings, ("query_id", "embedding"), ("vec_id", "embedding"),
                    other_than_self=True)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("nearest_cells", f"""{_NEAREST_SQL}
    SELECT q AS query_id, vec_id, round(1 - distance, 6) AS similarity, 1 AS place FROM r WHERE n = 1""")
def nearest_cells(t):
    """The same search on the way that entries too many to send take."""
    queries = t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding")
    found = nearest(queries, t.embeddings, ("query_id", "embedding"), ("vec_id", "embedding"),
                    other_than_self=True, sent_numbers=0)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("nearest_threshold", """
    WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
    d AS (SELECT a.vec_id AS q, b.vec_id AS vec_id,
                 list_distance(list_transform(a.v, lambda x: x + a.label * 0.0047::DOUBLE), b.v) AS distance
          FROM e a JOIN e b ON true),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, vec_id) AS n FROM d)
    SELECT q AS query_id, vec_id, round(1 - distance, 6) AS similarity, n::INTEGER AS place
    FROM r WHERE n <= 3 AND 1 - distance > 0.80""")
def nearest_threshold(t):
    """Vectors moved away from the stored ones by label: those moved far match nothing."""
    moved = F.transform(
        F.col("embedding").cast("array<double>"), lambda x: x + F.col("label") * F.lit(0.0047))
    queries = t.embeddings.select(F.col("vec_id").alias("query_id"), moved.alias("moved"))
    found = nearest(queries, t.embeddings, ("query_id", "moved"), ("vec_id", "embedding"),
                    k=3, min_similarity=0.80)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("review_override", """
    SELECT o_orderkey, o_orderpriority,
           CASE WHEN o_totalprice > 450000 THEN 'R' WHEN o_orderpriority = '5-LOW' THEN 'L'
                ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def review_override(t):
    changed = F.when(F.col("o_totalprice") > 450000, "R").when(F.col("o_orderpriority") == "5-LOW", "L")
    corrections = t.orders.select("o_orderkey", "o_orderpriority", changed.alias("corrected")).dropna()
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return override(rows, corrections, ["o_orderkey", "o_orderpriority"], "o_orderstatus")


@query("substring_link", """
    WITH a AS (SELECT DISTINCT n_name AS source_name FROM nation
               UNION SELECT DISTINCT lower(n_name) || '_' || lower(c_mktsegment) || '_full'
               FROM customer JOIN nation ON c_nationkey = n_nationkey),
         b AS (SELECT DISTINCT 'stg_' || n_name || '_' || c_mktsegment AS stage_name
               FROM customer JOIN nation ON c_nationkey = n_nationkey
               UNION SELECT DISTINCT n_name || '_' || c_mktsegment
               FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT source_name, stage_name FROM a JOIN b
    ON contains(upper(stage_name), upper(source_name)) OR contains(upper(source_name), upper(stage_name))""")
def substring_link_query(t):
    pair = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")) \
        .select("n_name", "c_mktsegment").distinct()
    full = F.concat(F.lower("n_name"), F.lit("_"), F.lower("c_mktsegment"), F.lit("_full"))
    a = t.nation.select(F.col("n_name").alias("source_name")).union(pair.select(full))
    b = pair.select(F.concat_ws("_", F.lit("stg"), "n_name", "c_mktsegment").alias("stage_name")) \
        .union(pair.select(F.concat_ws("_", "n_name", "c_mktsegment")))
    return substring_link(a, b, "source_name", "stage_name")
