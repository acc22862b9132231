from __future__ import annotations

from pyspark.sql import functions as F

from weftline import functions as E
from weftline.operators.custom import custom_column, custom_rows
from weftline.operators.expand import normalizer, split_records, union_all
from weftline.operators.project import (
    expression,
    filter_rows,
    mapplet,
    passthrough,
    predicate,
    router,
    router_split,
    split_valid,
    update_record,
)
from weftline.operators.types import Field, conform, map_types
from weftline.plans.catalog import query


@query("expression_select", """
    SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net,
           l_returnflag || l_linestatus AS flags FROM lineitem""")
def expression_select(t):
    return expression(t.lineitem, {
        "l_orderkey": None, "l_linenumber": None,
        "net": "l_extendedprice * (1 - l_discount)",
        "flags": E.concat("l_returnflag", "l_linestatus"),
    })


@query("update_record", """
    SELECT c_custkey, upper(c_name) AS c_name, c_nationkey, c_acctbal + 1 AS c_acctbal,
           c_mktsegment FROM customer""")
def update_record_query(t):
    return update_record(
        t.customer,
        {"c_name": E.upper("c_name"), "c_acctbal": "c_acctbal + 1", "c_mktsegment": "'unused'"},
        input_only=("c_mktsegment",),
    )


@query("passthrough", "SELECT * FROM supplier")
def passthrough_query(t):
    return passthrough(t.supplier)


@query("mapplet", """
    SELECT p_partkey, upper(p_name) AS p_name, p_size * 2 AS doubled FROM part WHERE p_size > 10""")
def mapplet_query(t):
    clean = mapplet(
        lambda df: filter_rows(df, "p_size > 10"),
        lambda df: update_record(df, {"p_name": E.upper("p_name")}),
        lambda df: expression(df, {"p_partkey": None, "p_name": None, "doubled": "p_size * 2"}),
    )
    return t.part.transform(clean)


@query("filter_rows", """
    SELECT o_orderkey, o_totalprice FROM orders
    WHERE nullif(o_orderstatus, 'P') <> 'F' AND o_totalprice > 100000""")
def filter_rows_query(t):
    status = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    kept = filter_rows(t.orders, (status != "F") & (F.col("o_totalprice") > 100000))
    return kept.select("o_orderkey", "o_totalprice")


def _routes():
    status = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    return {
        "large": F.col("o_totalprice") > 300000,
        "open": status == "O",
        "urgent": F.col("o_orderpriority") == "1-URGENT",
    }


@query("router", """
    WITH r AS (SELECT o_orderkey, o_totalprice > 300000 AS a, nullif(o_orderstatus,'P') = 'O' AS b,
                      o_orderpriority = '1-URGENT' AS c FROM orders)
    SELECT o_orderkey, 'large' AS route FROM r WHERE a
    UNION ALL SELECT o_orderkey, 'open' FROM r WHERE b
    UNION ALL SELECT o_orderkey, 'urgent' FROM r WHERE c
    UNION ALL SELECT o_orderkey, 'unmatched' FROM r
    WHERE NOT (coalesce(a, false) OR coalesce(b, false) OR coalesce(c, false))""")
def router_query(t):
    return router(t.orders, _routes()).select("o_orderkey", "route")


@query("router_unmatched", """
    SELECT o_orderkey, o_orderstatus FROM orders
    WHERE NOT (o_totalprice > 300000 OR coalesce(nullif(o_orderstatus,'P') = 'O', false)
               OR o_orderpriority = '1-URGENT')""")
def router_unmatched(t):
    return router_split(t.orders, _routes())["unmatched"].select("o_orderkey", "o_orderstatus")


@query("predicates", """
    SELECT event_id, nullif(event_type,'error') = 'click' AS is_click, user_id = 8 AS is_user,
           nullif(event_type,'error') IS NULL AS missing,
           nullif(event_type,'error') IS NOT NULL AS known FROM events""")
def predicates(t):
    events = t.events.withColumn("kind", F.nullif(F.col("event_type"), F.lit("error")))
    return events.select(
        "event_id", predicate("kind", "equals", "click").alias("is_click"),
        predicate("user_id", "equals", 8).alias("is_user"),
        predicate("kind", "is null").alias("missing"),
        predicate("kind", "is not null").alias("known"),
    )


@query("reject_rows", """
    SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%LOW' THEN o_orderpriority
                            ELSE substr(o_orderpriority, 1, 1) END AS level,
           CASE WHEN o_orderpriority LIKE '%LOW' THEN 'level: not int' ELSE '' END AS reject_reason
    FROM orders""")
def reject_rows(t):
    low = F.col("o_orderpriority").endswith("LOW")
    level = F.when(low, F.col("o_orderpriority")).otherwise(E.substr("o_orderpriority", 1, 1))
    valid, bad = split_valid(t.orders.select("o_orderkey", level.alias("level")), {"level": "int"})
    valid = valid.withColumns({"level": F.col("level").cast("string"), "reject_reason": F.lit("")})
    return union_all(valid, bad)


@query("union_all", """
    SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
    UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier
    UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier""")
def union_all_query(t):
    customers = t.customer.select(
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"))
    suppliers = t.supplier.select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    return union_all(customers, suppliers, suppliers)


@query("normalizer", """
    SELECT l_orderkey, l_linenumber, 1 AS occurrence, l_quantity AS value FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 2, l_tax + 0.0::DOUBLE FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 3, l_discount + 0.0::DOUBLE FROM lineitem""")
def normalizer_query(t):
    rates = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_quantity",
        (F.col("l_tax") + F.lit(0.0)).alias("l_tax"),
        (F.col("l_discount") + F.lit(0.0)).alias("l_discount"))
    return normalizer(rates, ["l_quantity", "l_tax", "l_discount"])


@query("split_records", """
    WITH w AS (SELECT doc_id, string_split(text, ' ') AS words FROM documents)
    SELECT doc_id, i::INTEGER AS fragment, words[i] AS record
    FROM w, LATERAL (SELECT unnest(generate_series(1, len(words))) AS i)""")
def split_records_query(t):
    words = t.documents.select("doc_id", F.split("text", " ").alias("words"))
    return split_records(words, "words")


_FIELDS = [
    Field("p_name", "VARCHAR2(6)"), Field("p_partkey", "integer"),
    Field("p_retailprice", "NUMBER(12,1)"), Field("p_size", "smallint"),
    Field("p_brand", "decimal", 10, 2),
]


@query("conform_schema", """
    SELECT left(p_name, 6) AS p_name, p_partkey::INTEGER AS p_partkey,
           round(p_retailprice::DECIMAL(18,2), 1)::DOUBLE AS p_retailprice,
           p_size::SMALLINT AS p_size, NULL::DOUBLE AS p_brand FROM part""")
def conform_schema(t):
    price = {n: F.col(n).cast("double") for n in ("p_retailprice", "p_brand")}
    return conform(t.part, _FIELDS).withColumns(price)


@query("conform_reject", """
    SELECT p_name, p_partkey, p_size,
           CASE WHEN length(p_name) > 8 AND p_size > 40 THEN 'p_name: too long; code: not int'
                WHEN length(p_name) > 8 THEN 'p_name: too long' ELSE 'code: not int' END AS reject_reason,
           CASE WHEN p_size > 40 THEN p_brand ELSE p_size::VARCHAR END AS code
    FROM part WHERE length(p_name) > 8 OR p_size > 40""")
def conform_reject(t):
    code = F.when(F.col("p_size") > 40, F.col("p_brand")).otherwise(F.col("p_size").cast("string"))
    fields = [Field("p_name", "string", 8), Field("p_partkey", "bigint"), Field("p_size", "int"),
              Field("code", "integer")]
    return conform(t.part.withColumn("code", code), fields, on_error="reject")


@query("map_type_names", """
    WITH d AS (SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'VARCHAR2(' || p_size || ')'
        WHEN 'LARGE' THEN ' Number(' || p_size || ',2)' WHEN 'MEDIUM' THEN 'date/time'
        WHEN 'PROMO' THEN 'Money' WHEN 'SMALL' THEN 'BLOB' ELSE 'geometry' END AS declared FROM part)
    SELECT p_partkey, declared, trim(regexp_replace(lower(declared), '\\s*\\([^()]*\\)\\s*$', '')) AS base_type,
        CASE trim(regexp_replace(lower(declared), '\\s*\\([^()]*\\)\\s*$', ''))
            WHEN 'varchar2' THEN 'string' WHEN 'number' THEN 'decimal(' || regexp_extract(declared, '([0-9]+),', 1) || ',2)' WHEN 'date/time' THEN 'timestamp'
            WHEN 'money' THEN 'decimal(19,4)' WHEN 'blob' THEN 'binary' ELSE 'string' END AS spark_type
    FROM d""")
def map_type_names(t):
    size = F.col("p_size").cast("string")
    declared = E.decode(
        "p_type", "ECONOMY", F.concat(F.lit("VARCHAR2("), size, F.lit(")")),
        "LARGE", F.concat(F.lit(" Number("), size, F.lit(",2)")),
        "MEDIUM", "date/time", "PROMO", "Money", "SMALL", "BLOB", "geometry")
    return map_types(t.part.select("p_partkey", declared.alias("declared")), "declared")


@query("custom_rows", """
    SELECT doc_id, len(list_filter(string_split(text, ' '), lambda w: w <> ''))::BIGINT AS words,
           len(string_split(text, chr(10)))::BIGINT AS lines FROM documents""")
def custom_rows_query(t):
    def measure(batch):
        words = batch["text"].str.split(" ").map(lambda ws: sum(1 for w in ws if w))
        lines = batch["text"].str.count("\n") + 1
        return batch[["doc_id"]].assign(words=words, lines=lines)

    return custom_rows(t.documents.select("doc_id", "text"), measure, "doc_id long, words long, lines long")


@query("custom_column", """
    SELECT o_orderkey, round(o_totalprice * 1.1, 4) AS gross FROM orders""")
def custom_column_query(t):
    gross = custom_column(lambda price: price * 1.1, "double")
    return t.orders.select("o_orderkey", F.round(gross("o_totalprice"), 4).alias("gross"))
