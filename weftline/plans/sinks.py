from __future__ import annotations

from pyspark.sql import functions as F

from weftline.plans.catalog import query
from weftline.session import scratch_path
from weftline.sinks import (
    append,
    compact,
    convert,
    fan_out,
    nest_packet,
    update_by_key,
    update_files,
    update_partitions,
    write_csv,
    write_files,
    write_json,
    write_routes,
)
from weftline.sources import read_files


@query("sink_replace", "SELECT * FROM customer")
def sink_replace(t):
    path = scratch_path(t.spark, "replace")
    write_files(t.supplier, path)
    write_files(t.customer, path)
    return t.spark.read.parquet(path)


@query("sink_insert", "SELECT * FROM supplier UNION ALL SELECT * FROM supplier WHERE s_acctbal > 0")
def sink_insert(t):
    path = scratch_path(t.spark, "insert")
    append(t.supplier, path)
    append(t.supplier.where("s_acctbal > 0"), path)
    return t.spark.read.parquet(path)


@query("sink_update", """
    WITH u AS (SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS price,
                      arg_max_null(nullif(o_orderpriority, '5-LOW'), (o_orderdate, o_orderkey)) AS priority
               FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
    SELECT c_custkey, c_name, CASE WHEN o_custkey IS NULL THEN c_acctbal ELSE price END AS c_acctbal,
           CASE WHEN o_custkey IS NULL THEN c_mktsegment ELSE priority END AS c_mktsegment
    FROM customer LEFT JOIN u ON c_custkey = o_custkey""")
def sink_update(t):
    """Customers updated from their latest filled order; a null new value is written."""
    updates = t.orders.where("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"),
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("c_mktsegment"),
        "o_orderdate", "o_orderkey")
    updated = update_by_key(
        t.customer, updates, ["c_custkey"], ["c_acctbal", "c_mktsegment"],
        latest=[F.desc("o_orderdate"), F.desc("o_orderkey")])
    path = scratch_path(t.spark, "update")
    write_files(updated, path)
    return t.spark.read.parquet(path).select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@query("sink_update_in_place", """
    SELECT o_orderkey, o_orderpriority, o_orderstatus,
           CASE WHEN o_orderpriority = '1-URGENT' AND l_orderkey IS NOT NULL THEN parts ELSE o_shippriority END AS o_shippriority
    FROM (SELECT o_orderkey, o_orderpriority, o_orderstatus, 0::BIGINT AS o_shippriority FROM orders)
    LEFT JOIN (SELECT l_orderkey, count(*) AS parts FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def sink_update_in_place(t):
    """Urgent orders get their number of parts, written over the table that they are read from."""
    path = scratch_path(t.spark, "update-in-place")
    orders = t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus", F.lit(0).cast("long").alias("o_shippriority"))
    orders.write.partitionBy("o_orderpriority").parquet(path)
    parts = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("o_shippriority"))
    updates = parts.withColumn("o_orderpriority", F.lit("1-URGENT"))
    update_partitions(
        t.spark, path, "o_orderpriority", updates, ["o_orderkey"], ["o_shippriority"],
        latest=[F.desc("o_shippriority")])
    return t.spark.read.parquet(path)


@query("sink_update_files", """
    SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN o_orderkey IS NULL THEN l_returnflag ELSE o_orderstatus END AS l_returnflag
    FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey < (SELECT max(o_orderkey) / 10 FROM orders)) ON o_orderkey = l_orderkey""")
def sink_update_files(t):
    """Line items of the first tenth of the orders take their status, in a table without partitions, where it lies."""
    path = scratch_path(t.spark, "update-files")
    t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag").repartitionByRange(20, "l_orderkey").write.parquet(path)
    last = t.orders.agg(F.max("o_orderkey") / 10)
    updates = t.orders.where(F.col("o_orderkey") < last.scalar()).select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("l_returnflag"))
    update_files(t.spark, path, updates, ["l_orderkey"], ["l_returnflag"], latest=[F.col("l_returnflag")])
    return t.spark.read.parquet(path)


@query("sink_json", """
    SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, strftime(ts, '%Y-%m-%d') AS day,
           nullif(event_type, 'error') AS event_type, value FROM events""")
def sink_json(t):
    path = scratch_path(t.spark, "json")
    write_json(t.events.select(
        "event_id", "ts", F.col("ts").cast("date").alias("day"),
        F.nullif(F.col("event_type"), F.lit("error")).alias("event_type"), "value"), path)
    # Read as text fields, so that the written formats show.
    return t.spark.read.schema(
        "event_id long, ts string, day string, event_type string, value double").json(path)


@query("sink_csv", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def sink_csv(t):
    path = scratch_path(t.spark, "csv")
    write_csv(t.customer.select("c_custkey", "c_name", "c_acctbal"), path)
    return t.spark.read.option("header", True).schema(
        "c_custkey long, c_name string, c_acctbal double").csv(path)


@query("convert_format", """
    SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders""")
def convert_format(t):
    """Parquet to CSV to ORC."""
    csv, orc = scratch_path(t.spark, "converted"), scratch_path(t.spark, "converted")
    convert(t.spark, f"{t.folder}/orders.parquet", "parquet", csv, "csv")
    convert(t.spark, csv, "csv", orc, "orc", t.orders.schema)
    return t.spark.read.orc(orc).select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")


@query("compact", "SELECT * FROM events")
def compact_query(t):
    path = scratch_path(t.spark, "compact")
    compact(t.events, path, rows_per_file=50_000)
    return t.spark.read.parquet(path)


@query("fan_out", """
    SELECT 'large' AS target, o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_totalprice > 300000
    UNION ALL SELECT 'urgent', o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT 'all', o_orderkey, o_orderstatus || o_orderpriority FROM orders""")
def fan_out_query(t):
    base = scratch_path(t.spark, "fan-out")
    steps = {
        "large": lambda df: df.where("o_totalprice > 300000").selectExpr("o_orderkey k", "o_orderstatus v"),
        "urgent": lambda df: df.where("o_orderpriority = '1-URGENT'").selectExpr(
            "o_orderkey k", "o_orderpriority v"),
        "all": lambda df: df.selectExpr("o_orderkey k", "concat(o_orderstatus, o_orderpriority) v"),
    }
    sink = lambda name: lambda df: write_files(df, f"{base}/target={name}")
    fan_out(t.orders, {name: (step, sink(name)) for name, step in steps.items()})
    return t.spark.read.parquet(base)


@query("fan_out_routes", """
    SELECT 'large' AS route, o_orderkey FROM orders WHERE o_totalprice > 300000
    UNION ALL SELECT 'urgent', o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT 'unmatched', o_orderkey FROM orders
    WHERE o_totalprice <= 300000 AND o_orderpriority <> '1-URGENT'""")
def fan_out_routes(t):
    path = scratch_path(t.spark, "routes")
    write_routes(t.orders, {"large": "o_totalprice > 300000", "urgent": "o_orderpriority = '1-URGENT'"}, path)
    return t.spark.read.parquet(path).select("route", "o_orderkey")


@query("nest_packet", """
    WITH n AS (SELECT o_custkey, count(*)::INTEGER AS n, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order,
                      arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY o_custkey)
    SELECT c_custkey, c_name, 0 AS part, coalesce(n, 0)::INTEGER AS n, first_order, last_order
    FROM customer LEFT JOIN n ON c_custkey = o_custkey""")
def nest_packet_query(t):
    detail = t.orders.select(
        F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", "o_totalprice")
    packets = nest_packet(
        t.customer.select("c_custkey", "c_name"), detail, "c_custkey", ["o_orderdate", "o_orderkey"])
    return packets.select(
        "c_custkey", "c_name", "part", F.size("details").alias("n"),
        F.try_element_at("details", F.lit(1))["o_orderkey"].alias("first_order"),
        F.try_element_at("details", F.lit(-1))["o_orderkey"].alias("last_order"))


@query("nest_packet_parts", """
    WITH n AS (SELECT *, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) - 1) // 1000 AS part
               FROM orders)
    SELECT o_orderstatus, part::INTEGER AS part, count(*)::INTEGER AS n,
           arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order,
           arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM n GROUP BY o_orderstatus, part""")
def nest_packet_parts(t):
    """All orders under their three states: every key is a large one."""
    detail = t.orders.select("o_orderstatus", "o_orderdate", "o_orderkey")
    packets = nest_packet(detail.select("o_orderstatus").distinct(), detail, "o_orderstatus",
                          ["o_orderdate", "o_orderkey"], most=1000)
    ends = {"first_order": 1, "last_order": -1}
    return packets.select("o_orderstatus", "part", F.size("details").alias("n"), *[
        F.try_element_at("details", F.lit(at))["o_orderkey"].alias(name) for name, at in ends.items()])


@query("sink_csv_text", "SELECT doc_id, text, nullif(lang, 'de') AS lang FROM documents")
def sink_csv_text(t):
    """Whole texts with line breaks, quotes, blanks at the ends and nulls, through CSV."""
    path = scratch_path(t.spark, "csv")
    write_csv(t.documents.select("doc_id", "text", F.nullif(F.col("lang"), F.lit("de")).alias("lang")), path)
    return read_files(t.spark, path, "*.csv", "doc_id long, text string, lang string", multiline=True)
