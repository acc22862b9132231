from __future__ import annotations

from pyspark.sql import functions as F

from weftline.plans.catalog import query
from weftline.session import scratch_path
from weftline.sinks import write_csv, write_files
from weftline.sources import (
    attributes_map,
    batch_report,
    fetch_incremental,
    fetch_next,
    generate,
    incremental,
    read_batch,
    read_fetched,
    read_files,
    read_table,
    read_xml,
    source_qualifier,
    sql_call,
    xml_children,
    xml_flatten,
)


@query("scan_csv", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def scan_csv(t):
    path = scratch_path(t.spark, "csv")
    columns = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    write_csv(t.orders.select(columns), path)
    schema = "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"
    return read_files(t.spark, path, "*.csv", schema)


@query("scan_table", "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey")
def scan_table(t):
    nation = read_table(t.spark, f"{t.folder}/nation.parquet")
    region = read_table(t.spark, f"{t.folder}/region.parquet")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"])


def _new_orders(t):
    last = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    return incremental(t.orders, "o_orderdate", last)


@query("incremental_fetch", """
    SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '2000-01-01'""")
def incremental_fetch(t):
    return _new_orders(t)[0].select("o_orderkey", "o_orderdate")


@query("incremental_high_water", """
    SELECT max(o_orderdate) AS o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '2000-01-01'""")
def incremental_high_water(t):
    return _new_orders(t)[1]


@query("incremental_pass", """
    SELECT o_orderkey, o_orderdate, (SELECT max(o_orderdate) FROM orders) AS newest FROM orders""")
def incremental_pass(t):
    """Two fetches: the second takes up where the first one's maximum says."""
    path = scratch_path(t.spark, "fetched")
    orders = t.orders.select("o_orderkey", "o_orderdate")
    early = orders.where(F.col("o_orderdate") < F.lit("1996-01-01 00:00:00").cast("timestamp_ntz"))
    moment = lambda fetched: F.lit(str(fetched.first()[0])).cast("timestamp_ntz")
    last = moment(fetch_incremental(early, "o_orderdate", path))
    newest = moment(fetch_incremental(orders, "o_orderdate", path, last))
    return t.spark.read.parquet(path).withColumn("newest", newest)


@query("incremental_position", """
    SELECT o_orderkey, o_orderdate, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 0 ELSE 1 END AS run FROM orders""")
def incremental_position(t):
    """Two fetches whose position is kept with the rows, the second after a call that failed before its record."""
    path = scratch_path(t.spark, "position")
    orders = t.orders.select("o_orderkey", "o_orderdate")
    fetch_next(orders.where(F.col("o_orderdate") < F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")), "o_orderdate", path)
    orders.where("o_orderkey % 3 = 0").write.parquet(f"{path}/run=1")
    fetch_next(orders, "o_orderdate", path)
    return read_fetched(t.spark, path)


@query("source_qualifier", """
    SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'""")
def source_qualifier_query(t):
    return source_qualifier(
        t.lineitem, ["l_orderkey", "l_partkey", "l_quantity"],
        F.col("l_shipdate") >= F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"))


@query("sql_call", """
    SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 1000.0 AND c_mktsegment <> 'MACHINERY'
    GROUP BY c_mktsegment""")
def sql_call_query(t):
    text = """SELECT c_mktsegment, count(*) AS n FROM {customer}
              WHERE c_acctbal > :least AND c_mktsegment <> :without GROUP BY c_mktsegment"""
    return sql_call(t.spark, text, {"customer": t.customer}, least=1000.0, without="MACHINERY")


@query("generate_rows", """
    WITH span AS (SELECT min(o_orderdate)::DATE AS first, max(o_orderdate)::DATE AS last FROM orders),
         days AS (SELECT unnest(range(0, date_diff('day', first, last) + 1)) AS id, first FROM span)
    SELECT id, 'DUAL' AS dummy, count(o_orderkey) AS orders
    FROM days LEFT JOIN orders ON date_diff('day', first, o_orderdate::DATE) = id GROUP BY id""")
def generate_rows(t):
    """A generated row for every day from the first order to the last, with its orders."""
    day = F.col("o_orderdate").cast("date")
    first, last = t.orders.agg(F.min(day), F.max(day)).first()
    if first is None:
        return generate(t.spark, 0).select("id", F.lit("DUAL").alias("dummy"), F.col("id").alias("orders"))
    counts = t.orders.where(day.isNotNull()).groupBy(F.datediff(day, F.lit(first)).cast("long").alias("id")) \
        .agg(F.count("o_orderkey").alias("orders"))
    days = generate(t.spark, (last - first).days + 1).withColumn("dummy", F.lit("DUAL"))
    return days.join(counts, "id", "left").fillna(0, ["orders"])


_XML = ("_NAME string, _SIZE int, BRAND string, "
        "TABLEATTRIBUTE array<struct<_NAME: string, _VALUE: string>>")


def _xml_text():
    """A part as XML with attributes, an element and repeated children."""
    attribute = lambda name, value: F.concat(
        F.lit(f'<TABLEATTRIBUTE NAME="{name}">'), value, F.lit("</TABLEATTRIBUTE>"))
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    # Small parts have no children; the type is given twice, the last time in lower case.
    children = F.when(F.col("p_size") <= 5, "").otherwise(F.concat(
        attribute("type", F.col("p_type")), attribute("price", price),
        attribute("type", F.lower("p_type"))))
    return F.concat(
        F.lit('<TRANSFORMATION NAME="'), "p_name", F.lit('" SIZE="'), "p_size", F.lit('"><BRAND>'),
        "p_brand", F.lit("</BRAND>"), children, F.lit("</TRANSFORMATION>"))


def _records(t):
    xml = _xml_text()
    return xml_flatten(t.part.select("p_partkey", xml.alias("xml")), "xml", _XML, keep=("p_partkey",))


@query("xml_parent", """
    SELECT p_partkey, p_name AS name, p_size AS size, p_brand AS brand FROM part""")
def xml_parent(t):
    return _records(t).select(
        "p_partkey", F.col("_NAME").alias("name"), F.col("_SIZE").alias("size"),
        F.col("BRAND").alias("brand"))


def _children(t):
    return xml_children(_records(t), "TABLEATTRIBUTE", ("p_partkey",)) \
        .toDF("p_partkey", "position", "name", "value")


@query("xml_children", """
    SELECT p_partkey, 1 AS position, 'type' AS name, p_type AS value FROM part WHERE p_size > 5
    UNION ALL SELECT p_partkey, 2, 'price', p_retailprice::DECIMAL(12,2)::VARCHAR FROM part WHERE p_size > 5
    UNION ALL SELECT p_partkey, 3, 'type', lower(p_type) FROM part WHERE p_size > 5
    UNION ALL SELECT p_partkey, NULL, NULL, NULL FROM part WHERE p_size <= 5""")
def xml_children_query(t):
    return _children(t)


@query("xml_files", """
    SELECT p_name AS name, p_size AS size, p_brand AS brand,
           CASE WHEN p_size > 5 THEN 3 ELSE 0 END AS children FROM part WHERE p_size <> 7
    UNION ALL SELECT NULL, NULL, 'bad', count(*) FROM part WHERE p_size = 7""")
def xml_files(t):
    """The parts as XML files; those of one size are damaged."""
    path = scratch_path(t.spark, "xml")
    damaged = F.replace(_xml_text(), F.lit("</BRAND>"), F.lit("</BRANT>"))
    t.part.select(F.when(F.col("p_size") == 7, damaged).otherwise(_xml_text()).alias("value")) \
        .write.option("extension", "xml").text(path)
    good, bad = read_xml(t.spark, path, "TRANSFORMATION", _XML, "part-*")
    good = good.select(
        F.col("_NAME").alias("name"), F.col("_SIZE").alias("size"), F.col("BRAND").alias("brand"),
        F.coalesce(F.size("TABLEATTRIBUTE"), F.lit(0)).cast("long").alias("children"))
    counted = bad.agg(F.count("*").alias("children")).withColumn("brand", F.lit("bad"))
    return good.unionByName(counted, allowMissingColumns=True)


@query("attributes_map", """
    SELECT p_partkey, 2 AS entries, lower(p_type) AS type, p_retailprice::DECIMAL(12,2)::VARCHAR AS price
    FROM part WHERE p_size > 5""")
def attributes_map_query(t):
    folded = attributes_map(_children(t), "p_partkey", "name", "value", "position")
    return folded.select(
        "p_partkey", F.size("attributes").alias("entries"),
        F.col("attributes")["type"].alias("type"), F.col("attributes")["price"].alias("price"))


@query("batch_files", """
    SELECT event_type AS source, 'good' AS state, count(*) AS n, count(DISTINCT user_id) AS users
    FROM events WHERE value < 90 GROUP BY ALL
    UNION ALL SELECT event_type, 'bad', count(*), NULL FROM events WHERE value >= 90 GROUP BY ALL""")
def batch_files(t):
    """A folder of JSON files per event type; records of large values are damaged."""
    path = scratch_path(t.spark, "batch")
    record = F.to_json(F.struct("event_id", "user_id", "value"))
    damaged = F.when(F.col("value") >= 90, F.concat(record, F.lit(", oops"))).otherwise(record)
    damaged = F.regexp_replace(damaged, r"\}, oops", ", oops")
    t.events.select("event_type", damaged.alias("value")).write.partitionBy("event_type") \
        .option("extension", "json").text(path)
    good, bad = read_batch(t.spark, path, "event_id long, user_id long, value double", "part-*")
    source = F.regexp_extract("file_path", "event_type=([^/]+)/", 1).alias("source")
    counted = good.groupBy(source, F.lit("good").alias("state")).agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    rejected = bad.groupBy(source, F.lit("bad").alias("state")).agg(F.count("*").alias("n"))
    return counted.unionByName(rejected, allowMissingColumns=True)


@query("batch_broken", """
    SELECT event_type AS source, CASE event_type WHEN 'error' THEN 'broken' ELSE 'whole' END AS state,
           CASE WHEN event_type <> 'error' THEN count(*) END AS n
    FROM events GROUP BY event_type""")
def batch_broken(t):
    """A folder of packed JSON files per event type; those of one type are cut half-way."""
    path = scratch_path(t.spark, "batch")
    record = F.to_json(F.struct("event_id", "user_id", "value")).alias("value")
    t.events.select("event_type", record).write.partitionBy("event_type").option("compression", "gzip").text(path)
    _cut_half(t.spark, f"{path}/event_type=error")
    report = batch_report(t.spark, path, "part-*")
    source = F.regexp_extract("file_path", "event_type=([^/]+)/", 1).alias("source")
    broken = F.count("error") > 0
    return report.groupBy(source).agg(
        F.when(broken, "broken").otherwise("whole").alias("state"), F.when(~broken, F.sum("lines")).alias("n"))


def _cut_half(spark, folder):
    """Leave the first half of each file in a folder, as a transfer that broke off would."""
    hadoop = spark._jvm.org.apache.hadoop
    root = hadoop.fs.Path(folder)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.listStatus(root):
        source, target = system.open(status.getPath()), system.create(hadoop.fs.Path(folder, "cut"), True)
        spark._jvm.org.apache.commons.io.IOUtils.copyLarge(source, target, 0, status.getLen() // 2)
        source.close()
        target.close()
        system.rename(hadoop.fs.Path(folder, "cut"), hadoop.fs.Path(folder, f"part-cut-{status.getPath().getName()}"))
        system.delete(status.getPath(), False)
