"""Streams over the events, run until everything there is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators.expand import union_all
from weftline.operators.joins import lookup
from weftline.operators.project import expression, filter_rows
from weftline.plans.catalog import query
from weftline.session import scratch_path
from weftline.streaming import batch_files, fan_out_batches, fan_out_stream, run_available, stream_files


def _folder(t, rows=None):
    """The events as a folder of about ten files."""
    path = scratch_path(t.spark, "events")
    rows = t.events if rows is None else rows
    rows.write.option("maxRecordsPerFile", 1 + t.events.count() // 10).parquet(path)
    return path


def _run(t, stream):
    out = scratch_path(t.spark, "stream-out")
    run_available(stream, out, scratch_path(t.spark, "stream-state"))
    return t.spark.read.parquet(out)


@query("stream_file_source", "SELECT * FROM events")
def stream_file_source(t):
    return _run(t, stream_files(t.spark, _folder(t), t.events.schema))


@query("stream_limited", """
    SELECT 'files' AS intake, event_id, value FROM events UNION ALL SELECT 'bytes', event_id, value FROM events""")
def stream_limited(t):
    """The same folder taken up at most four files, and half a megabyte, at a time."""
    folder = _folder(t)
    limits = {"files": {"max_files": 4}, "bytes": {"max_bytes": 1 << 19}}
    runs = [
        _run(t, stream_files(t.spark, folder, t.events.schema, **limit)
             .select(F.lit(name).alias("intake"), "event_id", "value"))
        for name, limit in limits.items()
    ]
    return union_all(*runs)


@query("stream_router", """
    SELECT 'click' AS route, event_id FROM events WHERE event_type = 'click'
    UNION ALL SELECT 'large', event_id FROM events WHERE value > 50
    UNION ALL SELECT 'unmatched', event_id FROM events WHERE event_type <> 'click' AND value <= 50""")
def stream_router(t):
    out = scratch_path(t.spark, "stream-routes")
    fan_out_batches(
        stream_files(t.spark, _folder(t), t.events.schema, max_files=5),
        {"click": "event_type = 'click'", "large": "value > 50"}, out,
        scratch_path(t.spark, "stream-state"))
    return t.spark.read.option("basePath", out).parquet(out).select("route", "event_id")


@query("stream_fan_out", """
    SELECT 'rows' AS target, event_id AS id, event_type AS label, 1 AS n FROM events WHERE value > 50
    UNION ALL SELECT 'counts', NULL, event_type, count(*) FROM events GROUP BY event_type""")
def stream_fan_out(t):
    """Two targets of different shape and format; the counts of the batches are summed."""
    rows, counts = scratch_path(t.spark, "stream-rows"), scratch_path(t.spark, "stream-counts")
    fan_out_stream(
        stream_files(t.spark, _folder(t), t.events.schema, max_files=5),
        {"rows": (lambda df: df.where("value > 50").select("event_id", "event_type"), batch_files(rows)),
         "counts": (lambda df: df.groupBy("event_type").count(), batch_files(counts, "json"))},
        scratch_path(t.spark, "stream-state"))
    large = t.spark.read.parquet(rows).select(
        F.lit("rows").alias("target"), F.col("event_id").alias("id"), F.col("event_type").alias("label"), F.lit(1).cast("long").alias("n"))
    summed = t.spark.read.schema("event_type string, count long").json(counts).groupBy("event_type").agg(F.sum("count").alias("n"))
    return large.unionByName(summed.select(
        F.lit("counts").alias("target"), F.lit(None).cast("long").alias("id"), F.col("event_type").alias("label"), "n"))


@query("stream_resume", "SELECT event_id, ts, event_type FROM events")
def stream_resume(t):
    """The second run takes up only the files that came after the first."""
    early = F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    folder = _folder(t, t.events.where(early))
    out, state = scratch_path(t.spark, "stream-out"), scratch_path(t.spark, "stream-state")
    run_available(stream_files(t.spark, folder, t.events.schema), out, state)
    t.events.where(~early).write.mode("append").parquet(folder)
    run_available(stream_files(t.spark, folder, t.events.schema), out, state)
    return t.spark.read.parquet(out).select("event_id", "ts", "event_type")


@query("stream_lookup", """
    SELECT event_id, c_name, upper(event_type) AS kind FROM events
    LEFT JOIN customer ON user_id = c_custkey WHERE value > 10""")
def stream_lookup(t):
    stream = stream_files(t.spark, _folder(t), t.events.schema)
    named = lookup(stream, t.customer, {"user_id": "c_custkey"}, ["c_name"], unique=True)
    return _run(t, expression(
        filter_rows(named, "value > 10"), {"event_id": None, "c_name": None, "kind": "upper(event_type)"}))
