from __future__ import annotations

from weftline.streaming import fan_out_batches, run_available, stream_files

SCHEMA = "id long, kind string"


def put(spark, path, start, end):
    rows = spark.range(start, end, 1, 1).selectExpr("id", "if(id % 2 = 0, 'even', 'odd') kind")
    rows.write.mode("append").parquet(path)


def test_restart_takes_up_only_new_files(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    put(spark, source, 0, 10)
    first = run_available(stream_files(spark, source, SCHEMA), out, state)
    assert first.lastProgress["numInputRows"] == 10
    put(spark, source, 10, 14)
    second = run_available(stream_files(spark, source, SCHEMA), out, state)
    assert sum(p["numInputRows"] for p in second.recentProgress) == 4
    third = run_available(stream_files(spark, source, SCHEMA), out, state)
    assert sum(p["numInputRows"] for p in third.recentProgress) == 0
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(14))


def test_intake_limit_makes_several_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    for i in range(6):
        put(spark, source, i * 5, i * 5 + 5)
    query = run_available(
        stream_files(spark, source, SCHEMA, max_files=2), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == 3
    query = run_available(
        stream_files(spark, source, SCHEMA, max_bytes=1), str(tmp_path / "out2"), str(tmp_path / "state2"))
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == 6


def test_fan_out_batches_can_be_run_again(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, source, 0, 10)
    routes = {"even": "kind = 'even'", "small": "id < 3"}
    # A lost checkpoint makes the same batch run again over its own output.
    for attempt in ("a", "b"):
        fan_out_batches(stream_files(spark, source, SCHEMA), routes, out, str(tmp_path / attempt))
    counts = spark.read.option("basePath", out).parquet(out).groupBy("route").count().collect()
    assert {r["route"]: r["count"] for r in counts} == {"even": 5, "small": 3, "unmatched": 4}


def test_timer_trigger(spark, tmp_path):
    source = str(tmp_path / "in")
    put(spark, source, 0, 4)
    query = run_available(
        stream_files(spark, source, SCHEMA), str(tmp_path / "out"), str(tmp_path / "state"), period="0 seconds")
    try:
        query.processAllAvailable()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    finally:
        query.stop()
