"""What jobs keep between runs: positions of fetches, swaps of files, batches of streams; and what a failure leaves."""

from __future__ import annotations

import datetime as dt
import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weftline.session import scratch_made
from weftline.sinks import finish_update, update_files
from weftline.sources import fetch_incremental, fetch_next, read_fetched
from weftline.sources import readers
from weftline.streaming import batch_files, fan_out_stream, stream_files


def moments(spark, rows):
    utc = [(i, dt.datetime(2024, 11, 3, h, m, tzinfo=dt.timezone.utc)) for i, h, m in rows]
    return spark.createDataFrame(utc, "id int, at timestamp")


def test_position_over_a_clock_change(spark, tmp_path):
    """05:30 and 06:30 UTC are both 01:30 in New York on that day."""
    path, other = str(tmp_path / "kept"), str(tmp_path / "given")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        first, second = [(1, 5, 30), (2, 6, 30)], [(1, 5, 30), (2, 6, 30), (3, 6, 31)]
        assert [fetch_next(moments(spark, rows), "at", path) for rows in (first, first, second, second)] == [2, 0, 1, 0]
        last = fetch_incremental(moments(spark, first), "at", other).first()["at"]
        micros = fetch_incremental(moments(spark, first), "at", other).select(F.unix_micros("at")).first()[0]
        assert micros == 1730615400 * 1_000_000 and last is not None
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert sorted((r.id, r.run) for r in read_fetched(spark, path).collect()) == [(1, 0), (2, 0), (3, 2)]


@pytest.mark.parametrize("kind, values", [("long", [1, 5, 9]), ("string", ["a", "b", "c"]), ("date", [dt.date(2020, 1, d) for d in (1, 2, 3)]),
                                          ("decimal(38,6)", [1, 2, 3]), ("timestamp_ntz", [dt.datetime(2020, 1, 1, 0, 0, 0, d) for d in (1, 2, 3)])])
def test_position_of_any_type(spark, tmp_path, kind, values):
    rows = spark.createDataFrame([(str(v),) for v in values] + [(None,)], "v string").select(F.col("v").cast(kind))
    path = str(tmp_path / "kept")
    assert fetch_next(rows.limit(0), "v", path) == 0
    assert fetch_next(rows.where(F.col("v") <= F.lit(values[1])), "v", path) == 2
    assert fetch_next(rows, "v", path) == 1
    assert fetch_next(rows, "v", path) == 0
    assert sorted(r.v for r in read_fetched(spark, path).select(F.col("v").cast("string")).collect()) == sorted(
        r.v for r in rows.dropna().select(F.col("v").cast("string")).collect())


def test_a_fetch_that_fails_after_its_rows_leaves_none_twice(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "kept"), spark.range(10)
    fetch_next(rows.where("id < 4"), "id", path)
    real = readers._append_newer

    def breaks(*args):
        real(*args)
        raise OSError("the driver is lost")

    monkeypatch.setattr(readers, "_append_newer", breaks)
    with pytest.raises(OSError):
        fetch_next(rows.where("id < 8"), "id", path)
    monkeypatch.setattr(readers, "_append_newer", real)
    assert read_fetched(spark, path).count() == 4
    assert fetch_next(rows, "id", path) == 6
    assert sorted(r.id for r in read_fetched(spark, path).collect()) == list(range(10))


def parts(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("part-*.parquet")}


@pytest.mark.parametrize("partitioned", [False, True])
def test_only_touched_files_are_written(spark, tmp_path, partitioned):
    path = str(tmp_path / "a target")
    rows = spark.range(0, 100, 1, 10).select("id", F.concat(F.lit("k: "), (F.col("id") % 2).cast("string")).alias("kind"), F.lit("old").alias("v"))
    (rows.write.partitionBy("kind") if partitioned else rows.write).parquet(path)
    before = parts(path)
    updates = spark.createDataFrame([(3, "x", 1), (3, "first", 0), (4, None, 0), (55, "y", 0), (1000, "no row", 0)], "id long, v string, n int")
    count = update_files(spark, path, updates, ["id"], ["v"], [F.col("n")])
    after = parts(path)
    assert count == (3 if partitioned else 2) and len(set(before.items()) - set(after.items())) == count
    got = {r.id: (r.kind, r.v) for r in spark.read.parquet(path).collect()}
    assert got == {i: (f"k: {i % 2}", {3: "first", 4: None, 55: "y"}.get(i, "old")) for i in range(100)}
    assert update_files(spark, path, updates.where("id = 1000"), ["id"], ["v"], [F.col("n")]) == 0 and parts(path) == after
    assert not [n for n in os.listdir(path) if n.startswith(("_update", "_plan"))]


def test_a_swap_that_breaks_off_is_finished(spark, tmp_path):
    path = tmp_path / "target"
    spark.range(0, 20, 1, 4).select("id", F.lit("old").alias("v")).write.parquet(str(path))
    # As if the driver went after the plan and one of the moves: one new file is in place, both old ones are still there.
    staged = path / "_update-x"
    touched = sorted(path.glob("part-*.parquet"))[:2]
    spark.read.parquet(*map(str, touched)).withColumn("v", F.lit("new")).repartition(2, "id").write.parquet(str(staged))
    moved = next(staged.glob("part-*.parquet"))
    moved.rename(path / moved.name)
    plan = path / "_plan-_update-x"
    spark.createDataFrame([(f.as_uri(), staged.name) for f in touched], "old string, staged string").write.json(str(plan))
    # And a stage that was never committed.
    spark.range(3).select("id", F.lit("stray").alias("v")).write.parquet(str(path / "_update-y"))
    finish_update(spark, str(path))
    rows = sorted((r.id, r.v) for r in spark.read.parquet(str(path)).collect())
    assert [i for i, _ in rows] == list(range(20)) and [v for _, v in rows].count("new") == 10
    assert not [n for n in os.listdir(path) if n.startswith(("_update", "_plan"))]
    finish_update(spark, str(path))


def test_a_batch_that_fails_skips_finished_targets_and_frees_its_copy(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    for k in range(3):
        spark.range(k * 10, k * 10 + 10, 1, 1).write.mode("append").parquet(source)
    calls, fail = [], {"b": 1}

    def sink(name):
        write = batch_files(str(tmp_path / name))

        def put(rows, batch_id):
            calls.append((name, batch_id))
            write(rows, batch_id)
            if batch_id == 1 and fail.get(name):
                fail[name] -= 1
                raise OSError("the target is gone")
        return put

    before = scratch_made(spark)
    same = lambda df: df
    run = lambda: fan_out_stream(stream_files(spark, source, "id long", max_files=1), {"a": (same, sink("a")), "b": (same, sink("b"))}, state)
    with pytest.raises(Exception, match="the target is gone"):
        run()
    assert calls == [("a", 0), ("b", 0), ("a", 1), ("b", 1)]
    run()
    # The finished target is not asked again; the other one replaces what it had written.
    assert calls[4:] == [("b", 1), ("a", 2), ("b", 2)]
    for name in "ab":
        assert sorted(r.id for r in spark.read.parquet(str(tmp_path / name)).collect()) == list(range(30))
    assert scratch_made(spark) == before
    records = [p for p in (tmp_path / "state-targets").glob("batch=*")]
    assert [p.name for p in records] == ["batch=2"]
