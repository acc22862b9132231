from __future__ import annotations

import datetime as dt
import gzip
import json
from collections import Counter
from pathlib import Path
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from weftline.sinks import (
    append,
    compact,
    convert,
    fan_out,
    nest_packet,
    update_by_key,
    update_partitions,
    write_csv,
    write_files,
    write_json,
    write_routes,
)
from weftline.sources import (
    attributes_map,
    batch_report,
    fetch_incremental,
    generate,
    incremental,
    read_batch,
    read_files,
    source_qualifier,
    sql_call,
    unread_files,
    xml_children,
    xml_flatten,
)
from weftline.sources.readers import _broken


def files(path, pattern):
    return sorted(Path(path).rglob(pattern))


def test_read_files_by_header_and_filter(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,\n")
    (tmp_path / "b.txt").write_text("id,name\n9,no\n")
    assert read_files(spark, str(tmp_path), "*.csv").dtypes == [("id", "string"), ("name", "string")]
    typed = read_files(spark, str(tmp_path), "*.csv", "id int, name string")
    assert sorted(tuple(r) for r in typed.collect()) == [(1, "x"), (2, None)]


def test_incremental(spark):
    df = spark.createDataFrame([(1,), (5,), (3,), (None,)], "v int")
    rows, newest = incremental(df, "v")
    assert rows.count() == 4 and newest.first()["v"] == 5
    rows, newest = incremental(df, "v", 3)
    assert [r["v"] for r in rows.collect()] == [5] and newest.first()["v"] == 5
    rows, newest = incremental(df, "v", 9)
    assert rows.count() == 0 and newest.first()["v"] == 9


def test_small_sources(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert source_qualifier(df, ["v"], "id > 1").collect()[0].asDict() == {"v": "b"}
    assert source_qualifier(df).columns == df.columns
    got = sql_call(spark, "SELECT v FROM {t} WHERE id = :id AND v <> :v", {"t": df}, id=2, v="it's")
    assert [r["v"] for r in got.collect()] == ["b"]
    assert [r["n"] for r in generate(spark, 3, "n").collect()] == [0, 1, 2]


def test_read_batch_keeps_bad_records_apart(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.json").write_text('{"id": 1}\n{"id": "no"}\n')
    (tmp_path / "b.json").write_text('{"id": 2}\nnot json\n')
    (tmp_path / "c.txt").write_text('{"id": 3}\n')
    good, bad = read_batch(spark, str(tmp_path), "id int")
    assert sorted((r["id"], Path(r["file_path"]).name) for r in good.collect()) == [(1, "a.json"), (2, "b.json")]
    assert sorted(r["_corrupt_record"] for r in bad.collect()) == ["not json", '{"id": "no"}']
    assert good.count() == 2 and bad.count() == 2


def test_xml(spark):
    schema = "_NAME string, KIND string, ATTR array<struct<_N: string, _V: string>>"
    texts = ['<T NAME="a"><KIND>k</KIND><ATTR N="x" V="1"/><ATTR N="y" V="2"/><ATTR N="x" V="3"/></T>',
             '<T NAME="b"/>', "not xml"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, xml string")
    records = xml_flatten(df, "xml", schema, keep=("id",))
    assert [(r["id"], r["_NAME"], r["KIND"]) for r in records.orderBy("id").collect()] \
        == [(0, "a", "k"), (1, "b", None), (2, None, None)]
    children = xml_children(records, "ATTR", ("id",)).toDF("id", "position", "n", "v")
    assert sorted((r["id"], r["position"] or 0, r["n"] or "", r["v"] or "") for r in children.collect()) == [
        (0, 1, "x", "1"), (0, 2, "y", "2"), (0, 3, "x", "3"), (1, 0, "", ""), (2, 0, "", "")]
    maps = attributes_map(children, "id", "n", "v", "position").collect()
    assert [(r["id"], r["attributes"]) for r in maps] == [(0, {"x": "3", "y": "2"})]


def test_replace_append_and_compact(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(10)
    write_files(spark.range(99), path)
    write_files(df, path)
    append(df.where("id < 3"), path)
    assert spark.read.parquet(path).count() == 13
    small = str(tmp_path / "small")
    spark.range(1000).repartition(20).write.parquet(small)
    out = str(tmp_path / "out")
    compact(spark.read.parquet(small), out, rows_per_file=600)
    assert len(files(out, "*.parquet")) < 20
    assert spark.read.parquet(out).select(F.sum("id")).first()[0] == sum(range(1000))


def test_json_and_csv_formats(spark, tmp_path):
    df = spark.range(0, 1, 1, 1).select(
        F.lit("2024-03-05 06:07:08.9").cast("timestamp_ntz").alias("a"),
        F.lit("2024-03-05 06:07:08.9").cast("timestamp").alias("b"),
        F.lit("2024-03-05").cast("date").alias("c"), F.lit(None).cast("string").alias("d"))
    write_json(df, str(tmp_path / "j"))
    record = json.loads(files(tmp_path / "j", "*.json")[0].read_text())
    assert record == {"a": "2024-03-05 06:07:08", "b": "2024-03-05 06:07:08", "c": "2024-03-05", "d": None}
    write_csv(df, str(tmp_path / "c"))
    text = files(tmp_path / "c", "*.csv")[0].read_text().splitlines()
    assert text[0] == "a,b,c,d" and text[1].startswith("2024-03-05 06:07:08,2024-03-05 06:07:08,2024-03-05,")


@pytest.mark.parametrize("fmt", ["csv", "json", "orc"])
def test_convert(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "x", dt.date(2024, 1, 2)), (2, None, None)], "id int, s string, d date")
    source, middle, back = (str(tmp_path / n) for n in ("s", "m", "b"))
    df.write.parquet(source)
    convert(spark, source, "parquet", middle, fmt)
    convert(spark, middle, fmt, back, "parquet", df.schema)
    assert Counter(map(tuple, spark.read.parquet(back).collect())) == Counter(map(tuple, df.collect()))


def test_update_by_key(spark):
    target = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (None, "n", 30)], "k int, s string, v int")
    updates = spark.createDataFrame(
        [(1, None, 1), (1, "old", 0), (3, "new", 5), (None, "never", 1)], "k int, s string, at int")
    out = update_by_key(target, updates, ["k"], ["s"], [F.desc("at")])
    assert out.columns == target.columns
    assert sorted((r["v"], r["s"]) for r in out.collect()) == [(10, None), (20, "b"), (30, "n")]


def test_fan_out(spark, tmp_path):
    df = spark.range(10)
    sink = lambda name: lambda d: write_files(d, str(tmp_path / name))
    for reuse in (True, False):
        fan_out(df, {"all": (lambda d: d, sink("all")), "few": (lambda d: d.where("id < 3"), sink("few"))}, reuse)
        assert spark.read.parquet(str(tmp_path / "all")).count() == 10
        assert spark.read.parquet(str(tmp_path / "few")).count() == 3
    assert not df.storageLevel.useDisk
    write_routes(df, {"low": "id < 5", "even": "id % 2 = 0"}, str(tmp_path / "routes"))
    counts = spark.read.parquet(str(tmp_path / "routes")).groupBy("route").count().collect()
    assert {r["route"]: r["count"] for r in counts} == {"low": 5, "even": 5, "unmatched": 3}


def test_nest_packet_splits_hot_keys_and_keeps_copies(spark):
    head = spark.createDataFrame([(1, "hot"), (2, "few"), (3, "none"), (4, "copies")], "k int, name string")
    detail = [(1, i, "x") for i in range(95)] + [(2, 2, "b"), (2, 1, "a")] + [(4, 7, "same")] * 33 + [(None, 0, "lost")]
    df = spark.createDataFrame(detail, "k int, n int, s string")
    packets = nest_packet(head, df, "k", ["n"], most=10).collect()
    sizes = {}
    for r in packets:
        sizes.setdefault(r["k"], []).append(len(r["details"]))
        assert [d["n"] for d in r["details"]] == sorted(d["n"] for d in r["details"])
    assert sum(sizes[1]) == 95 and len(sizes[1]) > 5
    assert sizes[2] == [2] and sizes[3] == [0]
    assert sum(sizes[4]) == 33 and max(sizes[4]) <= 10
    rows = Counter((r["k"], d["n"], d["s"]) for r in packets for d in r["details"])
    assert rows == Counter(d for d in detail if d[0] is not None)
    assert len({(r["k"], r["part"]) for r in packets}) == len(packets)
    assert {r["part"] for r in nest_packet(head, df, "k", ["n"]).collect()} == {0}


def test_unreadable_files_do_not_end_a_batch(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": 1}\n\n{"k": oops\n')
    (tmp_path / "b.json.gz").write_bytes(b"this is no archive")
    (tmp_path / "c.json").write_text("")
    good, bad = read_batch(spark, str(tmp_path), "k long", "*.json*")
    assert [r["k"] for r in good.collect()] == [1]
    assert [r["_corrupt_record"] for r in bad.collect()] == ['{"k": oops']
    lost = unread_files(spark, str(tmp_path), "*.json*").collect()
    assert [(r["file_path"].rsplit("/", 1)[1], r["bytes"]) for r in lost] == [("b.json.gz", 18)]


def test_a_report_tells_which_files_broke_and_where(spark, tmp_path):
    def packed(k):
        return gzip.compress("".join(f'{{"k": {k}{i:07}}}\n' for i in range(40_000)).encode())

    (tmp_path / "in ner [1]").mkdir()
    for k in range(1, 7):
        (tmp_path / f"{k}.json.gz").write_bytes(packed(k))
    half = tmp_path / "in ner [1]" / "half %.json.gz"
    half.write_bytes(packed(8)[: len(packed(8)) // 2])
    # The sum of checks at the end is wrong: all lines are given, and yet the file is not right.
    (tmp_path / "7sum.json.gz").write_bytes(packed(7)[:-8] + b"\0" * 8)
    (tmp_path / "none.json.gz").write_bytes(b"this is no archive")
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "plain.json").write_bytes(b'{"k": 1}\r\n\r\n \n{"k": oops')
    report = {unquote(r["file_path"]).rsplit("/", 1)[1]: r for r in batch_report(spark, str(tmp_path), "*.json*").collect()}
    assert sorted(report) == sorted(f.name for f in tmp_path.rglob("*.json*") if f.name != "empty.json")
    assert {name for name, r in report.items() if r["error"]} == {"half %.json.gz", "7sum.json.gz", "none.json.gz"}
    assert all((report[f"{k}.json.gz"]["lines"], report[f"{k}.json.gz"]["reached"]) == (40_000, 40_000 * 16) for k in range(1, 7))
    assert 0 < report["half %.json.gz"]["lines"] < 40_000
    assert report["half %.json.gz"]["reached"] == report["half %.json.gz"]["lines"] * 16
    assert "EOFException" in report["half %.json.gz"]["error"]
    assert (report["none.json.gz"]["lines"], report["none.json.gz"]["bytes"]) == (0, 18)
    assert report["plain.json"]["lines"] == 2
    good, _ = read_batch(spark, str(tmp_path), "k long", "*.json.gz")
    read = {unquote(r["file_path"]).rsplit("/", 1)[1]: r["count"] for r in good.groupBy("file_path").count().collect()}
    assert read["half %.json.gz"] == report["half %.json.gz"]["lines"]


def test_a_report_raises_what_is_no_fault_of_a_file(spark, tmp_path):
    (tmp_path / "a.json").write_text("1\n")
    lines = spark.read.text(str(tmp_path)).select(F.col("_metadata.file_path").alias("file_path"), F.raise_error(F.lit("other")).alias("value"))
    with pytest.raises(Exception, match="other"):
        _broken(lines, [r["file_path"] for r in spark.read.text(str(tmp_path)).select("_metadata.file_path").collect()])


def test_fetch_keeps_the_old_maximum_when_nothing_is_new(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5), (2, 7)], "id int, at int")
    path = str(tmp_path / "t")
    assert fetch_incremental(rows, "at", path).first()["at"] == 7
    assert fetch_incremental(rows, "at", path, 7).first()["at"] == 7
    more = rows.union(spark.createDataFrame([(3, 9)], "id int, at int"))
    assert fetch_incremental(more, "at", path, 7).first()["at"] == 9
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_update_in_place_leaves_other_partitions_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a", "p"), (2, "b", "p"), (1, "c", "q")], "k int, s string, part string") \
        .write.partitionBy("part").parquet(path)
    before = sorted(f.name for f in (tmp_path / "t" / "part=q").glob("*.parquet"))
    updates = spark.createDataFrame([(1, None, "p", 2), (1, "old", "p", 1), (9, "x", "p", 1)], "k int, s string, part string, at int")
    update_partitions(spark, path, "part", updates, ["k"], ["s"], [F.desc("at")])
    assert sorted(map(tuple, spark.read.parquet(path).collect()), key=str) == [(1, "c", "q"), (1, None, "p"), (2, "b", "p")]
    assert sorted(f.name for f in (tmp_path / "t" / "part=q").glob("*.parquet")) == before
