from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

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


@pytest.fixture
def people(spark):
    return spark.createDataFrame(
        [(1, "Ann", 10), (2, None, 20), (3, "Bob", None)], "id int, name string, n int")


def values(df, column):
    return sorted(r[column] for r in df.collect())


def test_expression_order_and_default(people):
    df = expression(people, {"twice": "n * 2", "id": None, "label": F.lit("x")})
    assert df.columns == ["twice", "id", "label"]
    assert expression(people).columns == people.columns
    assert passthrough(people) is people


def test_update_record_reads_incoming_values(people):
    df = update_record(people, {"n": "n + 1", "id": "n", "name": "'no'"}, input_only=("name",))
    assert [tuple(r) for r in df.where("n = 11").collect()] == [(10, "Ann", 11)]


def test_mapplet(people):
    both = mapplet(lambda d: d.where("id > 1"), lambda d: d.select("id"))
    assert values(people.transform(both), "id") == [2, 3]


def test_filter_drops_null(people):
    assert values(filter_rows(people, "n <> 10"), "id") == [2]


def test_router_sends_to_every_match_and_unmatched(people):
    routes = {"small": "n <= 20", "named": F.col("name").isNotNull(), "big": "n >= 20"}
    got = sorted((r["id"], r["route"]) for r in router(people, routes).collect())
    assert got == [(1, "named"), (1, "small"), (2, "big"), (2, "small"), (3, "named")]
    routes = {"big": "n > 15"}
    assert sorted((r["id"], r["route"]) for r in router(people, routes).collect()) \
        == [(1, "unmatched"), (2, "big"), (3, "unmatched")]
    split = router_split(people, routes)
    assert values(split["big"], "id") == [2] and values(split["unmatched"], "id") == [1, 3]


def test_predicates(people):
    row = people.where("id = 2").select(
        predicate("n", "equals", 20).alias("a"), predicate("name", "is null").alias("b"),
        predicate("name", "is not null").alias("c")).first()
    assert tuple(row) == (True, True, False)
    with pytest.raises(ValueError):
        predicate("n", "like")


def test_split_valid(spark):
    df = spark.createDataFrame(
        [("1", "2024-01-01"), ("x", "2024-13-01"), (None, None), ("2", "bad")], "a string, b string")
    valid, bad = split_valid(df, {"a": "int", "b": "date"})
    assert sorted((r["a"] is None, str(r["b"])) for r in valid.collect()) \
        == [(False, "2024-01-01"), (True, "None")]
    assert sorted((r["a"], r["reject_reason"]) for r in bad.collect()) \
        == [("2", "b: not date"), ("x", "a: not int; b: not date")]


def test_union_normalize_split(spark, people):
    both = union_all(people, people.select("id"))
    assert both.count() == 6 and both.columns == people.columns
    wide = spark.createDataFrame([(1, 10, 20), (2, None, 40)], "id int, q1 int, q2 int")
    got = sorted((r["id"], r["occurrence"], r["value"] or 0) for r in normalizer(wide, ["q1", "q2"]).collect())
    assert got == [(1, 1, 10), (1, 2, 20), (2, 1, 0), (2, 2, 40)]
    lists = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "id int, l array<string>")
    assert [(r["id"], r["fragment"], r["record"]) for r in split_records(lists, "l").collect()] \
        == [(1, 1, "a"), (1, 2, "b")]


def test_custom_code(people):
    rows = custom_rows(people, lambda f: pd.DataFrame({"k": f["id"] * 10}), "k long")
    assert values(rows, "k") == [10, 20, 30]
    shout = custom_column(lambda s: s.str.upper() + "!", "string")
    assert values(people.where("name IS NOT NULL").select(shout("name").alias("x")), "x") == ["ANN!", "BOB!"]
