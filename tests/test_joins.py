from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftline.operators.joins import (
    joiner,
    lookup,
    lookup_split,
    map_lookup,
    override,
    pair_all,
)


@pytest.fixture
def left(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c"), (9, "d")], "k int, v string")


@pytest.fixture
def reference(spark):
    return spark.createDataFrame(
        [(1, 10, "x"), (2, 30, "late"), (2, 20, "first"), (None, 5, "null"), (3, 7, "unused")],
        "rk int, o int, w string")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_joiner(left, reference):
    assert joiner(left, reference, {"k": "rk"}).count() == 7
    extra = joiner(left, reference, {"k": "rk"}, reference["o"] > 20)
    assert rows(extra.where("w IS NOT NULL"), "v", "w") == [("b", "late"), ("b", "late")]
    assert joiner(left, reference, {"k": "rk"}, how="inner").count() == 5
    with pytest.raises(ValueError):
        joiner(left, reference, condition=F.lit(True))


@pytest.mark.parametrize("most", [1, 4, 1_000_000])
def test_pair_all(spark, left, reference, most):
    pairs = pair_all(left, reference, most)
    assert pairs.count() == 25 and pairs.columns == ["k", "v", "rk", "o", "w"]
    assert pairs.distinct().count() == 20
    empty = pair_all(left, reference.limit(0), most)
    assert rows(empty, "v", "w") == rows(left.withColumn("w", F.lit(None)), "v", "w")
    assert pair_all(left.limit(0), reference, most).count() == 0


@pytest.mark.parametrize("lefts, rights", [(2_000, 2_000), (40_000, 100), (100, 40_000)])
def test_pairs_a_task_are_bounded(spark, lefts, rights):
    paired = pair_all(spark.range(lefts), spark.range(rights).withColumnRenamed("id", "other"), 250_000)
    each = [r["n"] for r in paired.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).select("n").collect()]
    # A few pairs of blocks may fall together.
    assert sum(each) == 4_000_000 and max(each) <= 5 * 250_000 and len(each) >= 6


def test_lookup_takes_one_row_and_never_matches_null(left, reference):
    found = lookup(left, reference, {"k": "rk"}, ["w"], order_by=[F.col("o")])
    assert found.columns == ["k", "v", "w"]
    assert rows(found, "v", "w") == [("a", "x"), ("b", "first"), ("b", "first"), ("c", None), ("d", None)]


def test_lookup_same_names_and_composite(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, None, 3)], "k int, s string, id int")
    b = spark.createDataFrame([(1, "x", 7), (1, None, 8)], "k int, s string, w int")
    assert rows(lookup(a, b, {"k": "k", "s": "s"}, ["w"]), "id", "w") == [(1, 7), (2, None), (3, None)]


def test_lookup_split(left, reference):
    matched, unmatched = lookup_split(left, reference, {"k": "rk"})
    assert rows(matched, "v") == [("a",), ("b",), ("b",)]
    assert rows(unmatched, "v") == [("c",), ("d",)]


def test_map_lookup(spark, left):
    assert rows(map_lookup(left, "k", "n", {1: "one", 2: "two"}, "?"), "v", "n") \
        == [("a", "one"), ("b", "two"), ("b", "two"), ("c", "?"), ("d", "?")]
    frame = spark.createDataFrame([(1, "one")], "kk int, nn string")
    assert rows(map_lookup(left, "k", "n", frame, "?"), "v", "n") \
        == [("a", "one"), ("b", "?"), ("b", "?"), ("c", "?"), ("d", "?")]
    assert rows(map_lookup(left, "k", "n", {}), "n")[0] == (None,)


def test_override(left, spark):
    fixes = spark.createDataFrame([(2, "B"), (None, "never"), (5, "none")], "k int, corrected string")
    assert rows(override(left, fixes, ["k"], "v"), "v") == [("B",), ("B",), ("a",), ("c",), ("d",)]


def test_hot_key_is_split_by_aqe(spark):
    """A third of the rows have one key; neither side may be broadcast."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        key = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))
        left = spark.range(0, 300_000, 1, 8).select(
            key.alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))
        reference = spark.range(4_000).select((F.col("id") % 1000).alias("rk"), F.col("id").alias("w"))
        for df, matches in (
            (lookup(left, reference, {"k": "rk"}, ["w"]), 300_000),
            (lookup_split(left, reference, {"k": "rk"})[1], None),
        ):
            got = df.collect()
            assert matches in (None, len(got))
            assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
