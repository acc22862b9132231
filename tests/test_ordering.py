from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators.ordering import Order, number_rows, rank, sequence, sorter, top_k


def rows(spark, seed=1, n=600):
    """Numbers with ties and nulls; one group holds half of the rows, one is null."""
    pick = random.Random(seed)
    data = [
        (i, pick.choice(["hot", "hot", "hot", "b", "c", None]),
         None if pick.random() < 0.1 else pick.randrange(20), f"t{pick.randrange(5)}")
        for i in range(n)
    ]
    return data, spark.createDataFrame(data, "id int, grp string, v int, t string").repartition(5)


def expected(data, desc, partition):
    def key(r):
        null = r[2] is None
        by = (1 if null else 0, 0 if null else -r[2]) if desc else (0 if null else 1, 0 if null else r[2])
        return by + (r[0],)

    numbers, seen = {}, {}
    for r in sorted(data, key=key):
        g = r[1] if partition else None
        seen[g] = seen.get(g, 0) + 1
        numbers[r[0]] = seen[g]
    return numbers


@pytest.mark.parametrize("desc", [False, True])
@pytest.mark.parametrize("partition", [False, True])
@pytest.mark.parametrize("buckets", [1, 2, 7, 60])
def test_numbering_matches_sorting(spark, desc, partition, buckets):
    data, df = rows(spark)
    numbered = number_rows(
        df, [Order("v", desc), Order("id")], "n", ["grp"] if partition else (), buckets)
    got = {r["id"]: r["n"] for r in numbered.collect()}
    assert got == expected(data, desc, partition)


def test_equal_rows_are_spread(spark):
    """Rows that are equal in every column: each gets its number, and several tasks hold them."""
    df = spark.range(0, 200_000, 1, 6).select(F.lit(1).alias("v"))
    ranked = rank(df, "v")
    assert ranked.agg(F.min("RANK_COL"), F.max("RANK_COL"), F.countDistinct("RANK_COL")).first() == (1, 200_000, 200_000)
    numbered = number_rows(df, [Order("v")], "n", buckets=16)
    held = [r["n"] for r in numbered.groupBy(F.spark_partition_id()).count().withColumnRenamed("count", "n").collect()]
    assert max(held) < 100_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        in_parts = sorter(df, "v").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(in_parts) == 200_000 and max(in_parts) < 100_000


def test_text_and_mixed_directions(spark):
    data, df = rows(spark, seed=3)
    numbered = number_rows(df, [Order("t", True), Order("v"), Order("id", True)], "n", buckets=9)
    got = [r["id"] for r in numbered.orderBy("n").collect()]
    wanted = sorted(data, key=lambda r: (-int(r[3][1]), (0, 0) if r[2] is None else (1, r[2]), -r[0]))
    assert got == [r[0] for r in wanted]


def test_moments_closer_than_the_splitter_text(spark):
    """Splitters lose microseconds, so they need not be sorted; the numbers must be right."""
    pick = random.Random(9)
    micros = lambda: 1000 * pick.randrange(2) + pick.choice([0, 0, 0, 100, 200, 300])
    data = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=micros())) for i in range(400)]
    df = spark.createDataFrame(data, "id int, ts timestamp_ntz").repartition(3)
    for desc in (False, True):
        numbered = number_rows(df, [Order("ts", desc), Order("id", not desc)], "n", buckets=50)
        got = [r["id"] for r in numbered.orderBy("n").collect()]
        assert got == [r[0] for r in sorted(data, key=lambda r: (r[1], -r[0]), reverse=desc)]
        assert sorted(r["n"] for r in numbered.collect()) == list(range(1, 401))


def test_all_rows_equal_and_empty(spark):
    same = spark.range(500).select(F.lit(1).alias("v"))
    assert [r["n"] for r in number_rows(same, [Order("v")], "n", buckets=8).orderBy("n").collect()] \
        == list(range(1, 501))
    assert number_rows(same.limit(0), [Order("v")], "n").count() == 0


def test_no_window_over_the_whole_frame(spark):
    plan = rank(spark.range(200_000).toDF("v"), "v")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]


def test_sequence(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "v int")
    got = {r["v"]: r["s"] for r in sequence(df, "s", ["v"], start=10, step=5).collect()}
    assert got == {1: 10, 2: 15, 3: 20}
    loose = [r["s"] for r in sequence(df, "s").collect()]
    assert len(set(loose)) == 3 and min(loose) >= 1


def test_sorter_order_and_top_k(spark):
    data, df = rows(spark)
    values = [r["v"] for r in sorter(df, "v", desc=True).collect()]
    known = [v for v in values if v is not None]
    assert known == sorted(known, reverse=True) and values[len(known):] == [None] * (len(values) - len(known))
    assert [r["v"] for r in sorter(df, "v").collect()][0] is None
    assert [r["id"] for r in top_k(df, [F.desc("id")], 3).collect()] == [599, 598, 597]


def test_sorter_orders_by_its_position(spark):
    ties = spark.range(2000).select((F.col("id") % 3).alias("k"), "id")
    places = [r.p for r in sorter(ties, "k", position="p").collect()]
    assert places == sorted(places)


def test_one_value_over_all_rows_is_numbered_by_several_tasks(spark):
    from pyspark.sql import functions as F

    df = spark.range(40_000).select(F.col("id"), F.lit(1).alias("k"))
    from weftline.operators.ordering import rank

    ranked = rank(df, "k").withColumn("task", F.spark_partition_id())
    rows = ranked.groupBy("task").count().collect()
    assert sorted(r["RANK_COL"] for r in ranked.collect()) == list(range(1, 40_001))
    assert len(rows) > 1 and max(r["count"] for r in rows) < 25_000
