"""What the plans must and must not contain, whatever the size of the tables."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weftline.plans import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def large_tables(spark):
    """No side counts as small enough to broadcast unless the operator bounds it itself."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("fn_")))
def test_no_pairwise_joins(spark, large_tables, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["rank_global", "rank_partitioned", "sequence", "sorter"])
def test_numbering_has_no_single_task_window(spark, name):
    """Only the row counts per bucket, a bounded number, may meet in one task."""
    text = plan(QUERIES[name](spark, FOLDER))
    for window in re.findall(r"Window \[row_number\(\).*", text):
        assert "_bucket" in window


@pytest.mark.parametrize("name, pushed, read", [
    ("incremental_fetch", "GreaterThan(o_orderdate", {"o_orderkey", "o_orderdate"}),
    ("source_qualifier", "GreaterThanOrEqual(l_shipdate",
     {"l_orderkey", "l_partkey", "l_quantity", "l_shipdate"}),
    ("filter_rows", "GreaterThan(o_totalprice,100000.0)", {"o_orderkey", "o_orderstatus", "o_totalprice"}),
    ("mapplet", "GreaterThan(p_size,10)", {"p_partkey", "p_name", "p_size"}),
    ("router_unmatched", "", {"o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"}),
    ("custom_rows", "", {"doc_id", "text"}),
    ("count_by_type", "", {"p_type"}),
])
def test_filters_and_columns_reach_the_scan(spark, name, pushed, read):
    text = plan(QUERIES[name](spark, FOLDER))
    assert pushed in text
    assert set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<(.*)>", text).group(1))) == read


def test_first_per_key_is_limited_before_the_shuffle(spark):
    from weftline.operators.joins import first_per_key

    df = first_per_key(spark.range(10).select((F.col("id") % 3).alias("k"), "id"), ["k"], [F.col("id")])
    text = plan(df)
    assert text.index("WindowGroupLimit") < text.index("Exchange") < text.rindex("WindowGroupLimit")


def test_scalar_functions_stay_native(spark):
    for name in QUERIES:
        if name.startswith("fn_"):
            text = plan(QUERIES[name](spark, FOLDER))
            assert "Exchange" not in text and "Python" not in text and "*(1)" in text


def test_shared_folder_is_the_one_the_session_names(spark):
    from weftline import session

    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = session.shared_folder(spark)
    assert folder == (named or spark.sparkContext.getCheckpointDir())

    class Context:
        master = "spark://somewhere"

        def getCheckpointDir(self):
            return None

    class Conf:
        named = None

        def get(self, key, default):
            return self.named

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.shared_folder(Session())
    Conf.named = "hdfs:///shared"
    assert session.scratch_path(Session(), "x").startswith("hdfs:///shared/x-")
