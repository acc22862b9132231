from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import types as T

from weftline.operators.types import Field, conform, map_types, read_schema, spark_type


@pytest.mark.parametrize("name, precision, scale, expected", [
    ("VARCHAR2(100)", None, None, "string"), ("NUMBER(10,2)", None, None, "decimal(10,2)"),
    ("number(p,s)", None, None, "double"), ("date/time", None, None, "timestamp"),
    ("datetime", None, None, "timestamp"), ("decimal", 18, 4, "decimal(18,4)"),
    ("binary", 255, None, "binary"), ("string", 200, None, "string"), ("integer", None, None, "int"),
    (" BigInt ", None, None, "bigint"), ("numeric(7)", None, None, "decimal(7,0)"),
    ("NUMBER(10,2)", 12, 3, "decimal(12,3)"), ("tinyint", None, None, "smallint"),
    ("money", None, None, "decimal(19,4)"), ("bit", None, None, "boolean"),
    ("timestamp_ntz", None, None, "timestamp_ntz"), ("geometry", None, None, "string"),
])
def test_spark_type(spark, name, precision, scale, expected):
    assert spark_type(name, precision, scale).simpleString() == expected


def test_read_schema(spark):
    schema = read_schema([Field("a", "NUMBER(5,1)"), Field("b", "text")])
    assert schema == T.StructType([
        T.StructField("a", T.DecimalType(5, 1)), T.StructField("b", T.StringType())])


def test_conform(spark):
    df = spark.createDataFrame(
        [("12.34", "abcdef", 1), ("x", "abc", 2), ("99999", None, 3), (None, "ab", 4)], "n string, s string, id int")
    fields = [Field("id", "bigint"), Field("s", "varchar(4)"), Field("n", "number(5,1)")]
    out = conform(df, fields)
    assert out.dtypes == [("id", "bigint"), ("s", "string"), ("n", "decimal(5,1)")]
    assert sorted(tuple(r) for r in out.collect()) == [
        (1, "abcd", Decimal("12.3")), (2, "abc", None), (3, None, None), (4, "ab", None)]
    assert [r["id"] for r in conform(df, fields, on_error="drop").collect()] == [4]
    rejected = conform(df, fields, on_error="reject").collect()
    assert sorted((r["id"], r["n"], r["reject_reason"]) for r in rejected) == [
        (1, "12.34", "s: too long"), (2, "x", "n: not decimal(5,1)"), (3, "99999", "n: not decimal(5,1)")]
    with pytest.raises(ValueError):
        conform(df, fields, on_error="other")


def test_map_types(spark):
    df = spark.createDataFrame([("CHAR(5)",), (" Number (10, 2) ",), ("sdo",), (None,)], "t string")
    assert {r["t"]: r["spark_type"] for r in map_types(df, "t").collect()} == {
        "CHAR(5)": "string", " Number (10, 2) ": "decimal(10,2)", "sdo": "string", None: "string"}
