from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from weftline import functions as E


def one(spark, column, **values):
    """Evaluate a column over one row of the given values."""
    row = spark.range(1)
    for name, value in values.items():
        literal = value() if callable(value) else F.lit(value)
        row = row.withColumn(name, literal)
    return row.select(column.alias("r")).first()["r"]


def ntz(text):
    return lambda: F.lit(text).cast("timestamp_ntz")


def null_text():
    return F.lit(None).cast("string")


def null_number():
    return F.lit(None).cast("double")


@pytest.mark.parametrize("status, expected", [("A", 1), ("B", 0), (null_text, 0)])
def test_iif(spark, status, expected):
    assert one(spark, E.iif(F.col("s") == "A", 1, 0), s=status) == expected


@pytest.mark.parametrize("kind, expected", [
    ("A", "Active"), ("I", "Inactive"), ("X", "Unknown"), (null_text, "Unknown")])
def test_decode(spark, kind, expected):
    column = E.decode("k", "A", "Active", "I", "Inactive", "Unknown")
    assert one(spark, column, k=kind) == expected


def test_decode_without_default_and_null_search(spark):
    assert one(spark, E.decode("k", "A", 1), k="B") is None
    assert one(spark, E.decode("k", None, "nothing", "x"), k=null_text) == "nothing"
    assert one(spark, E.decode("k", "x"), k="a") == "x"


def test_nvl_isnull(spark):
    assert one(spark, E.nvl("d", 0.0), d=null_number) == 0.0
    assert one(spark, E.nvl("d", 0.0), d=2.5) == 2.5
    assert one(spark, E.isnull("d"), d=null_number) is True
    assert one(spark, E.isnull("d"), d="") is False


@pytest.mark.parametrize("number, scale, expected", [
    (0.29, 2, 0.29), (-0.29, 1, -0.2), (1.999, 2, 1.99), (-1.999, 0, -1.0), (0.0, 3, 0.0),
    (12345.678, 0, 12345.0), (1e9 + 0.5, 0, 1e9)])
def test_trunc_number(spark, number, scale, expected):
    assert one(spark, E.trunc_number("n", scale), n=number) == expected


def test_trunc_and_round_of_null_and_halves(spark):
    assert one(spark, E.trunc_number("n", 2), n=null_number) is None
    assert one(spark, E.trunc_number("n", 1, mode="round"), n=Decimal("2.25")) == Decimal("2.3")
    assert one(spark, E.round_number("n"), n=-2.5) == -3.0
    with pytest.raises(ValueError):
        E.trunc_number("n", mode="other")


def test_mod_sign_and_zero(spark):
    assert one(spark, E.mod("n", 3), n=-7) == -1
    assert one(spark, E.mod("n", 0), n=7) is None
    assert one(spark, E.absolute("n"), n=-7) == 7


def test_text(spark):
    assert one(spark, E.instr("s", "lo"), s="hello") == 4
    assert one(spark, E.instr("s", "x"), s="hello") == 0
    assert one(spark, E.substr("s", 0, 2), s="hello") == "he"
    assert one(spark, E.substr("s", -3), s="hello") == "llo"
    assert one(spark, E.upper(E.substr("s", 1, 3)), s="code9") == "COD"
    assert one(spark, E.ltrim(E.rtrim("s")), s="  a b ") == "a b"
    assert one(spark, E.ltrim("s", "0"), s="0070") == "70"
    assert one(spark, E.length("s"), s="añ ") == 3
    assert one(spark, E.length("s"), s="") == 0
    assert one(spark, E.safe_name("s"), s="a b/c-d_é1") == "a_b_c-d_é1"


def test_concat_is_null_with_a_null_part(spark):
    assert one(spark, E.concat("a", "b"), a="x", b=null_text) is None
    assert one(spark, E.concat_op("a", F.lit("-"), "b"), a="x", b="y") == "x-y"


def test_formats():
    assert E.spark_format("YYYY-MM-DD HH24:MI:SS") == "yyyy-MM-dd HH:mm:ss"
    assert E.spark_format("DD MON YY") == "dd MMM yy"
    assert E.spark_format("YYYY-MM-DDTHH24") == "yyyy-MM-dd'T'HH"
    for unknown in ("week YYYY", "Q", "WW", "SS.FF9"):
        with pytest.raises(ValueError, match="unknown letters"):
            E.spark_format(unknown)


def test_dates(spark):
    moment = ntz("2024-01-31 23:15:10")
    parsed = one(spark, E.to_date("s", "YYYY-MM-DD"), s="2024-02-29")
    assert parsed == dt.datetime(2024, 2, 29)
    assert one(spark, E.to_date("s", "YYYY-MM-DD"), s="2023-02-29") is None
    assert one(spark, E.add_to_date("d", "MM", 1), d=moment) == dt.datetime(2024, 2, 29, 23, 15, 10)
    assert one(spark, E.add_to_date("d", "DD", 30), d=moment) == dt.datetime(2024, 3, 1, 23, 15, 10)
    assert one(spark, E.add_to_date("d", "YY", -1), d=moment) == dt.datetime(2023, 1, 31, 23, 15, 10)
    assert one(spark, E.trunc_date("d", "MM"), d=moment) == dt.datetime(2024, 1, 1)
    assert one(spark, E.get_date_part("d", "YEAR"), d=moment) == 2024
    assert one(spark, E.date_diff("a", "b"), a=ntz("2024-01-02 00:00:00"), b=ntz("2024-01-01 23:00:00")) == 1
    assert one(spark, E.to_char("d", "DD/MM/YYYY HH24:MI"), d=moment) == "31/01/2024 23:15"
    with pytest.raises(ValueError):
        E.trunc_date("d", "QUARTER")
    with pytest.raises(ValueError):
        E.date_diff("a", "b", "MM")


@pytest.mark.parametrize("text, expected", [
    ("12", 12), ("12.9", 12), ("-12.9", -12), ("abc", None), ("", None), (" 7 ", 7),
    ("99999999999", None)])
def test_to_integer(spark, text, expected):
    assert one(spark, E.to_integer("s"), s=text) == expected


def test_to_decimal_and_to_char(spark):
    assert one(spark, E.to_decimal("s", 5, 2), s="123.456") == Decimal("123.46")
    assert one(spark, E.to_decimal("s", 5, 2), s="1234.5") is None
    assert one(spark, E.to_char("n"), n=12) == "12"
    assert one(spark, E.to_char("n", "999.99"), n=Decimal("12.50")).strip() == "12.50"


def test_cuts_are_exact(spark):
    rows = spark.createDataFrame([("1.99999999999",), ("1.9999999999999999999",), ("-1.99999999999",), ("1e3",), ("x",), (" 7 ",), (None,)], "t string")
    assert [r[0] for r in rows.select(E.to_integer("t")).collect()] == [1, 1, -1, 1000, None, 7, None]
    numbers = spark.createDataFrame([(1.99999999999, 0.1234567890123), (-1.99999999999, -0.29), (1e30, 1e30), (None, None)], "a double, b double")
    assert [tuple(r) for r in numbers.select(E.trunc_number("a"), E.trunc_number("b", 12)).collect()] == [
        (1.0, 0.123456789012), (-1.0, -0.29), (1e30, 1e30), (None, None)]


def test_safe_name_keeps_letters_of_any_script(spark):
    rows = spark.createDataFrame([("\u00e9\u65e5a b/c",)], "t string")
    assert rows.select(E.safe_name("t")).first()[0] == "\u00e9\u65e5a_b_c"
