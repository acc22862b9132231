"""One query per scalar function, over every row of a table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline import functions as E
from weftline.plans.catalog import query


def _status() -> Column:
    """Order status with nulls in place of P."""
    return F.nullif(F.col("o_orderstatus"), F.lit("P"))


def _signed() -> Column:
    """Account balances as they are: about one in eleven is negative."""
    return F.col("c_acctbal")


def _padded() -> Column:
    return F.concat(F.lit("  "), F.col("p_name"), F.lit("   "))


# name -> (table, key, {output: (column factory, SQL)})
_FUNCTIONS = {
    "fn_iif": ("orders", "o_orderkey", {
        "text": (lambda: E.iif(_status() == "F", "filled", "open"),
                 "CASE WHEN nullif(o_orderstatus,'P') = 'F' THEN 'filled' ELSE 'open' END"),
        "nested": (lambda: E.iif(F.col("o_totalprice") > 200000,
                                 E.iif(F.col("o_totalprice") > 400000, 3, 2), 1),
                   "CASE WHEN o_totalprice > 400000 THEN 3 WHEN o_totalprice > 200000 THEN 2 ELSE 1 END"),
        "no_else": (lambda: E.iif(_status() == "O", "x"),
                    "CASE WHEN nullif(o_orderstatus,'P') = 'O' THEN 'x' END"),
    }),
    "fn_decode": ("orders", "o_orderkey", {
        "two_pairs": (lambda: E.decode(_status(), "F", "Filled", "O", "Open", "Unknown"),
                      "CASE nullif(o_orderstatus,'P') WHEN 'F' THEN 'Filled' WHEN 'O' THEN 'Open' ELSE 'Unknown' END"),
        "null_matches": (lambda: E.decode(_status(), None, "none", "F", "f"),
                         "CASE WHEN nullif(o_orderstatus,'P') IS NULL THEN 'none' WHEN o_orderstatus='F' THEN 'f' END"),
        "many_pairs": (lambda: E.decode("o_orderpriority", "1-URGENT", 1, "2-HIGH", 2, "3-MEDIUM", 3, "5-LOW", 5, 0),
                       "CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 5 ELSE 0 END"),
    }),
    "fn_sysdate": ("orders", "o_orderkey", {
        "is_past": (lambda: E.sysdate() > F.col("o_orderdate"), "now() > o_orderdate"),
    }),
    "fn_to_date": ("orders", "o_orderkey", {
        "day": (lambda: E.to_date(F.date_format("o_orderdate", "yyyy/MM/dd"), "YYYY/MM/DD"),
                "date_trunc('day', o_orderdate)::TIMESTAMP"),
        "moment": (lambda: E.to_date(F.date_format("o_orderdate", "dd-MM-yyyy HH:mm:ss"), "DD-MM-YYYY HH24:MI:SS"),
                   "o_orderdate"),
        "bad": (lambda: E.to_date("o_orderpriority", "YYYY-MM-DD"), "NULL::TIMESTAMP"),
    }),
    "fn_trunc_num": ("customer", "c_custkey", {
        "whole": (lambda: E.trunc_number(_signed()), "trunc(c_acctbal)"),
        "one_digit": (lambda: E.trunc_number(_signed(), 1),
                      "(trunc(c_acctbal::DECIMAL(18,2) * 10)::DECIMAL(18,1) / 10)::DECIMAL(18,1)::DOUBLE"),
        "two_digits": (lambda: E.trunc_number(_signed(), 2), "c_acctbal"),
    }),
    "fn_trunc_decimal": ("customer", "c_custkey", {
        "wide": (lambda: E.trunc_number(F.expr("cast(c_acctbal as decimal(38,3)) * 10000000000000001BD").cast("decimal(38,3)"), 1, decimal=True).cast("string"),
                 "left((c_acctbal::DECIMAL(12,2)::DECIMAL(38,3) * 10000000000000001)::DECIMAL(38,3)::VARCHAR, -2)"),
    }),
    "fn_trunc_round": ("customer", "c_custkey", {
        "one_digit": (lambda: E.trunc_number(F.col("c_acctbal").cast("decimal(18,2)"), 1, mode="round").cast("double"),
                      "round(c_acctbal::DECIMAL(18,2), 1)::DOUBLE"),
    }),
    "fn_trunc_month": ("events", "event_id", {
        "result": (lambda: E.trunc_date("ts", "MM"), "date_trunc('month', ts)::TIMESTAMP")}),
    "fn_trunc_day": ("events", "event_id", {
        "result": (lambda: E.trunc_date("ts", "DD"), "date_trunc('day', ts)::TIMESTAMP")}),
    "fn_trunc_year": ("events", "event_id", {
        "result": (lambda: E.trunc_date("ts", "YY"), "date_trunc('year', ts)::TIMESTAMP")}),
    "fn_trunc_date": ("events", "event_id", {
        "result": (lambda: E.trunc_date("ts"), "date_trunc('day', ts)::TIMESTAMP")}),
    "fn_instr": ("part", "p_partkey", {
        "letter": (lambda: E.instr("p_name", "o"), "instr(p_name, 'o')::INTEGER"),
        "word": (lambda: E.instr("p_name", " ring"), "instr(p_name, ' ring')::INTEGER"),
    }),
    "fn_substr": ("customer", "c_custkey", {
        "from_one": (lambda: E.substr("c_name", 1, 3), "substr(c_name, 1, 3)"),
        "from_zero": (lambda: E.substr("c_name", 0, 3), "substr(c_name, 1, 3)"),
        "from_end": (lambda: E.substr("c_name", -4, 2), "substr(c_name, -4, 2)"),
    }),
    "fn_substr_tail": ("customer", "c_custkey", {
        "result": (lambda: E.substr("c_name", 10), "substr(c_name, 10)"),
        "beyond": (lambda: E.substr("c_name", 100), "substr(c_name, 100)"),
    }),
    "fn_ltrim": ("part", "p_partkey", {
        "result": (lambda: E.ltrim(_padded()), "ltrim('  ' || p_name || '   ')"),
        "letters": (lambda: E.ltrim("p_name", "rs"), "ltrim(p_name, 'rs')"),
    }),
    "fn_rtrim": ("part", "p_partkey", {
        "result": (lambda: E.rtrim(_padded()), "rtrim('  ' || p_name || '   ')"),
        "letters": (lambda: E.rtrim("p_name", "tg"), "rtrim(p_name, 'tg')"),
    }),
    "fn_trim": ("part", "p_partkey", {
        "result": (lambda: E.trim(_padded()), "trim('  ' || p_name || '   ')"),
        "nested": (lambda: E.ltrim(E.rtrim(_padded())), "ltrim(rtrim('  ' || p_name || '   '))"),
    }),
    "fn_length": ("documents", "doc_id", {
        "result": (lambda: E.length("text"), "length(text)::INTEGER")}),
    "fn_len": ("part", "p_partkey", {
        "result": (lambda: E.length(_padded()), "length('  ' || p_name || '   ')::INTEGER")}),
    "fn_upper": ("part", "p_partkey", {
        "result": (lambda: E.upper("p_name"), "upper(p_name)"),
        "of_part": (lambda: E.upper(E.substr("p_name", 1, 3)), "upper(substr(p_name, 1, 3))"),
    }),
    "fn_lower": ("part", "p_partkey", {
        "result": (lambda: E.lower("p_brand"), "lower(p_brand)")}),
    "fn_concat": ("orders", "o_orderkey", {
        "result": (lambda: E.concat(_status(), "o_orderpriority"),
                   "nullif(o_orderstatus,'P') || o_orderpriority")}),
    "fn_concat_op": ("orders", "o_orderkey", {
        "result": (lambda: E.concat_op("o_orderpriority", F.lit("-"), "o_orderstatus", F.lit("!")),
                   "o_orderpriority || '-' || o_orderstatus || '!'"),
        "with_null": (lambda: E.concat_op("o_orderpriority", F.lit("-"), _status()),
                      "o_orderpriority || '-' || nullif(o_orderstatus,'P')"),
    }),
    "fn_round": ("customer", "c_custkey", {
        "one_digit": (lambda: E.round_number(F.col("c_acctbal").cast("decimal(18,2)"), 1).cast("double"),
                      "round(c_acctbal::DECIMAL(18,2), 1)::DOUBLE"),
        "whole": (lambda: E.round_number(F.col("c_acctbal").cast("decimal(18,2)")).cast("double"),
                  "round(c_acctbal::DECIMAL(18,2), 0)::DOUBLE"),
    }),
    "fn_abs": ("customer", "c_custkey", {
        "result": (lambda: E.absolute(_signed()), "abs(c_acctbal)")}),
    "fn_mod": ("customer", "c_custkey", {
        "result": (lambda: E.mod("c_custkey", 7), "c_custkey % 7"),
        "negative": (lambda: E.mod(-F.col("c_custkey"), 7), "(-c_custkey) % 7"),
        "by_zero": (lambda: E.mod("c_custkey", F.col("c_nationkey") * 1), "CASE WHEN c_nationkey = 0 THEN NULL ELSE c_custkey % c_nationkey END"),
    }),
    "fn_nvl": ("orders", "o_orderkey", {
        "result": (lambda: E.nvl(_status(), "none"), "coalesce(nullif(o_orderstatus,'P'), 'none')")}),
    "fn_isnull": ("orders", "o_orderkey", {
        "result": (lambda: E.isnull(_status()), "nullif(o_orderstatus,'P') IS NULL")}),
    "fn_to_char_date": ("events", "event_id", {
        "moment": (lambda: E.to_char("ts", "YYYY-MM-DD HH24:MI:SS"), "strftime(ts, '%Y-%m-%d %H:%M:%S')"),
        "day": (lambda: E.to_char("ts", "DD/MM/YYYY"), "strftime(ts, '%d/%m/%Y')"),
        "with_digits": (lambda: E.to_char("ts", "YYYY-MM-DD 00:09"), "strftime(ts, '%Y-%m-%d 00:09')"),
    }),
    "fn_to_char": ("part", "p_partkey", {
        "whole": (lambda: E.to_char("p_size"), "p_size::VARCHAR"),
        "price": (lambda: E.to_char(F.col("p_retailprice").cast("decimal(12,2)"), "99999.99"),
                  "lpad(p_retailprice::DECIMAL(12,2)::VARCHAR, 8, ' ')"),
    }),
    "fn_to_integer": ("orders", "o_orderkey", {
        "text": (lambda: E.to_integer(E.substr("o_orderpriority", 1, 1)), "substr(o_orderpriority,1,1)::INTEGER"),
        "bad": (lambda: E.to_integer("o_orderpriority"), "NULL::INTEGER"),
        "cut": (lambda: E.to_integer("o_totalprice"), "trunc(o_totalprice)::INTEGER"),
        "cut_text": (lambda: E.to_integer(F.col("o_totalprice").cast("decimal(12,2)").cast("string")),
                     "trunc(o_totalprice)::INTEGER"),
    }),
    "fn_to_decimal": ("orders", "o_orderkey", {
        "fits": (lambda: E.to_decimal("o_totalprice", 12, 1).cast("double"),
                 "round(o_totalprice::DECIMAL(18,2), 1)::DOUBLE"),
        "bad": (lambda: E.to_decimal("o_orderpriority", 10, 2).cast("double"), "NULL::DOUBLE"),
        "small": (lambda: E.to_decimal(F.col("o_totalprice").cast("decimal(18,2)"), 7, 2).cast("double"),
                  "CASE WHEN o_totalprice < 100000 THEN o_totalprice END"),
    }),
    "fn_add_days": ("events", "event_id", {
        "later": (lambda: E.add_to_date("ts", "DD", 30), "ts + INTERVAL 30 DAY"),
        "earlier": (lambda: E.add_to_date("ts", "DD", -1), "ts - INTERVAL 1 DAY"),
    }),
    "fn_add_months": ("events", "event_id", {
        "later": (lambda: E.add_to_date("ts", "MM", 1), "ts + INTERVAL 1 MONTH"),
        "earlier": (lambda: E.add_to_date("ts", "MM", -11), "ts - INTERVAL 11 MONTH"),
    }),
    "fn_add_years": ("orders", "o_orderkey", {
        "later": (lambda: E.add_to_date("o_orderdate", "YY", 3), "o_orderdate + INTERVAL 3 YEAR"),
        "by_column": (lambda: E.add_to_date("o_orderdate", "YY", E.to_integer(E.substr("o_orderpriority", 1, 1))),
                      "o_orderdate + to_years(substr(o_orderpriority,1,1)::INTEGER)"),
    }),
    "fn_date_diff": ("events", "event_id", {
        "whole": (lambda: E.date_diff(F.lit("2024-02-01 00:30:00").cast("timestamp_ntz"), "ts", "DD"),
                  "date_diff('day', ts, TIMESTAMP '2024-02-01 00:30:00')::INTEGER"),
        "negative": (lambda: E.date_diff("ts", F.lit("2024-01-15 23:59:59").cast("timestamp_ntz")),
                     "date_diff('day', TIMESTAMP '2024-01-15 23:59:59', ts)::INTEGER"),
    }),
    "fn_year": ("orders", "o_orderkey", {
        "result": (lambda: E.get_date_part("o_orderdate", "YEAR"), "year(o_orderdate)::INTEGER")}),
    "fn_month": ("orders", "o_orderkey", {
        "result": (lambda: E.get_date_part("o_orderdate", "MONTH"), "month(o_orderdate)::INTEGER")}),
    "fn_day": ("orders", "o_orderkey", {
        "result": (lambda: E.get_date_part("o_orderdate", "DAY"), "day(o_orderdate)::INTEGER")}),
    "fn_safe_name": ("orders", "o_orderkey", {
        "result": (lambda: E.safe_name(F.concat_ws(" /.", "o_orderpriority", "o_orderstatus")),
                   "regexp_replace(o_orderpriority || ' /.' || o_orderstatus, '[^\\p{L}\\p{N}_-]', '_', 'g')")}),
}


def _register(name: str, table: str, key: str, outputs: dict) -> None:
    selected = ", ".join(f"{sql} AS {output}" for output, (_, sql) in outputs.items())

    @query(name, f"SELECT {key}, {selected} FROM {table}")
    def run(t):
        columns = [make().alias(output) for output, (make, _) in outputs.items()]
        return getattr(t, table).select(key, *columns)


for _name, (_table, _key, _outputs) in _FUNCTIONS.items():
    _register(_name, _table, _key, _outputs)
