"""ETL scalar functions as native Column expressions (no Python UDFs)."""

from weftline.functions.conditional import decode, iif, isnull, nvl
from weftline.functions.convert import to_char, to_decimal, to_integer
from weftline.functions.dates import (
    add_to_date,
    date_diff,
    get_date_part,
    spark_format,
    sysdate,
    to_date,
    trunc_date,
)
from weftline.functions.numeric import absolute, mod, round_number, trunc_number
from weftline.functions.text import (
    concat,
    concat_op,
    instr,
    length,
    lower,
    ltrim,
    rtrim,
    safe_name,
    substr,
    trim,
    upper,
)

__all__ = [
    "absolute", "add_to_date", "concat", "concat_op", "date_diff", "decode",
    "get_date_part", "iif", "instr", "isnull", "length", "lower", "ltrim", "mod",
    "nvl", "round_number", "rtrim", "safe_name", "spark_format", "substr", "sysdate",
    "to_char", "to_date", "to_decimal", "to_integer", "trim", "trunc_date",
    "trunc_number", "upper",
]
