"""Declared field types and conforming a frame to a declared field list."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.joins import map_lookup

# Declared type names by the Spark type they become.
TYPE_NAMES = {
    "string": "string", "nstring": "string", "char": "string", "nchar": "string",
    "text": "string", "clob": "string", "nclob": "string", "ntext": "string",
    "varchar": "string", "varchar2": "string", "nvarchar2": "string", "rowid": "string",
    "urowid": "string", "xmltype": "string",
    "raw": "binary", "longraw": "binary", "binary": "binary", "varbinary": "binary",
    "blob": "binary", "bytea": "binary",
    "integer": "int", "int": "int", "serial": "int",
    "smallinteger": "smallint", "smallint": "smallint", "tinyint": "smallint",
    "bigint": "bigint", "long": "bigint", "bigserial": "bigint", "milisecond": "bigint",
    "decimal": "double", "numeric": "double", "number": "double",
    "money": "decimal(19,4)", "smallmoney": "decimal(10,4)",
    "float": "float", "real": "float", "double": "double",
    "date/time": "timestamp", "timestamp": "timestamp", "datetime": "timestamp",
    "timestamp_tz": "timestamp", "timestamp_ltz": "timestamp",
    "timestamp_ntz": "timestamp_ntz",
    "date": "date", "time": "string",
    "interval": "string", "json": "string", "jsonb": "string", "any": "string",
    "uniqueidentifier": "string",
    "boolean": "boolean", "bit": "boolean",
}
DEFAULT_TYPE = "string"
_SIZED_DECIMALS = {"decimal", "numeric", "number"}
_SIZED_TEXTS = {"string", "nstring", "char", "nchar", "varchar", "varchar2", "nvarchar2"}
_PARAMETERS = r"\s*\(([^()]*)\)\s*$"


class Field(NamedTuple):
    """A declared field; ``type`` may carry its size, as in ``NUMBER(10,2)``."""

    name: str
    type: str
    precision: int | None = None
    scale: int | None = None


def _declared(field: Field) -> tuple[str, int | None, int | None]:
    """Bare type name with the sizes; sizes given apart win over inline ones."""
    text = field.type.strip().lower()
    inline: list[int | None] = []
    match = re.search(_PARAMETERS, text)
    if match:
        text = text[: match.start()]
        inline = [int(p) if p.strip().isdigit() else None for p in match.group(1).split(",")]
    inline += [None, None]
    precision = field.precision if field.precision is not None else inline[0]
    scale = field.scale if field.scale is not None else inline[1]
    return text.strip(), precision, scale


def spark_type(name: str, precision: int | None = None, scale: int | None = None) -> T.DataType:
    """Spark type of a declared type name; unknown names are strings."""
    base, precision, scale = _declared(Field("", name, precision, scale))
    if base in _SIZED_DECIMALS and precision is not None:
        return T.DecimalType(precision, scale or 0)
    return T._parse_datatype_string(TYPE_NAMES.get(base, DEFAULT_TYPE))


def read_schema(fields: Sequence[Field]) -> T.StructType:
    return T.StructType([
        T.StructField(f.name, spark_type(f.type, f.precision, f.scale)) for f in fields
    ])


def conform(
    df: DataFrame, fields: Sequence[Field], on_error: str = "null", reason: str = "reject_reason"
) -> DataFrame:
    """Select the declared fields in order with their declared types.

    A value that does not convert becomes null, and over-long text is cut. With
    ``on_error='reject'`` only the rows with such values are returned, unconverted, with
    the reason; with ``on_error='drop'`` only the rows without.
    """
    columns: list[Column] = []
    problems: list[Column] = []
    for field in fields:
        base, width, _ = _declared(field)
        source = F.col(field.name)
        target = spark_type(field.type, field.precision, field.scale)
        if base in _SIZED_TEXTS and width is not None:
            text = source.cast("string")
            columns.append(F.left(text, F.lit(width)).alias(field.name))
            problems.append(F.when(F.length(text) > width, F.lit(f"{field.name}: too long")))
        else:
            converted = source.try_cast(target)
            columns.append(converted.alias(field.name))
            problems.append(F.when(source.isNotNull() & converted.isNull(),
                                   F.lit(f"{field.name}: not {target.simpleString()}")))
    reasons = F.array_join(F.array_compact(F.array(*problems)), "; ")
    if on_error == "null":
        return df.select(*columns)
    if on_error == "drop":
        return df.where(reasons == "").select(*columns)
    if on_error == "reject":
        return df.select(*[f.name for f in fields], reasons.alias(reason)).where(F.col(reason) != "")
    raise ValueError(f"unknown on_error {on_error!r}")


def map_types(df: DataFrame, column: str, output: str = "spark_type") -> DataFrame:
    """Normalise a column of declared type names (case, blanks, size) and map it, as
    :func:`spark_type` does: the inline size of a decimal counts."""
    base = F.trim(F.regexp_replace(F.lower(F.col(column)), _PARAMETERS, ""))
    mapped = map_lookup(
        df.withColumn("base_type", base), "base_type", output, TYPE_NAMES, DEFAULT_TYPE)
    size = lambda group: F.regexp_extract(column, r"\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)\s*$", group)
    sized = F.concat(F.lit("decimal("), size(1), F.lit(","), F.when(size(2) == "", "0").otherwise(size(2)), F.lit(")"))
    is_sized = F.col("base_type").isin(*sorted(_SIZED_DECIMALS)) & (size(1) != "")
    return mapped.withColumn(output, F.when(is_sized, sized).otherwise(F.col(output)))
