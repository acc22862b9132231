"""XML records, held in files or in a text column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import cut_lineage

# Attributes and elements are told apart by this prefix, as in Spark's XML source.
_OPTIONS = {"attributePrefix": "_", "valueTag": "_VALUE"}


def read_xml(
    spark: SparkSession, folder: str, row_tag: str, schema: str, file_filter: str = "*.xml"
) -> tuple[DataFrame, DataFrame]:
    """All XML files below a folder, one row per ``row_tag`` element: the good records with
    the file each came from, and the text of the elements that do not fit the schema.

    The elements are read once and kept in the shared folder, from which both parts come.
    """
    corrupt = "_corrupt_record"
    rows = cut_lineage(
        spark.read.format("xml").schema(f"{schema}, {corrupt} string")
        .options(**_OPTIONS, rowTag=row_tag, recursiveFileLookup=True, pathGlobFilter=file_filter,
                 mode="PERMISSIVE", columnNameOfCorruptRecord=corrupt, ignoreCorruptFiles=True,
                 # The parser that goes on with the next element after a malformed one.
                 useLegacyXMLParser=True)
        .load(folder).select(F.col("_metadata.file_path").alias("file_path"), "*")
    )
    good = rows.where(F.col(corrupt).isNull()).drop(corrupt)
    return good, rows.where(F.col(corrupt).isNotNull()).select("file_path", corrupt)


def xml_flatten(df: DataFrame, column: str, schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per record: its attributes and elements as columns, repeated children as
    arrays. Text that is no such record gives nulls."""
    parsed = df.select(*keep, F.from_xml(F.col(column), schema, _OPTIONS).alias("_record"))
    return parsed.select(*keep, "_record.*")


def xml_children(records: DataFrame, child: str, keep: tuple[str, ...]) -> DataFrame:
    """One row per repeated child with its position from 1; a record without children
    keeps one row of nulls."""
    exploded = records.select(*keep, F.posexplode_outer(child).alias("_pos", "_child"))
    return exploded.select(*keep, (F.col("_pos") + 1).alias("position"), "_child.*")


def attributes_map(df: DataFrame, key: str, name: str, value: str, position: str) -> DataFrame:
    """Name/value rows folded into one map per key; of a repeated name the last counts.

    Repeats are reduced first, map-side, so a map holds as many entries as there are
    different names, whatever the number of rows per key.
    """
    last = df.where(F.col(name).isNotNull()).groupBy(key, name) \
        .agg(F.max_by(value, position).alias(value))
    entries = F.collect_list(F.struct(name, value))
    return last.groupBy(key).agg(F.map_from_entries(F.array_sort(entries)).alias("attributes"))
