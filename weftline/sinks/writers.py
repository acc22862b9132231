from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.joins import first_per_key, lookup
from weftline.operators.ordering import Order, number_rows
from weftline.operators.project import router
from weftline.session import cut_counted, cut_lineage

# Record writer formats.
DATE_FORMAT = "yyyy-MM-dd"
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
_TEXT_FORMATS = {
    "dateFormat": DATE_FORMAT, "timestampFormat": TIMESTAMP_FORMAT,
    "timestampNTZFormat": TIMESTAMP_FORMAT,
}


# Delimited text: fields are quoted where they must be, a quote inside is doubled, blanks at the
# ends stay, and an empty text ("") differs from a null (nothing).
CSV_FORMAT = {
    "header": "true", "quote": '"', "escape": '"',
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def write_files(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """File target that replaces what is there."""
    df.write.mode("overwrite").format(fmt).save(path)


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Table target, INSERT."""
    df.write.mode("append").format(fmt).save(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON records with fixed date formats; null fields are written."""
    df.write.mode("overwrite").options(**_TEXT_FORMATS, ignoreNullFields="false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**_TEXT_FORMATS, **CSV_FORMAT).csv(path)


def convert(
    spark: SparkSession, source: str, fmt: str, path: str, target_fmt: str, schema=None,
    multiline: bool = False,
) -> None:
    """Read one format, write another. ``multiline`` says that the fields of a CSV source
    may hold line breaks; each of its files is then read by one task."""
    reader = spark.read.format(fmt).options(**_TEXT_FORMATS)
    if fmt == "csv":
        reader = reader.options(**CSV_FORMAT, multiLine=multiline)
    if schema is not None:
        reader = reader.schema(schema)
    writer = reader.load(source).write.mode("overwrite").options(**_TEXT_FORMATS)
    (writer.options(**CSV_FORMAT) if target_fmt == "csv" else writer).format(target_fmt).save(path)


def update_by_key(
    target: DataFrame, updates: DataFrame, keys: Sequence[str], columns: Sequence[str],
    latest: Sequence[Column],
) -> DataFrame:
    """UPDATE: matched target rows take the new values (null included), the others stay,
    updates without a target row are dropped. Of several updates for a key the first by
    ``latest`` counts."""
    one = first_per_key(updates, keys, latest).select(
        *keys, F.struct(*columns).alias("_new"))
    found = lookup(target, one, {k: k for k in keys}, ["_new"], unique=True)
    changed = {
        c: F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)) for c in columns
    }
    return found.withColumns(changed).drop("_new")


def update_partitions(
    spark: SparkSession, path: str, partition: str, updates: DataFrame, keys: Sequence[str],
    columns: Sequence[str], latest: Sequence[Column],
) -> None:
    """``update_by_key`` on Parquet files in place, partitioned by ``partition``.

    Updates carry the partition they mean, so only its rows are read and written again. The new
    rows are staged in the shared folder first; the partitions are then replaced at the
    commit of one write, which can be run again.
    """
    target = spark.read.parquet(path)
    touched = target.join(updates.select(partition).distinct(), partition, "left_semi")
    staged = cut_lineage(update_by_key(touched, updates, [partition, *keys], columns, latest))
    staged.select(target.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(partition).parquet(path)


def update_files(
    spark: SparkSession, path: str, updates: DataFrame, keys: Sequence[str], columns: Sequence[str], latest: Sequence[Column],
) -> int:
    """``update_by_key`` on Parquet files in place, whatever their layout; the number of files written anew.

    Only files that hold a key of the updates are read whole and replaced; the others stay
    as they are. The new files are staged next to the target first. A plan of the swap is
    then written, which commits it: a run that fails later is finished by the next one, or by
    ``finish_update``. Folders named ``name=value`` stay. Someone who reads while files are
    swapped may see some of them twice; only one run may update a target at a time. On a table of a catalog that has it, use :func:`merge_by_key`.
    """
    finish_update(spark, path)
    target = spark.read.parquet(path)
    one = cut_lineage(first_per_key(updates, keys, latest).select(*keys, *[c for c in columns if c not in keys]))
    # Keys only are read, with the file each row is in.
    places = target.select(*keys, F.col("_metadata.file_path").alias("_file"))
    # File paths come with their special characters escaped.
    touched = [unquote(r[0]) for r in places.join(one.select(*keys).distinct(), list(keys), "left_semi").select("_file").distinct().collect()]
    if not touched:
        return 0
    root = _folder(spark, path)
    partitions = [p.split("=", 1)[0] for p in touched[0].split(root.toUri().getPath(), 1)[1].split("/")[:-1] if "=" in p]
    changed = update_by_key(spark.read.schema(target.schema).option("basePath", path).parquet(*touched), one, keys, columns, [F.lit(1)])
    name = f"_update-{uuid.uuid4().hex}"
    writer = changed.select(target.columns).write.option("compression", "snappy")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(f"{path}/{name}")
    plan = spark.createDataFrame([(f,) for f in touched], "old string").withColumn("staged", F.lit(name))
    plan.coalesce(1).write.json(f"{path}/_plan-{name}")
    finish_update(spark, path)
    return len(touched)


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place)


def finish_update(spark: SparkSession, path: str) -> None:
    """Carry out the swaps that were planned at ``path``, and delete what was staged without a plan.

    Each step can be run again: a staged file is moved if it is still there, an old one deleted if it is.
    """
    root = _folder(spark, path)
    store, at = root.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path
    names = [f.getPath().getName() for f in store.listStatus(root)] if store.exists(root) else []
    for plan in (n for n in names if n.startswith("_plan-") and store.exists(at(f"{root}/{n}/_SUCCESS"))):
        staged = at(f"{root}/{plan.removeprefix('_plan-')}")
        if store.exists(staged):
            files = store.listFiles(staged, True)
            while files.hasNext():
                file = files.next().getPath()
                if file.getName().startswith("part-"):
                    below = file.toString().split(f"{staged.getName()}/", 1)[1]
                    new = at(f"{root}/{below}")
                    store.mkdirs(new.getParent())
                    store.rename(file, new)
            store.delete(staged, True)
        for row in spark.read.schema("old string, staged string").json(f"{root}/{plan}").collect():
            store.delete(at(row.old), False)
        store.delete(at(f"{root}/{plan}"), True)
    for name in names:
        if name.startswith("_update-") or name.startswith("_plan-"):
            store.delete(at(f"{root}/{name}"), True)


def merge_by_key(
    spark: SparkSession, table: str, updates: DataFrame, keys: Sequence[str], columns: Sequence[str], latest: Sequence[Column],
) -> None:
    """``update_by_key`` as a MERGE INTO on a catalog table whose format has it (untested: none is here)."""
    first_per_key(updates, keys, latest).select(*keys, *[c for c in columns if c not in keys]).createOrReplaceTempView("_merge_updates")
    on = " AND ".join(f"t.`{k}` = u.`{k}`" for k in keys)
    put = ", ".join(f"t.`{c}` = u.`{c}`" for c in columns)
    spark.sql(f"MERGE INTO {table} t USING _merge_updates u ON {on} WHEN MATCHED THEN UPDATE SET {put}")


def compact(df: DataFrame, path: str, rows_per_file: int, fmt: str = "parquet") -> None:
    """Rewrite many small batches as fewer, evenly sized files. AQE sizes the partitions
    (and splits large ones) from the real shuffle sizes."""
    df.hint("rebalance").write.mode("overwrite") \
        .option("maxRecordsPerFile", rows_per_file).format(fmt).save(path)


def fan_out(
    df: DataFrame,
    targets: Mapping[str, tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], None]]],
    reuse: bool = True,
) -> None:
    """Send one frame to several targets, each with its own step and sink.

    ``reuse`` writes the shared part to the shared folder once, so that all targets see the
    same rows whatever is lost; turn it off when the part is a plain scan that each target's
    filter can prune.
    """
    shared = cut_lineage(df) if reuse else df
    for step, sink in targets.values():
        sink(shared.transform(step))


def write_routes(df: DataFrame, routes: Mapping[str, Column | str], path: str) -> None:
    """Fan-out of same-shaped rows in one job: one folder per route, one scan."""
    router(df, routes).write.mode("overwrite").partitionBy("route").parquet(path)


def nest_packet(
    head: DataFrame, detail: DataFrame, key: str, order_by: Sequence[str], output: str = "details",
    most: int = 10_000,
) -> DataFrame:
    """Header rows with their details as a sorted array of structs, plus ``part``.

    A key's sorted details are cut after every ``most`` of them: part 0 holds the first
    ``most``, part 1 the next, so the parts in order are the sorted list and no task holds an
    unbounded group. Keys without details have one packet with an empty array.
    """
    fields = [c for c in dict.fromkeys([*order_by, *detail.columns]) if c != key]
    detail = detail.where(F.col(key).isNotNull())
    counts = detail.groupBy(key).agg(F.count("*").alias("_n"))
    large, hot_keys = cut_counted(counts.where(F.col("_n") > most).select(key, F.lit(True).alias("_hot")))
    rows = _cut_large(detail, large, key, fields, most) if hot_keys \
        else detail.withColumn("part", F.lit(0))
    packed = rows.groupBy(key, "part").agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias(output))
    return head.join(packed, key, "left").withColumns({
        "part": F.coalesce("part", F.lit(0)),
        output: F.coalesce(output, F.array().cast(packed.schema[output].dataType)),
    })


def _cut_large(
    detail: DataFrame, large: DataFrame, key: str, fields: Sequence[str], most: int
) -> DataFrame:
    """``part`` of each detail: those of the large keys are numbered in their order, without
    a window over a whole key; all others are in part 0."""
    marked = lookup(detail, large, {key: key}, ["_hot"], unique=True)
    usual = marked.where(F.col("_hot").isNull()).drop("_hot").withColumn("part", F.lit(0))
    hot = cut_lineage(marked.where("_hot").select(key, *fields))
    placed = number_rows(hot, [Order(f) for f in fields], "_place", partition=[key])
    part = F.floor((F.col("_place") - 1) / most).cast("int")
    return usual.unionByName(placed.withColumn("part", part).select(*usual.columns))
