from __future__ import annotations

from collections.abc import Callable, Mapping
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.project import router
from weftline.session import cut_counted, free_scratch, scratch_path

# Intake limits per trigger.
MAX_FILES = 10_000
MAX_BYTES = 1 << 30


def stream_files(
    spark: SparkSession, folder: str, schema: T.StructType | str, fmt: str = "parquet",
    max_files: int | None = MAX_FILES, max_bytes: int | None = None,
) -> DataFrame:
    """New files of a folder as they appear, with an intake limit per trigger.

    Spark takes one limit, files or bytes; ``max_bytes`` (such as :data:`MAX_BYTES`)
    replaces ``max_files``.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    elif max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder)


def run_available(df: DataFrame, path: str, checkpoint: str, period: str | None = None) -> StreamingQuery:
    """Write the stream to Parquet. Without ``period`` everything there now is processed
    and the call returns when it is; with one the query keeps running on that timer.

    A later call with the same checkpoint goes on where the last one stopped.
    """
    writer = df.writeStream.format("parquet").option("path", path) \
        .option("checkpointLocation", checkpoint)
    if period is not None:
        return writer.trigger(processingTime=period).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def fan_out_batches(
    df: DataFrame, routes: Mapping[str, Column | str], path: str, checkpoint: str
) -> None:
    """Route every micro-batch to one folder per route, in one scan and one write.

    A batch writes to a folder of its own number and replaces it, so a batch that is run
    again after a failure leaves no duplicates.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        router(batch, routes).write.mode("overwrite").partitionBy("route") \
            .parquet(f"{path}/batch={batch_id}")

    query = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()
    query.awaitTermination()


Step = Callable[[DataFrame], DataFrame]
BatchSink = Callable[[DataFrame, int], None]


def batch_files(path: str, fmt: str = "parquet", **options: str) -> BatchSink:
    """A sink that keeps each batch in a folder of its number, and replaces it when it is run again."""
    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").options(**options).format(fmt).save(f"{path}/batch={batch_id}")

    return write


def _marker(spark: SparkSession, path: str):
    """A path of the shared store, and its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def fan_out_stream(
    df: DataFrame, targets: Mapping[str, tuple[Step, BatchSink]], checkpoint: str, period: str | None = None,
) -> StreamingQuery:
    """Send every micro-batch to several targets, each with its own step, shape and sink.

    A batch is written to the shared folder once, so all targets see the same rows, and
    deleted when the batch ends. What each target finished is recorded next to the checkpoint: a
    batch that fails between two targets is run again for those without a record only. A target
    that failed half-way has none, so its sink has to replace what it wrote for the batch's number, as ``batch_files``
    does. Without ``period`` everything there now is processed and the call returns; with one the query keeps running on that timer.
    """
    records = f"{checkpoint.rstrip('/')}-targets"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = {name: _marker(spark, f"{records}/batch={batch_id}/{quote(name, safe='')}") for name in targets}
        left = [name for name, (place, store) in done.items() if not store.exists(place)]
        if left:
            path = scratch_path(spark, "batch")
            try:
                shared, _ = cut_counted(batch, path)
                for name in left:
                    step, sink = targets[name]
                    sink(shared.transform(step), batch_id)
                    place, store = done[name]
                    store.create(place, True).close()
            finally:
                free_scratch(spark, [path])
        # Spark has committed the batch before by now.
        place, store = _marker(spark, f"{records}/batch={batch_id - 1}")
        store.delete(place, True)

    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if period is not None:
        return writer.trigger(processingTime=period).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query
