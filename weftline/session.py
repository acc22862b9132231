"""Where jobs put data that must outlive an executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: While set, a union of frames of one partition each has one partition.
UNION_PARTITIONING = "spark.sql.unionOutputPartitioning"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Paths handed out and not deleted yet, by shared folder.
_made: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session, which has no other machines to share with, falls
    back to a temporary folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used before."""
    folder = shared_folder(spark)
    path = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.setdefault(folder, []).append(path)
    return path


def scratch_made(spark: SparkSession) -> list[str]:
    """The paths handed out in this session and not deleted yet."""
    return list(_made.get(shared_folder(spark), []))


def free_scratch(spark: SparkSession, paths: Iterable[str], keep: Sequence[DataFrame] = ()) -> None:
    """Delete these scratch paths, but for those that the frames ``keep`` read.

    Only for scratch whose readers have run: a frame that was built on it can't be read any more.
    """
    made = _made.get(shared_folder(spark), [])
    read = [file for df in keep for file in df.inputFiles()]
    for path in paths:
        if path in made and not any(f"{path.rsplit('/', 1)[-1]}/" in file for file in read):
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
            made.remove(path)


@contextmanager
def freed_scratch(spark: SparkSession) -> Iterator[None]:
    """Scratch made inside is deleted at the end, whatever happens; results must be written or counted by then."""
    before = set(scratch_made(spark))
    try:
        yield
    finally:
        free_scratch(spark, [p for p in scratch_made(spark) if p not in before])


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What runs inside deletes the shuffle files of each query at that query's end, whatever the session says."""
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """What runs inside hands Python so many rows at a time at most: for whole texts, of which a batch of the usual 10,000 is held several times over."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


@contextmanager
def side_by_side(spark: SparkSession) -> Iterator[None]:
    """Unions that run inside keep their frames' partitions beside one another, as tasks of their own."""
    before = spark.conf.get(UNION_PARTITIONING, "true")
    spark.conf.set(UNION_PARTITIONING, "false")
    try:
        yield
    finally:
        spark.conf.set(UNION_PARTITIONING, before)


def cut_counted(df: DataFrame, path: str | None = None, by: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """Write the rows to the shared folder (or a ``path`` in it) and go on from there,
    with their number.

    Nothing before this is computed again when an executor is lost, so its shuffle files
    go once the rows are written, and the planner knows the size from here on. Readers that want
    some values of the columns ``by`` read the files of these values only.
    """
    path = path or scratch_path(df.sparkSession, "step")
    seen = Observation()
    with freed_shuffles(df.sparkSession):
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    # Columns that rows are stored by come last.
    return out.select(*df.columns) if by else out, seen.get["rows"]


def cut_lineage(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return cut_counted(df, by=by)[0]
