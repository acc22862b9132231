"""Scratch in the shared folder and its end."""

from __future__ import annotations

import time
from pathlib import Path

import pytest

from weftline.session import SHUFFLE_CLEANUP, cut_lineage, free_scratch, freed_scratch, scratch_made, scratch_path


def folder(path: str) -> Path:
    return Path(path.removeprefix("file:"))


def test_scratch_is_freed_but_for_what_is_read(spark):
    before = scratch_made(spark)
    kept, gone = cut_lineage(spark.range(5)), scratch_path(spark, "gone")
    spark.range(3).write.parquet(gone)
    later = kept.where("id > 1")
    new = [p for p in scratch_made(spark) if p not in before]
    free_scratch(spark, new, (later,))
    assert later.count() == 3 and not folder(gone).exists()
    assert len(scratch_made(spark)) == len(before) + 1
    free_scratch(spark, new)
    assert scratch_made(spark) == before


def test_scratch_of_a_block_is_freed_after_an_error(spark):
    outside = cut_lineage(spark.range(2))
    with pytest.raises(ValueError), freed_scratch(spark):
        path = scratch_path(spark, "inside")
        spark.range(1).write.parquet(path)
        assert folder(path).exists()
        raise ValueError
    assert not folder(path).exists() and outside.count() == 2


def test_a_step_leaves_no_shuffle_files_and_the_setting_as_it_was(spark):
    files = lambda: {f for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
                     for f in Path(d).rglob("shuffle_*")}
    before, setting = files(), spark.conf.get(SHUFFLE_CLEANUP)
    step = cut_lineage(spark.range(1000).repartition(4, "id"))
    assert spark.conf.get(SHUFFLE_CLEANUP) == setting
    # Executors delete them a moment later.
    for _ in range(100):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and step.count() == 1000
