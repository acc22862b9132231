"""Python workers must not need the package on their own path."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent

SCRIPT = f"""
import importlib.util
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
spec = importlib.util.spec_from_file_location("entry", {str(ROOT / "__spark_entry__.py")!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
for name in ("custom_rows", "custom_column", "nearest_neighbour"):
    print(name, entry.queries()[name](spark, {FOLDER!r}).count() > 0)
from weftline.operators.vectors import nearest
t = spark.read.parquet({FOLDER!r} + "/embeddings.parquet")
found = nearest(t.limit(20).withColumnRenamed("vec_id", "q"), t, ("q", "embedding"),
                ("vec_id", "embedding"), sent_numbers=0)
print("cells", found.count() == 20)
"""


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
def test_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.split() == [
        "custom_rows", "True", "custom_column", "True", "nearest_neighbour", "True", "cells", "True"
    ], done.stderr[-2000:]
