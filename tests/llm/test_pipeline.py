"""The pipeline's stages on their own and together, on odd input and against brute force."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from corpus_pipeline import STAGES, run
from weftline.session import scratch_made

FOLDER = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n", "en", "a", 3), (None, "some words that stand in no other place at all", "en", "b", 9),
       (4, "x" * 100_000, "de", None, 100_000), (5, "word " * 30_000, None, "c", 150_000), (6, "the same text in two rows of one id, long enough", "en", "a", 48),
       (6, "the same text in two rows of one id, long enough", "en", "a", 48), (7, "ü", "fr", "z", 1)]


@pytest.mark.parametrize("name,stage", STAGES)
def test_stages_take_odd_rows_and_none(spark, name, stage):
    docs = spark.createDataFrame(ODD, COLUMNS)
    out = stage(spark, docs, FOLDER)
    assert out.columns[:5] == docs.columns and (name == "sharding" or out.columns == docs.columns)
    rows = out.select(docs.columns).collect()
    assert all(tuple(r) in ODD for r in rows)
    # Nothing here is like a document of the benchmark, and texts without words are like none.
    if name in ("decontaminate", "sharding"):
        assert len(rows) == len(ODD)
    if name == "near_duplicates":
        assert sorted(str(r.doc_id) for r in rows) == sorted(["1", "2", "3", "None", "4", "5", "6", "7"])
    empty = stage(spark, docs.limit(0), FOLDER)
    assert empty.count() == 0


def test_mixing_keeps_four_fifths_of_the_tokens(spark):
    rng = random.Random(2)
    rows = [(i, "w" * rng.randrange(4, 400), rng.choice(["en", "de", None]), f"s{rng.randrange(4)}", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, COLUMNS)
    kept = [tuple(r) for r in dict(STAGES)["mixing"](spark, docs, FOLDER).collect()]
    assert len(kept) == len(set(kept)) and set(kept) <= set(rows)
    size = lambda some: sum((len(r[1]) + 3) // 4 for r in some)
    # A leaf's last document stays whole: at most one document over for each of the leaves.
    assert 0.8 * size(rows) - 1 <= size(kept) <= 0.8 * size(rows) + 100 * 12


def test_each_stage_is_a_filter_of_the_one_before_and_scratch_stays_bounded(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before, ids, left = {*scratch_made(spark)}, None, []
    for name, stage in STAGES:
        out = corpus_pipeline.cut_lineage(stage(spark, docs, FOLDER))
        now = [r.doc_id for r in out.select("doc_id").collect()]
        assert ids is None or set(now) <= set(ids) and len(now) <= len(ids)
        docs, ids = out, now
        left.append(len({*scratch_made(spark)} - before))
    whole = [r.doc_id for r in run(spark, FOLDER).select("doc_id").collect()]
    assert sorted(whole) == sorted(ids) and len(ids) > 50
    # Only the stages' tables and the last stage's own steps are there.
    assert left[-1] <= len(STAGES) + 4
