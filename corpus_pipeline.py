"""From raw documents to training shards: five stages, each a Parquet table that the next one reads."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.decontaminate import without_leaks
from weftline.llm.hilbert import hilbert_shards
from weftline.llm.minhash import one_of_each
from weftline.llm.mixing import mix
from weftline.llm.quality import quality
from weftline.llm.queries import mix_levels, mix_weights, rough_tokens, table, trusted
from weftline.session import cut_lineage, free_scratch, scratch_made

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: What earlier stages left in the shared folder, by session.
_left: dict[str, list[str]] = {}


def _stage(stage: Stage) -> Stage:
    """The stage, after what earlier stages left in the shared folder is deleted.

    Their results are written tables by then, of which the last one is ``docs``; a stage that is
    handed a frame not written yet keeps what that frame reads.
    """
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _left.setdefault(spark.sparkContext.applicationId, [])
        free_scratch(spark, left, keep=[docs])
        before = {*scratch_made(spark)} - {*left}
        out = stage(spark, docs, sf_dir)
        left[:] = [p for p in scratch_made(spark) if p not in before]
        return out

    return run_stage


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's limit."""
    return quality(docs, trusted(spark, sf_dir)).where("kept").select(*docs.columns)


@_stage
def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that share four fifths of their runs of five words."""
    return one_of_each(docs, percent=80)


@_stage
def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


@_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens, by the weights of domains, languages and sources, no document twice.

    A leaf's last document stays whole, so a leaf may pass its budget by part of a document.
    """
    return mix(docs, mix_levels(), mix_weights(), rough_tokens(), F.col("doc_id"), fraction=0.8, max_epochs=1, seed=17).select(*docs.columns)


@_stage
def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot along the curve of language, source and size."""
    sized = docs.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)) + 1)
    placed = hilbert_shards(sized, ["lang", "source"], ["size"], 8, order=["doc_id"])
    return placed.select(*docs.columns, "shard", "slot")


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontaminate", decontaminate_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

# The first three stages cannot be put in SQL; tests/llm/test_pipeline.py holds each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``documents`` that all stages keep, with their shard and slot.

    Each stage's table is deleted once the next one's is written.
    """
    docs, before = table(spark, sf_dir, "documents"), {*scratch_made(spark)}
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
            free_scratch(spark, [p for p in scratch_made(spark) if p not in before], keep=[docs])
    return docs
