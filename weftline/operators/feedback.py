"""Turning reviewed corrections into audit rows and approved rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.aggregates import REVIEW_BELOW
from weftline.operators.joins import lookup

# Confidence of a promoted rule and of a new semantic entry.
PROMOTED_CONFIDENCE = 0.9
NEW_ENTRY_CONFIDENCE = 0.7


def _learned(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reviewed rows that changed, or whose old confidence was low."""
    revised = new.select(*keys, F.col("translated").alias("_corrected"))
    pairs = lookup(old, revised, {k: k for k in keys}, ["_corrected"], unique=True)
    # An unknown confidence counts as certain, as a missing one does in the review file.
    certain = F.coalesce("confidence", F.lit(1.0))
    changed = F.trim("_corrected") != F.trim("translated")
    return pairs.where(F.col("_corrected").isNotNull() & (F.length("original") > 0)).where(
        F.coalesce(changed, F.lit(True)) | (certain < REVIEW_BELOW)
    )


def promote_feedback(
    old: DataFrame, new: DataFrame, keys: Sequence[str], reason: Column
) -> tuple[DataFrame, DataFrame]:
    """Audit rows and approved rules from the translations before and after review.

    Both frames have the keys, ``original``, ``translated`` and ``confidence``; ``new``
    holds at most one row per key.
    """
    learned = _learned(old, new, keys)
    audit = learned.select(
        *keys, F.col("original").alias("original_logic"),
        F.col("translated").alias("output"), F.col("_corrected").alias("corrected_output"),
        reason.alias("reason"),
    )
    rules = learned.select(
        *keys, F.col("original").alias("pattern"), F.col("_corrected").alias("replacement"),
        F.lit(PROMOTED_CONFIDENCE).alias("confidence"), F.lit(True).alias("approved"),
        F.lit(0).alias("usage_count"),
    )
    return audit, rules


def semantic_append(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Existing entries plus new ones, which start with a fixed confidence."""
    return entries.unionByName(new.withColumn("confidence", F.lit(NEW_ENTRY_CONFIDENCE)))
