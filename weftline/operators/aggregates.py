"""Aggregator and the roll-ups. All are partial + final aggregations, so a hot key
reaches the shuffle as one row per map task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Confidence when nothing was scored, the penalty, the review threshold.
UNSCORED_CONFIDENCE = 0.7
PENALTY = 0.2
REVIEW_BELOW = 0.75

# Transformation types that add to the complexity score, and the bands.
COMPLEXITY_WEIGHTS = {
    "Expression": 1, "Lookup Procedure": 2, "Aggregator": 2, "Joiner": 3, "Router": 1,
}
SIMPLE_UP_TO = 2
MEDIUM_UP_TO = 5


def aggregator(
    df: DataFrame, group_by: Sequence[str] = (), aggregates: Mapping[str, Column | str] = {},
) -> DataFrame:
    """Group ports first, then the aggregate ports; without group ports one row."""
    columns = [
        (F.expr(a) if isinstance(a, str) else a).alias(name) for name, a in aggregates.items()
    ]
    if not columns:
        return df.select(*group_by).distinct()
    return df.groupBy(*group_by).agg(*columns)


def count_by(df: DataFrame, column: str, output: str = "n") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias(output))


def confidence(df: DataFrame, key: str, score: str, penalty: str) -> DataFrame:
    """Mean score per key (a default when no score is known), lowered when any row carries
    the penalty flag, kept in [0, 1], and flagged for review when low."""
    mean = F.coalesce(F.avg(score), F.lit(UNSCORED_CONFIDENCE))
    lowered = mean - F.when(F.bool_or(F.coalesce(penalty, F.lit(False))), PENALTY).otherwise(0.0)
    return (
        df.groupBy(key)
        .agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), lowered)).alias("confidence"))
        .withColumn("review_required", F.col("confidence") < REVIEW_BELOW)
    )


def complexity(
    df: DataFrame, key: str, kind: str, weights: Mapping[str, int] = COMPLEXITY_WEIGHTS
) -> DataFrame:
    """Sum of the weights of the kinds present at least once per key, with its band."""
    score = F.lit(0)
    for name, weight in weights.items():
        score = score + F.max(F.when(F.col(kind) == name, weight).otherwise(0))
    band = F.when(F.col("score") <= SIMPLE_UP_TO, "SIMPLE") \
        .when(F.col("score") <= MEDIUM_UP_TO, "MEDIUM").otherwise("COMPLEX")
    return df.groupBy(key).agg(score.alias("score")).withColumn("complexity", band)


def count_usage(rules: DataFrame, hits: DataFrame, rule_id: str) -> DataFrame:
    """Add the number of hits per rule to ``usage_count``."""
    used = hits.groupBy(rule_id).agg(F.count("*").alias("_hits"))
    added = F.col("usage_count") + F.coalesce("_hits", F.lit(0))
    return rules.join(used, rule_id, "left").withColumn("usage_count", added).drop("_hits")


def batch_summary(df: DataFrame, review_flag: str) -> DataFrame:
    flagged = F.coalesce(F.col(review_flag), F.lit(False))
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(~flagged).alias("passed"),
        F.count_if(flagged).alias("needs_review"),
    )


def distinct_pairs(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """Field-level links reduced to one edge per pair of nodes."""
    return edges.select(source, target).distinct()
